import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from earshot.llm import warc


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_report(spark):
    same = "<p>sâme</p>"
    rows = [(1, "http://a/1", same, "x"), (7, "http://a/7", same, "x"), (3, None, same, "x"), (4, "u\r\nX: 1", None, "x"), (5, "http://a/5", "", "x"),
            (6, "http://a/6", "z" * 3_000_000, "x"), (8, "http://b/é", "once", "x"), (8, "http://b/é", "once", "x"), (None, "n", same, "x"), (9, "p", "WARC/1.1\r\n\r\n", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    path = warc.fresh_archive(spark)
    got = warc.archive_report(pages, path).collect()
    expected = []
    for page_id, _, html, _ in rows:
        known = [r[0] for r in rows if r[0] is not None and (r[2] or "") == (html or "")]
        revisit = page_id is not None and page_id != max(known)
        expected.append((page_id, len((html or "").encode()), sha(html), "revisit" if revisit else "response", max(known) if revisit else None))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    full = {(r.record_id, r.record_type): r for r in warc.read_warc(spark, path).collect()}
    assert full["urn:x-page:6", "response"].payload == b"z" * 3_000_000
    assert full["urn:x-page:4", "revisit"].target_uri == "u%0D%0AX: 1"
    assert full["urn:x-page:3", "revisit"].target_uri is None and full["urn:x-page:3", "revisit"].payload is None


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_report(pages, warc.fresh_archive(spark)).collect() == []


def test_filters_are_tested_in_the_source(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}/{i}", f"page {i // 2}") for i in range(40)], "page_id long, url string, html string")
    path = warc.fresh_archive(spark)
    warc.write_warc(warc.page_records(pages), path)
    records = warc.read_warc(spark, path, "none")
    revisits = records.filter((F.col("record_type") == "revisit") & F.col("target_uri").startswith("http://h1/"))
    plan = revisits._jdf.queryExecution().executedPlan().toString()
    assert " Filter (" not in plan
    assert {r.record_id for r in revisits.collect()} == {f"urn:x-page:{i}" for i in range(0, 40, 2) if i % 3 == 1}
    assert records.filter("record_type != 'revisit'").count() == 20
    assert records.filter("record_type in ('revisit', 'x')").count() == 20
    assert records.filter("payload_length > 6 and record_type = 'response'").count() == 10


def record(kind, ident, body, date="2024-01-01T00:00:00Z"):
    row = {"record_type": kind, "record_id": ident, "target_uri": "http://x/", "refers_to": "urn:x:0", "payload": body, "payload_length": 4, "payload_digest": sha("x")}
    return warc.record_bytes(row, date)


class Handle(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.got = 0

    def size(self):
        return len(self.getvalue())

    def read(self, n=-1):
        data = super().read(n)
        self.got += len(data)
        return data


@pytest.mark.parametrize("pack", [lambda r: warc.gzip_member(r, 1), gzip.compress, bytes])
def test_all_kinds_of_archive(pack):
    bodies = [b"", b"a" * 100_000, bytes(range(256)) * 3000, b"\r\n\r\n" * 50]
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    data = pack(info) + b"".join(pack(record("response", f"urn:x:{i}", b)) for i, b in enumerate(bodies)) + pack(record("revisit", "urn:x:9", None))
    rows = list(warc.read_records(Handle(data), [], "full"))
    assert [r["record_type"] for r in rows] == ["warcinfo"] + ["response"] * 4 + ["revisit"]
    assert [r["payload"] for r in rows[1:5]] == bodies and rows[0]["payload"] == b"hello" and rows[5]["payload_length"] == 4
    only = list(warc.read_records(Handle(data), [("record_id", "in", ("urn:x:3",))], "full"))
    assert [r["payload"] for r in only] == [bodies[3]]


def test_unwanted_payloads_are_not_read():
    import os

    data = b"".join(warc.gzip_member(record("response", f"urn:x:{i}", os.urandom(4 << 20)), 1) for i in range(5))
    handle = Handle(data)
    assert len(list(warc.read_records(handle, [("record_type", "in", ("revisit",))], "full"))) == 0
    assert handle.got < len(data) / 3


def test_damage_is_seen():
    good = record("response", "urn:x:1", b"payload")
    with pytest.raises(ValueError, match="damaged"):
        list(warc.read_records(Handle(good.replace(b"payload\r\n", b"paYload\r\n")), [], "digest"))


def test_failed_attempts_are_not_read(spark):
    path = warc.fresh_archive(spark)
    pages = spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string")
    warc.write_warc(warc.page_records(pages), path)
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(path)
    with files.open_output_stream(f"{root}/part-000000-left.warc.gz", compression=None) as out:
        out.write(warc.gzip_member(record("response", "urn:x:left", b"left"), 1))
    assert warc.read_warc(spark, path).count() == 1
    warc.write_warc(warc.page_records(pages), path)
    assert warc.read_warc(spark, path).count() == 2
