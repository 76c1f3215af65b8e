"""WARC archives as a Python data source, and pages archived with revisits.

Archives are gzip members, one a record, whose header carries the member's length (the skip-length field).  A read plans
partitions of whole files, parses a record's WARC header first, tests it against the predicates that Spark pushed
down (record type and other header fields), and seeks past records that fail.  Payloads are inflated only where asked for.
Archives without skip lengths, and uncompressed ones, are read as well.

Archives are reached through ``pyarrow.fs``, so any folder it knows by URI will do.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, Not,
    StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from earshot.llm.joins import salted_join
from earshot.session import work_folder

WRITE_SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload binary, payload_length long, payload_digest string"
READ_SCHEMA = WRITE_SCHEMA + ", date string"
#: Columns that stand in a record's header, and the field of each.
FIELDS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "date": "WARC-Date",
}
MANIFEST = "_manifest"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 128 << 20
_HEAD = 8 << 10


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -- Writing ----------------------------------------------------------------------------------------------------


def _field(value: str) -> str:
    """A header value on one line: control characters and the per cent sign of none else are escaped."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record_bytes(row: dict, date: str) -> bytes:
    """One record as it stands uncompressed; a revisit has the HTTP head but no payload."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    length = row["payload_length"] if revisit else len(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block += b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{_field(row['record_id'])}>", f"WARC-Date: {date}"]
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {_field(row['target_uri'])}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{_field(row['refers_to'])}>"]
    digest = row["payload_digest"] if revisit else payload_digest(payload)
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    """A gzip member whose extra field ``sl`` holds its compressed and uncompressed length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    length = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, length, len(data))
    return struct.pack("<BBBBIBBH", 31, 139, 8, 4, 0, 0, 255, len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """A task writes files of its own; the commit lists those of the attempts that count, and only they are read."""

    def __init__(self, options: dict):
        self.path, self.date = options["path"], options.get("date", "1970-01-01T00:00:00Z")
        self.level = int(options.get("level", "1"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = fs.FileSystem.from_uri(self.path)
        names, out, size = [], None, 0
        part = TaskContext.get().partitionId()
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    names.append(f"part-{part:06d}-{uuid.uuid4().hex}.warc.gz")
                    out, size = files.open_output_stream(posixpath.join(root, names[-1]), compression=None), 0
                member = gzip_member(record_bytes(row, self.date), self.level)
                out.write(member)
                size += len(member)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(root, recursive=True)
        known = _manifest(files, root) or []
        names = sorted(set(known).union(*(m.files for m in messages if m is not None)))
        with files.open_output_stream(posixpath.join(root, MANIFEST)) as out:
            out.write("\n".join(names).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        for message in messages:
            for name in message.files if message is not None else ():
                files.delete_file(posixpath.join(root, name))


# -- Reading ----------------------------------------------------------------------------------------------------


def _manifest(files: fs.FileSystem, root: str) -> list[str] | None:
    at = posixpath.join(root, MANIFEST)
    if files.get_file_info(at).type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(at) as f:
        return f.read().decode().split("\n") if files.get_file_info(at).size else []


class _Window:
    """Bytes of a file by position, read ahead in chunks; what is skipped is not read."""

    def __init__(self, handle, chunk: int = 1 << 20):
        self._handle, self._chunk, self.size = handle, chunk, handle.size()
        self._start, self._data = 0, b""

    def bytes(self, at: int, length: int) -> bytes:
        length = min(length, self.size - at)
        if at < self._start or at + length > self._start + len(self._data):
            self._handle.seek(at)
            self._start, self._data = at, self._handle.read(max(length, self._chunk))
        return self._data[at - self._start : at - self._start + length]


class _Member:
    """A record that is inflated as far as it is asked for."""

    def __init__(self, window: _Window, at: int):
        self._window, self._at = window, at
        start = window.bytes(at, 24)
        self._gzip = start[:2] == b"\x1f\x8b"
        self._inflate = zlib.decompressobj(31) if self._gzip else None
        self.length = struct.unpack("<I", start[16:20])[0] if self._gzip and start[3] & 4 and start[12:14] == b"sl" else None
        self.data = bytearray()
        self._read = 0

    @property
    def ended(self) -> bool:
        return self._inflate.eof if self._gzip else self._at + self._read >= self._window.size

    def more(self, step: int = _HEAD) -> None:
        raw = self._window.bytes(self._at + self._read, min(step, self.length - self._read) if self.length else step)
        if self._gzip:
            if not raw and not self._inflate.eof:
                raise ValueError(f"the record at {self._at} is cut off")
            self.data += self._inflate.decompress(raw)
            self._read += len(raw) - len(self._inflate.unused_data)
        else:
            self.data += raw
            self._read += len(raw)

    def until(self, mark: bytes, start: int = 0) -> int:
        """The position after ``mark``, or -1 if the member ends before."""
        while (found := self.data.find(mark, start)) < 0 and not self.ended:
            self.more()
        return found + len(mark) if found >= 0 else -1

    def upto(self, size: int) -> None:
        while len(self.data) < size and not self.ended:
            self.more(1 << 18)

    def next_at(self, record_size: int) -> int:
        if self.length is not None:
            return self._at + self.length
        if not self._gzip:
            return self._at + record_size
        while not self.ended:  # only inflating tells where this member ends
            self.data.clear()
            self.more(1 << 18)
        return self._at + self._read


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    pairs = (line.split(":", 1) for line in lines[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _header_row(fields: dict[str, str]) -> dict[str, str | None]:
    row = {column: fields.get(name.lower()) for column, name in FIELDS.items()}
    for column in ("record_id", "refers_to"):
        if row[column] is not None:
            row[column] = row[column].removeprefix("<").removesuffix(">")
    if row["payload_digest"] is not None:
        row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
    return row


def _passes(row: dict, tests: list[tuple]) -> bool:
    return all(_test(row.get(column), kind, value) for column, kind, value in tests)


def _test(own: str | None, kind: str, value) -> bool:
    if own is None:
        return False
    if kind == "in":
        return own in value
    if kind == "not in":
        return own not in value
    return {"starts": own.startswith, "ends": own.endswith, "contains": own.__contains__}[kind](value) if kind != "known" else True


def read_records(handle, tests: list[tuple], payload: str) -> Iterator[dict]:
    """Records of an open archive that pass ``tests`` on their headers.

    ``payload``: "none" leaves payloads alone, "digest" inflates them for length and digest, "full" returns them.  Where a payload is
    inflated, its digest is computed and must agree with the header.
    """
    window, at = _Window(handle), 0
    while at < window.size:
        member = _Member(window, at)
        end = member.until(b"\r\n\r\n")
        if end < 0:
            raise ValueError(f"no record header at {at}")
        fields = _fields(bytes(member.data[: end - 4]))
        size = int(fields.get("content-length", 0))
        row = _header_row(fields)
        if _passes(row, tests):
            start, length = end, size
            if fields.get("content-type", "").startswith("application/http"):
                start = member.until(b"\r\n\r\n", end)
                if start < 0 or start > end + size:
                    raise ValueError(f"no HTTP header in the record at {at}")
                http = _fields(bytes(member.data[end : start - 4]))
                # A revisit has no payload; its HTTP head tells the length of the one it stands for.
                length = int(http.get("content-length", size - (start - end))) if row["record_type"] == "revisit" else size - (start - end)
            row |= {"payload": None, "payload_length": length}
            if payload != "none" and row["record_type"] != "revisit":
                member.upto(end + size)
                body = bytes(member.data[start : end + size])
                digest = payload_digest(body)
                if row["payload_digest"] not in (None, digest) or len(body) != length:
                    raise ValueError(f"the payload of {row['record_id']} is damaged")
                row |= {"payload_digest": digest, "payload": body if payload == "full" else None}
            yield row
        at = member.next_at(end + size + 4)


@dataclass
class _Files(InputPartition):
    names: list[str]

    def __init__(self, names: list[str]):
        super().__init__(0)
        self.names = names


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "full")
        self.partition_bytes = int(options.get("partitionbytes", options.get("partitionBytes", 64 << 20)))
        if self.payload not in ("none", "digest", "full"):
            raise ValueError("payload must be none, digest or full")
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = {EqualTo: "in", In: "in", IsNotNull: "known", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "contains"}
        for given in filters:
            inner, no = (given.child, True) if isinstance(given, Not) else (given, False)
            kind = kinds.get(type(inner))
            if kind is None or len(inner.attribute) != 1 or inner.attribute[0] not in FIELDS or no and kind != "in":
                yield given
                continue
            value = (inner.value,) if isinstance(inner, EqualTo) else getattr(inner, "value", None)
            if kind == "in" and any(v is None for v in value):
                yield given
                continue
            self.tests.append((inner.attribute[0], "not in" if no else kind, value))

    def partitions(self) -> list[InputPartition]:
        files, root = fs.FileSystem.from_uri(self.path)
        names = _manifest(files, root)
        if names is None:
            found = files.get_file_info(fs.FileSelector(root, recursive=True))
            infos = [(f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith((".warc", ".warc.gz"))]
        else:
            infos = [(f.path, f.size) for f in files.get_file_info([posixpath.join(root, n) for n in names if n])]
        plan: list[list[str]] = []
        room = 0
        for path, size in sorted(infos):
            if not plan or size > room:
                plan.append([])
                room = self.partition_bytes
            plan[-1].append(path)
            room -= size
        return [_Files(names) for names in plan]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.path)
        text = pa.string()
        schema = pa.schema(
            [("record_type", text), ("record_id", text), ("target_uri", text), ("refers_to", text), ("payload", pa.binary()),
             ("payload_length", pa.int64()), ("payload_digest", text), ("date", text)]
        )
        rows, size = [], 0
        for name in partition.names if isinstance(partition, _Files) else ():
            with files.open_input_file(name) as handle:
                for row in read_records(handle, self.tests, self.payload):
                    rows.append(row)
                    size += 200 + len(row["payload"] or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``; options: path, payload, partitionBytes, date, level."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options))


def read_warc(spark: SparkSession, path: str, payload: str = "full") -> DataFrame:
    """Records of the archives below ``path``; filters on header columns are tested before anything else is inflated."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", payload).load(path)


def write_warc(records: DataFrame, path: str) -> None:
    """Append ``records`` (the columns of WRITE_SCHEMA) to the archives below ``path``."""
    records.sparkSession.dataSource.register(WarcSource)
    names = [part.split()[0] for part in WRITE_SCHEMA.split(", ")]
    files, root = fs.FileSystem.from_uri(path)
    files.create_dir(root, recursive=True)
    records.select(*names).write.format("warc").mode("append").save(path)


# -- Pages ------------------------------------------------------------------------------------------------------

_PAGE = "urn:x-page:"


def page_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """A record for each row of ``pages`` (page_id, url, html): of equal payloads of at least ``least_bytes``, that with the
    largest page_id is the response and the others revisit it.

    A null html is an empty payload.  Rows with a null page_id, and all rows that repeat the largest one, are responses.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    # Only payloads that occur under several ids need a lookup; the largest id is found map-side.
    known = rows.filter(F.col("page_id").isNotNull() & (F.octet_length("payload") >= least_bytes)).groupBy("sha")
    shared = known.agg(F.max("page_id").alias("kept"), F.min("page_id").alias("least")).filter("kept != least").select("sha", "kept")
    rows = salted_join(rows, shared, ["sha"], "left", ["page_id"])
    big = F.octet_length("payload") >= least_bytes
    revisit = F.coalesce(big & F.col("kept").isNotNull() & (F.col("page_id") != F.col("kept")), F.lit(False))
    name = F.concat(F.lit(_PAGE), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    digest = F.when(revisit, F.hex("sha"))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), name.alias("record_id"), F.col("url").alias("target_uri"),
        F.when(revisit, F.concat(F.lit(_PAGE), F.col("kept").cast("string"))).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"), F.octet_length("payload").cast("bigint").alias("payload_length"),
        _base32(digest).alias("payload_digest"),
    )


def _base32(hexed):
    """Upper-case base32 of a hexadecimal SHA-1: four times 40 bits, eight letters each."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for at in range(0, 40, 10):
        number = F.conv(F.substring(hexed, at + 1, 10), 16, 10).cast("bigint")
        for shift in range(35, -1, -5):
            parts.append(F.substring(F.lit(letters), F.shiftright(number, shift).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)))
    return F.concat(*parts)


def archive_report(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives below ``path``, read these back with every payload checked, and return a row per page."""
    write_warc(page_records(pages, least_bytes), path)
    records = read_warc(pages.sparkSession, path, "digest").filter(F.col("record_type").isin("response", "revisit"))
    kind = pages.schema["page_id"].dataType

    def page(column: str):
        text = F.substring(F.col(column), len(_PAGE) + 1, 1 << 30)
        return F.when(text != "", text).cast(kind)

    return records.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def fresh_archive(spark: SparkSession) -> str:
    """A folder for archives below the shared work folder."""
    folder = work_folder(spark, "warc")
    return folder if "://" in folder or folder.startswith("/") else f"/{folder}"


def report_sql() -> str:
    bits = "list_transform(string_split(hex, ''), lambda c: bin(strpos('0123456789abcdef', c) + 15)[2:])"
    return f"""
with p as (select page_id, coalesce(html, '') as t, lower(sha1(coalesce(html, ''))) as hex from pages),
b as (select *, array_to_string({bits}, '') as bits from p),
m as (select *, max(page_id) over (partition by t) as kept from b)
select page_id, strlen(t) as payload_bytes,
  array_to_string(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast(1 + 16 * cast(bits[i + 1] as int) + 8 * cast(bits[i + 2] as int) + 4 * cast(bits[i + 3] as int) + 2 * cast(bits[i + 4] as int) + cast(bits[i + 5] as int) as bigint), 1)), '') as payload_digest,
  case when page_id = kept then 'response' else 'revisit' end as record_type, case when page_id <> kept then kept end as refers_to
from m"""
