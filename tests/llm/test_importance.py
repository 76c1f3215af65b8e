import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, differences
from hypothesis import given, settings, strategies as st

from earshot.llm import importance
from earshot.llm.importance import CrcShift, Importance, WordRuns, drawn_documents, importance_draw, report_sql
from earshot.llm.plans import op12_importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def runs(text, longest=3):
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def brute(docs, target, how):
    bucket = lambda x: crc32(x.encode()) % how.buckets
    s = Counter(bucket(x) for _, text in docs for x in runs(text)[0])
    t = Counter(bucket(x) for text in target for x in runs(text)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + how.buckets) / ((s[b] + 1) * (all_t + how.buckets)))) for b in range(how.buckets)]
    rows = []
    for doc_id, text in docs:
        found, words = runs(text)
        h = int(hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in found)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in rows if r[5] >= how.min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for nth, row in enumerate(able[: how.percent * len(able) // 100]):
        row[4] = nth + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def texts():
    rng = random.Random(8)
    letters = ["a", "B", "é", "È", "İ", "𝔘", "7", "-", " ", "  ", "\n", "\x00", "{", "@", "`", "/", ":", "word", "Some"]
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(120))) for _ in range(300)]
    return [*out, None, "", " ", "x", "long" * 60_000 + " Word", "a b " * 100_000, *out[:5]]


def test_shift():
    shift = CrcShift()
    for n in (0, 1, 3, 255, 256, 257, 70_000, 1 << 24):
        a, b = b"some bytes", bytes(range(256)) * (n // 256 + 1)
        b = b[:n]
        moved = shift(np.array([crc32(a)] * 2, np.uint32), np.array([n, 0]))
        assert moved[0] ^ crc32(b) == crc32(a + b) and moved[1] == crc32(a)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aZ9é𝔘 -\n\x00İ")), st.text()), max_size=6), st.integers(1, 5))
def test_crcs_of_all_runs(column, at_once):
    kinds = [t if t is None else t.encode("utf8", "ignore").decode() for t in column]
    got = {i: Counter() for i in range(len(kinds))}
    for row, crc in WordRuns(3, at_once).crcs(pa.array(kinds, pa.string())):
        for r, c in zip(row.tolist(), crc.tolist(), strict=True):
            got[r][c] += 1
    assert got == {i: Counter(crc32(x.encode()) for x in runs(t)[0]) for i, t in enumerate(kinds)}


@pytest.mark.parametrize("how", [Importance(), Importance(buckets=7, min_words=1, percent=37, seed=1)])
def test_equals_brute_force(spark, how):
    docs = [(i // 2 if i % 11 else None, t) for i, t in enumerate(texts())]
    target = ["Some word a b", None, "", "word word é 7"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("weight", importance.F.lit("x")).repartition(4)
    got = importance_draw(df, spark.createDataFrame([(t,) for t in target], "text string"), how)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, target, how)


def test_drawn_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} " * 30, "x") for i in range(100)], "doc_id long, text string, rank string")
    target = spark.createDataFrame([("word3 word3",)], "text string")
    drawn = drawn_documents(docs, target, Importance(percent=10))
    assert drawn.columns == docs.columns and drawn.count() == 10
    none = importance_draw(docs.limit(0), target)
    assert none.collect() == []
    assert importance_draw(docs, target.limit(0)).filter("rank is not null").count() == 5


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert differences(op12_importance(spark, sf), connect(sf), report_sql()) == []
