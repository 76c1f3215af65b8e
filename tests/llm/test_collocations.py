import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, differences
from hypothesis import given, settings, strategies as st

from earshot.llm.collocations import Collocations, Fingerprints, collocations, phrase_counts, report_sql
from earshot.llm.plans import op13_collocations

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def counts(rows, longest):
    said = {}
    for lang, text in rows:
        c = said.setdefault("und" if lang is None else lang, Counter())
        for words in pieces(text):
            c[()] += len(words)
            c.update(tuple(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1))
    return said


def brute(rows, how):
    out = []
    for lang, c in counts(rows, how.longest).items():
        found = {p: a for p, a in c.items() if len(p) >= 2 and a >= how.least}
        lines = []
        for p, a in found.items():
            holds = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if not any(len(q) > len(p) and 100 * b >= how.share * a and holds(q) for q, b in found.items()):
                score, _, left, right = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                lines.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, phrase, left, right) in enumerate(sorted(lines)[: how.first]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, c[()], -score))
    return sorted(out)


def texts():
    rng = random.Random(6)
    words = ["the", "The", "of", "sea", "É", "é", "new", "york", "city", "a\x00b", "𝔘x", "ﬀ", "-"]
    out = []
    for _ in range(400):
        line = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", " \r"]) for _ in range(rng.randrange(40)))
        out.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), line))
    out += [("en", "new york city " * 20_000), ("xx", None), ("xx", ""), ("yy", "w" * 200_000 + " end. " + "w" * 200_000 + " end"), ("zz", "one of a kind")]
    return out


@pytest.mark.parametrize("how", [Collocations(), Collocations(longest=4, least=3, share=80, first=9, filter_bits=6, at_once=7, gathered=50)])
def test_equals_brute_force(spark, how):
    rows = texts()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "lang string, text string, phrase string").repartition(5)
    got = collocations(docs, how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, how)


@settings(deadline=None, max_examples=50)
@given(st.lists(st.text(st.sampled_from("aB .\té\n"), max_size=30), max_size=5), st.integers(1, 4))
def test_runs_of_a_block(column, at_once):
    block = pa.RecordBatch.from_arrays([pa.array(["x"] * len(column), pa.string()), pa.array(column, pa.string())], names=["lang", "text"])
    got, named = Counter(), {}
    for _, runs in Fingerprints(Collocations(at_once=at_once)).runs(block):
        for n in (1, 2, 3):
            first = runs.whole(n)
            for i, h in zip(first.tolist(), runs.prints(first, n).tolist(), strict=True):
                phrase = runs.text.tobytes()[runs.starts[i] : runs.ends[i + n - 1]].decode()
                got[tuple(phrase.split(" "))] += 1
                assert named.setdefault(phrase, h) == h
    wanted = counts([("x", t) for t in column], 3).get("x", Counter())
    del wanted[()]
    assert got == wanted and len(set(named.values())) == len(named)


def test_colliding_fingerprints_are_told_apart(spark):
    """Thue-Morse words defeat a polynomial modulo 2**64 for any base."""
    bits = np.array([bin(i).count("1") % 2 for i in range(2048)])
    one = "".join("ab"[b] for b in bits)
    other = "".join("ba"[b] for b in bits)
    block = pa.RecordBatch.from_arrays([pa.array(["x"]), pa.array([f"{one} {other}"])], names=["lang", "text"])
    [(_, runs)] = Fingerprints(Collocations()).runs(block)
    same = runs.prints(np.array([0, 1]), 1)
    assert same[0] == same[1]
    rows = [("x", f"{one} sea"), ("x", f"{other} sea")] * 6 + [("x", f"{one} sea")] * 5
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = {(r.phrase.split(" ")[0], r.words): r.n for r in phrase_counts(docs).filter("words = 2").collect()}
    assert got == {(one, 2): 11} and sorted(tuple(r) for r in collocations(docs).collect()) == brute(rows, Collocations())


def test_counts_past_64_bits_and_empty_tables(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations(docs).collect() == [] and phrase_counts(docs).collect() == []
    big = 3 * 10**12
    row = spark.sql(f"select (cast(1000000 as decimal(7,0)) * (cast({big} as decimal(16,0)) * cast({big} as decimal(16,0)))) div (cast({big + 1} as decimal(16,0)) * cast({big} as decimal(16,0))) as s").first()
    assert row.s == 1_000_000 * big * big // ((big + 1) * big)


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert differences(op13_collocations(spark, sf), connect(sf), report_sql()) == []
