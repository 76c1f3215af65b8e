import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from earshot.llm import secrets
from earshot.llm.secrets import BASE_RULES, RULES, BlockIndex, grams_of, scan_secrets, secret_report, trigram_query

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def brute(text):
    text = text or ""
    spans = []
    for m in ASSIGN.finditer(text):
        if len(m.group(2)) >= 6:
            spans.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for order, kind, pattern, least in ((1, "access", r"AKIA[A-Z0-9]+", 20), (2, "hex", r"[0-9a-f]+", 24)):
        for m in re.finditer(pattern, text):
            if len(m.group()) >= least:
                spans.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(spans)]


TEXTS = [
    None, "", "no secrets here", "password=hunter22", "Token: abc", "secret=token:abcdef", "PASSWD = 'Xy/z+1234'",
    "é" * 50 + "api_key=\"ABCDEF123\" AKIA" + "A1" * 10, "deadbeef" * 3, "deadbeef" * 2, "x" * 200_000 + " apikey:zzzzzz",
    "password=token=abcdefgh secret: a secret:bcdefg", "AKIAAKIA" + "Z" * 12, "password\u017f=abcdef to\u212aen=123456", "-----BEGIN RSA PRIVATE KEY-----",
]


def test_report_equals_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x"), (None, TEXTS[3], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")  # an extra column named like a result
    got = secret_report(docs).collect()
    assert len(got) == len(rows)
    by_id = {}
    for row in got:
        by_id.setdefault(row.doc_id, []).append(row)
    for i, text in enumerate(TEXTS):
        expected = brute(text)
        for row in by_id[i]:
            base = [s for s in row.spans.split(",") if s.split(":")[0] in {r.kind for r in BASE_RULES}]
            assert base == expected, text
            assert row.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest()
            assert row.n_assign == sum(s.startswith("assign") for s in expected)
            assert row.n_access == sum(s.startswith("access") for s in expected)
            assert row.n_hex == sum(s.startswith("hex") for s in expected)
    assert len(by_id[3]) == 2 and len(by_id[None]) == 1
    assert by_id[14][0].spans.startswith("private_key:0:")


def test_empty_table(spark):
    assert scan_secrets(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rules_without_trigrams_scan_fully():
    assert trigram_query(RULES[2].pattern) is None
    assert grams_of(trigram_query(r"AKIA[A-Z0-9]+")) == {int.from_bytes(b"aki"), int.from_bytes(b"kia")}
    assert trigram_query("abc|x+") is None
    assert trigram_query("(?:abc)?d*") is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcABCK. é", max_size=12), max_size=8), st.sampled_from(["abc", "a(b|cc)a?b", "(?i)abK", "ab+c", "(abc|bca)[abc]{2}", "a.{2}bca", "éab", "^abc$"]))
def test_candidates_hold_every_match(texts, pattern):
    import pyarrow as pa

    query = trigram_query(pattern)
    found = set(BlockIndex(sorted(grams_of(query))).load(pa.array(texts, pa.string())).search(query).tolist())
    assert {i for i, t in enumerate(texts) if re.search(pattern, t)} <= found


@pytest.mark.parametrize("word", ["token", "api_?key"])
def test_either_case_is_ascii_only(word):
    assert re.fullmatch(secrets.either_case(word), word.replace("?", "").upper())
    assert not re.fullmatch(secrets.either_case("token"), "to\u212aen")
