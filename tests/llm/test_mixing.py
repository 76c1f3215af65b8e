import numpy as np
import pytest

from earshot.llm import mixing
from earshot.llm.mixing import Mixture, fitted_rates


def documents():
    topics = {"a": "apple pear plum fruit", "b": "bolt nut screw metal", "c": "cat dog bird pet"}
    rows, labels = [], []
    for i in range(240):
        domain = "aaab bbcc"[i % 9] if i % 9 != 4 else "c"
        words = topics[domain].split() + ["the", "of", "and"]
        rows.append((i, " ".join(words[(i + k * k) % len(words)] for k in range(10 + i % 30)), "x"))
        if i % 2:
            labels.append((i, domain))
    return rows, labels


def test_targets_are_met(spark):
    rows, labels = documents()
    rows += [(500, None, "x"), (501, "", "x"), (502, "unheard words only", "x"), (None, rows[0][1], "x"), rows[3], rows[3], (503, "apple " * 20_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate string")
    labelled = spark.createDataFrame(labels + [(3, None), (None, "a"), (99999, "b"), (5, "unknown")], "doc_id long, domain string")
    how = Mixture({"a": 0.2, "b": 0.5, "c": 0.3}, rounds=200)
    got = mixing.mixture_report(docs, labelled, how).collect()
    assert len(got) == len(rows)
    tokens = np.array([r.tokens for r in got], float)
    p = np.array([[r.p_a, r.p_b, r.p_c] for r in got])
    rate = np.array([r.rate for r in got])
    assert np.allclose(p.sum(axis=1), 1) and (rate >= 0).all()
    share = (rate * tokens) @ p / tokens.sum()
    assert np.abs(share - [0.2, 0.5, 0.3]).max() < 1e-3
    by_id = {r.doc_id: r for r in got}
    assert by_id[500].tokens == by_id[501].tokens == 0 and by_id[502].tokens == 3
    assert all(int(r.rate) <= r.times <= int(r.rate) + 1 for r in got)
    mixed = mixing.mixed_corpus(docs, labelled, how)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.times for r in got)


def brute_rates(tokens, p, targets, rounds, tolerance):
    """The same descent in numpy."""
    r = np.ones(len(tokens))
    n = tokens @ p
    total = n.sum()
    for _ in range(rounds):
        gap = (r * tokens) @ p - np.array(targets) * total
        if np.abs(gap).max() <= tolerance * total:
            break
        r = np.maximum(0, r - p @ (gap / n))
    return r


@pytest.mark.parametrize("targets", [(0.7, 0.2, 0.1), (0.0, 0.0, 1.0), (1 / 3, 1 / 3, 1 / 3)])
def test_rates_equal_brute_force_and_are_the_least_squares(spark, targets):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3, 0.3, 0.3], 120)
    tokens = rng.integers(0, 500, 120).astype(float)
    table = spark.createDataFrame([(int(i), 0, int(t), 1, *map(float, x)) for i, (t, x) in enumerate(zip(tokens, p))], "k1 long, k2 long, tokens long, copies long, p_0 double, p_1 double, p_2 double")
    how = Mixture(dict(zip("abc", targets)), rounds=40, pending=7)
    got = np.array([r.rate for r in fitted_rates(table, how).orderBy("k1").collect()])
    assert np.allclose(got, brute_rates(tokens, p, targets, 40, how.tolerance), atol=1e-9)
    # No feasible direction lowers the squared error by much.
    share = (got * tokens) @ p / tokens.sum()
    assert np.abs(share - targets).max() < (0.02 if min(targets) > 0 else 0.1)


def test_documents_of_a_kept_domain_stay_and_the_gap_is_told(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.4, 0.4, 0.4], 150)
    rows = [(i, 0, int(t), 1, *map(float, x)) for i, (t, x) in enumerate(zip(rng.integers(1, 500, 150), p))]
    table = spark.createDataFrame(rows, "k1 long, k2 long, tokens long, copies long, p_0 double, p_1 double, p_2 double")
    how = Mixture({"a": 0.6, "b": 0.25, "c": 0.15}, keep=("a",), rounds=200)
    got = fitted_rates(table, how).orderBy("k1").collect()
    tokens, rate = np.array([r.tokens for r in got], float), np.array([r.rate for r in got])
    kept = p.argmax(axis=1) == 0
    assert (rate[kept] >= 1).all() and (rate[~kept] < 1).any()
    gap = np.abs((rate * tokens) @ p / tokens.sum() - [0.6, 0.25, 0.15]).max()
    assert {r.gap for r in got} == {got[0].gap} and abs(got[0].gap - gap) < 1e-9 and gap <= how.tolerance
    assert fitted_rates(table, Mixture({"a": 0.0, "b": 0.0, "c": 1.0}, keep=("a", "b", "c"), rounds=20)).first().gap > 0.1


def test_clean_documents_stay_in_the_mixture(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    labelled = mixing.labelled_domains(labels)
    report = mixing.mixture_report(docs, labelled, mixing.CLEANER).join(labelled.filter("domain = 'clean'"), "doc_id", "left_semi")
    assert report.count() > 200 and report.filter("times = 0").isEmpty()


def test_words_end_at_any_white_space(spark):
    got = mixing.mixture_report(spark.createDataFrame([(1, "a b\nc\td\r\n e")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, domain string"), Mixture({"a": 1.0}))
    assert got.first().tokens == 5


def test_nothing_labelled_and_empty_tables(spark):
    no_docs = spark.createDataFrame([], "doc_id long, text string")
    no_labels = spark.createDataFrame([], "doc_id long, domain string")
    how = Mixture({"a": 1.0, "b": 1.0})
    assert mixing.mixture_report(no_docs, no_labels, how).collect() == []
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    got = mixing.mixture_report(docs, no_labels, how).collect()
    assert [(r.p_a, r.p_b) for r in got] == [(0.5, 0.5)] * 2 and all(abs(r.rate - 1) < 1e-6 for r in got)


def test_flags(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 1), (4, None, 0), (5, 1, None)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.domain for r in mixing.labelled_domains(labels).collect()} == {1: "clean", 2: "low", 3: "toxic", 5: "clean"}


def test_no_python_in_the_plans(spark, tmp_path):
    rows, labels = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labelled = spark.createDataFrame(labels, "doc_id long, domain string")
    plan = mixing.mixture_report(docs, labelled, Mixture({"a": 1.0, "b": 1.0, "c": 1.0}))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Cartesian" not in plan
