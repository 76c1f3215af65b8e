import corpus_pipeline
import __spark_entry__ as entry
from compare import connect, differences
import pytest

from earshot.llm import near_dups, plans

SF = "/root/testdata/sf0.001"


def test_registered():
    assert {n.split("_")[0] for n in plans.queries()} == {f"op{i}" for i in range(1, 14)}
    assert set(plans.queries()) | {"pipeline"} <= set(entry.queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "mixture", "packing"]


@pytest.mark.parametrize("name", list(plans.oracle_sql()))
def test_query_equals_sql(spark, name):
    df = plans.queries()[name](spark, SF)
    assert differences(df, connect(SF), plans.oracle_sql()[name]) == []


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        if name != "mixture":
            assert out.join(docs, "doc_id", "left_anti").isEmpty()
        docs = out.checkpoint()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_lines_are_cut_however_large_their_share(spark):
    license = "this long license stands on the pages of many sites " * 4
    rows = [(i, f"{license}\n\nown sentence {i}", "en", f"s{i}", 1) for i in range(12)] + [(20, f"{license}\n", "en", "s1", 1)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    got = {r.doc_id: r.text for r in corpus_pipeline.dedupe_lines(spark, docs, SF).collect()}
    assert got == {i: f"\nown sentence {i}" for i in range(12)} | {20: f"{license}\n"}


def test_no_near_duplicates_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.dedupe_documents(spark, docs, SF)
    found = near_dups.near_duplicates(kept)
    assert found.filter("not kept").isEmpty() and kept.count() < docs.count()


def test_odd_documents(spark):
    rows = [(1, None, None, None, None), (None, "some the and of words", "en", "s", 3), (2, "", "en", "s", 0), (3, "the and of " * 50, None, "s", 1), (3, "the and of " * 50, None, "s", 1)]
    docs = spark.createDataFrame(rows + [(10 + i, f"the and of words number {i} " * 5, "en", f"s{i}", 1) for i in range(12)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).checkpoint()
        if name in ("language", "lines", "near_duplicates"):
            ids = [r.doc_id for r in docs.collect()]
            assert 1 not in ids and 2 not in ids and ids.count(None) == 1
            assert ids.count(3) == (1 if name == "near_duplicates" else 2)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").isEmpty()
