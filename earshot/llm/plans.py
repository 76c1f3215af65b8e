"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from earshot.llm import block_topk, chat, collocations, importance, language, mixing, multi_index, near_dups, packing, secrets, site_lines, token_files, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.labelled_domains(_table(spark, sf_dir, "labels"))
    return mixing.mixture_report(_table(spark, sf_dir, "documents"), labelled, mixing.CLEANER)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(_table(spark, sf_dir, "pages"), warc.fresh_archive(spark))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_report(spark, _table(spark, sf_dir, "documents"))


def op6_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.line_report(_table(spark, sf_dir, "documents"))


def op7_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(_table(spark, sf_dir, "documents"), near_dups.NearDuplicates(words=3, percent=85))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.language_report(docs, language.fit_languages(docs.filter(~language.held_out())))


def op10_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_topk.top_products(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return chat.chat_report(rows.unionByName(chat.sample_chat(spark, rows), allowMissingColumns=True))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_draw(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


TOP_PRODUCTS_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings),
s as (select q.vec_id as query_id, d.vec_id, cast(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v d on q.vec_id <> d.vec_id where q.vec_id % 100 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10"""


QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_secret_scan": (op1_secret_scan, secrets.report_sql()),
    "op2_mixing": (op2_mixing, None),
    "op3_warc": (op3_warc, warc.report_sql()),
    "op4_neighbours": (op4_neighbours, None),
    "op5_token_files": (op5_token_files, None),
    "op6_site_lines": (op6_site_lines, site_lines.report_sql()),
    "op7_near_dups": (op7_near_dups, None),
    "op8_packing": (op8_packing, None),
    "op9_language": (op9_language, None),
    "op10_top_products": (op10_top_products, TOP_PRODUCTS_SQL),
    "op11_chat_format": (op11_chat_format, chat.report_sql()),
    "op12_importance": (op12_importance, importance.report_sql()),
    "op13_collocations": (op13_collocations, collocations.report_sql()),
}


def queries() -> dict[str, Query]:
    return {name: build for name, (build, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
