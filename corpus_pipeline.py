"""A corpus prepared for training: language, repeated lines, near duplicates, mixture, packed sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from earshot.llm import language, mixing, near_dups, packing, site_lines
from earshot.session import work_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised by a model of the labelled ones among them; null and letterless texts go."""
    return language.keep_identified(docs, language.fit_languages(docs))


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand on many sites, and n_chars as they are then; no document goes.

    However large their share, the lines are cut; a document without any other line stays whole, for the next stage to find its copies.
    """
    cleaned = site_lines.without_boilerplate(docs, most_share=None)
    return cleaned.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def dedupe_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity from 0.8."""
    return near_dups.keep_one(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of the labelled domains ask for."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.mixed_corpus(docs, mixing.labelled_domains(labels), mixing.CLEANER)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with the sequence and the offset at which each lies."""
    return packing.packed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("lines", dedupe_lines),
    ("near_duplicates", dedupe_documents),
    ("mixture", mix_domains),
    ("packing", pack_windows),
]

#: Several stages fit models or iterate; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = work_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
