"""Cross-site line deduplication by the spread of a line over distinct sites.

Lines are known by hashes.  HyperLogLog sketches of the sites of each line are built map-side and merged by aggregation.
Lines whose estimate is clearly above the limit are boilerplate; those near it get an exact distinct count.  Boilerplate
is then cut from every document but those that a caller's limit leaves whole: documents that consist mostly of it (as the
registered query's SQL has it) or of nothing else (the pipeline), which document-level deduplication then sees as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from earshot.llm.arrow import unused
from earshot.session import written

#: Copies of a boilerplate line's row in the join that finds it, so that a line in a third of all documents is spread.
SALTS = 16


def _line_hash(line: Column) -> list[Column]:
    """128 bits from two differently seeded hashes of the trimmed line."""
    trimmed = F.trim(line)
    return [F.xxhash64(trimmed).alias("h1"), F.xxhash64(F.lit(1), trimmed).alias("h2")]


def _lines(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """A narrow row for each line that is not blank: the document's key, the position, the hashes."""
    text = F.col(text_col)
    exploded = docs.select(*_document_key(id_col, text_col), *more, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    kept = exploded.filter(F.trim("line") != "")
    return kept.select("k1", "k2", *[F.col("site")] * bool(more), "pos", *_line_hash(F.col("line")))


def _document_key(id_col: str, text_col: str) -> list[Column]:
    """Equal for repeated rows only; a null id is an id of its own."""
    return [F.xxhash64(F.col(id_col)).alias("k1"), F.xxhash64(F.lit(1), F.col(text_col)).alias("k2")]


def boilerplate_lines(
    docs: DataFrame, site_col: str, min_sites: int, id_col: str = "doc_id", text_col: str = "text", lg_k: int = 12, band: float = 0.1
) -> DataFrame:
    """Hashes (h1, h2) of the lines that stand on at least ``min_sites`` distinct sites; a null site counts as none.

    ``band`` is the share of the limit (at least one site) within which an estimate is replaced by an exact count; with
    ``lg_k`` = 12 that is six standard errors.
    """
    width = max(1.0, band * min_sites)
    lines = _lines(docs, id_col, text_col, F.col(site_col).cast("string").alias("site")).filter(F.col("site").isNotNull())
    estimate = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k)))
    wide = lines.groupBy("h1", "h2").agg(estimate.alias("sites")).filter(F.col("sites") >= min_sites - width)
    wide = written(wide, "line-spread")
    sure = wide.filter(F.col("sites") > min_sites + width).select("h1", "h2")
    near = wide.filter(F.col("sites") <= min_sites + width).select("h1", "h2")
    salt = F.pmod(F.xxhash64("k1", "k2", "pos"), F.lit(SALTS)).cast("int")
    spread = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # A line's rows shrink to one for each site before they meet.
    sites = lines.withColumn("salt", salt).join(spread.hint("merge"), ["h1", "h2", "salt"], "left_semi").select("h1", "h2", "site").distinct()
    exact = sites.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites")).filter(F.col("sites") >= min_sites)
    return sure.unionByName(exact.select("h1", "h2"))


def cut_lines(docs: DataFrame, boilerplate: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_share: float | None = None) -> DataFrame:
    """``docs`` with boilerplate lines cut from the text, plus a struct ``cut``: lines, removed.

    A document that would be left without any line that is not blank stays whole, as does one of whose characters boilerplate makes up
    more than ``most_share``, where that is given.  Null and empty texts stay as they are; every input row gives one row.
    """
    salted = boilerplate.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("k1", "k2", "pos"), F.lit(SALTS)).cast("int")
    hits = _lines(docs, id_col, text_col).withColumn("salt", salt).join(salted.hint("merge"), ["h1", "h2", "salt"], "left_semi")
    places = hits.groupBy("k1", "k2").agg(F.collect_set("pos").alias("places"))

    own = F.struct(*[F.col(c) for c in docs.columns]).alias("own")
    joined = docs.select(own, *_document_key(id_col, text_col)).join(places, ["k1", "k2"], "left")
    text = F.col("own")[text_col]
    lines = F.split(text, "\n")
    marked = joined.select("own", lines.alias("lines"), F.coalesce("places", F.array().cast("array<int>")).alias("places"))
    gone = F.aggregate("places", F.lit(0), lambda n, i: n + F.length(F.element_at("lines", i + 1)))
    own_lines = F.size(F.filter("lines", lambda line: F.trim(line) != "")) > F.size("places")
    cuttable = own_lines if most_share is None else own_lines & (gone <= most_share * F.length(text))
    marked = marked.withColumn("places", F.when(cuttable, F.col("places")).otherwise(F.array().cast("array<int>")))
    all_places = F.sequence(F.lit(0), F.size("lines") - 1)
    stay = F.transform(F.array_except(all_places, F.col("places")), lambda i: F.element_at("lines", i + 1))
    new_text = F.when(F.size("places") > 0, F.array_join(stay, "\n")).otherwise(text)
    columns = [new_text.alias(c) if c == text_col else F.col("own")[c].alias(c) for c in docs.columns]
    counts = F.struct(F.coalesce(F.when(text.isNotNull(), F.size("lines")), F.lit(0)).cast("bigint").alias("lines"), F.size("places").cast("bigint").alias("removed"))
    return marked.select(*columns, counts.alias(unused(docs, "cut")))


def without_boilerplate(docs: DataFrame, site_col: str = "source", min_sites: int = 8, id_col: str = "doc_id", text_col: str = "text", most_share: float | None = None) -> DataFrame:
    """``cut_lines`` with the boilerplate that ``docs`` itself shows."""
    return cut_lines(docs, boilerplate_lines(docs, site_col, min_sites, id_col, text_col), id_col, text_col, most_share)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the cleaned text's n_chars and md5, for each row (n_chars and md5 null for a null text)."""
    cleaned = without_boilerplate(docs.select("doc_id", "source", "text"))
    return cleaned.select(
        "doc_id", F.col("cut.lines").alias("n_lines"), F.col("cut.removed").alias("n_removed"),
        F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"),
    )


def report_sql(min_sites: int = 8) -> str:
    return f"""
with d as (select row_number() over () as row, doc_id, source, text, string_split(text, chr(10)) as ls from documents),
l as (select row, source, unnest(ls) as line, generate_subscripts(ls, 1) as pos from d where text is not null),
wide as (select trim(line) as t from l where trim(line) <> '' group by 1 having count(distinct source) >= {min_sites}),
m as (select l.row, pos, line, wide.t is not null as hit from l left join wide on trim(line) = wide.t),
g as (select row, bool_or(trim(line) <> '' and not hit) as own from m group by row),
kept as (select row, count(*) filter (hit and own) as removed, string_agg(line, chr(10) order by pos) filter (not (hit and own)) as new
  from m join g using (row) group by row)
select doc_id, coalesce(len(ls), 0) as n_lines, coalesce(removed, 0) as n_removed,
  case when text is not null then length(coalesce(new, '')) end as n_chars, case when text is not null then md5(coalesce(new, '')) end as text_md5
from d left join kept using (row)"""
