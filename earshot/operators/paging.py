"""Pages of an ordered result, and places in it, at any depth.

A derived result is dealt to ranges of its order by one range shuffle, sorted within them and written once, each range in a folder of its own;
its rows per range, read from the files' footers, say which range holds a page, and only that one is read.  A page by a unique number
needs no copy: rows are counted by ranges of the number, and the page is read between two numbers that reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F, types as T

from earshot.session import remove_folder, work_folder


@dataclass(frozen=True)
class By:
    """A column to order by; nulls come first upwards and last downwards."""

    column: Column
    down: bool = False

    def sorted(self) -> Column:
        return self.column.desc() if self.down else self.column.asc()


def up(column: Column | str) -> By:
    return By(F.col(column) if isinstance(column, str) else column)


def down(column: Column | str) -> By:
    return By(F.col(column) if isinstance(column, str) else column, True)


@dataclass(frozen=True)
class Ordered:
    """A result written in ranges of its order: ``rows`` has ``_range`` (a folder each) and ``_place`` (from 0 within the range)."""

    rows: DataFrame
    sizes: dict[int, int]  # rows by range, ranges ascending in the order
    folder: str

    @property
    def total(self) -> int:
        return sum(self.sizes.values())

    def starts(self) -> dict[int, int]:
        return dict(zip(self.sizes, accumulate(self.sizes.values(), initial=0), strict=False))

    def numbered(self, out: str) -> DataFrame:
        """All rows with their number in the order, from 1; the starts of the ranges are a row a range."""
        spark = self.rows.sparkSession
        starts = spark.createDataFrame(list(self.starts().items()), "_range int, _start long")
        return self.rows.join(F.broadcast(starts), "_range").withColumn(out, F.col("_start") + F.col("_place") + 1).drop("_range", "_place", "_start")

    def between(self, offset: int, limit: int) -> DataFrame:
        """Rows ``offset`` to ``offset + limit``, in order, read from the ranges that hold them."""
        first = {r: at for r, at in self.starts().items() if at < offset + limit and at + self.sizes[r] > offset}
        touched = self.rows.filter(F.col("_range").isin(*first)) if first else self.rows.filter(F.lit(False))
        nth = F.coalesce(*[F.when(F.col("_range") == r, F.lit(at) + F.col("_place")) for r, at in first.items()], F.lit(0))
        return touched.filter((nth >= offset) & (nth < offset + limit)).orderBy("_range", "_place").drop("_range", "_place")

    def page(self, page: int, limit: int) -> DataFrame:
        """Rows ``(page-1)*limit .. page*limit``, taken to the driver, and the files removed."""
        spark, shown = self.rows.sparkSession, self.between((page - 1) * limit, limit)
        rows = shown.collect()
        remove_folder(spark, self.folder)
        return spark.createDataFrame(rows, shown.schema).coalesce(1)


def in_order(df: DataFrame, order: list[By], ranges: int | None = None) -> Ordered:
    """``df`` in ``order``, which must leave no ties, written once in ``ranges`` parts (else as many as the session shuffles to)."""
    spark = df.sparkSession
    keys = [by.sorted() for by in order]
    dealt = df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)
    # The lower 33 bits of the id count the rows of a task, which holds one range in order.
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = dealt.sortWithinPartitions(*keys).withColumns({"_place": place, "_range": F.spark_partition_id()})
    folder = work_folder(spark, "ordered")
    placed.write.partitionBy("_range").parquet(folder)
    schema = T.StructType([*df.schema.fields, T.StructField("_place", T.LongType()), T.StructField("_range", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(folder)
    sizes = {r["_range"]: r["n"] for r in rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect()}
    return Ordered(rows, sizes, folder)


def page_rows(df: DataFrame, order: list[By], page: int, limit: int, bounds: int | None = None) -> DataFrame:
    """Rows ``(page-1)*limit .. page*limit`` of ``df`` in ``order``, which must leave no ties; ``bounds`` is the number of ranges."""
    return in_order(df, order, bounds).page(page, limit)


@dataclass(frozen=True)
class Numbers:
    """Where the rows of ``df`` lie by a unique number: their count, and the bounds between which a page is."""

    df: DataFrame
    number: str
    total: int
    low: int
    high: int
    skip: int

    def rows(self, limit: int) -> DataFrame:
        inside = self.df.filter(F.col(self.number).between(self.low, self.high))
        return inside.orderBy(F.desc(self.number)).offset(self.skip).limit(limit)


def find_page(df: DataFrame, number: str, offset: int, limit: int, most: int = 100_000, ways: int = 4096) -> Numbers:
    """Where rows ``offset`` to ``offset + limit`` by ``number``, largest first, lie.

    The span of numbers is cut into ``ways`` ranges, rows are counted by range, and the range is divided again until what the page's ranges hold
    is at most ``most`` rows or a single number a range.  Each round reads the number alone (and what ``df`` filters by), from the second round on
    only between the bounds.  The driver sees ``ways`` counts.  Rows with a null number come last and on no page.
    """
    numbers = df.select(F.col(number).cast("bigint").alias("x")).filter("x is not null")
    ends = numbers.agg(F.min("x"), F.max("x")).first()
    total, low, high, skip = None, ends[0] or 0, ends[1] or 0, offset
    while True:
        width = (high - low) // ways + 1
        counted = numbers.filter(F.col("x").between(low, high)).groupBy(F.floor((F.lit(high) - F.col("x")) / width).alias("r")).count()
        sizes = sorted((r["r"], r["count"]) for r in counted.collect())
        total = sum(n for _, n in sizes) if total is None else total
        touched, before = [], 0
        for r, n in sizes:
            if before < skip + limit and before + n > skip:
                touched.append((r, n, before))
            before += n
        if not touched:
            return Numbers(df, number, total, 1, 0, 0)
        high, low = high - touched[0][0] * width, max(low, high - (touched[-1][0] + 1) * width + 1)
        skip -= touched[0][2]
        if width == 1 or sum(n for _, n, _ in touched) <= max(most, 2 * limit):
            return Numbers(df, number, total, low, high, skip)


def page_by_number(df: DataFrame, number: str, page: int, limit: int, width: int = 100_000) -> DataFrame:
    """Rows ``(page-1)*limit .. page*limit`` by a unique whole ``number``, largest first, cut out of about ``width`` rows."""
    return find_page(df, number, (page - 1) * limit, limit, width).rows(limit)


def with_total(page: DataFrame, total: Column | int, limit: int | None = None) -> DataFrame:
    """Add ``total`` and, for a page size, ``total_pages``."""
    page = page.withColumn("total", F.lit(total).cast("bigint") if isinstance(total, int) else total)
    return page if limit is None else page.withColumn("total_pages", F.ceil(F.col("total") / limit).cast("bigint"))
