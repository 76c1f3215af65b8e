"""What the two vector searches share: usable vectors as bytes, copies as one entry, answers back to rows.

Rows with equal vectors are one entry with the smallest ids of its rows, as many as an answer can hold.  So a vector that a third
of all rows share is scored once, and no answer changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from earshot.llm.joins import SALTS, salted_join
from earshot.session import written

#: Entries and queries that meet in one task; both bound its memory.
SHARD = 16_384
CHUNK = 4_096


def searched_by_length(rows: DataFrame, vector_col: str, search: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """``search(rows of one vector length, the length)`` for each length, put together: vectors of different lengths have no product.

    A search for each length is planned, so there should be few; a table has one as a rule.
    """
    sizes = rows.select(F.size(vector_col).alias("size")).filter("size > 0").distinct().collect()
    found = [search(rows.filter(F.size(vector_col) == size), size) for size in sorted(r["size"] for r in sizes)]
    return reduce(DataFrame.unionByName, found) if found else search(rows.limit(0), 0)


def usable_vectors(rows: DataFrame, id_col: str, vector_col: str, size: int, encode: Callable[[np.ndarray], np.ndarray | None]) -> DataFrame:
    """id (bigint), raw (``encode`` of the vector, as bytes) for the rows that take part, all of whose vectors have ``size`` components; distinct.

    Left out are null ids, null vectors, those holding a null or non-finite component, and those that ``encode`` turns down.
    """
    sized = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, raw = [], []
            column = batch.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)  # a null becomes NaN
            ok = np.isfinite(flat).all(axis=1)
            for i in np.flatnonzero(ok):
                made = encode(flat[i])
                if made is not None:
                    ids.append(batch.column(0)[int(i)].as_py())
                    raw.append(made.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], names=["id", "raw"])

    same = sized.select("id", F.col("v").cast("array<double>").alias("v"))
    return written(same.mapInArrow(packed, "id long, raw binary").distinct(), "vectors")


def entries(vectors: DataFrame, ids: int) -> DataFrame:
    """raw, ids (the ``ids`` smallest of its rows, ascending), first (the smallest) for each distinct vector."""
    salted = vectors.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    for keys in (["raw", "salt"], ["raw"]):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
        salted = salted.withColumn("nth", nth).filter(F.col("nth") <= ids).drop("nth")
    return salted.groupBy("raw").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min("id").alias("first"))


def bounded_sample(table: DataFrame, key: str, most: int) -> list:
    """About ``most`` rows of ``table``, never more than a few standard deviations above, by a hash of ``key`` over all rows."""
    total = table.count()
    place = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return table.filter(place < (most / total if total else 0.0)).collect() if total > most else table.collect()


def clusters(vectors: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """k-means of a bounded sample."""
    rng = np.random.default_rng(seed)
    centroids = vectors[rng.choice(len(vectors), min(k, len(vectors)), replace=False)]
    for _ in range(rounds):
        of = nearest(vectors, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, vectors)
        n = np.bincount(of, minlength=len(centroids))
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, less each vector's own constant."""
    return (centroids * centroids).sum(axis=1)[None, :] - 2.0 * (vectors @ centroids.T)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return distances(vectors, centroids).argmin(axis=1)


def matrix(raws: list[bytes] | pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Rows of equal length from bytes."""
    parts = raws if isinstance(raws, list) else raws.to_pylist()
    if not parts:
        return np.zeros((0, 0), kind)
    return np.frombuffer(b"".join(parts), kind).reshape(len(parts), -1)


def chosen_queries(vectors: DataFrame, is_query: Column) -> tuple[DataFrame, DataFrame]:
    """The query rows (id, raw), and the distinct vectors among them as (query, raw), named by their smallest id."""
    rows = vectors.filter(is_query)
    return rows, rows.groupBy("raw").agg(F.min("id").alias("query")).select("query", "raw")


def merged(found: DataFrame, most: int) -> DataFrame:
    """query, vec_id, score of the ``most`` best of each query from parts (query, vec_id, score); ties to the smaller id."""
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= most).drop("nth")


def answers(rows: DataFrame, queries: DataFrame, best: DataFrame, most: int) -> DataFrame:
    """query_id, rank, vec_id, score for each query row: the best of its vector without itself, ``most`` at the most.

    ``best`` holds ``most`` + 1 for each distinct vector, so that one is left over for the row itself.
    """
    lists = best.groupBy("query").agg(F.collect_list(F.struct((-F.col("score")).alias("by"), "vec_id", "score")).alias("list"))
    known = queries.join(lists, "query").select("raw", F.array_sort("list").alias("list"))
    each = salted_join(rows, known, ["raw"], "inner", ["id"]).select(F.col("id").alias("query_id"), "list")
    others = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, most)
    ranked = each.select("query_id", F.posexplode(others).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
