"""Exact top-k inner products with block-at-a-time pruning.

Entries are put in an order that keeps similar ones together and cut into document-range blocks.  A block has a forward
index (its entries' weights for all terms) and, for each term, the largest and smallest weight.  A query's bound for
a block sums, over its terms, its weight times the extreme of matching sign.  A query takes the blocks of a range by falling
bound and scores them through their forward index until the next bound falls below its k-th best score.

Two passes: the first scores every range's best block only, and merging its scores gives each query a
k-th score that holds for the whole corpus; the second starts every range from that score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from earshot.llm.vectors import CHUNK, SHARD, answers, bounded_sample, chosen_queries, clusters, entries, matrix, merged, nearest, searched_by_length, usable_vectors
from earshot.session import written

_LONG = np.iinfo(np.int64)


@dataclass(frozen=True)
class BlockSearch:
    """``most`` results; components are floor(``scale`` * x).  ``pivots`` centroids, fit on about ``sample`` entries, give the order."""

    most: int = 10
    scale: int = 1024
    block: int = 128
    pivots: int = 64
    sample: int = 8_000


def scaled(vector: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers; beyond their range, the nearest of them."""
    return np.clip(np.floor(scale * vector), -(2.0**63), 2.0**63 - 1024).astype("<i8")


def products(queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floating point where every sum stays below 2^53, else by Python's integers."""
    reach = float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(entries.astype(np.float64)).max(initial=0)) * max(queries.shape[1], 1)
    if reach < 2.0**53:
        return np.rint(queries.astype(np.float64) @ entries.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ entries.astype(object).T
    return np.clip(exact, _LONG.min, _LONG.max).astype(np.int64)


def bounds(queries: np.ndarray, highest: np.ndarray, lowest: np.ndarray) -> np.ndarray:
    """For each query and block, no less than any score in the block."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    reach = float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(max(np.abs(highest.astype(np.float64)).max(initial=0), np.abs(lowest.astype(np.float64)).max(initial=0))) * max(queries.shape[1], 1)
    if reach < 2.0**53:
        return np.rint(up.astype(np.float64) @ highest.astype(np.float64).T + down.astype(np.float64) @ lowest.astype(np.float64).T)
    exact = up.astype(object) @ highest.astype(object).T + down.astype(object) @ lowest.astype(object).T
    return np.nextafter(np.clip(exact, _LONG.min, _LONG.max).astype(np.float64), np.inf)


class RangeSearch:
    """The blocks of one document range in one task."""

    def __init__(self, held: pa.Table):
        held = held.sort_by("block")
        self.highest, self.lowest = matrix(held["highest"], "<i8"), matrix(held["lowest"], "<i8")
        self.forward = [np.frombuffer(f, "<i8").reshape(n, -1) for f, n in zip(held["forward"].to_pylist(), held["n"].to_pylist(), strict=True)]
        self.ids = held["ids"].to_pylist()

    def best_blocks(self, queries: np.ndarray, most: int) -> list[np.ndarray]:
        """The ``most`` largest scores of each query in its best block."""
        first = bounds(queries, self.highest, self.lowest).argmax(axis=1)
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries)
        for b in np.unique(first):
            asking = np.flatnonzero(first == b)
            copies = np.array([len(x) for x in self.ids[b]])
            scores = products(queries[asking], self.forward[b])
            for row, q in enumerate(asking):
                out[q] = np.sort(np.repeat(scores[row], copies))[::-1][:most]
        return out

    def search(self, queries: np.ndarray, floor: np.ndarray, most: int) -> tuple[list[tuple[int, int, int]], int]:
        """(query, vec_id, score) of the ``most`` best at or above each query's ``floor``, and how many blocks were scored.

        Blocks are taken in waves of doubling length, so that queries that want a block together are scored together; within a
        wave the floor still rules blocks out.
        """
        bound = bounds(queries, self.highest, self.lowest)
        order = np.argsort(-bound, axis=1, kind="stable")
        floor = floor.astype(np.float64).copy()
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        scored, at, width = 0, 0, 1
        while at < order.shape[1]:
            wave = order[:, at : at + width]
            open_ = np.take_along_axis(bound, wave, 1) >= floor[:, None]
            if not open_.any():
                break
            for b in np.unique(wave[open_]):
                asking = np.flatnonzero((open_ & (wave == b)).any(axis=1))
                asking = asking[bound[asking, b] >= floor[asking]]
                if not len(asking):
                    continue
                scored += len(asking)
                scores = products(queries[asking], self.forward[b])
                row, entry = np.nonzero(scores >= floor[asking][:, None])
                changed = set()
                for r, e in zip(row.tolist(), entry.tolist(), strict=True):
                    q = int(asking[r])
                    best[q] += [(-int(scores[r, e]), vec_id) for vec_id in self.ids[b][e]]
                    changed.add(q)
                for q in changed:
                    best[q] = sorted(best[q])[:most]
                    if len(best[q]) == most:
                        floor[q] = max(floor[q], -best[q][-1][0])
            at, width = at + width, width * 2
        return [(q, vec_id, -score) for q, found in enumerate(best) for score, vec_id in found], scored


def _blocks(table: DataFrame, how: BlockSearch) -> DataFrame:
    """Blocks by range: range, block, n, forward, highest, lowest, ids."""
    sample = matrix([bytes(r["raw"]) for r in sorted(bounded_sample(table.select("raw"), "raw", how.sample), key=lambda r: bytes(r["raw"]))], "<i8")
    pivots = clusters(sample.astype(np.float64), how.pivots)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = nearest(matrix(batch.column(0), "<i8").astype(np.float64), pivots) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.int64())], names=["raw", "ids", "first", "pivot"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, raws, ids = 0, [], []

        def block() -> pa.RecordBatch:
            rows = matrix(raws, "<i8")
            return pa.RecordBatch.from_pylist(
                [{"block": at, "n": len(raws), "forward": b"".join(raws), "highest": rows.max(axis=0).tobytes(), "lowest": rows.min(axis=0).tobytes(), "ids": ids}],
                pa.schema([("block", pa.int64()), ("n", pa.int64()), ("forward", pa.binary()), ("highest", pa.binary()), ("lowest", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64())))]),
            )

        for batch in batches:
            for raw, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raws.append(raw)
                ids.append(own)
                if len(raws) == how.block:
                    yield block()
                    at, raws, ids = at + 1, [], []
        if raws:
            yield block()

    ranges = max(1, -(-table.count() // SHARD))
    ordered = table.select("raw", "ids", "first").mapInArrow(near, "raw binary, ids array<long>, first long, pivot long")
    ordered = ordered.repartitionByRange(ranges, "pivot", "first").sortWithinPartitions("pivot", "first").select("raw", "ids")
    made = ordered.mapInArrow(cut, "block long, n long, forward binary, highest binary, lowest binary, ids array<array<long>>")
    return written(made.withColumn("range", F.spark_partition_id()), "blocks")


def top_products(rows: DataFrame, is_query: Column, how: BlockSearch = BlockSearch(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` (an expression over ``id``), the others with the largest scores.

    Scores are exact integer inner products of the scaled vectors, ties go to the smaller id, and there are fewer rows only where
    there are fewer candidates.  Null, empty, null-holding and non-finite vectors take no part, nor do null ids.  Rows
    with a query's own id are never its candidates; rows that repeat id and vector count once.
    Vectors of another length are searched for themselves.  Scaled components, and scores, beyond 64 bits count as the 64-bit number nearest to them.
    """
    return searched_by_length(rows, vector_col, lambda same, size: _products(same, size, is_query, how, id_col, vector_col))


def _products(rows: DataFrame, size: int, is_query: Column, how: BlockSearch, id_col: str, vector_col: str) -> DataFrame:
    usable = usable_vectors(rows, id_col, vector_col, size, lambda v: scaled(v, how.scale))
    most = how.most + 1
    table = written(entries(usable, most), "entries")
    if table.isEmpty():
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    held = _blocks(table, how)
    query_rows, queries = chosen_queries(usable, is_query)
    queries = written(queries, "queries")
    chunks = max(1, -(-queries.count() // CHUNK))
    ranges = [r["range"] for r in held.select("range").distinct().collect()]

    # Each chunk of queries meets each range once: the stated queries against all rows, in blocks.
    spread = held.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = queries.withColumn("chunk", F.pmod(F.xxhash64("query"), F.lit(chunks)).cast("int"))

    def everywhere(table: DataFrame) -> DataFrame:
        return table.withColumn("range", F.explode(F.array(*[F.lit(r) for r in ranges]))).groupBy("range", "chunk")

    def seeds(ask: pa.Table, hold: pa.Table) -> pa.Table:
        names, top = [], []
        if ask.num_rows and hold.num_rows:
            names = ask["query"].to_pylist()
            top = RangeSearch(hold).best_blocks(matrix(ask["raw"], "<i8"), most)
        return pa.table({"query": pa.array(names, pa.int64()), "scores": pa.array(top, pa.list_(pa.int64()))})

    def search(ask: pa.Table, hold: pa.Table) -> pa.Table:
        found = []
        if ask.num_rows and hold.num_rows:
            names = ask["query"].to_pylist()
            floor = np.array([-np.inf if x is None else x for x in ask["floor"].to_pylist()], np.float64)
            found = [(names[q], vec_id, score) for q, vec_id, score in RangeSearch(hold).search(matrix(ask["raw"], "<i8"), floor, most)[0]]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query", "vec_id", "score"), columns, strict=True)})

    first = everywhere(asked).cogroup(spread.groupBy("range", "chunk")).applyInArrow(seeds, "query long, scores array<long>")
    # A list for each range and query: as many as there are ranges, each of ``most`` numbers.
    seeded = first.groupBy("query").agg(F.slice(F.sort_array(F.flatten(F.collect_list("scores")), asc=False), 1, most).alias("s"))
    floors = seeded.select("query", F.when(F.size("s") == most, F.element_at("s", most)).alias("floor"))
    asked = asked.join(floors, "query", "left")
    found = everywhere(asked).cogroup(spread.groupBy("range", "chunk")).applyInArrow(search, "query long, vec_id long, score long")
    return answers(query_rows, queries, merged(found, most), how.most)
