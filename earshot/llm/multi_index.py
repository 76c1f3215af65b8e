"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised separately, so an entry's cell is a pair of centroids.  A query orders both lists of
centroids by distance and visits pairs by the summed distance with a heap, until the cells visited hold
enough entries; these are scored exactly.  How many are enough is measured: a bounded set of queries is
answered by brute force over all entries, and the budget is set so that visits would have covered the wanted share of the true answers.

The measure is the inner product.  An extra component in the second half gives every entry the same length, which makes the nearest by
distance the largest by inner product.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from earshot.llm.vectors import CHUNK, SHARD, answers, bounded_sample, chosen_queries, clusters, distances, entries, matrix, merged, nearest, searched_by_length, usable_vectors
from earshot.session import written


@dataclass(frozen=True)
class MultiIndexing:
    """``most`` neighbours.  Centroids a half follow the number of entries (``cell`` entries a cell on average) up to ``centroids``;
    they are fit on at most about ``sample`` entries.  ``measured`` queries set the budget for a recall of ``recall``.
    """

    most: int = 20
    cell: int = 16
    centroids: int = 256
    sample: int = 20_000
    measured: int = 256
    recall: float = 0.96


@dataclass(frozen=True)
class Quantiser:
    """Bounded by centroids, whatever the number of vectors."""

    halves: tuple[np.ndarray, np.ndarray]
    longest: float

    @property
    def k(self) -> int:
        return len(self.halves[0])

    def split(self, rows: np.ndarray, queries: bool = False) -> tuple[np.ndarray, np.ndarray]:
        half = rows.shape[1] // 2
        rest = 0.0 if queries else np.sqrt(np.maximum(self.longest - (rows * rows).sum(axis=1), 0.0))
        return rows[:, :half], np.hstack([rows[:, half:], np.broadcast_to(rest, len(rows))[:, None]])

    def cells(self, rows: np.ndarray) -> np.ndarray:
        first, second = (nearest(part, c) for part, c in zip(self.split(rows), self.halves, strict=True))
        return first * len(self.halves[1]) + second


def visited(first: np.ndarray, second: np.ndarray, counts: np.ndarray, budget: int) -> list[int]:
    """The cells that one query visits, in order of summed distance, until they hold ``budget`` entries; empty cells are passed over."""
    by_first, by_second = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    a, b = np.sort(first).tolist(), np.sort(second).tolist()
    width, held, out = len(b), 0, []
    reach = [0] * len(a)  # how many pairs of each row have been put on the heap
    heap = [(a[0] + b[0], 0, 0)]
    reach[0] = 1
    while heap and held < budget:
        _, i, j = heapq.heappop(heap)
        cell = by_first[i] * width + by_second[j]
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        # A pair goes on the heap once the pair before it in its row and in its column have been visited.
        if j + 1 < width and reach[i] == j + 1 and (i == 0 or reach[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            reach[i] = j + 2
        if i + 1 < len(a) and reach[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
            reach[i + 1] = j + 1
    return out


def _fit(table: DataFrame, how: MultiIndexing) -> Quantiser:
    sample = matrix([r["raw"] for r in sorted(bounded_sample(table.select("raw"), "raw", how.sample), key=lambda r: bytes(r["raw"]))], "<f8")
    longest = _longest(table)
    k = int(np.clip(round((table.count() / how.cell) ** 0.5), 1, how.centroids))
    shape = Quantiser((np.zeros((1, 1)), np.zeros((1, 1))), longest)
    first, second = shape.split(sample)
    return Quantiser((clusters(first, k), clusters(second, k)), longest)


def _longest(table: DataFrame) -> float:
    """The largest squared length."""

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0.0
        for batch in batches:
            if batch.num_rows:
                rows = matrix(batch.column(0), "<f8")
                most = max(most, float((rows * rows).sum(axis=1).max()))
        yield pa.RecordBatch.from_arrays([pa.array([most])], names=["most"])

    return table.select("raw").mapInArrow(longest, "most double").agg(F.max("most")).first()[0] or 0.0


def _assigned(table: DataFrame, quantiser: Quantiser) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = quantiser.cells(matrix(batch.column(0), "<f8")) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int64())], names=["raw", "ids", "first", "cell"])

    return table.select("raw", "ids", "first").mapInArrow(assign, "raw binary, ids array<long>, first long, cell long")


def brute_force(index: DataFrame, asked: np.ndarray, names: list[int], most: int) -> DataFrame:
    """query, vec_id, score, cell: the ``most`` best entries of each of a bounded number of queries, against all entries."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = asked @ matrix(batch.column(0), "<f8").T
            top = np.argsort(-scores, axis=1, kind="stable")[:, :most]
            at = top.ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(names, top.shape[1]), pa.int64()), batch.column(1).take(pa.array(at)),
                    pa.array(np.take_along_axis(scores, top, 1).ravel(), pa.float64()), batch.column(2).take(pa.array(at)),
                ],
                names=["query", "vec_id", "score", "cell"],
            )

    found = index.select("raw", "first", "cell").mapInArrow(scored, "query long, vec_id long, score double, cell long")
    return merged(found, most)


def measured_budget(index: DataFrame, queries: DataFrame, quantiser: Quantiser, counts: np.ndarray, how: MultiIndexing) -> int:
    """Entries to visit so that the wanted share of the true neighbours of a bounded set of queries lies in visited cells."""
    sample = sorted(bounded_sample(queries, "query", how.measured), key=lambda r: r["query"])
    if not sample:
        return 0
    asked = matrix([bytes(r["raw"]) for r in sample], "<f8")
    names = [r["query"] for r in sample]
    truth: dict[int, list[int]] = {}
    for row in brute_force(index, asked, names, how.most + 1).collect():  # (most + 1) x measured rows
        truth.setdefault(row["query"], []).append(row["cell"])
    first, second = (distances(p, c) for p, c in zip(quantiser.split(asked, queries=True), quantiser.halves, strict=True))
    needed = []
    for i, name in enumerate(names):
        order = visited(first[i], second[i], counts, int(counts.sum()))
        held = dict(zip(order, np.cumsum(counts[order]).tolist(), strict=True))
        needed += [held[cell] for cell in truth.get(name, ())]
    return int(np.quantile(needed, how.recall, method="higher"))


def nearest_neighbours(rows: DataFrame, is_query: Column, how: MultiIndexing = MultiIndexing(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` (an expression over ``id``), the nearest others found.

    Scores are inner products in double precision, ties go to the smaller id, and there are fewer rows only where there are fewer
    candidates.  Null, zero, null-holding and non-finite vectors take no part, nor do null ids.  Rows
    with a query's own id are never its candidates; rows that repeat id and vector count once.
    Vectors of another length have neighbours of that length.
    """
    return searched_by_length(rows, vector_col, lambda same, size: _neighbours(same, size, is_query, how, id_col, vector_col))


def _neighbours(rows: DataFrame, size: int, is_query: Column, how: MultiIndexing, id_col: str, vector_col: str) -> DataFrame:
    usable = usable_vectors(rows, id_col, vector_col, size, lambda v: (v + 0.0).astype("<f8") if v.any() else None)
    spark = rows.sparkSession
    table = written(entries(usable, how.most + 1), "entries")
    if table.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    quantiser = _fit(table, how)
    index = written(_assigned(table, quantiser), "multi-index")
    counts = np.zeros(quantiser.k * len(quantiser.halves[1]), np.int64)
    for row in index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # at most centroids squared rows
        counts[row["cell"]] = row["n"]
    query_rows, queries = chosen_queries(usable, is_query)
    queries = written(queries, "queries")
    budget = max(measured_budget(index, queries, quantiser, counts, how), how.most + 1)

    # Cells go to shards of about SHARD entries; a larger cell is split over several, by a hash.
    before = np.concatenate([[0], np.cumsum(counts)[:-1]])
    shard_of = before // SHARD * 2  # even: shared by whole cells
    parts_of = -(-counts // SHARD)
    large = np.flatnonzero(parts_of > 1)
    own = {int(c): 2 * i + 1 for i, c in enumerate(np.concatenate([[0], np.cumsum(parts_of[large])[:-1]]) if len(large) else [])}
    first_part = np.zeros(len(counts), np.int64)
    first_part[large] = list(own.values())
    chunks = max(1, -(-queries.count() // CHUNK))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(3).to_numpy()
            spread = np.array([r % p for r, p in zip(batch.column(2).to_pylist(), np.maximum(parts_of[cell], 1).tolist(), strict=True)], np.int64)
            shard = np.where(parts_of[cell] > 1, first_part[cell] + 2 * spread, shard_of[cell])
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), *batch.columns], names=["shard", "raw", "ids", "first", "cell"])

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            asked = matrix(batch.column(1), "<f8")
            first, second = (distances(p, c) for p, c in zip(quantiser.split(asked, queries=True), quantiser.halves, strict=True))
            out: dict[str, list] = {"shard": [], "query": [], "raw": [], "cells": []}
            for i, (name, raw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                by_shard: dict[int, list[int]] = {}
                for cell in visited(first[i], second[i], counts, budget):
                    if parts_of[cell] > 1:
                        for p in range(int(parts_of[cell])):
                            by_shard.setdefault(int(first_part[cell]) + 2 * p, []).append(cell)
                    else:
                        by_shard.setdefault(int(shard_of[cell]), []).append(cell)
                for shard, cells in by_shard.items():
                    for column, value in zip(out.values(), (shard, name, raw, cells), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["shard"], pa.int64()), pa.array(out["query"], pa.int64()), pa.array(out["raw"], pa.binary()), pa.array(out["cells"], pa.list_(pa.int64()))],
                names=["shard", "query", "raw", "cells"],
            )

    def rerank(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "vec_id": [], "score": []}
        if asked.num_rows and held.num_rows:
            ids, least = held["ids"].to_pylist(), held["first"].to_numpy()
            known, questions = matrix(held["raw"], "<f8"), matrix(asked["raw"], "<f8")
            cells, place = np.unique(held["cell"].to_numpy(), return_inverse=True)
            wanted = np.zeros((len(questions), len(cells)), bool)
            for i, own_cells in enumerate(asked["cells"].to_pylist()):
                at = np.searchsorted(cells, own_cells)
                at = at[(at < len(cells)) & (cells[np.minimum(at, len(cells) - 1)] == own_cells)]
                wanted[i, at] = True
            for at in range(0, len(questions), 256):
                part = slice(at, at + 256)
                scores = np.where(wanted[part][:, place], questions[part] @ known.T, -np.inf)
                keep = min(how.most + 9, len(known))
                top = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
                for i, candidates in enumerate(top):
                    candidates = candidates[np.isfinite(scores[i, candidates])]
                    exact = (known[candidates] * questions[at + i]).sum(axis=1)
                    for c in np.lexsort((least[candidates], -exact))[: how.most + 1]:
                        for vec_id in ids[candidates[c]]:
                            out["query"].append(asked["query"][at + i].as_py())
                            out["vec_id"].append(vec_id)
                            out["score"].append(float(exact[c]))
        return pa.table({"query": pa.array(out["query"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    located = index.mapInArrow(placed, "shard long, raw binary, ids array<long>, first long, cell long")
    located = located.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = queries.repartition(max(8, chunks)).mapInArrow(probes, "shard long, query long, raw binary, cells array<long>")
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("query"), F.lit(chunks)).cast("int"))
    found = asked.groupBy("shard", "chunk").cogroup(located.groupBy("shard", "chunk")).applyInArrow(rerank, "query long, vec_id long, score double")
    return answers(query_rows, queries, merged(found, how.most + 1), how.most)
