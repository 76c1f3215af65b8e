import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.llm import block_topk
from earshot.llm.block_topk import BlockSearch, top_products
from earshot.llm.multi_index import MultiIndexing, nearest_neighbours, visited

SCHEMA = "vec_id long, embedding array<float>, score string"


def table():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(900):
        v = (centres[i % 12] + 0.3 * rng.normal(size=16)).astype(np.float32)
        rows.append((i, [float(x) for x in v], "x"))
    same = rows[5][1]
    rows += [(1000 + i, same, "x") for i in range(300)]  # a third of what matters is one vector
    odd = [(2000, None, "x"), (2020, [], "x"), (2040, [0.0] * 16, "x"), (2060, [None] + [1.0] * 15, "x"), (2080, [float("nan")] * 16, "x"),
           (2100, [float("inf")] + [0.0] * 15, "x"), (2120, [1.0] * 7, "x"), (None, same, "x"), rows[20], rows[20]]
    return rows + odd


def usable(rows, zero):
    out = {}
    for vec_id, v, _ in rows:
        if vec_id is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            out[vec_id] = np.array(v, np.float64)
    return out


def brute(vectors, step, most, product):
    ids = np.array(sorted(vectors))
    m = np.stack([vectors[i] for i in ids])
    out = {}
    for q in ids[ids % step == 0]:
        s = product(vectors[q], m)
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:most]
        out[int(q)] = [(int(ids[k]), s[k]) for k in order]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_exact_search_equals_brute_force(spark):
    rows = table()
    vectors = {i: np.floor(1024 * v).astype(np.int64) for i, v in usable(rows, zero=True).items()}
    expected = brute(vectors, 100, 10, lambda q, m: m @ q)
    got = by_query(top_products(spark.createDataFrame(rows, SCHEMA), F.col("id") % 100 == 0, BlockSearch(block=32)).collect())
    assert got == expected


def test_pruning_skips_blocks_and_loses_nothing():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    centres = rng.integers(-1000, 1000, (40, 8))
    entries = np.concatenate([c + rng.integers(-20, 20, (32, 8)) for c in centres]).astype("<i8")
    held = [{"block": b, "n": 32, "forward": (f := entries[b * 32 : b * 32 + 32]).tobytes(), "highest": f.max(axis=0).tobytes(), "lowest": f.min(axis=0).tobytes(), "ids": [[b * 32 + i] for i in range(32)]} for b in range(40)]
    search = block_topk.RangeSearch(pa.Table.from_pylist(held))
    queries = entries[::64]
    found, scored = search.search(queries, np.full(len(queries), -np.inf), 11)
    for q in range(len(queries)):
        s = entries @ queries[q]
        best = np.lexsort((np.arange(len(s)), -s))[:11]
        assert sorted((-x, i) for k, i, x in found if k == q) == [(-int(s[i]), int(i)) for i in best]
    assert scored < 0.3 * len(queries) * 40


def test_huge_components_are_exact():
    q, e = np.array([[1 << 40, 3]], "<i8"), np.array([[1 << 20, 1], [-(1 << 62), 1 << 62]], "<i8")
    assert block_topk.products(q, e).tolist() == [[(1 << 60) + 3, np.iinfo(np.int64).min]]


def test_neighbours_reach_the_recall(spark):
    rows = table()
    vectors = usable(rows, zero=False)
    expected = brute(vectors, 20, 20, lambda q, m: (m * q).sum(axis=1))
    got = by_query(nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("id") % 20 == 0).collect())
    assert set(got) == set(expected)
    hits = 0
    for q, found in got.items():
        assert len(found) == 20 and q not in [i for i, _ in found] and len({i for i, _ in found}) == 20
        for i, s in found:
            assert s == pytest.approx(float((vectors[i] * vectors[q]).sum()), abs=1e-12)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in found} & {i for i, _ in expected[q]})
    assert hits >= 0.9 * 20 * len(expected)
    # A query among 300 copies gets the smallest ids of them, but not its own.
    copies = [i for i, s in got[1020] if s == dict(got[1020]).get(5)]
    assert copies == [5, *(i for i in range(1000, 1300) if i != 1020)][: len(copies)]


def test_vectors_of_other_lengths_are_searched_for_themselves(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=3 if i % 3 == 0 else 5)], "x") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    exact, near = {}, {}
    for size in (3, 5):
        own = {i: np.array(v) for i, v, _ in rows if len(v) == size}
        near |= brute(own, 20, 20, lambda q, m: m @ q)
        exact |= brute({i: np.floor(1024 * v).astype(np.int64) for i, v in own.items()}, 100, 10, lambda q, m: m @ q)
    assert by_query(top_products(df, F.col("id") % 100 == 0).collect()) == exact
    got = by_query(nearest_neighbours(df, F.col("id") % 20 == 0).collect())
    assert set(got) == set(near) and all(len(got[q]) == 20 for q in got)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in near[q]}) for q in near) >= 0.9 * 20 * len(near)


def test_few_and_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], "x"), (20, [0.5, 0.5], "x")], SCHEMA)
    assert by_query(nearest_neighbours(few, F.col("id") % 20 == 0).collect()) == {0: [(20, 0.5)], 20: [(0, 0.5)]}
    assert by_query(top_products(few, F.col("id") % 20 == 0).collect()) == {0: [(20, 1024 * 512)], 20: [(0, 1024 * 512)]}
    for empty in (spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, None, "x")], SCHEMA)):
        assert nearest_neighbours(empty, F.col("id") % 20 == 0).collect() == []
        assert top_products(empty, F.col("id") % 20 == 0).collect() == []
    assert nearest_neighbours(spark.createDataFrame([(1, [1.0], "x")], SCHEMA), F.col("id") % 20 == 0).collect() == []


def test_pairs_come_in_order_of_distance():
    rng = np.random.default_rng(5)
    for _ in range(30):
        a, b = rng.integers(0, 6, rng.integers(1, 9)).astype(float), rng.integers(0, 6, rng.integers(1, 9)).astype(float)
        counts = rng.integers(0, 3, len(a) * len(b))
        order = visited(a, b, counts, int(counts.sum()) + 1)
        sums = [a[c // len(b)] + b[c % len(b)] for c in order]
        assert sums == sorted(sums) and sorted(order) == np.flatnonzero(counts).tolist()
        half = visited(a, b, counts, int(counts.sum()) // 2)
        assert half == order[: len(half)] and counts[half].sum() >= counts.sum() // 2


def test_real_table_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in rows.collect()}
    expected = brute(vectors, 20, 20, lambda q, m: m @ q)
    got = by_query(nearest_neighbours(rows, F.col("id") % 20 == 0, MultiIndexing()).collect())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * sum(map(len, expected.values()))
