import random
import re

import numpy as np
import pyarrow as pa
import pytest

from earshot.llm.joins import components
from earshot.llm.near_dups import NearDuplicates, Shingler, Signatures, _chunked, _families, common_counts, keep_one, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute(rows, k, percent):
    """component by position in ``rows`` for distinct ids"""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), least[root(i)]) for i, (doc_id, _) in enumerate(rows)]


def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(25):  # chains of edits, so that the ends of a group are often not linked themselves
        words = [rng.choice(vocabulary) for _ in range(rng.choice([2, 6, 20, 60, 200]))]
        for _ in range(rng.randrange(1, 9)):
            out.append(" ".join(words))
            words = list(words)
            for _ in range(max(1, len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
    out += [out[0].upper(), out[3].replace(" ", "\t\n "), "", "  \n", "one", "ONE", "one two", "É accent here it is", "é accent here it is"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_equals_brute_force(spark, k, percent):
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near_duplicates(docs, NearDuplicates(words=k, percent=percent)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [
        (5, text, "x"), (5, text, "x"), (9, text + " more", "x"), (None, text, "x"), (7, None, "x"), (8, "", "x"), (2, "w " * 200_000, "x"), (3, "w " * 200_001, "x"),
        (5, "something else altogether for the same id", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = near_duplicates(docs, NearDuplicates(words=3, percent=85)).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(2, 2), (3, 2), (5, 5), (5, 5), (5, 5), (7, 7), (8, 8), (9, 5)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert {r.n_shingles for r in got if r.doc_id in (7, 8)} == {0}
    kept = keep_one(docs, NearDuplicates(words=3, percent=85))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in kept.collect()) == sorted([(0, len(text)), (2, 400_000), (5, len(text)), (5, 41), (7, 0), (8, 0)])


def test_rows_of_one_id_are_judged_each_by_its_own_text(spark):
    rng = random.Random(3)
    one, other, third = (" ".join(rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(60)) for _ in range(3))
    rows = [(5, one), (9, one + " more"), (9, other), (12, third), (12, third + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert got[:3] == [(5, 56, 5, True), (9, 56, 9, True), (9, 57, 5, False)]
    assert [g[2] for g in got[3:]] == [12, 12] and [g[3] for g in got[3:]].count(True) == 1
    left = [tuple(r) for r in keep_one(docs).collect()]
    assert len(left) == 3 and (5, one) in left and (9, other) in left and sum(i == 12 for i, _ in left) == 1


def test_copies_around_an_original_of_a_middle_id(spark):
    # Every copy is linked with the original (0.89) and hardly any two copies with each other (0.8).
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    original = [rng.choice(vocabulary) for _ in range(400)]
    rows = [(300, " ".join(original))]
    for i in [*range(100, 300), *range(301, 501)]:
        words = list(original)
        for at in rng.sample(range(5, 395, 4), 8):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    rows += [(1, " ".join(rng.choice(vocabulary) for _ in range(400)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for star in (256, 30):
        got = near_duplicates(docs, NearDuplicates(words=3, percent=85, star=star)).collect()
        assert {r.doc_id: r.component_id for r in got} == {1: 1, **{i: 100 for i in range(100, 501)}}, star


def test_large_groups(spark):
    """3,000 copies around an original of a middle id, and 3,000 texts that are just too unlike their model and each other."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(5000)]
    original, model = ([rng.choice(vocabulary) for _ in range(200)] for _ in range(2))
    rows = [(1500, " ".join(original)), (9000, " ".join(model))]
    for i in [*range(1500), *range(1501, 3000)]:
        words = list(original)
        for at in rng.sample(range(4, 196, 4), 4):  # 12 of 198 shingles: 0.886 with the original, 0.785 with each other
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    for i in range(4000, 7000):
        words = list(model)
        for at in rng.sample(range(4, 196, 4), 6):  # 18: 0.833 with the model
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    rows.append((9001, " ".join(words) + " more"))  # linked with the last of them
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.component_id for r in near_duplicates(docs, NearDuplicates(words=3, percent=85)).collect()}
    assert found == {**{i: 0 for i in range(3000)}, **{i: i for i in range(4000, 7000)}, 9000: 9000, 9001: 6999}


def test_no_table_grows_with_pairs(spark):
    """Members meet once for each chunk of the members beside the largest component, and what is handed on joins components."""
    how = NearDuplicates(chunk=100, family=500)
    rows = [(i, bytes([i % 251, i // 251]), 60, bytes([0, 0]) if i < 1500 else bytes([i % 251, i // 251])) for i in range(1700)]
    members = spark.createDataFrame([(7, *r[1:]) for r in rows], "family long, id binary, n long, group binary")
    chunks = _chunked(members, how)
    apart, main = 200, 1500
    assert chunks.filter("group = x'0000'").count() == main * (apart // 100) and chunks.count() == main * 2 + apart * (2 + 15)
    places = spark.createDataFrame([(b, *r[1:]) for r in rows for b in (1, 2 + r[0] % 3)], "bucket long, id binary, n long, group binary")
    assert _families(places, how).count() == 2 * 1700 and _families(places, NearDuplicates(family=1700)).count() == 1700


@pytest.mark.parametrize("how", [NearDuplicates(3, 85, family=3), NearDuplicates(3, 85, chunk=2), NearDuplicates(3, 85, chunk_shingles=30, family=20, star=2)])
def test_any_cut_of_families_and_chunks(spark, how):
    rng = random.Random(2)
    out = []
    for _ in range(4):
        words = [f"w{rng.randrange(300)}" for _ in range(80)]
        for _ in range(30):
            own = list(words)
            for at in rng.sample(range(80), rng.randrange(6)):
                own[at] = f"w{rng.randrange(300)}"
            out.append(" ".join(own))
    rows = [(i, t) for i, t in enumerate(rng.sample(out, len(out)))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), how).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, 85)


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 90, size, np.uint64)) for size in (0, 1, 5, 40, 80, 60, 60)]
    x, y = np.array([0, 3, 4, 6]), np.array([1, 2, 3, 5])
    for width in (1, 7, 2048):
        got = common_counts(sets, x, y, width)
        assert all(got[a, b] == len(np.intersect1d(sets[i], sets[j])) for a, i in enumerate(x) for b, j in enumerate(y) if i != j)
    assert common_counts([np.empty(0, np.uint64)] * 2, np.array([0]), np.array([1])).tolist() == [[0]]


def test_words_that_defeat_polynomials_stay_apart(spark):
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    for size in (64, 200, 256, 257, 1024, 4096):
        one, other = ("".join(letters[b] for b in bits[:size]) for letters in ("ab", "ba"))
        a, b, c = Shingler(1).sets(pa.array([one, other, one + " " + one]))
        assert len(a) == len(b) == 1 and a[0] != b[0] and c.tolist() == a.tolist()
    docs = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, NearDuplicates(3, 85)).collect()} == {1: 1, 2: 2, 3: 1}


def test_word_hashes_depend_on_every_byte():
    words = ["a", "b", "aa", "aaaaaaaa", "aaaaaaaaa", "aaaaaaaab", "baaaaaaaa", "a\x00", "a" * 16, "a" * 17, "a" * 256, "a" * 257, "a" * 255 + "b", "é", "e"]
    one = Shingler(1)
    alone = [one.sets(pa.array([w]))[0].tolist() for w in words]
    assert len({h for [h] in alone}) == len(words)
    assert sorted(h for [h] in alone) == one.sets(pa.array([" ".join(words)]))[0].tolist()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).collect() == []
    assert keep_one(docs).collect() == []


def test_signatures_follow_similarity():
    import numpy as np

    rng = np.random.default_rng(3)
    signatures = Signatures(32, 4)
    for size in (10, 100, 3000):
        a = np.unique(rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: int(size * 0.8)], rng.integers(0, 1 << 63, int(size * 0.1), np.uint64)]))
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        values = signatures.of([a, b, np.empty(0, np.uint64)])
        assert abs((values[0] == values[1]).mean() - exact) < 0.2
        assert not values[2].any()


def test_shingles_of_a_block_equal_those_alone():
    import pyarrow as pa

    some = [*texts()[:40], None, "", "a", "a b c d e f"]
    shingler = Shingler(3)
    together = shingler.sets(pa.array(some, pa.string()))
    for text, own in zip(some, together):
        assert own.tolist() == shingler.sets(pa.array([text], pa.string()))[0].tolist()
        assert len(own) == len(shingles(text, 3))
    in_chunks = Shingler(3, chunk=50).sets(pa.array(some, pa.string()))
    assert [s.tolist() for s in in_chunks] == [s.tolist() for s in together]


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 300)]
    star = [(1000, 2000 + i) for i in range(500)] + [(2100, 999)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path + star + [(7, 7)], "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301))
    assert all(got[2000 + i] == 999 for i in range(500)) and got[1000] == 999 and len(got) == 301 + 502
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
