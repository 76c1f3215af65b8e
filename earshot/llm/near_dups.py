"""Near-duplicate documents by one-permutation MinHash.

A document's set holds its distinct word shingles.  Documents with equal sets are one class, known by the set's digest; its text is
read from a row of the smallest id.  One hash of each shingle gives bin (its top bits) and value; empty bins are filled by optimal densification, each
from a random non-empty bin of its own probe sequence.  Runs of bins make bands; classes that share a band meet in a bucket.

Each bucket gives a star of candidates: its smallest digest paired with each other member.  Candidates pass a size test
and a sketch test that is far below the limit, then the full sets decide, and confirmed links are merged into components.
A star says nothing of two members that are both unlike its centre.  Buckets that hold more than one component after it are therefore joined to
families (buckets with common members), and the full sets of a family are compared exactly: its members are cut into chunks, each pair of chunks is a
task that multiplies two 0/1 matrices of members and shingles, and hands on one link for each two components that it joins.
So no table has a row for each pair: stars have a row a member and bucket, tasks a row a member and chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from earshot.llm.arrow import ascii_lower, blocks, unused, utf8
from earshot.llm.joins import SMALL_BYTES, checked_join, components, salted_join, table_bytes
from earshot.session import written, written_for_now

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


@dataclass(frozen=True)
class NearDuplicates:
    """``words`` a shingle; linked from ``percent`` % of common shingles; ``bands`` x ``rows`` bins.

    With 32 bands of 4 rows, two sets at 0.8 miss each other in all bands with probability 5e-8.
    """

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    #: How far below the limit a sketch's estimate may be; five standard errors at 128 bins.
    slack: float = 0.2
    star: int = 256  # members that are compared with one copy of their centre
    chunk: int = 512  # members of a chunk of a family
    chunk_shingles: int = 1 << 21  # and shingles, unless one member has more
    family: int = 8192  # members of a family; buckets of a larger one are families of their own

    @property
    def bins(self) -> int:
        return self.bands * self.rows

    def linked(self, common: int, a: int, b: int) -> bool:
        return 100 * common >= self.percent * (a + b - common)


class Shingler:
    """Sets of shingle hashes of texts; built inside a task."""

    def __init__(self, words: int, chunk: int = 1 << 17, long: int = 256):
        self.words, self._chunk, self._long = words, chunk, long
        self._lower = ascii_lower()
        self._space = np.zeros(256, bool)
        self._space[[32, 9, 10, 11, 12, 13]] = True

    def sets(self, column: pa.Array) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text; fewer words than a shingle has make one shingle; no words none."""
        data, offsets = utf8(column)
        rows = len(column)
        if not len(data):
            return [np.empty(0, np.uint64)] * rows
        low = self._lower[data]
        space = self._space[low]
        # A document's ends separate words as white space does.
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        starts = np.flatnonzero(~space & (np.concatenate([[True], space[:-1]]) | cut[:-1]))
        ends = np.flatnonzero(~space & (np.concatenate([space[1:], [True]]) | cut[1:])) + 1
        # Some words at a time, so that a very long text needs no wide array of its length.
        low = np.concatenate([low, np.zeros(8, np.uint8)])
        parts = [self._hashed(low, starts[at : at + self._chunk], ends[at : at + self._chunk]) for at in range(0, len(starts), self._chunk)]
        word = np.concatenate([np.empty(0, np.uint64), *parts])
        first = np.searchsorted(starts, offsets[:-1])
        count = np.diff(np.append(first, len(starts)))
        chained = self._chain([word[i : len(word) - self.words + 1 + i] for i in range(self.words)]) if len(word) >= self.words else word[:0]
        out = []
        for at, n in zip(first.tolist(), count.tolist(), strict=True):
            if n >= self.words:
                out.append(np.unique(chained[at : at + n - self.words + 1]))
            elif n:
                out.append(self._chain([word[at + i : at + i + 1] for i in range(n)]))
            else:
                out.append(word[:0])
        return out

    def _hashed(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each word's bytes and length: eight bytes at a time are added and scrambled; very long words are left to BLAKE2b."""
        eight = np.lib.stride_tricks.sliding_window_view(low, 8)
        lengths = ends - starts
        h = mixed(lengths.astype(np.uint64) * _ODD)
        long = lengths > self._long
        at, active = 0, np.flatnonzero(~long)
        while len(active):
            lane = np.ascontiguousarray(eight[starts[active] + at]).view("<u8")[:, 0]
            left = np.minimum(lengths[active] - at, 8).astype(np.uint64)
            lane = lane & (~np.uint64(0) >> (np.uint64(64) - left * np.uint64(8)))
            h[active] = mixed(h[active] * _ODD + lane)
            at += 8
            active = active[lengths[active] > at]
        for i in np.flatnonzero(long).tolist():
            digest = hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
            h[i] = int.from_bytes(digest, "little")
        return h

    @staticmethod
    def _chain(words: list[np.ndarray]) -> np.ndarray:
        h = np.full(len(words[0]), len(words), np.uint64)
        for w in words:
            h = mixed(h * _ODD + w)
        return h


class Signatures:
    """One-permutation signatures with optimal densification."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self._probes = np.random.default_rng(7).integers(0, self.bins, (64 * self.bins, self.bins))

    def of(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of bin values for each set (empty sets give zeros)."""
        values = np.zeros((len(sets), self.bins), np.uint64)
        full = np.zeros((len(sets), self.bins), bool)
        for row, hashes in enumerate(sets):
            if len(hashes):
                # The product's high half maps a hash to its bin, in order, for any number of bins.
                bin_of = ((hashes >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], bin_of[1:] != bin_of[:-1]]))
                values[row, bin_of[first]] = hashes[first]
                full[row, bin_of[first]] = True
        row, empty = np.nonzero(~full & full.any(axis=1, keepdims=True))
        for probe in self._probes:
            if not len(row):
                break
            source = probe[empty]
            hit = full[row, source]
            values[row[hit], empty[hit]] = values[row[hit], source[hit]]
            row, empty = row[~hit], empty[~hit]
        for r, e in zip(row, empty, strict=True):  # once in very many sets
            values[r, e] = values[r, full[r].argmax()]
        return values

    def band_keys(self, values: np.ndarray) -> np.ndarray:
        keys = np.empty((len(values), self.bands), np.uint64)
        for band in range(self.bands):
            h = np.full(len(values), band + 1, np.uint64)
            for i in range(band * self.rows, (band + 1) * self.rows):
                h = mixed(h * _ODD + values[:, i])
            keys[:, band] = h
        return keys.view(np.int64)

    @staticmethod
    def sketch(values: np.ndarray) -> np.ndarray:
        """A byte of each bin's value."""
        return (values * _ODD >> np.uint64(56)).astype(np.uint8)


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def shingle_sets(docs: DataFrame, how: NearDuplicates, id_col: str, text_col: str) -> DataFrame:
    """id, print (a hash of the text), n (set size), digest (of the set; null if empty), bands, sketch for each row."""
    ids = docs.schema[id_col].dataType
    schema = (
        T.StructType().add("id", ids).add("print", T.LongType()).add("n", T.LongType()).add("digest", T.BinaryType())
        .add("bands", T.ArrayType(T.LongType())).add("sketch", T.BinaryType())
    )

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signatures = Shingler(how.words), Signatures(how.bands, how.rows)
        for block in blocks(batches, "text"):
            sets = shingler.sets(block.column(2))
            values = signatures.of(sets)
            keys, sketch = signatures.band_keys(values), signatures.sketch(values)
            digest = [_digest(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0),
                    block.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digest, pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, keys.size + 1, how.bands, dtype=np.int32), keys.ravel()),
                    pa.array([s.tobytes() for s in sketch], pa.binary()),
                ],
                names=["id", "print", "n", "digest", "bands", "sketch"],
            )

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("print"), F.col(text_col).alias("text")).mapInArrow(sketched, schema)


def _first_stars(placed: DataFrame, how: NearDuplicates) -> DataFrame:
    """Star-shaped pairs (a: the bucket's smallest node, b) of ``placed`` (bucket, id, n) whose sizes allow a link."""
    centre = F.min(F.struct(F.col("id").alias("a"), F.col("n").alias("n_a"))).alias("c")
    stars = placed.groupBy("bucket").agg(centre).select("bucket", "c.a", "c.n_a")
    met = salted_join(placed, stars, ["bucket"], "inner", ["id"]).filter("id != a")
    sizes = 100 * F.least("n", "n_a") >= how.percent * F.greatest("n", "n_a")
    return met.filter(sizes).select("a", F.col("id").alias("b")).distinct()


def _open_buckets(placed: DataFrame, groups: DataFrame) -> DataFrame:
    """bucket, id, n, group (the component as it is by now) of the members of buckets in which the star left work; with two members it left none."""
    named = checked_join(placed, groups.withColumnRenamed("node", "id"), ["id"], "left", ["bucket"], of=groups, salts=1)
    named = named.select("bucket", "id", "n", F.coalesce("component", "id").alias("group"))
    counts = named.groupBy("bucket", "group").agg(F.count(F.lit(1)).alias("n_group"))
    sizes = counts.groupBy("bucket").agg(F.sum("n_group").alias("total"), F.count(F.lit(1)).alias("groups"))
    return salted_join(named, sizes.filter("total > 2 and groups > 1").select("bucket"), ["bucket"], "left_semi", ["id"])


def _families(members: DataFrame, how: NearDuplicates) -> DataFrame:
    """family, id, n, group: the members (as of ``_open_buckets``) of each family once; of families of more than ``how.family``, once for each bucket."""
    centre = members.groupBy("bucket").agg(F.min("id").alias("a"))
    edges = checked_join(members.select("bucket", "id"), centre, ["bucket"], "inner", ["id"], of=members).select("a", F.col("id").alias("b"))
    family = components(edges)
    sizes = family.groupBy("component").agg(F.count(F.lit(1)).alias("_size"))
    sized = checked_join(family, sizes, ["component"], "inner", ["node"], of=family).select(F.col("node").alias("id"), "component", "_size")
    placed = checked_join(members, sized, ["id"], "inner", ["bucket"], of=family, salts=1)
    # A member of a large family takes part once for each of its buckets; of another, once.
    own = F.when(F.col("_size") > how.family, F.xxhash64(F.lit("bucket"), "bucket")).otherwise(F.xxhash64("component"))
    return placed.select(own.alias("family"), "id", "n", "group").distinct()


def _chunked(members: DataFrame, how: NearDuplicates) -> DataFrame:
    """family, i, j, chunk, id, group: the members (as of ``_families``) in each pair of chunks i <= j that they take part in.

    Members of a family's largest component lie in chunks of their own, which need not be compared with each other, so that a large group
    that is found already costs no more than the members beside it.
    """
    counts = members.groupBy("family", "group").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    main = F.max(F.struct("members", "shingles", "group")).alias("main")
    sizes = counts.groupBy("family").agg(F.sum("members").alias("members"), F.sum("shingles").alias("shingles"), main)

    def chunks(members_: Column, shingles: Column) -> Column:
        return F.ceil(F.greatest(members_ / how.chunk, shingles / how.chunk_shingles)).cast("int")

    # A family that fits one chunk is one.
    small = chunks(F.col("members"), F.col("shingles")) <= 1
    apart = chunks(F.col("members") - F.col("main.members"), F.col("shingles") - F.col("main.shingles"))
    more = chunks(F.col("main.members"), F.col("main.shingles"))
    sizes = sizes.select(
        "family", F.col("main.group").alias("main"), F.when(small, 1).otherwise(apart).alias("apart"), F.when(small, 0).otherwise(more).alias("more")
    )
    dealt = checked_join(members, sizes, ["family"], "inner", ["id"], of=members)
    hashed = F.xxhash64("id")
    in_main = (F.col("group") == F.col("main")) & (F.col("more") > 0)
    chunk = F.when(in_main, F.col("apart") + F.pmod(hashed, F.greatest("more", F.lit(1)))).otherwise(F.pmod(hashed, F.greatest("apart", F.lit(1))))
    dealt = dealt.withColumn("chunk", chunk.cast("int"))
    partners = F.when(F.col("chunk") < F.col("apart"), F.col("apart") + F.col("more")).otherwise(F.col("apart"))
    met = dealt.filter(partners > 0).withColumn("_with", F.explode(F.sequence(F.lit(0), partners - 1)))
    return met.select("family", F.least("chunk", "_with").alias("i"), F.greatest("chunk", "_with").alias("j"), "chunk", "id", "group")


def common_counts(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, width: int = 2048) -> np.ndarray:
    """How many elements each of the sets ``x`` has in common with each of ``y``: products of 0/1 matrices, ``width`` elements at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.concatenate(sets)
    common = np.zeros((len(x), len(y)), np.int64)
    if not len(every):
        return common
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    element = np.cumsum(new) - 1
    shared = np.bincount(element)[element] > 1  # what a single set holds is common to none
    owner, element = owner[shared], np.cumsum(new & shared)[shared] - 1
    edges = np.searchsorted(element, np.arange(0, (int(element[-1]) + 1 if len(element) else 0) + width, width))
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        held = np.zeros((len(sets), width), np.float32)
        held[owner[a:b], element[a:b] - k * width] = 1
        common += (held[x] @ held[y].T).astype(np.int64)
    return common


def _joining(sets: list[np.ndarray], groups: list, x: np.ndarray, y: np.ndarray, how: NearDuplicates) -> list[tuple[int, int]]:
    """Of the linked pairs between ``x`` and ``y``, as many as it takes to join the components that they join."""
    codes: dict = {}
    group = np.array([codes.setdefault(g, len(codes)) for g in groups])
    if len(codes) < 2 or not len(x) or not len(y):
        return []
    n = np.array([len(s) for s in sets], np.int64)
    common = common_counts(sets, x, y)
    linked = (100 * common >= how.percent * (n[x, None] + n[None, y] - common)) & (group[x, None] != group[None, y])
    i, j = np.nonzero(linked)
    i, j = x[i], y[j]
    _, first = np.unique(np.minimum(group[i], group[j]) * len(codes) + np.maximum(group[i], group[j]), return_index=True)
    parent = list(range(len(codes)))

    def root(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    out = []
    for a, b in zip(i[first].tolist(), j[first].tolist(), strict=True):
        one, other = root(int(group[a])), root(int(group[b]))
        if one != other:
            parent[one] = other
            out.append((a, b))
    return out


def _full_sets(ids: DataFrame, nodes: DataFrame, docs: DataFrame, how: NearDuplicates, id_col: str, text_col: str) -> DataFrame:
    """(id, shingles) of the nodes ``ids``, from the text of a row that stands for the class."""
    wanted = nodes.join(ids, "id", "left_semi").select("id", "rep")
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text"))
    schema = T.StructType().add("id", T.BinaryType()).add("shingles", T.BinaryType())

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(how.words)
        for block in blocks(batches, "text"):
            found = [(i, s) for i, s in zip(block.column(0).to_pylist(), shingler.sets(block.column(1)), strict=True) if len(s) and _digest(s) == i]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary())], names=["id", "shingles"])

    return wanted.join(texts, "rep").select("id", "text").mapInArrow(made, schema).dropDuplicates(["id"])


def _compared(chunks: DataFrame, sets: DataFrame, how: NearDuplicates) -> DataFrame:
    """Confirmed links (a, b) between components, from every pair of chunks (as of ``_chunked``)."""
    met = salted_join(chunks, sets, ["id"], "inner", ["family", "i", "j"], salts=1)
    ordered = met.select("family", "i", "j", "chunk", "id", "group", "shingles").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    schema = T.StructType().add("a", T.BinaryType()).add("b", T.BinaryType())

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, task = None, []

        def close() -> pa.RecordBatch:
            side = np.array([r[0] == key[1] for r in task])
            x = np.flatnonzero(side)
            y = x if key[1] == key[2] else np.flatnonzero(~side)
            found = _joining([np.frombuffer(r[3], np.uint64) for r in task], [r[2] for r in task], x, y, how)
            ends = [pa.array([task[pair[k]][1] for pair in found], pa.binary()) for k in (0, 1)]
            task.clear()
            return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

        for batch in batches:
            for *place, chunk, member, group, shingles in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if place != key and task:
                    yield close()
                key = place
                task.append((chunk, member, group, shingles))
        if task:
            yield close()

    return ordered.mapInArrow(joined, schema)


def _alike(pairs: DataFrame, nodes: DataFrame, how: NearDuplicates) -> DataFrame:
    """The pairs whose sketches don't rule a link out; sets too small for a steady estimate always pass."""
    sketches = nodes.select("id", "n", "sketch")
    centres = sketches.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
    centres = centres.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a"))
    members = sketches.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    least = how.percent / 100 - how.slack

    @F.arrow_udf(returnType=T.DoubleType())
    def agreement(one: pa.Array, other: pa.Array) -> pa.Array:
        x = np.frombuffer(b"".join(one.to_pylist()), np.uint8).reshape(len(one), -1)
        y = np.frombuffer(b"".join(other.to_pylist()), np.uint8).reshape(len(other), -1)
        return pa.array((x == y).mean(axis=1) if len(x) else np.zeros(0), pa.float64())

    joined = salted_join(pairs, centres, ["a"], "inner", ["b"])
    joined = salted_join(joined, members, ["b"], "inner", ["a"], salts=4)
    return joined.filter((F.col("n_b") < how.bins) | (agreement.asNondeterministic()("sketch_a", "sketch_b") >= least)).select("a", "b")


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, how: NearDuplicates, id_col: str, text_col: str) -> DataFrame:
    """The pairs that their full sets link.  Of the rows that repeat an id, those with another set than the node's are passed over.

    A star's members are dealt to groups of about ``how.star``, each with a copy of the centre; a partition is read in order,
    centre first, so a task holds one set at a time however large the star.
    """
    stars = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / how.star).cast("int").alias("parts"))
    dealt = salted_join(pairs, stars, ["a"], "inner", ["b"]).select(
        "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("id"), F.lit(1).alias("role")
    )
    centres = stars.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("id"), F.lit(0).alias("role"))
    needed = dealt.unionByName(centres)
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text"))
    wanted = needed.join(nodes.select("id", "rep"), "id").join(texts, "rep").select("a", "part", "role", "id", "text")
    ordered = wanted.repartition("a", "part").sortWithinPartitions("a", "part", "role", "id")
    schema = T.StructType().add("a", T.BinaryType()).add("b", T.BinaryType())

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(how.words)
        star, centre = None, np.empty(0, np.uint64)
        for block in blocks(batches, "text"):
            found_a, found_b = [], []
            made = shingler.sets(block.column(4))
            keys = zip(block.column(0).to_pylist(), block.column(1).to_pylist(), block.column(2).to_pylist(), block.column(3).to_pylist(), made, strict=True)
            for a, part, role, member, own in keys:
                if _digest(own) != member:
                    continue
                if role == 0:
                    star, centre = (a, part), own
                elif star == (a, part) and how.linked(len(np.intersect1d(centre, own, assume_unique=True)), len(centre), len(own)):
                    found_a.append(a)
                    found_b.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, block.schema.field(0).type), pa.array(found_b, block.schema.field(0).type)], names=["a", "b"])

    return ordered.mapInArrow(judged, schema).distinct()


def _judged(docs: DataFrame, how: NearDuplicates, id_col: str, text_col: str) -> DataFrame:
    """id, print, n, component_id and kept for each row of ``docs``."""
    sets = written(shingle_sets(docs, how, id_col, text_col), "shingle-sets")
    usable = sets.filter("id is not null and digest is not null")
    classes = usable.groupBy("digest").agg(F.min("id").alias("rep"))
    nodes = usable.join(classes.withColumnRenamed("rep", "id"), ["digest", "id"], "left_semi")
    nodes = nodes.select(F.col("digest").alias("id"), F.col("id").alias("rep"), "n", "bands", "sketch").dropDuplicates(["id", "rep"])
    nodes, drop_nodes = written_for_now(nodes, "classes")
    placed = nodes.select("id", "n", F.explode("bands").alias("bucket"))
    # Most buckets hold one class and are done with here; every round works on the others.
    met = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("bucket")
    placed, drop_placed = written_for_now(salted_join(placed, met, ["bucket"], "left_semi", ["id"]), "buckets")
    pairs, drop_pairs = written_for_now(_alike(_first_stars(placed, how), nodes, how), "candidates")
    links = written(_confirmed(pairs, nodes, docs, how, id_col, text_col), "links")
    drop_pairs()
    groups = components(links)
    members, drop_members = written_for_now(_open_buckets(placed, groups), "open-buckets")
    drop_placed()
    if not members.isEmpty():
        families, drop_families = written_for_now(_families(members, how), "families")
        shingles, drop_shingles = written_for_now(_full_sets(families.select("id"), nodes, docs, how, id_col, text_col), "full-sets")
        links = links.unionByName(written(_compared(_chunked(families, how), shingles, how), "links"))
        groups = components(links)
        drop_families()
        drop_shingles()
    drop_members()
    drop_nodes()

    # A component is named by its smallest id, and kept is the class of that id (of several with it, the one of the smallest digest).
    labels = groups.withColumnRenamed("node", "digest")
    if table_bytes(groups) <= SMALL_BYTES:
        linked = classes.join(F.broadcast(labels), "digest")
    else:
        linked = salted_join(labels, classes, ["digest"], "inner", ["component"], salts=1)
    heads = linked.groupBy("component").agg(F.min(F.struct("rep", "digest")).alias("head"))
    linked = checked_join(linked, heads, ["component"], "inner", ["digest"], of=groups).select("digest", "head")
    linked = written(linked, "linked")
    classes = checked_join(classes, linked, ["digest"], "left", ["rep"], of=linked, salts=1)
    classes = classes.select("digest", F.coalesce("head.rep", "rep").alias("component_id"), F.coalesce("head.digest", "digest").alias("_head"))
    # A class of one that is linked with nothing needs no lookup.
    named = salted_join(sets.select("id", "print", "n", "digest"), classes, ["digest"], "left", ["id"])
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    first = (F.col("component_id") == F.col("id")) & F.coalesce(F.col("_head") == F.col("digest"), F.lit(True))
    return named.select("id", "print", "n", component.alias("component_id"), F.coalesce(first, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, how: NearDuplicates = NearDuplicates(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable over links) and kept for each row of ``docs``.

    A null text, or one without words, has an empty set and is linked with nothing.  A null id takes no part in linking:
    its component is null and it is kept.  Rows that repeat an id are judged each by its own text; repeated rows repeat the answer.
    """
    found = _judged(docs, how, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def keep_one(docs: DataFrame, how: NearDuplicates = NearDuplicates(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id; rows that repeat id and text count once.

    Documents without words and rows with a null id all stay.
    """
    print_ = unused(docs, "_print")
    gone = _judged(docs, how, id_col, text_col).filter(~F.col("kept")).select(F.col("id").alias("_gone"), F.col("print").alias("_text")).distinct()
    named = docs.filter(F.col(id_col).isNotNull()).withColumn(print_, F.xxhash64(F.col(text_col)))
    left = named.join(gone, (named[id_col] == gone["_gone"]) & (named[print_] == gone["_text"]), "left_anti")
    left = left.dropDuplicates([id_col, print_]).drop(print_)
    return left.unionByName(docs.filter(F.col(id_col).isNull()))
