"""Collocated phrases, mined by Rabin-Karp fingerprints.

A phrase is a run of words within a piece of a text.  Numpy prefix polynomials give a 64-bit fingerprint of every run of a block at once.
Length by length, tasks count the fingerprints of runs whose two shorter runs may be frequent; a shuffle adds them up by ranges of
fingerprints, and the frequent ones are kept as a bitmap of fixed size, a filter that lets all frequent runs pass and few others.
Texts are then read once more: each run that passes is followed by its pointer (start and end in the block) to its text and counted by
it, so a collision of fingerprints, or of bits, never joins two phrases; a task hands its counts on in cells, which are added up.  Only these phrases ever exist as text; all else is arithmetic on their counts.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from earshot.llm.arrow import blocks, joined_words
from earshot.session import written

_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Collocations:
    """Phrases of 2 to ``longest`` words said ``least`` times or more; the ``first`` best of a group are returned.

    A phrase goes if a longer candidate that holds it is said at least ``share`` % as often.
    """

    longest: int = 3
    least: int = 10
    share: int = 50
    first: int = 2000
    filter_bits: int = 26  # up to 48; 2**26 bits are 8 MB a length, and more of them let fewer rare runs pass, never fewer frequent ones
    at_once: int = 1 << 16  # words
    gathered: int = 1 << 21  # fingerprints or phrases that a task holds before it hands them on


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


@dataclass
class Runs:
    """Some consecutive words of a block, by prefix polynomials; runs are named by their first word."""

    text: memoryview
    starts: np.ndarray
    ends: np.ndarray
    group: np.ndarray  # of each word
    piece: np.ndarray
    salt: np.ndarray  # of each word's group
    firsts: int  # words that begin runs; those after them only end some
    sums: np.ndarray
    back: np.ndarray

    def whole(self, n: int) -> np.ndarray:
        """The first words of the runs of ``n`` words within a piece."""
        count = min(self.firsts, len(self.starts) - n + 1)
        return np.flatnonzero(self.piece[:count] == self.piece[n - 1 : n - 1 + count]) if count > 0 else np.empty(0, np.int64)

    def prints(self, first: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of the runs of ``n`` words from ``first`` on, which depend on their bytes and their group alone."""
        begin = self.starts[first]
        own = (self.sums[self.ends[first + n - 1]] - self.sums[begin]) * self.back[begin]
        return _scrambled(_scrambled(own + np.uint64(n)) * _ODD + self.salt[first])


class Fingerprints:
    """Cuts blocks into ``Runs``; built inside a task."""

    def __init__(self, how: Collocations):
        self._how = how
        self._word = np.ones(256, bool)
        self._ending = np.zeros(256, bool)
        self._ending[list(b".,;:!?\n\x0b\x0c\r")] = True
        self._word[self._ending] = False
        self._word[list(b" \t")] = False
        self._letters = np.random.default_rng(20240301).integers(1, 1 << 63, 256, np.uint64)
        self._base = 0x5851F42D4C957F2D
        self._power = self._back = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._power) < n:
            made = []
            for base in (self._base, pow(self._base, -1, 1 << 64)):
                factors = np.full(2 * n, base, np.uint64)
                factors[0] = 1
                made.append(np.cumprod(factors, dtype=np.uint64))
            self._power, self._back = made

    def runs(self, block: pa.RecordBatch) -> Iterator[tuple[list[str], Runs]]:
        """The groups' names and the runs of a block of (group, text), some words at a time."""
        names = block.column(0).dictionary_encode()
        groups = names.dictionary.to_pylist()
        code = names.indices.to_numpy(zero_copy_only=False)
        salts = np.array([int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little") for g in groups], np.uint64)
        normal, row, piece = joined_words(block.column(1), self._word, self._ending)
        ends = np.flatnonzero(normal == 32)
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])
        text, most = memoryview(normal), self._how.at_once
        for at in range(0, len(ends), most):
            stop = min(at + most + self._how.longest - 1, len(ends))
            low, high = int(starts[at]), int(ends[stop - 1])
            self._powers(high - low + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self._letters[normal[low:high]] * self._power[: high - low], dtype=np.uint64)])
            group = code[row[at:stop]]
            yield groups, Runs(text[low:high], starts[at:stop] - low, ends[at:stop] - low, group, piece[at:stop], salts[group], min(most, stop - at), sums, self._back)


class Filter:
    """A bitmap of the first ``bits`` bits of fingerprints."""

    def __init__(self, data: np.ndarray, bits: int):
        self._data, self._shift = data, np.uint64(64 - bits)

    def __call__(self, prints: np.ndarray) -> np.ndarray:
        at = prints >> self._shift
        return (self._data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def _passing(runs: Runs, n: int, filters: list[Filter]) -> np.ndarray:
    """The first words of the runs of ``n`` words both of whose shorter runs pass."""
    first = runs.whole(n)
    if n > 1:
        first = first[filters[n - 2](runs.prints(first, n - 1))]
        first = first[filters[n - 2](runs.prints(first + 1, n - 1))]
    return first


def _cell_bits(texts: DataFrame, how: Collocations) -> int:
    """Counts are added up in 2**bits cells, one for each 2 MB that Spark expects of the texts (256 to 2**20), so that a cell stays small."""
    expected = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(how.filter_bits, max(8, min(20, (expected >> 21).bit_length())))


def _filter(texts: DataFrame, n: int, filters: list[Filter], how: Collocations) -> Filter:
    """The runs of ``n`` words that are said ``how.least`` times or more.

    A task hands on its distinct fingerprints, of 48 bits here, sorted and cut into ranges, as numpy arrays with counts up to ``least``; the ranges are
    shuffled and added up.
    """
    cell_bits, least = _cell_bits(texts, how), how.least

    def handed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, held, size = Fingerprints(how), [], 0

        def given() -> pa.RecordBatch:
            prints, counts = np.unique(np.concatenate(held) >> np.uint64(16), return_counts=True)
            held.clear()
            counts = np.minimum(counts, least).astype(np.uint16)
            cell = prints >> np.uint64(48 - cell_bits)
            # Upper and lower parts lie apart: those of a sorted array take little room.
            high, low = (prints >> np.uint64(32)).astype(np.uint16), prints.astype(np.uint32)
            edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            parts = list(zip(edges, edges[1:], strict=False))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(cell[edges[:-1]].astype(np.int64)),
                    *[pa.array([part[a:b].tobytes() for a, b in parts], pa.binary()) for part in (high, low, counts)],
                ],
                names=["cell", "high", "low", "counts"],
            )

        for block in blocks(batches, "text"):
            for _, runs in cutter.runs(block):
                held.append(runs.prints(_passing(runs, n, filters), n))
                size += len(held[-1])
                if size >= how.gathered:
                    yield given()
                    size = 0
        if size:
            yield given()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, prints, counts = None, [], []

        def frequent() -> pa.RecordBatch:
            every, count = np.concatenate(prints), np.concatenate(counts)
            order = np.argsort(every, kind="stable")
            every, count = every[order], count[order]
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            enough = np.add.reduceat(count.astype(np.int64), first) >= least
            bit = np.unique(every[first[enough]] >> np.uint64(48 - how.filter_bits))
            return pa.RecordBatch.from_arrays([pa.array(bit.astype(np.int64))], names=["bit"])

        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column(0)[k].as_py() != cell and prints:
                    yield frequent()
                    prints, counts = [], []
                cell = batch.column(0)[k].as_py()
                high, low, count = (np.frombuffer(batch.column(c)[k].as_py(), kind) for c, kind in ((1, np.uint16), (2, np.uint32), (3, np.uint16)))
                prints.append(high.astype(np.uint64) << np.uint64(32) | low)
                counts.append(count)
        if prints:
            yield frequent()

    cells = texts.mapInArrow(handed, "cell bigint, high binary, low binary, counts binary").repartition("cell").sortWithinPartitions("cell")
    bits = cells.mapInArrow(added, "bit bigint")
    number = F.col("bit") + 1  # positions count from 1
    maps = bits.groupBy(F.bitmap_bucket_number(number).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
    data = np.zeros(1 << how.filter_bits >> 3, np.uint8)
    for row in maps.collect():  # 4 KB a row, as many bytes as the filter has
        part = np.frombuffer(row["bits"], np.uint8)
        at = (row["part"] - 1) * len(part)
        data[at : at + len(part)] = part[: len(data) - at]
    return Filter(data, how.filter_bits)


def phrase_counts(docs: DataFrame, how: Collocations = Collocations(), group_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, words, phrase, n): every run of 1 to ``how.longest`` words said ``how.least`` times or more in its group's texts; with words 0 all words.

    A null group is ``und``; a null text is empty.
    """
    texts = docs.select(F.coalesce(F.col(group_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    filters: list[Filter] = []
    for n in range(1, how.longest + 1):
        filters.append(_filter(texts, n, filters, how))

    cells = 1 << _cell_bits(texts, how)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, said, codec = Fingerprints(how), {}, pa.Codec("zstd")
        size = 0

        def given() -> pa.RecordBatch:
            rows = []
            for (lang, n), counts in said.items():
                parts: dict[int, list[bytes]] = {}
                for phrase in counts:
                    parts.setdefault(crc32(phrase) % cells, []).append(phrase)
                # A line break ends a piece, so no phrase holds one.
                for cell, own in parts.items():
                    text = b"\n".join(own)
                    rows.append((cell, lang, n, len(text), codec.compress(text, asbytes=True), np.array([counts[x] for x in own], np.int64).tobytes()))
            said.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                names=["cell", "lang", "words", "size", "phrases", "counts"],
            )

        for block in blocks(batches, "text"):
            for groups, runs in cutter.runs(block):
                data = runs.text.tobytes()
                every = np.bincount(runs.group[: runs.firsts], minlength=len(groups))
                for code in np.flatnonzero(every).tolist():
                    said.setdefault((groups[code], 0), Counter())[b""] += int(every[code])
                for n in range(1, how.longest + 1):
                    first = _passing(runs, n, filters)
                    first = first[filters[n - 1](runs.prints(first, n))]
                    begin, end, group = runs.starts[first], runs.ends[first + n - 1], runs.group[first]
                    for code in np.unique(group).tolist():
                        own = group == code
                        counts = said.setdefault((groups[code], n), Counter())
                        before = len(counts)
                        counts.update([data[a:b] for a, b in zip(begin[own].tolist(), end[own].tolist(), strict=True)])
                        size += len(counts) - before
                if size >= how.gathered // 4:
                    yield given()
                    size = 0
        if said:
            yield given()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total, codec = None, {}, pa.Codec("zstd")

        def frequent() -> pa.RecordBatch:
            _, lang, n = place
            kept = [(phrase, count) for phrase, count in total.items() if not n or count >= how.least]
            total.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(kept), pa.string()), pa.array([n] * len(kept), pa.int32()),
                    pa.array([phrase for phrase, _ in kept], pa.binary()).cast(pa.string()), pa.array([count for _, count in kept], pa.int64()),
                ],
                names=["lang", "words", "phrase", "n"],
            )

        for batch in batches:
            for cell, lang, n, length, phrases, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (cell, lang, n) != place and total:
                    yield frequent()
                place = (cell, lang, n)
                text = codec.decompress(phrases, length, asbytes=True)
                for phrase, count in zip(text.split(b"\n"), np.frombuffer(counts, np.int64).tolist(), strict=True):
                    total[phrase] = total.get(phrase, 0) + count
        if total:
            yield frequent()

    place = ["cell", "lang", "words"]
    parts = texts.mapInArrow(counted, "cell int, lang string, words int, size bigint, phrases binary, counts binary")
    return parts.repartition(*place).sortWithinPartitions(*place).mapInArrow(added, "lang string, words int, phrase string, n bigint")


def collocations(docs: DataFrame, how: Collocations = Collocations(), group_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``how.first`` best phrases of each group.

    Phrases of two words or more are scored at the cut where they hold together least: ``floor(1000000 * a * a / (l * r))`` of the counts of the phrase and
    its two parts, exactly, in decimals of 38 digits (counts below 10**16); ties go to the smallest first part.  n counts the group's words.  A group without
    a frequent phrase gives no row, nor does an empty table.
    """
    counts = written(phrase_counts(docs, how, group_col, text_col), "phrases")
    phrases = counts.filter("words >= 2").select("lang", "words", "phrase", F.col("n").alias("a"))

    # Of longer candidates only the most frequent one that holds a phrase matters.
    words = F.split("phrase", " ")
    inner = phrases.filter("words > 2").select("lang", "a", words.alias("ws"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "a", "ws", "size", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("size") + 1)).alias("at"))
    inner = inner.groupBy("lang", F.array_join(F.slice("ws", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    alone = phrases.join(inner, ["lang", "phrase"], "left")
    alone = alone.filter(F.col("longer").isNull() | (100 * F.col("longer") < how.share * F.col("a")))

    cut = alone.select("lang", "phrase", "a", words.alias("ws"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("ws", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("ws", F.col("k") + 1, F.size("ws") - F.col("k")), " ").alias("tail"),
    )
    parts = counts.filter((F.col("words") >= 1) & (F.col("words") < how.longest))
    # Both parts are said as often as the phrase at least, so they are there.  A word that begins very many phrases is left to Spark's own splitting.
    cut = cut.join(parts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cut = cut.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    a, left, right = (F.col(c).cast("decimal(16,0)") for c in ("a", "l", "r"))
    cut = cut.withColumns({"_over": F.lit(1_000_000).cast("decimal(7,0)") * (a * a), "_under": left * right}).withColumn("score", F.expr("_over div _under"))
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")

    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    top = scored.withColumn("rank", best.cast("bigint")).filter(F.col("rank") <= how.first)
    totals = counts.filter("words = 0").select("lang", "n")
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def report_sql(how: Collocations = Collocations()) -> str:
    """The rows of ``collocations`` for phrases of 2 and 3 words."""
    return f"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from p),
f as (select lang, unnest(ws) as phrase, 1 as words from w
  union all select lang, unnest(list_transform(list_zip(ws[:-2], ws[2:]), lambda p: p[1] || ' ' || p[2])), 2 from w
  union all select lang, unnest(list_transform(list_zip(ws[:-3], ws[2:-2], ws[3:]), lambda p: p[1] || ' ' || p[2] || ' ' || p[3])), 3 from w),
c as (select lang, words, phrase, count(*) as n from f group by all), t as (select lang, cast(sum(n) as bigint) as n from c where words = 1 group by lang),
k as (select lang, words, phrase, n as a, string_split(phrase, ' ') as ws from c where words >= 2 and n >= {how.least}),
i as (select lang, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) as phrase, a from k where words = 3),
d as (select lang, phrase, max(a) as longer from i group by all),
o as (select k.* from k left join d using (lang, phrase) where longer is null or 100 * longer < {how.share} * a),
u as (select lang, phrase, a, words, ws, unnest(range(1, words)) as cut from o),
s as (select u.lang, u.phrase, a, cut, x.n as l, y.n as r, cast(1000000::hugeint * a * a // (x.n::hugeint * y.n) as bigint) as score from u
  join c x on x.lang = u.lang and x.phrase = array_to_string(ws[:cut], ' ') and x.words = cut
  join c y on y.lang = u.lang and y.phrase = array_to_string(ws[cut + 1:], ' ') and y.words = u.words - cut),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
r as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b)
select lang, rank, phrase, a, l, r.r, t.n, score from r join t using (lang) where rank <= {how.first}"""
