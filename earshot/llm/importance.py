"""Importance resampling towards a target distribution of hashed word n-grams.

Documents and target texts are bags of word n-grams, each in one of ``buckets`` by its CRC-32.  A bucket's gain is the scaled logarithm of
its smoothed share of the target over its share of the documents; a document weighs the sum of the gains of its n-grams, and the
highest weights plus Gumbel noise are drawn, which samples without replacement.

A block's words are joined by one separator and scanned once, keeping the running CRC at the end of each word.  The CRC of any n-gram then
follows from two of them: the one before it, shifted past the n-gram's length over GF(2), cancels the one at its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from earshot.llm.arrow import blocks, joined_words, unused
from earshot.operators.paging import down, in_order, up
from earshot.session import written

_SPACE = 32
_POLYNOMIAL = 0xEDB88320  # of CRC-32, bits reversed


@dataclass(frozen=True)
class Importance:
    """Runs of 1 to ``longest`` words in ``buckets``; ``percent`` % of the documents with ``min_words`` words or more are drawn."""

    buckets: int = 10_000
    longest: int = 3
    min_words: int = 20
    percent: int = 5
    seed: int = 42


class CrcShift:
    """Moves CRC-32 values past any number of zero bytes, which is linear over GF(2): four table lookups for each base-256 digit of the number."""

    def __init__(self) -> None:
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = step >> np.uint32(1) ^ np.where(step & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
        self.step = step  # what a byte leaves after it was shifted out
        self._digits: list[np.ndarray] = []

    def zero_byte(self, crc: np.ndarray) -> np.ndarray:
        return self.step[crc & np.uint32(255)] ^ crc >> np.uint32(8)

    def _table(self, digit: int) -> np.ndarray:
        """[number of 256**digit bytes, byte of the value, its content]"""
        while len(self._digits) <= digit:
            once = self.zero_byte if not self._digits else lambda crc, last=self._digits[-1][255], one=self._digits[-1][1]: self._apply(one, self._apply(last, crc))
            table = np.empty((256, 4, 256), np.uint32)
            table[0] = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32)[:, None] * np.uint32(8))
            for n in range(1, 256):
                table[n] = once(table[n - 1])
            self._digits.append(table)
        return self._digits[digit]

    @staticmethod
    def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        out = table[0][crc & np.uint32(255)]
        for byte in range(1, 4):
            out = out ^ table[byte][crc >> np.uint32(8 * byte) & np.uint32(255)]
        return out

    def __call__(self, crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        digit, most = 0, int(lengths.max(initial=0))
        while most >> 8 * digit:
            at = lengths >> 8 * digit & 255
            table = self._table(digit)
            out = table[at, 0, crc & np.uint32(255)]
            for byte in range(1, 4):
                out = out ^ table[at, byte, crc >> np.uint32(8 * byte) & np.uint32(255)]
            crc, digit = out, digit + 1
        return crc


class WordRuns:
    """CRC-32 of all word runs of a column's texts; built inside a task.

    Words are runs of digits, letters and non-ASCII characters, A-Z in lower case.
    """

    def __init__(self, longest: int, at_once: int = 1 << 16):
        self._longest, self._at_once = longest, at_once
        self._word = np.zeros(256, bool)
        self._word[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
        self._shift = CrcShift()

    def words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The normalised bytes, each word followed by one space, and the row of each word."""
        normal, row, _ = joined_words(column, self._word)
        return normal, row

    def crcs(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, CRC-32) of every run of words, some at a time."""
        normal, row = self.words(column)
        ends = np.flatnonzero(normal == _SPACE)
        starts = np.concatenate([[0], ends[:-1] + 1])
        text = memoryview(np.ascontiguousarray(normal))
        for at in range(0, len(ends), self._at_once):
            stop = min(at + self._at_once + self._longest - 1, len(ends))  # with the words that the last runs reach into
            first, e, doc = starts[at:stop], ends[at:stop], row[at:stop]
            crc, cut, running = 0, int(first[0]), []
            for end in e.tolist():
                crc = crc32(text[cut:end], crc)
                running.append(crc)
                cut = end
            until = np.array(running, np.uint32)
            # What stands before a word is what ends before it, and the space.
            last = ~until[:-1]
            ahead = np.concatenate([np.zeros(1, np.uint32), ~(self._shift.step[(last ^ np.uint32(_SPACE)) & np.uint32(255)] ^ last >> np.uint32(8))])
            for n in range(1, self._longest + 1):
                count = min(self._at_once, len(e) - n + 1)
                if count <= 0:
                    break
                whole = doc[:count] == doc[n - 1 : n - 1 + count]
                begin, end = np.flatnonzero(whole), np.flatnonzero(whole) + n - 1
                yield doc[begin], until[end] ^ self._shift(ahead[begin], e[end] - first[begin])


def bucket_counts(texts: DataFrame, text_col: str, how: Importance) -> DataFrame:
    """(bucket, n) over all word runs of ``texts``; each task counts for itself first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, total = WordRuns(how.longest), np.zeros(how.buckets, np.int64)
        for block in blocks(batches, "text"):
            for _, crc in runs.crcs(block.column(0)):
                total += np.bincount(crc % np.uint32(how.buckets), minlength=how.buckets)
        bucket = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(total[bucket])], names=["bucket", "n"])

    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(counted, "bucket bigint, n bigint")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, how: Importance) -> DataFrame:
    """(bucket, gain) for every bucket, from ``bucket_counts`` of both sides."""
    one = docs.select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t"))
    both = one.unionByName(target.select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t")))
    every = both.unionByName(both.sparkSession.range(how.buckets).select(F.col("id").alias("bucket"), *[F.lit(0).cast("bigint").alias(c) for c in "st"]))
    held = every.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    totals = held.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))

    def smoothed(own: str, other: str) -> Column:
        return (F.col(own) + 1).cast("double") * (F.col(other) + how.buckets).cast("double")

    # One row of totals.
    ratio = smoothed("t", "all_s") / smoothed("s", "all_t")
    return held.join(F.broadcast(totals)).select("bucket", F.floor(1000 * F.ln(ratio)).cast("bigint").alias("gain"))


def importance_weights(docs: DataFrame, target: DataFrame, how: Importance = Importance(), id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """id, n_words, n_features and weight for each row of ``docs``; a null or wordless text has no feature and weighs 0.

    The driver holds the gains, ``how.buckets`` numbers.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, how), bucket_counts(target, target_col, how), how).collect()
    gain = np.zeros(how.buckets)
    gain[[r["bucket"] for r in gains]] = [r["gain"] for r in gains]

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = WordRuns(how.longest)
        for block in blocks(batches, "text"):
            size = block.num_rows
            features, weight, words = np.zeros(size, np.int64), np.zeros(size), np.bincount(runs.words(block.column(1))[1], minlength=size)
            for row, crc in runs.crcs(block.column(1)):
                features += np.bincount(row, minlength=size)
                weight += np.bincount(row, gain[crc % np.uint32(how.buckets)], size)  # whole numbers, exact below 2**53
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(words), pa.array(features), pa.array(weight.astype(np.int64))], names=["id", "n_words", "n_features", "weight"]
            )

    schema = T.StructType().add("id", docs.schema[id_col].dataType)
    for name in ("n_words", "n_features", "weight"):
        schema = schema.add(name, T.LongType())
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(weighed, schema)


def gumbel_noise(id_: Column, seed: int) -> Column:
    """Scaled Gumbel noise of an id's own hash, rounded down; a null id counts as empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("bigint")


def importance_draw(docs: DataFrame, target: DataFrame, how: Importance = Importance(), id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """id, n_features, weight, score and rank for each row of ``docs``; rank is 1, 2, ... by score for those drawn, else null.

    Ties go to the smaller id (null first); rows that repeat an id count each for itself.  Drawing is by places in ranges of the order, so no
    task sees all scores.  Without target texts every gain follows from the documents alone; without documents there is no row.
    """
    weights = importance_weights(docs, target, how, id_col, text_col, target_col)
    scored = written(weights.withColumn("score", F.col("weight") + gumbel_noise(F.col("id"), how.seed)), "importance")
    ordered = in_order(scored.filter(F.col("n_words") >= how.min_words), [down("score"), up("id")])
    drawn = how.percent * ordered.total // 100
    ranked = ordered.numbered("_nth").withColumn("rank", F.when(F.col("_nth") <= drawn, F.col("_nth"))).drop("_nth")
    rest = scored.filter(F.col("n_words") < how.min_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, how: Importance = Importance(), id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """The drawn rows of ``docs``, all columns as they are; rows whose id is drawn twice stay twice, rows with a null id are never drawn."""
    ids = importance_draw(docs, target, how, id_col, text_col, target_col).filter("rank is not null").select(F.col(id_col).alias(unused(docs, "_drawn")))
    return docs.join(ids.distinct(), docs[id_col] == ids[ids.columns[0]], "left_semi")


def report_sql(how: Importance = Importance()) -> str:
    """The rows of ``importance_draw``, CRC-32 byte by byte."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"coalesce(regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
    runs = """unnest(list_concat(ws, list_transform(list_zip(ws[:-2], ws[2:]), lambda p: p[1] || ' ' || p[2]),
      list_transform(list_zip(ws[:-3], ws[2:-2], ws[3:]), lambda p: p[1] || ' ' || p[2] || ' ' || p[3]))) as x"""
    bit = f"case when c & 1 = 1 then xor({_POLYNOMIAL}, c >> 1) else c >> 1 end"
    return f"""
with t as (select list(list_reduce(list_prepend(b, range(8)), lambda c, i: {bit}) order by b) as step from range(256) r(b)),
dw as (select row_number() over () as row, doc_id, {words} as ws from documents), bw as (select {words} as ws from benchmark),
df as (select row, {runs} from dw), bf as (select {runs} from bw),
x as (select distinct x from (select x from df union all select x from bf)),
y as (select x, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: cast('0x' || h as bigint)) as bytes from x),
z as (select x, xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), bytes), lambda c, v: xor(c >> 8, t.step[(xor(c, v) & 255) + 1]))) % {how.buckets} as bucket from y, t),
s as (select bucket, count(*) as s from df join z using (x) group by 1), g as (select bucket, count(*) as t from bf join z using (x) group by 1),
h as (select b as bucket, coalesce(s, 0) as s, coalesce(t, 0) as t from range({how.buckets}) r(b) left join s on s.bucket = b left join g on g.bucket = b),
a as (select cast(coalesce(sum(s), 0) as bigint) as all_s, cast(coalesce(sum(t), 0) as bigint) as all_t from h),
gains as (select bucket, cast(floor(1000 * ln(cast(t + 1 as double) * cast(all_s + {how.buckets} as double)
  / (cast(s + 1 as double) * cast(all_t + {how.buckets} as double)))) as bigint) as gain from h, a),
w as (select row, count(*) as n_features, cast(sum(gain) as bigint) as weight from df join z using (x) join gains using (bucket) group by row),
d as (select dw.doc_id, len(ws) as n, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
  cast('0x' || sha256('{how.seed}:' || coalesce(cast(dw.doc_id as varchar), ''))[:8] as bigint) as h from dw left join w using (row)),
v as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5) / cast(4294967296 as double)))) as bigint) as score from d),
r as (select *, row_number() over (order by n >= {how.min_words} desc, score desc, doc_id nulls first) as nth, count(*) filter (n >= {how.min_words}) over () as able from v)
select doc_id, n_features, weight, score, case when n >= {how.min_words} and nth <= {how.percent} * able // 100 then nth end as rank from r"""
