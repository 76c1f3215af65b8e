"""Packing token sequences by multiway Karmarkar-Karp differencing.

Documents are cut into pieces: whole windows first, then what remains in pieces of at most ``grain`` tokens.  Whole
windows are sequences of their own.  The rest is dealt to groups that hold the tokens of some hundred windows, and each
group is partitioned into the fewest windows its tokens can fill: the two partial partitions with the largest
imbalance are merged so that the heaviest window of one meets the lightest of the other, until one is left.
If a window of it exceeds the capacity, the group is partitioned into one window more.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from earshot.llm.arrow import blocks
from earshot.llm.tokens import encoder
from earshot.session import written

BLOCK_BYTES = 4 << 20  # of text whose ids are made together
CAPACITY = 2048
END = 1


def differenced(lengths: np.ndarray, windows: int) -> np.ndarray:
    """The window (0 to ``windows`` - 1) of each length in a near-equal partition by largest differencing."""
    if windows == 1:
        return np.zeros(len(lengths), np.int64)
    # A node's sums are in descending order; order[i] is the place that the i-th had when its two parts were added.
    sums: list[np.ndarray] = []
    made: list[tuple[int, int, np.ndarray]] = []
    heap = []
    for i, length in enumerate(lengths.tolist()):
        single = np.zeros(windows, np.int64)
        single[0] = length
        sums.append(single)
        heap.append((-length, i))
    heapq.heapify(heap)
    n = len(lengths)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        total = sums[a] + sums[b][::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        sums[a] = sums[b] = None
        made.append((a, b, order))
        sums.append(total)
        heapq.heappush(heap, (int(total[-1] - total[0]), n + len(made) - 1))
    # From the root down: which window each place of a node belongs to.
    window_of: dict[int, np.ndarray] = {heap[0][1]: np.arange(windows)}
    out = np.zeros(n, np.int64)
    for node in range(n + len(made) - 1, -1, -1):
        places = window_of.pop(node)
        if node < n:
            out[node] = places[0]
            continue
        a, b, order = made[node - n]
        first = np.empty(windows, np.int64)
        first[order] = places
        window_of[a], window_of[b] = first, first[::-1]
    return out


def windows_of(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """A window for each length with no window over ``capacity``; every length must fit in one."""
    windows = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        out = differenced(lengths, windows)
        if np.bincount(out, lengths, windows).max() <= capacity:
            return out
        windows += 1


def token_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json",
    end: int = END, capacity: int = CAPACITY, grain: int = 1024, filler: int = 32, fillers: int = 16, with_ids: bool = False,
) -> DataFrame:
    """Each document's ids, then ``end``, cut into pieces: id, start, length, ids_crc32, doc_tokens (and ids as binary).

    What remains beside whole windows is cut into pieces of at most ``grain`` ids; that of one document in ``fillers``, chosen by
    its last ids, into pieces of at most ``filler``, with which windows can be evened out.
    """
    schema = (
        T.StructType().add(id_col, docs.schema[id_col].dataType).add("start", T.LongType()).add("length", T.LongType())
        .add("ids_crc32", T.LongType()).add("doc_tokens", T.LongType())
    )
    if with_ids:
        schema = schema.add("ids", T.BinaryType())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            ids, at = encoder(tokenizer).flat_ids(block.column(1))
            ids = np.insert(ids, at[1:], np.uint32(end))
            at = at + np.arange(len(at))
            data, total = memoryview(ids.view(np.uint8)), np.diff(at)
            fine = np.array([zlib.crc32(data[4 * max(a, b - 32) : 4 * b]) % fillers == 0 for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], bool)
            # Whole windows, and the rest in equal pieces, so that none is needlessly small.
            whole = total // capacity
            rest = total % capacity
            parts = -(-rest // np.where(fine, filler, grain))
            row = np.repeat(np.arange(len(total)), whole + parts)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(whole + parts) - whole - parts, whole + parts)
            later = np.maximum(nth - whole[row], 0)
            start = np.minimum(nth, whole[row]) * capacity + rest[row] * later // np.maximum(parts[row], 1)
            length = np.diff(np.append(start, 0))
            last = np.cumsum(whole + parts) - 1
            length[last] = total - start[last]
            lo = 4 * (at[:-1][row] + start)
            bounds = list(zip(lo.tolist(), (lo + 4 * length).tolist(), strict=True))
            crc = [zlib.crc32(data[a:b]) for a, b in bounds]
            columns = [block.column(0).take(pa.array(row, pa.int64()))]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc, total[row])]
            if with_ids:
                columns.append(pa.array([data[a:b].tobytes() for a, b in bounds], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, windows: int = 192) -> DataFrame:
    """``pieces`` (with a ``length``) plus sequence_id and offset; a group holds the tokens of about ``windows`` windows.

    The pieces are written first, so a piece's number, on which its group rests, is the same on every attempt.  A
    sequence is numbered by group and window, or by its piece where that fills it; numbers are unique, not dense.
    """
    numbered = written(pieces.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    full = numbered.filter(F.col("length") >= capacity).select(
        *pieces.columns, (2 * F.col("piece") + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    part = numbered.filter(F.col("length") < capacity)
    tokens = part.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, -(-tokens // (capacity * windows)))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece", kind="stable")
        lengths = group["length"].to_numpy()
        window = windows_of(lengths, capacity)
        order = np.argsort(window, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.flatnonzero(np.concatenate([[True], np.diff(window[order]) > 0]))
        offset = np.empty(len(group), np.int64)
        offset[order] = before - np.repeat(before[first], np.diff(np.append(first, len(group))))
        return pd.DataFrame({"piece": group["piece"], "sequence_id": 2 * (group["group"].to_numpy() * (1 << 24) + window), "offset": offset})

    narrow = part.select("piece", "length", F.pmod(F.xxhash64("piece"), F.lit(groups)).cast("bigint").alias("group"))
    places = narrow.groupBy("group").applyInPandas(packed, "piece long, sequence_id long, offset long")
    return part.join(places, "piece").select(*full.columns).unionByName(full)


def packed_documents(docs: DataFrame, **how) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece of ``docs`` (doc_id, text).

    A null or empty text is its end id alone.  Repeated rows are packed as often as they occur; ids may be null.
    """
    return pack(token_pieces(docs, **how))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences of packed pieces with ``ids``: sequence_id, length, ids (little-endian unsigned 32-bit), at most a window each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select(
        "sequence_id", "length", F.aggregate(F.col("parts")["ids"], F.lit(b""), lambda held, more: F.concat(held, more)).alias("ids")
    )
