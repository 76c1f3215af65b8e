"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_BYTES = 1 << 20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying its text; null counts as empty.

    ``offsets`` has one entry more than the column has rows and starts at 0.
    """
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches by the bytes of one column, so that a task holds little at a time.

    A block has at most ``limit`` bytes of text, or a single row that is longer.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        _, offsets = utf8(column)
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def ascii_lower() -> np.ndarray:
    """A byte table that lower-cases A-Z only."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def joined_words(column: pa.Array, word: np.ndarray, ending: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a string column's texts, A-Z in lower case, each followed by one space; the row of each; and the piece it stands in.

    ``word`` marks the bytes of words (the space is none) and ``ending`` those that end a piece; a text's end does so always.
    """
    data, offsets = utf8(column)
    rows = len(column)
    low = np.full(len(data) + rows, 32, np.uint8)  # a space after each text
    low[np.arange(len(data)) + np.repeat(np.arange(rows), np.diff(offsets))] = ascii_lower()[data]
    inside = word[low]
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & ~before)
    row = np.searchsorted(offsets[1:] + np.arange(1, rows + 1), starts, "right")
    piece = row if ending is None else row + np.cumsum(ending[low])[starts]
    return np.where(inside, low, np.uint8(32))[inside | before], row, piece


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores appended until no column is called so (in either case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
