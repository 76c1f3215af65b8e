"""Token ids of a corpus in files of independently coded, checksummed blocks.

A file holds the ids of a range of documents, in ascending order of their ids.  Layout: the magic; per block its number of ids, the length of
its code, the CRC-32 of its ids as little-endian unsigned 32-bit integers, and the code; then a zlib-packed table of
documents (known, id, number of ids); then that table's length, the number of documents, of blocks and of ids, and the magic again.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from earshot.llm.arrow import blocks as text_blocks
from earshot.llm.range_coder import BLOCK, LANES, decode, encode
from earshot.llm.tokens import encoder
from earshot.session import work_folder, written

MAGIC = b"IDMIX2\r\n"
_BLOCK, _BLOCK_SIZE = "<III", 12
_END, _END_SIZE = "<QQQQ8s", 40
END = 2
BLOCK_BYTES = 8 << 20  # of text whose ids are made together


class FileWriter:
    """Appends documents, some at a time; full sets of blocks are coded as they fill, so memory does not grow with the file."""

    def __init__(self, out):
        self._out, self._table, self._pending, self._held = out, [], [], 0
        self.documents = self.blocks = self.ids = 0
        out.write(MAGIC)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        """``ids`` of some documents one after the other, and how many each has."""
        self._table += [struct.pack("<?qQ", doc_id is not None, doc_id or 0, n) for doc_id, n in zip(doc_ids, lengths.tolist(), strict=True)]
        self._pending.append(ids)
        self._held += len(ids)
        self.documents += len(doc_ids)
        self.ids += len(ids)
        if self._held >= BLOCK * LANES:
            self._code(everything=False)

    def _code(self, everything: bool) -> None:
        ids = np.concatenate(self._pending) if self._pending else np.empty(0, "<u4")
        whole = len(ids) if everything else len(ids) // BLOCK * BLOCK
        parts = [ids[i : min(i + BLOCK, whole)] for i in range(0, whole, BLOCK)]
        for at in range(0, len(parts), LANES):
            some = parts[at : at + LANES]
            for part, code in zip(some, encode(some), strict=True):
                self._out.write(struct.pack(_BLOCK, len(part), len(code), zlib.crc32(part.astype("<u4").tobytes())) + code)
                self.blocks += 1
        self._pending, self._held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._code(everything=True)
        table = zlib.compress(b"".join(self._table))
        self._out.write(table + struct.pack(_END, len(table), self.documents, self.blocks, self.ids, MAGIC))
        self._out.close()


def read_file(handle) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of an open file, in its order; a block whose ids don't have its checksum is an error."""
    size = handle.size()
    handle.seek(size - _END_SIZE)
    length, documents, count, total, magic = struct.unpack(_END, handle.read(_END_SIZE))
    handle.seek(0)
    if magic != MAGIC or handle.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    handle.seek(size - _END_SIZE - length)
    table = list(struct.iter_unpack("<?qQ", zlib.decompress(handle.read(length))))
    if len(table) != documents:
        raise ValueError("the document table is damaged")
    handle.seek(len(MAGIC))
    held, have, done = [], 0, 0

    def more() -> None:
        nonlocal have, done
        heads, codes = [], []
        for _ in range(min(LANES, count - done)):
            heads.append(struct.unpack(_BLOCK, handle.read(_BLOCK_SIZE)))
            codes.append(handle.read(heads[-1][1]))
        for head, ids in zip(heads, decode(codes, [h[0] for h in heads]), strict=True):
            if zlib.crc32(ids.tobytes()) != head[2]:
                raise ValueError("a block is damaged")
            held.append(ids)
            have += len(ids)
        done += len(heads)

    for known, doc_id, n in table:
        while have < n and done < count:
            more()
        if have < n:
            raise ValueError("ids are missing")
        ids = np.concatenate(held) if len(held) != 1 else held[0]
        held[:], have = [ids[n:]], have - n
        yield (doc_id if known else None), ids[:n]


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", end: int = END) -> DataFrame:
    """Write every document's ids below ``path`` and return the files: place (their order), name, documents, ids.

    A null or empty text is its end id alone; null ids come first; rows that repeat an id stay together, in any order.
    A failed attempt's file is not in the result, and only files in it are read.
    """
    files, root = fs.FileSystem.from_uri(path)
    files.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_files, out_root = fs.FileSystem.from_uri(path)
        place = TaskContext.get().partitionId()
        name = f"part-{place:06d}-{uuid.uuid4().hex}.ids"
        writer = None
        for block in text_blocks(batches, "text", BLOCK_BYTES):
            if writer is None and block.num_rows:
                writer = FileWriter(out_files.open_output_stream(posixpath.join(out_root, name), compression=None))
            ids, at = encoder(tokenizer).flat_ids(block.column(1))
            writer.add(block.column(0).to_pylist(), np.insert(ids, at[1:], np.uint32(end)), np.diff(at) + 1)
        if writer is not None:
            writer.close()
            row = {"place": place, "name": name, "documents": writer.documents, "ids": writer.ids}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("place", pa.int64()), ("name", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    # The second key lets rows that share an id go to several files.
    keyed = rows.withColumn("nth", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange("id", "nth").sortWithinPartitions("id", "nth").select("id", "text")
    return written(ordered.mapInArrow(write, "place long, name string, documents long, ids long"), "token-files")


def read_tokens(made: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, little-endian unsigned 32-bit) of every document in the files ``made``."""
    before = F.sum("ids").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    # One row a file.
    placed = made.select("place", "name", F.coalesce(before, F.lit(0)).alias("base"))
    spread = placed.repartitionByRange(max(1, made.count()), "place").select("name", "base")

    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
    schema = pa.schema(fields if with_ids else fields[:-1])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_files, in_root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size = [], 0
                with in_files.open_input_file(posixpath.join(in_root, name)) as handle:
                    for doc_id, ids in read_file(handle):
                        data = ids.tobytes()
                        row = {"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(data)}
                        rows.append(row | {"ids": data} if with_ids else row)
                        start += len(ids)
                        size += (len(data) if with_ids else 0) + 64
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write the files of ``docs`` to a folder of their own, read them back, and return a row per document without its ids."""
    folder = work_folder(spark, "tokens")
    return read_tokens(write_tokens(docs, folder), folder, with_ids=False)
