"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed n-grams (two and three bytes of its lower-cased letters), weighted by TF-IDF and scaled to
length 1.  Each language has a few centroids, from clustering a bounded sample of its labelled documents; a text
gets the language of the centroid with the largest cosine.  It is rejected when that cosine is far below
what texts of its length reach.  Document frequencies are counted over all training documents; only the clustering samples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from earshot.llm.arrow import blocks, unused, utf8
from earshot.llm.joins import hashed_sample

UNKNOWN = "und"

#: Rows that are turned into dense vectors at once.
_ROWS = 512


def _letters_only() -> np.ndarray:
    """A byte table that turns ASCII other than a-z into spaces and leaves the bytes of other characters."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def _hashed(low: np.ndarray, dims: int, more: bool) -> np.ndarray:
    """The dimension of each n-gram of a byte string, those of spaces only left out.

    ``more``: the next chunk begins with the last two bytes, and its first pair is this one's last.
    """
    codes = low.astype(np.uint32)
    two = codes[:-1] << 8 | codes[1:]
    three = two[:-1] << 8 | codes[2:]
    if more:
        two = two[:-1]
    grams = np.concatenate([two[two != 0x2020], three[three != 0x202020] | 1 << 24])
    return (grams * np.uint32(2654435761) >> np.uint32(7)) % np.uint32(dims)


def gram_counts(column: pa.Array, dims: int, chunk: int = 4 << 20) -> np.ndarray:
    """A row of n-gram counts for each text; long texts are counted in overlapping chunks."""
    data, offsets = utf8(pc.utf8_lower(column))
    table = _letters_only()
    out = np.zeros((len(column), dims), np.float32)
    for row in range(len(column)):
        start, end = offsets[row], offsets[row + 1]
        if end <= start:
            continue
        for at in range(start, end, chunk):
            stop = min(at + chunk + 2, end)
            low = table[data[at:stop]]
            if at == start:
                low = np.concatenate([[np.uint8(32)], low])
            if stop == end:
                low = np.concatenate([low, [np.uint8(32)]])
            dim = _hashed(low, dims, stop < end)
            if len(dim):
                out[row] += np.bincount(dim, minlength=dims)
            if stop == end:
                break
    return out


def _has_letter(column: pa.Array) -> np.ndarray:
    found = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False)
    return found.to_numpy(zero_copy_only=False).astype(bool)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with damped counts, scaled to length 1 (all zero stays zero)."""
    weighted = np.log1p(counts) * idf
    norms = np.sqrt((weighted * weighted).sum(axis=1, keepdims=True))
    return weighted / np.maximum(norms, np.float32(1e-12))


@dataclass(frozen=True)
class LanguageModel:
    """What prediction needs; its size is languages x clusters x dimensions, whatever the corpus."""

    languages: tuple[str, ...]  # of each centroid
    centroids: np.ndarray  # a row for each, of length 1
    idf: np.ndarray
    usual: np.ndarray  # median cosine of its sample, of each centroid
    usual_grams: float  # median number of n-grams in the sample
    reject: float  # share of the usual cosine below which a text is rejected

    def predict(self, column: pa.Array) -> pa.StructArray:
        """(lang, score, rejected) for each text."""
        n = len(column)
        lang = np.full(n, UNKNOWN, object)
        score, rejected = np.zeros(n), np.ones(n, bool)
        if not self.languages:
            return self._struct(lang, score, rejected)
        names = np.array(self.languages, object)
        letters = _has_letter(column)
        for at in range(0, n, _ROWS):
            part = slice(at, min(at + _ROWS, n))
            counts = gram_counts(column[part], len(self.idf))
            cosines = _vectors(counts, self.idf) @ self.centroids.T
            best = cosines.argmax(axis=1)
            top = np.clip(cosines[np.arange(len(best)), best].astype(np.float64), 0.0, 1.0)
            # A short text fills few dimensions, so its cosine is lower by about the root of its share of n-grams.
            share = np.sqrt(np.minimum(1.0, counts.sum(axis=1) / self.usual_grams))
            known = letters[part]
            lang[part] = np.where(known, names[best], UNKNOWN)
            score[part] = np.where(known, top, 0.0)
            rejected[part] = ~known | (top < self.reject * self.usual[best] * share)
        return self._struct(lang, score, rejected)

    @staticmethod
    def _struct(lang, score, rejected) -> pa.StructArray:
        return pa.StructArray.from_arrays(
            [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
            names=["lang", "score", "rejected"],
        )

    def column(self, text: Column) -> Column:
        """The prediction as a struct column; only the text goes to the Python workers."""
        kind = T.StructType().add("lang", T.StringType()).add("score", T.DoubleType()).add("rejected", T.BooleanType())

        @F.arrow_udf(returnType=kind)
        def identified(texts: pa.Array) -> pa.Array:
            column = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
            block = pa.RecordBatch.from_arrays([column], names=["text"])
            parts = [self.predict(b.column(0)) for b in blocks(iter([block]), "text")]
            return pa.concat_arrays(parts) if parts else self.predict(column)

        # Not to be evaluated again for a filter on it.
        return identified.asNondeterministic()(text)


def _clusters(vectors: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means: up to ``k`` centroids of length 1."""
    rng = np.random.default_rng(seed)
    centroids = vectors[rng.integers(len(vectors), size=1)]
    while len(centroids) < min(k, len(vectors)):
        far = 1.0 - (vectors @ centroids.T).max(axis=1)
        centroids = np.vstack([centroids, vectors[far.argmax()]])
    for _ in range(rounds):
        of = (vectors @ centroids.T).argmax(axis=1)
        sums = np.stack([vectors[of == i].sum(axis=0) for i in range(len(centroids)) if (of == i).any()])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids.astype(np.float32)


def fit_languages(
    train: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    dims: int = 4096,
    per_language: int = 300,
    clusters: int = 3,
    rounds: int = 12,
    reject: float = 0.3,
    seed: int = 7,
) -> LanguageModel:
    """Learn from labelled rows; those with a null language or text, or without a letter, teach nothing.

    ``per_language`` bounds the documents of each language that are clustered on the driver (chosen by a hash of the
    id, over all rows); document frequencies come from every row.  Without any labelled row the
    model knows no language and answers ``und`` to all.
    """
    labelled = train.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(dims, np.int64), 0
        for block in blocks(batches, "text"):
            for at in range(0, block.num_rows, _ROWS):
                part = block.column(0).slice(at, _ROWS)
                total += (gram_counts(part, dims) > 0).sum(axis=0)
                rows += len(part)
        # Dimension -1 carries the number of documents.
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, dims), pa.int32()), pa.array(np.concatenate([[rows], total]), pa.int64())], names=["dim", "n"]
        )

    counted = labelled.select("text").mapInArrow(frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n"))
    by_dim = {row["dim"]: row["n"] for row in counted.collect()}  # dims + 1 rows
    documents = by_dim.get(-1, 0)
    df = np.array([by_dim.get(i, 0) for i in range(dims)], np.float64)
    idf = (np.log((1.0 + documents) / (1.0 + df)) + 1.0).astype(np.float32)
    if not documents:
        return LanguageModel((), np.zeros((0, dims), np.float32), idf, np.zeros(0), 1.0, reject)

    chosen = hashed_sample(labelled.filter(F.col("id").isNotNull()), "lang", per_language)
    # At most per_language rows for each language.
    sample = labelled.join(F.broadcast(chosen), ["lang", "id"], "left_semi").dropDuplicates(["lang", "id"])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            for at in range(0, block.num_rows, _ROWS):
                part = block.slice(at, _ROWS)
                counts = gram_counts(part.column(2), dims)
                at_dims = [np.flatnonzero(row) for row in counts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1).cast(pa.string()),
                        pa.array(at_dims, pa.list_(pa.int32())),
                        pa.array([counts[i, d] for i, d in enumerate(at_dims)], pa.list_(pa.float32())),
                    ],
                    names=["lang", "id", "dims", "counts"],
                )

    rows = (
        sample.select("lang", F.col("id").cast("string").alias("id"), "text")
        .mapInArrow(sparse, "lang string, id string, dims array<int>, counts array<float>").collect()
    )
    grouped: dict[str, list[np.ndarray]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["id"])):
        dense = np.zeros(dims, np.float32)
        dense[row["dims"]] = row["counts"]
        grouped.setdefault(row["lang"], []).append(dense)
    languages, centroids, usual, grams = [], [], [], []
    for lang, counts in grouped.items():
        vectors = _vectors(np.stack(counts), idf)
        found = _clusters(vectors, clusters, rounds, seed)
        cosines = (vectors @ found.T).max(axis=1)
        grams += [c.sum() for c in counts]
        for centroid in found:
            languages.append(lang)
            centroids.append(centroid)
            usual.append(float(np.median(cosines)))
    return LanguageModel(tuple(languages), np.stack(centroids), idf, np.array(usual), float(np.median(grams)), reject)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4; never for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows whose language is recognised, unchanged and in any multiplicity; null, letterless and unlike texts go."""
    name = unused(docs, "_language")
    found = docs.withColumn(name, model.column(F.col(text_col)))
    return found.filter(~F.col(name)["rejected"]).drop(name)


def language_report(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for each row of ``docs``, repeated rows included."""
    found = docs.select("doc_id", held_out().alias("held_out"), model.column(F.col("text")).alias("found"))
    return found.select(
        "doc_id", "held_out", F.col("found")["lang"].alias("lang_pred"), F.col("found")["score"].alias("score"), F.col("found")["rejected"].alias("rejected")
    )
