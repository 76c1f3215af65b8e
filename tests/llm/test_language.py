import math
import zlib

import numpy as np
import pyarrow as pa

from earshot.llm import language

WORDS = {
    "en": "the and of with that this from have which their would there about other",
    "de": "der und die nicht mit einer werden auch über zwischen durch gegen schön",
    "fr": "le et des avec une être pour dans leur même où après français",
}


def corpus(n=90):
    rows = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        words = WORDS[lang].split()
        rows.append((i, " ".join(words[(i * 7 + k * (1 + i % 5)) % len(words)] for k in range(30)), lang, "a"))
    return rows


def test_held_out_accuracy_and_odd_rows(spark):
    odd = [
        (1000, None, "en", "a"), (1001, "", None, "a"), (1002, "1234 !!! 99", "de", "a"), (1003, "the " * 200_000, None, "a"),
        (1003, "the " * 200_000, None, "a"), (None, "und die der nicht werden", None, None), (1004, "你好", None, "a"),
    ]
    docs = spark.createDataFrame(corpus() + odd, "doc_id long, text string, lang string, lang_pred string")
    model = language.fit_languages(docs.filter(~language.held_out()), per_language=20)
    got = language.language_report(docs, model).collect()
    assert len(got) == 90 + len(odd)
    truth = {r[0]: r[2] for r in corpus()}
    for row in got:
        assert 0.0 <= row.score <= 1.0
        if row.doc_id is not None:
            assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        else:
            assert row.held_out is False and row.lang_pred == "de"
        if row.doc_id in truth:
            assert row.lang_pred == truth[row.doc_id] and not row.rejected
        if row.doc_id in (1000, 1001, 1002):
            assert row.lang_pred == "und" and row.rejected and row.score == 0.0
        if row.doc_id == 1003:
            assert row.lang_pred == "en"
        if row.doc_id == 1004:
            assert row.lang_pred in WORDS and row.rejected


def test_keeping_leaves_rows_as_they_are(spark):
    docs = spark.createDataFrame(corpus() + [(500, None, "en", "x"), (0, corpus()[0][1], "en", "a")], "doc_id long, text string, lang string, _language string")
    kept = language.keep_identified(docs, language.fit_languages(docs))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*range(90), 0])


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.fit_languages(empty)
    assert language.language_report(empty, model).collect() == []
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    row = language.language_report(docs, language.fit_languages(docs)).first()
    assert (row.lang_pred, row.score, row.rejected) == ("und", 0.0, True)


def test_long_texts_are_counted_in_chunks():
    text = pa.array(["der und die " * 300, "x"])
    assert np.array_equal(language.gram_counts(text, 512, chunk=1 << 20), language.gram_counts(text, 512, chunk=97))


def plain_counts(text, dims):
    """N-grams of two and three bytes, one at a time."""
    low = bytes(b if 97 <= b < 123 or b >= 128 else 32 for b in f" {text.lower()} ".encode())
    counts = {}
    for size, mark in ((2, 0), (3, 1 << 24)):
        for i in range(len(low) - size + 1):
            gram = low[i : i + size]
            if gram.strip(b" "):
                dim = ((int.from_bytes(gram, "big") | mark) * 2654435761 % (1 << 32) >> 7) % dims
                counts[dim] = counts.get(dim, 0) + 1
    return counts


def plain_vector(counts, idf):
    weights = {d: math.log(1 + n) * idf[d] for d, n in counts.items()}
    norm = math.sqrt(sum(w * w for w in weights.values()))
    return {d: w / norm for d, w in weights.items()}


def test_equals_tf_idf_and_cosines_one_at_a_time(spark):
    dims, rows = 512, corpus(60)
    model = language.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string, x string"), dims=dims, per_language=1000, clusters=1)
    counts = [plain_counts(text, dims) for _, text, _, _ in rows]
    idf = [math.log((1 + len(rows)) / (1 + sum(d in c for c in counts))) + 1 for d in range(dims)]
    centroids = {}
    for (_, _, lang, _), count in zip(rows, counts):
        for d, w in plain_vector(count, idf).items():
            centroids.setdefault(lang, {}).setdefault(d, []).append(w)
    centroids = {lang: {d: sum(ws) for d, ws in c.items()} for lang, c in centroids.items()}
    norms = {lang: math.sqrt(sum(w * w for w in c.values())) for lang, c in centroids.items()}
    texts = [r[1] for r in rows] + ["the und le", "with mit avec", "über", "zzz qqq", "The Of AND", "das ist ein kurzer satz", "b"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for row in language.language_report(docs, model).collect():
        own = plain_vector(plain_counts(texts[row.doc_id], dims), idf)
        cosines = {lang: sum(w * c.get(d, 0) for d, w in own.items()) / norms[lang] for lang, c in centroids.items()}
        assert abs(row.score - max(cosines.values())) < 1e-4
        assert cosines[row.lang_pred] > max(cosines.values()) - 1e-4


def test_equal_cosines_go_to_the_first_centroid():
    idf = np.ones(64, np.float32)
    same = np.full((2, 64), 1 / 8, np.float32)
    model = language.LanguageModel(("de", "en"), same, idf, np.ones(2), 1.0, 0.1)
    assert model.predict(pa.array(["some text"])).to_pylist()[0]["lang"] == "de"


def test_pipeline_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language.language_report(docs, language.fit_languages(docs.filter(~language.held_out()))).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out and lang is not null").collect()
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert got.filter("rejected").count() == 0
