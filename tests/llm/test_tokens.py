import itertools
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from earshot.llm import packing, range_coder, token_files, tokens
from earshot.llm.tokens import Encoder

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
_MADE = {}


def both(name):
    if name not in _MADE:
        _MADE[name] = Tokenizer.from_file(public_tokenizers.path(name)), Encoder(name)
    return _MADE[name]


PARTS = ["a", "Word", " ", "  ", "\n", "\t", "\r\n", "'s", "'", "12", "É", "é", "ß", "Σ", "|", " | ", "<|endoftext|>", "<|startoftext|>", "!!", " ", " ", "\x1c", "\x85", "你好", "🙂", "̸", "x" * 300]


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=400, deadline=None)
@given(parts=st.lists(st.sampled_from(PARTS), max_size=14))
def test_ids_equal_encoding_whole(name, parts):
    whole, pieces = both(name)
    text = "".join(parts)
    assert pieces.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids


#: Every character that a word may hold which goes past the library's cutting, and U+0130, which may not.
LETTERS = [chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)]]


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=300, deadline=None)
@given(words=st.lists(st.text(st.sampled_from(LETTERS), min_size=1, max_size=8), max_size=6), end=st.sampled_from(["", ".", "!!", "\n"]))
def test_ids_of_words_of_all_letters(name, words, end):
    whole, pieces = both(name)
    text = " ".join(words) + end
    assert pieces.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids


#: What stands beside a place where texts are cut beforehand.
BESIDE = [
    "a", "Été", "ǅ", "ȿ", "\u0130", "×", "÷", "я", "你", "\u0307", "\u0338", "=", ",", ".\n", "\n", "\n\n", "\r\n", " ", "  ", "\t", "\x0b", "\x1c", "\x7f", "\x85", "\xa0",
    "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "'", "'s", "'LL", "’s", "|", "||", "<", "<|", "<|endoftext|>", "<|startoftext|>", "_", "7", "½", "\U0001f642", "\0", "ﬁ", "Ⅷ",
]


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=600, deadline=None)
@given(parts=st.lists(st.sampled_from(BESIDE), max_size=10))
def test_ids_equal_where_texts_are_cut(name, parts):
    whole, pieces = both(name)
    text = "".join(parts)
    assert pieces.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
def test_ids_equal_beside_every_pair(name):
    whole, pieces = both(name)
    texts = [f"x{a}{b}y" for a in BESIDE for b in BESIDE] + [f"{a} {b}" for a in BESIDE for b in BESIDE] + [f"b{a}\n{b}" for a in BESIDE for b in BESIDE]
    for text, ids in zip(texts, pieces.all_ids(texts), strict=True):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name", NAMES)
def test_every_letter_alone_and_within_a_word(name):
    whole, pieces = both(name)
    for letter in LETTERS:
        for text in (letter, f"the city {letter}stanbul lies", f"x{letter}, {letter}{letter}"):
            assert pieces.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("name", NAMES)
def test_all_short_mixes_of_white_space(name):
    whole, pieces = both(name)
    for n in range(6):
        for parts in itertools.product("a \n", repeat=n):
            text = "".join(parts)
            assert pieces.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name", NAMES)
def test_ids_of_given_texts(spark, name):
    whole, pieces = both(name)
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert pieces.ids(row.text).tolist() == whole.encode(row.text, add_special_tokens=False).ids
    assert pieces.ids(None).tolist() == []


def sequences():
    rng = np.random.default_rng(1)
    out = [np.empty(0, "<u4"), np.array([65535], "<u4"), np.zeros(3000, "<u4"), np.arange(2500, dtype="<u4") * 26 % 65536]
    out += [np.minimum(rng.zipf(1.3, n), 65535).astype("<u4") for n in (1, 2, 5, 700, 1500)]
    out.append(np.tile(rng.integers(0, 50000, 40).astype("<u4"), 50))
    return out


def test_coder_round_trip_and_independent_blocks():
    blocks = sequences()
    coded = range_coder.encode(blocks)
    back = range_coder.decode(coded, [len(b) for b in blocks])
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back))
    for block, code in zip(blocks, coded):
        assert range_coder.encode([block]) == [code]
        assert np.array_equal(range_coder.decode([code], [len(block)])[0], block)
    assert len(coded[2]) < 300 and len(coded[-1]) < 0.45 * 2 * len(blocks[-1])
    with pytest.raises(ValueError):
        range_coder.encode([np.array([65536], "<u4")])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65535), max_size=60), min_size=1, max_size=6))
def test_coder_round_trips_anything(blocks):
    arrays = [np.array(b, "<u4") for b in blocks]
    assert [b.tolist() for b in range_coder.decode(range_coder.encode(arrays), list(map(len, blocks)))] == blocks


def prose_ids(n):
    """Ids as in prose: some of them frequent, and phrases that come back."""
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.25, n), 50000).astype("<u4")
    for at in rng.integers(0, n - 400, n // 400):
        ids[at : at + 40] = ids[at + 200 : at + 240]
    return ids


def test_coder_takes_little_time_and_room():
    ids = prose_ids(1 << 20)
    blocks = [ids[i : i + 4096] for i in range(0, len(ids), 4096)]
    began = time.process_time()
    coded = range_coder.encode(blocks)
    back = range_coder.decode(coded, [len(b) for b in blocks])
    taken = time.process_time() - began
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back, strict=True))
    assert sum(map(len, coded)) < 1.15 * len(ids)  # beside 2 bytes an id
    assert taken < 4  # of the CPU; a coder that goes nibble by nibble takes twice that, this one a seventh


def test_coder_blocks_of_all_lengths_and_extremes():
    rng = np.random.default_rng(5)
    most = range_coder.BLOCK
    blocks = [rng.integers(0, 65536, n).astype("<u4") for n in (0, 1, 2, 3, most - 1, most, 17, 0, most)]
    blocks += [np.full(most, 65535, "<u4"), np.zeros(most, "<u4"), np.arange(most, dtype="<u4") * 8, np.tile(np.array([7, 9], "<u4"), most // 2)]
    coded = range_coder.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, range_coder.decode(coded, list(map(len, blocks))), strict=True))
    assert [range_coder.encode([b])[0] for b in blocks] == coded
    assert range_coder.decode([], []) == [] and range_coder.encode([]) == []
    with pytest.raises(ValueError):
        range_coder.encode([np.zeros(most + 1, "<u4")])


def test_damaged_blocks_are_errors_or_other_ids():
    ids = prose_ids(4096)[:600]
    code = range_coder.encode([ids])[0]
    for at in range(0, len(code), 7):
        bad = bytearray(code)
        bad[at] ^= 0x55
        for some in (bytes(bad), code[:at]):
            try:
                (got,) = range_coder.decode([some], [len(ids)])
            except ValueError:
                continue
            assert len(got) == len(ids)


def documents(spark):
    rows = [(5, "five five", "x"), (-3, None, "x"), (2, "", "x"), (2, "two  words \n here", "x"), (2, "two  words \n here", "x"), (None, "no id", "x"), (9, "long text " * 60_000, "x"), (7, "###", "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, start string")


def test_token_files_round_trip(spark):
    rows, docs = documents(spark)
    got = token_files.token_report(spark, docs.repartition(4)).collect()
    whole = both(NAMES[0])[0]
    expected = []
    for doc_id, text, _ in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((doc_id, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(expected, key=repr)
    at = 0
    for row in sorted(got, key=lambda r: r.start):
        assert row.start == at
        at += row.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])


def test_token_files_empty_table_and_damage(spark, tmp_path):
    _, docs = documents(spark)
    assert token_files.token_report(spark, docs.limit(0)).collect() == []
    folder = str(tmp_path / "ids")
    made = token_files.write_tokens(docs, folder)
    name = max(made.collect(), key=lambda r: r.ids).name
    raw = bytearray((tmp_path / "ids" / name).read_bytes())
    raw[60] ^= 1
    (tmp_path / "ids" / name).write_bytes(raw)
    with open(tmp_path / "ids" / name, "rb") as handle:

        class Sized:
            read, seek = handle.read, handle.seek

            def size(self):
                return len(raw)

        with pytest.raises(ValueError):
            list(token_files.read_file(Sized()))


def check_packing(spark, docs, packed, capacity=2048):
    whole = both(NAMES[1])[0]
    expected = sorted(
        ((d, [*whole.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in docs.select("doc_id", "text").toLocalIterator()), key=repr
    )
    rows = packed.collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, parts in by_doc.items():
        own = [ids for d, ids in expected if d == doc_id]
        assert sum(r.length for r in parts) == sum(map(len, own))
        if len(own) == 1:
            at = 0
            for r in sorted(parts, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(own[0])
                assert r.ids_crc32 == zlib.crc32(np.array(own[0][at : at + r.length], "<u4").tobytes())
                at += r.length
    assert len(by_doc) == len({d for d, _ in expected})
    used = [sum(n for _, n in p) for p in by_sequence.values()]
    return sum(capacity - u for u in used if u & (u - 1)), sum(used)


def test_packing_odd_rows(spark):
    _, docs = documents(spark)
    check_packing(spark, docs, packing.packed_documents(docs))
    assert packing.packed_documents(docs.limit(0)).collect() == []


def test_packing_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    padding, used = check_packing(spark, docs, packing.packed_documents(docs))
    assert padding < 0.01 * used


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "k l m")], "doc_id long, text string")
    packed = packing.pack(packing.token_pieces(docs, capacity=8, grain=4, with_ids=True), capacity=8)
    got = packing.sequences(packed).collect()
    assert sum(r.length for r in got) == 15 and all(len(r.ids) == 4 * r.length <= 32 for r in got)
    whole = both(NAMES[1])[0]
    ids = [*whole.encode("a b c d e f g h i j").ids, 1, *whole.encode("k l m").ids, 1]
    assert sorted(i for r in got for i in np.frombuffer(r.ids, "<u4").tolist()) == sorted(ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=40), st.integers(50, 120))
def test_windows_hold_and_are_near_equal(lengths, capacity):
    lengths = np.array(lengths)
    window = packing.windows_of(lengths, capacity)
    load = np.bincount(window, lengths)
    assert load.max() <= capacity and load.sum() == lengths.sum()
    assert load.max() - load.min() <= max(lengths.max(), 1)


def test_differencing_known_case():
    load = np.bincount(packing.differenced(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])
    assert sorted(load) == [14, 16]
    load = np.bincount(packing.differenced(np.array([4, 5, 6, 7, 8]), 3), [4, 5, 6, 7, 8])
    assert load.max() - load.min() <= 3


@pytest.mark.parametrize("name", NAMES)
def test_flat_ids_of_many_texts_and_words_that_come_back(name, monkeypatch):
    whole, pieces = both(name)
    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    for turn in range(6):
        texts = [None, "", " ", f"word{turn} again, again\nthere {turn}", "x \n  y", "\n z", "", *(f"w{chr(97 + turn)}{chr(97 + i)} the." for i in range(26))]
        ids, at = pieces.flat_ids(pa.array(["skipped", *texts])[1:])
        assert len(at) == len(texts) + 1 and at[-1] == len(ids)
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == whole.encode(text or "", add_special_tokens=False).ids, repr(text)
        assert len(pieces._known) < 20 + 60  # a block's own words at most beside what is remembered
    assert len(pieces.flat_ids(pa.array([], pa.string()))[0]) == 0
