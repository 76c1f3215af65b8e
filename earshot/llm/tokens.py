"""Token ids of whole texts with public tokenizers, inside tasks."""

from __future__ import annotations

import os
import re
import sys
import types
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from earshot.llm.arrow import utf8

#: From so many pieces on, a worker remembers only those that came again; if these are more than half as many, it begins anew.
REMEMBERED = 400_000
_NEAR = 1 << 18  # bytes of text that are gone through together

#: A word of Latin letters or a run of punctuation: one unit for the model, whichever tokenizer.  U+0130 is left out, as
#: its lower case is two characters, which tokenizers treat in their own ways.
_UNIT = re.compile(r" ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+|[!-/:-@\[-`{-~]+)")


def _cuts(data: np.ndarray) -> np.ndarray:
    """Where UTF-8 texts, one after the other, may be cut so that encoding the parts equals encoding the whole; beside their ends.

    A cut is made before a space or a line break that follows something else than white space, after a line break that stands alone,
    and between a Latin letter and ASCII punctuation, except after an apostrophe and at a bar, which special tokens hold.
    """
    cut = np.zeros(len(data), bool)
    if not len(data):
        return cut
    letter = (data | 32) - np.uint8(97) < 26
    printed = data - np.uint8(33) < 94
    mark = printed & ~letter & (data - np.uint8(48) >= 10) & (data != ord("|"))
    solid, opens, ends, begins = printed, printed, letter, letter
    if (data >= 128).any():
        # U+00C0 to U+023F are letters but for two signs; U+0130 may become a letter and a mark.
        latin = data - np.uint8(0xC3) < 6
        latin[:-1] &= (data[:-1] != 0xC3) | (data[1:] != 0x97) & (data[1:] != 0xB7)
        latin[:-1] &= (data[:-1] != 0xC4) | (data[1:] != 0xB0)
        begins = letter | latin
        ends = letter.copy()
        ends[1:] |= latin[:-1]
        # White space beyond ASCII ends, among others, with these bytes, and begins with these.
        blank = data - np.uint8(0x80) < 48
        blank[1:] &= (data[:-1] - np.uint8(0x80) < 2) | (data[:-1] == 0x9A) | (data[:-1] == 0xC2)
        solid = printed | (data >= 128) & ~blank
        opens = printed | (data >= 0xC3) & ~(data - np.uint8(0xE1) < 3)
    line = data == ord("\n")
    np.logical_and((data == ord(" ")) | line, np.append(False, solid[:-1]), out=cut)
    cut[1:] |= ends[:-1] & mark[1:] | mark[:-1] & (data[:-1] != ord("'")) & begins[1:]
    cut[1:] |= line[:-1] & cut[:-1] & opens[1:]
    return cut


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as a character: itself where that is visible, else the next one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _library(path: str):
    """The tokenizer at ``path``, which is a file or a name that the installed public collection knows."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path if os.path.exists(path) else public_tokenizers.path(path))


class Encoder:
    """Ids by the tokenizers library without special tokens, equal to encoding each text whole.

    Both supported kinds cut a text before they look words up.  So a text is cut beforehand where either cuts it in any case, and
    each distinct piece, with the space before it, is encoded once and remembered.
    """

    def __init__(self, path: str):
        self._tokenizer = _library(path)
        self._keeps_space = len(self._encode([" "])[0]) > 0
        # Between pieces that are encoded together; it becomes one id that none of them can give.
        self._mark = "\n" if self._keeps_space else " | "
        self._mark_id = self._encode([self._mark])[0][0]
        self._letters = _byte_letters()
        # Whether words can go to the model past the library's cutting, which takes most of its time.
        trial = [" Word", " naïve", ",", " STRASSE", "!!", "Ÿe", " |", "'", "Begin", "\u00c9t\u00e9", " .."]
        self._direct = sys.byteorder == "little" and all(
            array("I", ids).tobytes() == self._unit(piece) for piece, ids in zip(trial, self._encode(trial), strict=True)
        )
        self._forget()

    def _forget(self) -> None:
        self._known = pa.array([], pa.large_string())
        self._flat = np.empty(0, "<u4")  # the ids of the known pieces
        self._at = np.zeros(1, np.int64)  # where each one's begin, and the last's end
        self._again = np.empty(0, bool)  # which of them came again

    def _keep_some(self) -> None:
        kept, ids = np.flatnonzero(self._again), np.repeat(self._again, np.diff(self._at))
        if len(kept) > REMEMBERED // 2:
            self._forget()
            return
        self._known, self._flat = self._known.take(pa.array(kept)), self._flat[ids]
        self._at = np.append(0, np.cumsum(np.diff(self._at)[kept]))
        self._again = np.zeros(len(kept), bool)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _unit(self, piece: str) -> bytes:
        """The ids of a piece that the library would not cut."""
        text = piece if self._keeps_space else piece.lstrip(" ").lower()
        if text.isascii():
            spelled = text.replace(" ", self._letters[32])
        else:
            spelled = text.encode().decode("latin-1").translate(self._letters)
        return array("I", [t.id for t in self._tokenizer.model.tokenize(spelled)]).tobytes()

    def _fresh(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        together, alone = [], []
        for i, piece in enumerate(pieces):
            if self._direct and _UNIT.fullmatch(piece):
                out[i] = self._unit(piece)
            # One word without white space, but for a space before it, or the mark.
            elif "|" not in piece and piece.split() == [piece.removeprefix(" ")]:
                together.append(i)
            else:
                alone.append(i)
        for at in range(0, len(together), 5000):
            part = together[at : at + 5000]
            ids = np.array(self._encode([self._mark.join([pieces[i] for i in part])])[0], "<u4")
            cuts = np.flatnonzero(ids == self._mark_id)
            starts, ends = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
            if len(starts) != len(part):
                alone += part
                continue
            data = ids.tobytes()
            for i, start, end in zip(part, starts, ends, strict=True):
                out[i] = data[4 * start : 4 * end]
        for i, ids in zip(alone, self._encode([pieces[i] for i in alone]), strict=True):
            out[i] = np.array(ids, "<u4").tobytes()
        return out

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where distinct pieces stand among the known ones, which they join."""
        if len(self._known) > REMEMBERED:
            self._keep_some()
        places = pc.index_in(pieces, value_set=self._known)
        new = pieces.filter(places.is_null())
        places = places.fill_null(-1).to_numpy().astype(np.int64)
        self._again[places[places >= 0]] = True
        if len(new):
            self._again = np.append(self._again, np.zeros(len(new), bool))
            places[places < 0] = len(self._known) + np.arange(len(new))
            ids = self._fresh(new.to_pylist())
            self._known = pa.concat_arrays([self._known, new])
            self._flat = np.concatenate([self._flat, np.frombuffer(b"".join(ids), "<u4")])
            self._at = np.append(self._at, self._at[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4))
        return places

    def flat_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The little-endian unsigned 32-bit ids of all texts one after the other, and where each text's begin and the last's end.

        A null or empty text has none.
        """
        data, offsets = utf8(texts)
        cut = np.empty(len(data), bool)
        # Some texts at a time, for the sake of the processor's cache.
        row = 0
        while row < len(texts):
            end = max(int(np.searchsorted(offsets, offsets[row] + _NEAR, "right")) - 1, row + 1)
            cut[offsets[row] : offsets[end]] = _cuts(data[offsets[row] : offsets[end]])
            row = end
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, len(data))
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        place = self._places(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        begin = self._at[place]
        sizes = self._at[place + 1] - begin
        at = np.concatenate([[0], np.cumsum(sizes)])
        shift = begin - at[:-1]
        out = np.empty(at[-1], "<u4")
        for i in range(0, len(place), _NEAR // 4):
            some = slice(i, i + _NEAR // 4)
            a, b = at[i], at[min(some.stop, len(place))]
            np.take(self._flat, np.repeat(shift[some], sizes[some]) + np.arange(a, b), out=out[a:b], mode="clip")
        return out, at[np.searchsorted(starts, offsets)]

    def all_ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text its little-endian unsigned 32-bit ids; none for a null or empty text."""
        ids, at = self.flat_ids(pa.array(texts, pa.large_string()))
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def ids(self, text: str | None) -> np.ndarray:
        return self.all_ids([text])[0]


def encoder(path: str) -> Encoder:
    """The worker process' encoder of a tokenizer; Spark gives a worker many tasks, which share what it remembers."""
    held = sys.modules.setdefault("earshot_encoders", types.ModuleType("earshot_encoders")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]
