"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that any match must contain.  A scan
cuts each partition into blocks of documents, builds every block's postings for the trigrams that the rules
ask for, evaluates each rule's query by intersecting and uniting those postings, and runs the regular
expression over the candidates only.  A rule whose query is empty (no mandatory trigram) scans every document.

Blocks are local to a task: nothing is shuffled, and memory is bounded by the block, not by a posting list of the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from re import _parser as syntax

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from earshot.llm.arrow import ascii_lower, blocks, utf8

#: How many alternative literals a part of an expression may expand to.
MOST_LITERALS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(word: str) -> str:
    """An expression for ``word`` with ASCII letters in either case (and no other case folding)."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isascii() and c.isalpha() else c for c in word)


_KEYWORDS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))

BASE_RULES = (
    Rule("assign", rf"({_KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)
EXTRA_RULES = (
    Rule("private_key", r"-----BEGIN[A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"[Bb]earer [A-Za-z0-9._~+/=-]+", least=27),
    Rule("url_login", r"://[A-Za-z0-9._%-]+:[A-Za-z0-9._%-]+@"),
)
RULES = BASE_RULES + EXTRA_RULES


# -- Boolean trigram queries -------------------------------------------------------------------------------------
# A query is None (says nothing), a trigram (int), or ("and" | "or", [queries]).


def _gram(three: bytes) -> int:
    return three[0] << 16 | three[1] << 8 | three[2]


def _both(queries: Iterable) -> object:
    said = [q for q in queries if q is not None]
    return None if not said else said[0] if len(said) == 1 else ("and", said)


def _one_of(queries: Iterable) -> object:
    said = list(queries)
    return None if not said or any(q is None for q in said) else said[0] if len(said) == 1 else ("or", said)


def _of_literals(literals: set[str]) -> object:
    def one(text: str):
        raw = text.encode()
        return _both(sorted({_gram(raw[i : i + 3]) for i in range(len(raw) - 2)}))

    return _one_of(one(x) for x in sorted(literals))


def _literals(op, arg, folded: bool) -> set[str] | None:
    """All strings, ASCII-lowered, that one element of an expression can match, if they are few."""
    if op is syntax.LITERAL:
        c = chr(arg)
        return None if folded and not c.isascii() else {c.lower() if c.isascii() else c}
    if op is syntax.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is syntax.LITERAL:
                values = [value]
            elif kind is syntax.RANGE and value[1] - value[0] < 8:
                values = range(value[0], value[1] + 1)
            else:
                return None
            for v in values:
                got = _literals(syntax.LITERAL, v, folded)
                if got is None:
                    return None
                chars |= got
        return chars if len(chars) <= 8 else None
    if op is syntax.SUBPATTERN:
        return _sequence_literals(arg[-1], folded or bool(arg[1] & re.IGNORECASE))
    if op is syntax.BRANCH:
        parts = [_sequence_literals(x, folded) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (syntax.MAX_REPEAT, syntax.MIN_REPEAT):
        least, most, item = arg
        inner = _sequence_literals(item, folded) if most in (0, 1) or least == most <= 4 else None
        if inner is None:
            return None
        grown = {""}
        for _ in range(least):
            grown = {a + b for a in grown for b in inner}
            if len(grown) > MOST_LITERALS:
                return None
        return grown if least == most else grown | inner
    if op is syntax.AT:
        return {""}
    return None


def _sequence_literals(sequence, folded: bool) -> set[str] | None:
    out = {""}
    for op, arg in sequence:
        part = _literals(op, arg, folded)
        if part is None or len(out) * len(part) > MOST_LITERALS:
            return None
        out = {a + b for a in out for b in part}
    return out


def _query(sequence, folded: bool) -> object:
    found, run = [], {""}
    for op, arg in sequence:
        part = _literals(op, arg, folded)
        if part is not None and len(run) * len(part) <= MOST_LITERALS:
            run = {a + b for a in run for b in part}
            continue
        found.append(_of_literals(run))
        run = part if part is not None else {""}
        if part is None:
            if op is syntax.SUBPATTERN:
                found.append(_query(arg[-1], folded or bool(arg[1] & re.IGNORECASE)))
            elif op is syntax.BRANCH:
                found.append(_one_of(_query(x, folded) for x in arg[1]))
            elif op in (syntax.MAX_REPEAT, syntax.MIN_REPEAT) and arg[0] >= 1:
                found.append(_query(arg[2], folded))
    return _both([*found, _of_literals(run)])


def trigram_query(pattern: str) -> object:
    """The Boolean query over trigrams of ASCII-lowered UTF-8 that every match of ``pattern`` satisfies; None: any text may match."""
    parsed = syntax.parse(pattern)
    return _query(parsed, bool(parsed.state.flags & re.IGNORECASE))


def grams_of(query: object) -> set[int]:
    """All trigrams that a query mentions."""
    if query is None:
        return set()
    return {query} if isinstance(query, int) else set().union(*map(grams_of, query[1]))


# -- Index and search of one block ------------------------------------------------------------------------------


class BlockIndex:
    """Postings (sorted row numbers) of chosen trigrams in one block of documents."""

    _lower = ascii_lower()

    def __init__(self, grams: list[int]):
        self._grams = grams
        self._number = np.zeros(1 << 24, np.uint16)  # of each trigram, from 1; 0: not asked for
        self._number[grams] = np.arange(1, len(grams) + 1)

    def load(self, column: pa.Array) -> BlockIndex:
        data, offsets = utf8(column)
        self.rows = np.arange(len(column))
        self.postings = {}
        if len(data) < 3:
            return self
        low = self._lower[data].astype(np.uint32)
        number = self._number[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
        at = np.flatnonzero(number)
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[row + 1]
        pairs = np.unique(number[at[inside]].astype(np.int64) << 32 | row[inside])
        numbers, rows = pairs >> 32, pairs & 0xFFFFFFFF
        cuts = np.searchsorted(numbers, np.arange(1, len(self._grams) + 2))
        self.postings = {g: rows[cuts[i] : cuts[i + 1]] for i, g in enumerate(self._grams)}
        return self

    def search(self, query: object) -> np.ndarray:
        if query is None:
            return self.rows
        if isinstance(query, int):
            return self.postings.get(query, self.rows[:0])
        kind, parts = query
        found = sorted((self.search(q) for q in parts), key=len)
        out = found[0]
        for other in found[1:]:
            out = np.intersect1d(out, other, assume_unique=True) if kind == "and" else np.union1d(out, other)
        return out


def _spans(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's secrets: (``id_col``, ``spans``: array of (kind, start, end)).

    Per rule the matches are leftmost and non-overlapping, those too short dropped afterwards; positions count code
    points, the end exclusive.  Spans are ordered by start, then by rule.  One row per input row, in any multiplicity:
    a null or empty text has no spans, a null id stays null, other columns are ignored.
    """
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    grams = sorted(set().union(*map(grams_of, queries.values())))
    ids = docs.schema[id_col].dataType
    span = T.StructType().add("kind", T.StringType()).add("start", T.LongType()).add("end", T.LongType())
    schema = T.StructType().add("id", ids).add("spans", T.ArrayType(span))
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = BlockIndex(grams)
        compiled = {rule.kind: re.compile(rule.pattern) for rule in rules}
        for block in blocks(batches, "text"):
            column = block.column(1)
            index.load(column)
            found: dict[int, list] = {}
            texts: dict[int, str] = {}
            for order, rule in enumerate(rules):
                for row in index.search(queries[rule.kind]).tolist():
                    text = texts.get(row)
                    if text is None:
                        text = texts[row] = column[row].as_py() or ""
                    for start, end in _spans(rule, compiled[rule.kind], text):
                        found.setdefault(row, []).append((start, order, end))
            spans = [
                [{"kind": rules[o].kind, "start": s, "end": e} for s, o, e in sorted(found.get(row, ()))]
                for row in range(block.num_rows)
            ]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(spans, kind_type)], names=["id", "spans"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and digests of ``scan_secrets`` over ``doc_id`` and ``text``, one row per document."""
    found = scan_secrets(docs, rules)
    base = [r.kind for r in BASE_RULES]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in base]
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *counts, F.sha2(joined(of_base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def report_sql() -> str:
    """The same in SQL: with a lazy gap before each match, gaps and matches give positions by running sums."""

    def literal(pattern: str) -> str:
        return pattern.replace("'", "''")

    parts = []
    for order, rule in enumerate(RULES):
        value = 2 + rule.group
        pattern = literal(f"(?s)(.*?)({rule.pattern})")
        parts.append(
            f"select row, '{rule.kind}' as kind, {order} as ord, {rule.least} as least, "
            f"unnest(regexp_extract_all(t, '{pattern}', 1)) as gap, unnest(regexp_extract_all(t, '{pattern}', 2)) as hit, "
            f"unnest(regexp_extract_all(t, '{pattern}', {value})) as val, "
            f"generate_subscripts(regexp_extract_all(t, '{pattern}', 1), 1) as i from d"
        )
    counts = ", ".join(f"count(kind) filter (kind = '{r.kind}') as n_{r.kind}" for r in BASE_RULES)
    kinds = ", ".join(f"'{r.kind}'" for r in BASE_RULES)
    span = "kind || ':' || s || ':' || e"
    return (
        "with d as (select row_number() over () as row, doc_id, coalesce(text, '') as t from documents), "
        f"raw as ({' union all '.join(parts)}), "
        "ended as (select *, sum(length(gap) + length(hit)) over (partition by row, kind order by i) as e from raw), "
        "spans as (select row, kind, ord, cast(e - length(hit) as bigint) as s, cast(e as bigint) as e from ended where length(val) >= least) "
        f"select any_value(doc_id) as doc_id, {counts}, "
        f"sha256(coalesce(string_agg({span}, ',' order by s, ord) filter (kind in ({kinds})), '')) as base_sha256, "
        f"coalesce(string_agg({span}, ',' order by s, ord), '') as spans "
        "from d left join spans using (row) group by row"
    )
