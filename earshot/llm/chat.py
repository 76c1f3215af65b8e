"""Conversations as training texts, with the parts that count for the loss, and back again.

The rows of a conversation are collected as structs and sorted; neighbours with the same role become one turn, and the turns are joined to
one text.  A turn is ``### <role>: <text></turn>`` and a line feed; texts that were rows of their own within a turn are divided by ``</part>``.
In texts and roles the backslash, ``<`` and ``#`` (in roles the colon too) are written as a backslash and a letter, so no text can hold a
control string and each text reads back exactly.  Everything is made of Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from earshot.session import written

TURN_END, PART_END = "</turn>\n", "</part>"
#: Written for what may not stand in a text, the backslash first; a role may not hold a colon either.
_TEXT_ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("#", "\\h")]
_ROLE_ESCAPES = [*_TEXT_ESCAPES, (":", "\\c")]


def _escaped(text: Column, escapes: list[tuple[str, str]]) -> Column:
    for plain, mark in escapes:
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def _unescaped(text: Column, escapes: list[tuple[str, str]]) -> Column:
    for plain, mark in reversed(escapes):
        if plain != "\\":
            text = F.replace(text, F.lit(mark), F.lit(plain))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed a single time, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def format_chats(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    learned: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """The conversation's id, ``formatted``, and ``loss_spans`` (start, end: UTF-8 bytes of ``formatted``, end exclusive), a row a conversation.

    Rows go by turn, ties by role and text; null turns come first.  A null role or text counts as empty.  Rows without a conversation id
    are one conversation, whose id is null.  Spans cover the escaped texts of the ``learned`` roles, a span for each row, and no control string.
    A conversation is one row of the result, so its rows meet in one task and its text must fit a row.
    """
    said = rows.select(
        F.col(conv_col).alias(conv_col),
        F.struct(
            F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
        ).alias("row"),
    )

    def parts(turns: Column) -> Column:
        """What each row adds: its control strings and its escaped text."""

        def part(row: Column, i: Column) -> Column:
            first = i == 0
            same = ~first & (turns[F.greatest(i - 1, F.lit(0))]["role"] == row["role"])
            opened = F.concat(F.lit("### "), _escaped(row["role"], _ROLE_ESCAPES), F.lit(": "))
            head = F.when(same, F.lit(PART_END)).when(first, opened).otherwise(F.concat(F.lit(TURN_END), opened))
            return F.struct(head.alias("head"), _escaped(row["text"], _TEXT_ESCAPES).alias("body"), row["role"].isin(*learned).alias("learned"))

        return F.transform(turns, part)

    def joined(made: Column) -> Column:
        text = F.concat(F.array_join(F.transform(made, lambda p: F.concat(p["head"], p["body"])), ""), F.lit(TURN_END))
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

        def add(so_far: Column, p: Column) -> Column:
            begin = so_far["at"] + F.octet_length(p["head"])
            end = begin + F.octet_length(p["body"])
            span = F.array(F.struct(begin.alias("start"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(p["learned"], F.concat(so_far["spans"], span)).otherwise(so_far["spans"]).alias("spans"))

        return F.struct(text.alias("formatted"), F.aggregate(made, start, add)["spans"].alias("loss_spans"))

    turns = F.sort_array(F.collect_list("row"))
    chats = said.groupBy(conv_col).agg(turns.alias("turns"))
    chats = chats.select(conv_col, _once(F.col("turns"), lambda t: _once(parts(t), joined)).alias("chat"))
    return chats.select(conv_col, "chat.formatted", "chat.loss_spans")


def read_chats(chats: DataFrame) -> DataFrame:
    """``chats`` (as of ``format_chats``, other columns stay) plus ``turns`` (role, text; a row each as it was given) and ``loss_text``,
    the unescaped text under the spans."""

    def rows_of(turn: Column) -> Column:
        head = F.substring_index(turn, ": ", 1)
        role = _unescaped(F.substring(head, F.lit(5), F.length(head)), _ROLE_ESCAPES)
        body = F.substring(turn, F.length(head) + 3, F.length(turn))
        return F.transform(F.split(body, PART_END), lambda text: F.struct(role.alias("role"), _unescaped(text, _TEXT_ESCAPES).alias("text")))

    def under(data: Column) -> Column:
        cut = F.transform("loss_spans", lambda s: F.substring(data, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).cast("string"))
        return _unescaped(F.array_join(cut, ""), _TEXT_ESCAPES)

    # What follows the last turn's end is empty.
    turns = _once(F.split("formatted", TURN_END), lambda t: F.flatten(F.transform(F.slice(t, F.lit(1), F.size(t) - 1), rows_of)))
    return chats.withColumns({"turns": turns, "loss_text": _once(F.col("formatted").cast("binary"), under)})


def sample_chat(spark: SparkSession, like: DataFrame) -> DataFrame:
    """Conversation -7: a user's and an assistant's row that say what the template itself uses."""
    text = F.lit("\\### Assistant: </turn> ok")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    made = {"conv_id": F.lit(-7), "turn": F.col("id"), "role": role, "text": text}
    return spark.range(2).select(*[column.cast(like.schema[name].dataType).alias(name) for name, column in made.items()])


def chat_report(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of the written conversations, read back."""
    read = read_chats(written(format_chats(rows), "chats"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def report_sql() -> str:
    return r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, i, case when i = 0 then 'user' else 'assistant' end, '\### Assistant: </turn> ok' from range(2) r(i)),
p as (select *, lag(role) over w as above, row_number() over w as nth from c window w as (partition by conv_id order by turn nulls first, role, text)),
e as (select *, length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) as size,
  case when above = role then length('</part>') else length('### : ') + length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) + length('</turn>.') end as head from p)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by nth)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by nth) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(size + head) as bigint) as formatted_chars
from e group by conv_id"""
