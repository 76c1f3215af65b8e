"""Joins and components that survive a key holding a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from earshot.llm.arrow import unused
from earshot.session import written, written_for_now

SALTS = 16


#: A written table of up to so many bytes may be sent to every task.
SMALL_BYTES = 8 << 20


def table_bytes(written_table: DataFrame) -> int:
    """The size of a table that was read from files, as its files have it."""
    return int(str(written_table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def checked_join(facts: DataFrame, lookup: DataFrame, keys: list[str], how: str, by: list[str], of: DataFrame, salts: int = SALTS) -> DataFrame:
    """``facts`` joined to ``lookup``, columns and rows of the written table ``of`` or less: broadcast if ``of`` is small, else a ``salted_join``."""
    if table_bytes(of) <= SMALL_BYTES:
        return facts.join(F.broadcast(lookup), keys, how)
    return salted_join(facts, lookup, keys, how, by, salts)


def salted_join(facts: DataFrame, lookup: DataFrame, keys: list[str], how: str, by: list[str], salts: int = SALTS) -> DataFrame:
    """``facts`` joined to the smaller ``lookup`` with each key's rows spread over ``salts`` tasks by the columns ``by``.

    Each lookup row is copied ``salts`` times.  ``how``: inner, left, left_semi or left_anti.  The copies are merged, never broadcast:
    their number is not in the size that Spark would judge by.
    """
    salt = unused(facts, "_salt")
    spread = lookup.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = facts.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    return dealt.join(spread.hint("merge"), [*keys, salt], how).drop(salt)


def hashed_sample(rows: DataFrame, group: str, most: int) -> DataFrame:
    """Up to ``most`` distinct rows (``group``, id) of each group, chosen by a hash of the id over all rows.

    ``group`` must have few values, such as languages: their counts are broadcast.  A threshold on the hash brings a group down to
    about three times ``most`` rows before they meet in one place.
    """
    known = rows.select(group, "id").distinct()
    sizes = known.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    near = known.join(F.broadcast(sizes), group).filter(place * F.col("_size") < 3 * most + 100)
    first = Window.partitionBy(group).orderBy(F.xxhash64("id"), "id")
    return near.withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") <= most).select(group, "id")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (a, b); a component is named by its smallest node.

    Each round every node joins the member of its closed neighbourhood that comes first, after the first round by a hash of its own, and the
    edges are contracted; the number of labels falls by a constant factor a round, whatever the shape of the graph.
    Minima are built map-side and joins are salted, so a node with very many neighbours does no harm.
    Nothing but a row count leaves the executors; the tables of the rounds are removed at the end.
    """
    current, drop_edges = written_for_now(edges.select("a", "b").filter("a != b").distinct(), "edges")
    rounds: list[DataFrame] = []
    drops = []
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # The first round goes by the nodes themselves, which settles stars around their smallest node at once.
        def rank(node: str, turn: int = len(rounds)) -> Column:
            return F.xxhash64(F.lit(turn), node) if turn else F.lit(0).cast("bigint")

        first = F.min(F.struct(rank("b").alias("h"), F.col("b").alias("n")))
        own = F.struct(rank("a").alias("h"), F.col("a").alias("n"))
        parent = both.groupBy("a").agg(first.alias("best")).select(F.col("a").alias("node"), F.least("best", own)["n"].alias("parent"))
        parent, drop_parent = written_for_now(parent, "parents")
        drops.append(drop_parent)
        for side in ("a", "b"):
            ends = parent.select(F.col("node").alias(side), F.col("parent").alias("_to"))
            current = checked_join(current, ends, [side], "inner", ["a", "b"], of=parent).withColumn(side, F.col("_to")).drop("_to")
        pair = current.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        current, drop_next = written_for_now(pair.distinct(), "edges")
        drop_edges()
        drop_edges = drop_next
        rounds.append(parent)
    if not rounds:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels, drop_labels = rounds[-1], drops.pop()
    for parent, drop_parent in zip(reversed(rounds[:-1]), reversed(drops), strict=True):
        onward = labels.select(F.col("node").alias("parent"), F.col("parent").alias("_to"))
        named = checked_join(parent, onward, ["parent"], "left", ["node"], of=labels).select("node", F.coalesce("_to", "parent").alias("parent"))
        named, drop_named = written_for_now(named, "labels")
        drop_labels()
        drop_parent()
        labels, drop_labels = named, drop_named
    names = labels.groupBy("parent").agg(F.min("node").alias("component"))
    # The label itself is a node of the component but need not be the smallest; it is covered by its own row or by its own name.
    names = names.withColumn("component", F.least("component", "parent"))
    named = written(checked_join(labels, names, ["parent"], "inner", ["node"], of=labels).select("node", "component"), "components")
    drop_edges()
    drop_labels()
    return named
