"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepipe.llm.common import stored


def _ordered(node: str, turn: int) -> Column:
    """A node behind a hash that changes every other turn.

    A chain of nodes in falling order must not shrink one by one; the leaves of a star meet in the second turn of an order,
    when its least node is the hub.
    """
    return F.struct(F.xxhash64(F.lit(turn // 2), node).alias("by"), F.col(node).alias("node"))


def _moves(links: DataFrame, turn: int) -> DataFrame:
    """(node, to): the first of each node and its neighbours in the order of ``turn``.

    It comes from an aggregate with a map side, so a hub's neighbours meet in no task.
    """
    sides = F.array(F.struct(F.col("a").alias("node"), _ordered("b", turn).alias("next")),
                    F.struct(F.col("b").alias("node"), _ordered("a", turn).alias("next")))
    near = links.select(F.inline(sides)).groupBy("node").agg(F.min("next").alias("next"))
    return near.select("node", F.least(_ordered("node", turn), "next")["node"].alias("to"))


def _contracted(links: DataFrame, moves: DataFrame) -> DataFrame:
    """The links between the nodes that were moved to; those inside one are gone."""
    for side in "ab":
        there = moves.select(F.col("node").alias(side), F.col("to").alias(f"to_{side}"))
        links = links.join(there, side)
    moved = links.where("to_a != to_b")
    return moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b); root is the least node it can reach.

    Loops and repeated links do no harm; without links the result is empty. In each round every node moves to one of its
    neighbours, or stays, and the links go with it until none are left: some half of the nodes are gone in a round, and
    stars in two. Each round is stored, and whether links are left is all of it that reaches the driver.
    """
    now = stored(links.select("a", "b").where("a != b").distinct(), "links")
    rounds: list[DataFrame] = []
    while not now.isEmpty():
        rounds.append(stored(_moves(now, len(rounds)), "moves"))
        now = stored(_contracted(now, rounds[-1]), "links")
    if not rounds:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[0]
    for moves in rounds[1:]:
        later = moves.select(F.col("node").alias("to"), F.col("to").alias("then"))
        found = found.join(later, "to", "left").select("node", F.coalesce("then", "to").alias("to"))
    found = stored(found, "met")
    least = found.groupBy("to").agg(F.min("node").alias("root"))
    return found.join(least, "to").select("node", "root")
