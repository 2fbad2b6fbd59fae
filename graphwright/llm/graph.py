"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.llm.common import dropped, table


def components(edges: DataFrame, left: str = "a", right: str = "b", rounds: int | None = None) -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node of its component.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each
    shrinks the edges to stars in a number of rounds that grows with the
    logarithm of the longest path.  Every round is two grouped minima, with
    partial aggregation before the shuffle, joined back to the edges; it is
    written to the shared folder.  Where a centre may have any number of edges,
    the minima are a table too, so that adaptive execution can split its edges
    in the join.  Only a count and a checksum reach the driver.

    After `rounds` it may stop before it is done: nodes of one root are then in
    one component, but not the other way round.
    """
    now = table(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct(),
        "edges",
    )
    was, done = None, 0
    while (rounds is None or done < rounds) and (state := _state(now)) != was:
        was, done = state, done + 1
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = table(both.join(table(_least(both, F.least("u", F.min("v"))), "least"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        joined = large.join(_least(large, F.min("v")), "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.where("v = m").select("u", F.col("m").alias("v"))).distinct()
        before, now = now, table(small, "edges")
        dropped(before)
        dropped(large)
    if rounds is not None:
        now = now.groupBy("u").agg(F.min("v").alias("v"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    if rounds is not None:
        roots = roots.join(now.select(F.col("u").alias("node")), "node", "left_anti")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _least(edges: DataFrame, least: Column) -> DataFrame:
    return edges.groupBy("u").agg(least.alias("m"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
