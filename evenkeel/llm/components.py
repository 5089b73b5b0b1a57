"""Connected components by alternating large and small stars, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(edges: DataFrame) -> DataFrame:
    """`edges` (a, b), in any direction and repeated or not; returns (id, component) for every end.

    The component is the smallest id in it. Each round is written to the shared folder, so
    lineage stays short; a node's neighbours are only aggregated and joined, never collected.
    Null ends and loops are ignored. The number of rounds grows with the logarithm of the
    longest path.
    """
    state = (edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state, mark = settle(state)
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        state, now = settle(small)
        if now == mark:
            break
        mark = now
    top = state.groupBy("u").agg(F.min("v").alias("component"))
    return (top.select(F.col("u").alias("id"), "component")
            .unionByName(top.select(F.col("component").alias("id"), "component").distinct()))


def settle(state: DataFrame) -> tuple[DataFrame, tuple]:
    """The written state and a mark that changes when the state does."""
    state = cut(state)
    return state, tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
