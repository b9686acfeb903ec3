"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wakeline.llm.common import durable

MAX_ROUNDS = 60
ROWS = 200_000  # links of a partition


def _least(both: DataFrame) -> DataFrame:
    """Least neighbour of each node, itself included; combined before the shuffle."""
    return both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))


def components(links: DataFrame) -> DataFrame:
    """node and component (its least node) for every node that has a link.

    Each round ties every greater neighbour of a node to the node's least neighbour,
    then every smaller one; it ends when nothing changes, in which case all links are
    stars. No neighbourhood is gathered: a node's rows meet its least neighbour by a
    join, which a hot node's rows may split. Links are laid out in partitions of about
    ROWS, so a few links need one task and no shuffle.
    """
    edges = durable(links.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).filter("u <> v").distinct())
    state = None
    parts = 1 + edges.count() // ROWS
    for _ in range(MAX_ROUNDS):
        edges = edges.coalesce(parts)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.filter("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        # Each node's smaller neighbours, and the node, are tied to the least of them.
        lows = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lows, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            lows.select("u", F.col("low").alias("v"))
        )
        edges = durable(small.filter("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    edges = edges.coalesce(parts)
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).distinct()
    return stars.unionByName(roots.select("node", F.col("node").alias("component")))
