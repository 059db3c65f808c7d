"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlane.sources.sinks import stage


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to the smallest of its neighbourhood."""
    near = _both_ways(links)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = near.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and itself, move to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(own).where("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): the smallest node it reaches.

    Large-star and small-star turns alternate until the links no longer change,
    a number of turns that grows with the logarithm of a component's width.
    Each turn is written to the shared folder; only a count and a checksum
    come to the driver. A node with very many links is one row per link in a
    join that adaptive execution can split.
    """
    links = stage(links.where("a <> b").select("a", "b").distinct(), "links")
    state = _state(links)
    while state[0]:
        links = stage(_small_star(_large_star(links)), "links")
        new = _state(links)
        if new == state:
            break
        state = new
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def extended(known: DataFrame, links: DataFrame) -> DataFrame:
    """The components of ``known``, (node, component), after further links (a, b).

    Links are taken between components first, so that the turns work on the few
    components that change and not on all links again.
    """

    def label(end: str) -> DataFrame:
        return known.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))

    between = links.join(label("a"), "a", "left").join(label("b"), "b", "left")
    joined = components(between.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    moved = joined.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    old = known.join(moved, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    fresh = joined.join(known.select("node"), "node", "left_anti")
    return stage(old.unionByName(fresh), "components")
