"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import hot_join, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_smallest(links: DataFrame) -> DataFrame:
    """links with m, the smallest node that a or a link of a's has. A hub's links stay where they are."""
    smallest = materialize(links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")))
    return hot_join(links, smallest, ["a"], "n")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), root being the smallest node of its component.

    Large star and small star in turn: every node hands its larger, then its smaller neighbours to the smallest node
    it knows, until nothing changes. Each round keeps at most as many links as there were; a hub's smallest neighbour
    is pre-aggregated before the shuffle and goes back to the hub's links by a broadcast (see hot_join). Rounds are written to the shared folder. Self-links and repeats are ignored; no links, no rows.
    """
    links = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_smallest(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where(F.col("a") != F.col("b")).distinct())
        small = _with_smallest(large)
        small = small.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        small = small.select(F.col("x.b").alias("a"), F.col("x.m").alias("b"))
        links = materialize(small.where(F.col("a") != F.col("b")).distinct())
        after = _state(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
