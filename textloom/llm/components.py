"""Connected components of a graph held as a table of links, by alternating
large-star and small-star steps (each a group-by and a join).  Nothing of the graph
reaches the driver but a count and a checksum of each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the least of it and its neighbours."""
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and it, go to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links(u, v); the component is the least
    node.  A node with any number of links is no burden: its links are dealt by
    aggregation and by joins whose large side can be split.  Rounds grow with the
    logarithm of the longest path; the last one changes nothing."""
    now = materialize(links.where("u != v").select("u", "v").distinct())
    before = mark = None
    while before is None or mark != before:
        before = mark or ()
        last, now = now, materialize(_small_star(_large_star(now)))
        discard(last)
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
