"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns node, component (the smallest node reachable) for every node that has a link to another.

    Each step hangs the neighbours of a node under the smallest of them; a step is written and read back, so lineage stays
    short. It ends when a step changes nothing: every node then hangs under its component's smallest. Nothing but a count and a
    checksum reaches the driver. Null ends and links of a node to itself are ignored; no links give no rows.
    """
    down = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before = _state(down)
    while before[0]:
        both = down.unionByName(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = materialize(low.withColumnRenamed("m", "b").unionByName(rest).distinct(), "stars")
        after = _state(down)
        if after == before:
            break
        before = after
    return down.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(down.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(down: DataFrame) -> tuple:
    return tuple(down.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
