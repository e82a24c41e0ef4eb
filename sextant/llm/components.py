"""Connected components of a links table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import checkpointed, released


def _least(links: DataFrame) -> DataFrame:
    """For each node u its smallest neighbour; partial minima before the shuffle, so hubs do no harm."""
    return links.groupBy("u").agg(F.min("v").alias("least"))


def connected_components(links: DataFrame) -> DataFrame:
    """links: u, v (of one kind that has an order). Returns node, component: the smallest node that can be reached, for every node of a link.

    Loops and repeated links do no harm; links with a null end are ignored; no links give no rows. Rounds go on until
    nothing changes, a number that grows with the logarithm of the nodes. Each round ends in a checkpoint; nothing but
    a count and a sum of hashes reaches the driver.
    """
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    links = checkpointed(links)
    before = None
    while True:
        # large star: every larger neighbour of a node, and the node, point to the smallest of all
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
        large = large.where("u <> v")  # links that repeat do no harm until the round's end
        # small star: all smaller neighbours of a node point to the smallest of them
        small = large.join(_least(large), "u")
        small = small.select("u", F.col("least").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("least").alias("v")))
        links = checkpointed(small.where("u <> v").distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            released(links.sparkSession)
            break
        before = now
        both = large = small = None
        released(links.sparkSession)
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
