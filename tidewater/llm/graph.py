"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch
from tidewater.session import by_shuffle


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component.

    Each round hangs larger neighbours on the smallest neighbour, found by an aggregate and a join, so a node
    of high degree is combined before the shuffle and never held as a list. Rounds grow with the logarithm
    of the longest path. Loops and repeated edges do no harm; no edges give no rows.
    """
    spark = edges.sparkSession
    before, held = None, Scratch(spark)
    stars = held.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
                      "edges")
    while True:
        with held, Scratch(spark) as within:
            both = stars.unionByName(stars.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
            low = both.groupBy("hi").agg(F.least(F.min("lo"), F.first("hi")).alias("least"))
            large = both.join(by_shuffle(low), "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
            large = within.keep(large.distinct(), "large-star")
            low = large.groupBy("hi").agg(F.min("lo").alias("least"))
            small = large.join(by_shuffle(low), "hi").where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
            after = Scratch(spark)
            stars = after.keep(small.unionByName(low.select("hi", F.col("least").alias("lo"))).distinct(), "small-star")
        held = after
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    leaves = stars.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
