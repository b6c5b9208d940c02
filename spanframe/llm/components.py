"""Connected components of links by alternating large and small stars, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import mark, release, written


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of the links (a, b long) but the roots.

    Each round rewires every node to the least of its neighbours; rounds grow as the logarithm
    of the longest path. No neighbour list is gathered: only minima are, so hubs do no harm.
    A round's table is deleted once the next one is written.
    """
    cur = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        at = mark() - 1
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        cur = written(small, "links")
        release(cur.sparkSession, at, keep=1)
        now = tuple(cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
