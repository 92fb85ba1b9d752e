"""Connected components of a graph of edges, in logarithmically many rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node reachable) of every node that stands on an edge (a, b) of two different longs.

    Alternating stars: every node links its larger neighbours, then its smaller
    ones, to the least of them, until each component is one star. Minima are
    aggregated before they are shuffled, and the joins that hand them back can
    be split by Spark, so a hub with most of the edges is no hot task. Every
    round is stored. Loops and repeated edges are dropped; no edge gives no rows.
    """
    found = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).collect()[0]
        if state.n == 0 or state == before:
            return found.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(found.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        both = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        found = saved(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct())
