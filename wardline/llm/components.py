"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014) on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.store import Store


def components(edges: DataFrame, store: Store) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component.

    A hub's edges are never gathered in one place: minima are pre-aggregated and joined back, where large partitions can
    be split. Each round is written to the shared folder; rounds end once all edges are stars around roots.
    """
    now = store.put(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    while True:
        tops = now.select(F.col("v").alias("u")).distinct()
        if now.join(tops, "u", "left_semi").select("u").unionByName(now.groupBy("u").count().filter("count > 1").select("u")).isEmpty():
            break  # each node hangs on one root, and no root on another
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = store.put(large, "star-large", instead=True)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = store.put(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "star", instead=True)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
