"""Connected components of an edge table by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.trail import checkpoint


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that edges (src, dst) reach. Nodes without an edge are their own root.

    Every round takes the least label of the neighbours and then follows labels one step, so distances halve.
    """
    both = checkpoint(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    now = checkpoint(nodes.select("node", F.col("node").alias("root")))
    while True:
        near = both.join(now, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("n")).agg(F.min("root").alias("near"))
        step = now.join(near, F.col("node") == F.col("n"), "left").select("node", F.least("root", F.coalesce("near", "root")).alias("root"), F.col("root").alias("before"))
        jump = step.select(F.col("node").alias("j"), F.col("root").alias("further"))
        after = checkpoint(step.join(jump, F.col("root") == F.col("j"), "left").select("node", F.least("root", F.coalesce("further", "root")).alias("root"), "before"))
        changed = not after.filter("root <> before").isEmpty()
        now = after.select("node", "root")
        if not changed:
            return now
