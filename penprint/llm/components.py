"""Connected components of an edge list by hooking to the smallest neighbour, pointer
jumping and contraction.

Every round is a few joins and aggregates over written tables; the edges shrink to those
between different roots, so the rounds grow with the logarithm of the longest chain.
Smallest neighbours are aggregates with map-side combine (a hub costs one row a task);
nothing but an emptiness test reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.llm.common import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a non-loop edge; root is the smallest node of its component."""
    e = written(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
                .where("a <> b").distinct(), "edges")
    labels = None
    while True:
        both = e.select(F.col("b").alias("node"), F.col("a").alias("other")) \
            .union(e.select(F.col("a").alias("node"), F.col("b").alias("other")))
        hook = both.groupBy("node").agg(F.min("other").alias("m")) \
            .select("node", F.least("node", "m").alias("root"))
        hook = written(hook, "hooks")
        up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
        hook = written(hook.join(up, "root").select("node", F.col("above").alias("root")), "hooks")
        up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
        if labels is None:
            labels = hook
        else:
            labels = written(labels.join(up, "root", "left")
                             .select("node", F.coalesce("above", "root").alias("root")), "labels")
        ends = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        e = (e.join(ends, "a").join(ends.toDF("b", "rb"), "b").where("ra <> rb")
             .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        e = written(e, "edges")
        if e.isEmpty():
            return labels
