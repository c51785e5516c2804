"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from presage.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of the edges (a, b).

    Rounds grow with the logarithm of the component size; each is written to
    the shared folder. A hub's edges are met by a join of two shuffled sides,
    which Spark splits if skewed, and minima are taken map-side first.
    """
    now = cut_lineage(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = cut_lineage(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("u"), F.least("a", "low").alias("low")))
        # large star: every larger neighbour of u goes to the lowest of u and its neighbours
        large = now.join(lowest, now["b"] == lowest["u"]).select(now["a"].alias("a"), F.col("low").alias("b")).filter("a != b").distinct()
        large = cut_lineage(large)
        # small star: u and its smaller neighbours go to the lowest of these
        lowest = cut_lineage(large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "u"))
        small = large.join(lowest, large["a"] == lowest["u"]).select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b")).filter("a != b").distinct()
        now = cut_lineage(small)
        got = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if got == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = got
