"""Connected components of an edge table, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import materialise


def components(edges: DataFrame) -> DataFrame:
    """Rows (v, root): every vertex of the edges (a, b) with the smallest vertex of its component.

    Alternates large-star and small-star steps, each over the edge table only, until nothing changes.
    A vertex with very many neighbours costs no more than its edges: only minima are gathered for it.
    No edges give no rows; loops and repeated edges change nothing.
    """
    now = materialise(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = down.join(low, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = materialise(small)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == mark:
            break
        mark = state
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("v"), "root").union(now.select(F.col("v").alias("v"), F.col("v").alias("root")).distinct())
