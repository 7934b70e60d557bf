"""Running totals over a whole table in one order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def running_total(df: DataFrame, order: list[str], value: Column, name: str = "before", partitions: int | None = None) -> DataFrame:
    """df with the sum of ``value`` over all rows before each one in the given order, as a BIGINT.

    Rows are range-partitioned by the order and summed within each partition; what stands before a partition
    is a sum over one row for each partition.  The order must be unique for a defined result.
    """
    n = partitions or max(2, df.sparkSession.sparkContext.defaultParallelism)
    ranged = df.withColumn("_v", value.cast("long")).repartitionByRange(n, *order)
    # written, so that both uses below see the same partitions
    rows = materialise(ranged.withColumn("_p", F.spark_partition_id()))
    sums = rows.groupBy("_p").agg(F.sum("_v").alias("_s"))
    offsets = sums.select("_p", (F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).alias("_o"))
    within = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_l", F.coalesce(F.sum("_v").over(within), F.lit(0)))
    return local.join(offsets, "_p").withColumn(name, (F.col("_l") + F.coalesce("_o", F.lit(0))).cast("long")).drop("_p", "_v", "_l", "_o")


def row_index(df: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """df with each row's number in the order, from 0."""
    return running_total(df, order, F.lit(1), name)
