"""Running totals and row numbers over groups of any size, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def running_total(df: DataFrame, order: Sequence[Column], weight: str, out: str, group: str | None = None) -> DataFrame:
    """`df` with the sum of `weight` over all rows before each row in the given order (of its group).

    Rows are range-partitioned by group and order; a partition then needs only the totals of the partitions before it,
    a table of at most partitions x groups-that-span-them rows.
    """
    keys = [F.col(group), *order] if group else list(order)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = materialize(df.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()), "running-total")
    g = F.col(group) if group else F.lit(0)
    sums = spread.groupBy(g.alias("__g"), "__part").agg(F.sum(weight).alias("__w"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__w").over(Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__w")
    own = F.coalesce(F.sum(weight).over(Window.partitionBy("__part", g).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    right = before.select(F.col("__g").alias("__g2"), F.col("__part").alias("__p2"), "__before")
    joined = spread.withColumn("__own", own).withColumn("__g", g).join(right, F.col("__g").eqNullSafe(F.col("__g2")) & (F.col("__part") == F.col("__p2")))
    return joined.withColumn(out, F.col("__own") + F.col("__before")).drop("__g", "__part", "__own", "__before", "__g2", "__p2")


def row_numbers(df: DataFrame, group: str, order: Sequence[Column], out: str) -> DataFrame:
    """`df` with 0-based row numbers within each group."""
    return running_total(df.withColumn("__one", F.lit(1)), order, "__one", out, group).drop("__one").withColumn(out, F.col(out).cast("long"))
