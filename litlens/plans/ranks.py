"""Running totals over a global order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def running_total(df: DataFrame, order: Sequence[str], weight: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``weight`` up to and with each row.

    The rows are stored in ranges of the order; the totals of the ranges before,
    one row a partition, give each range its start."""
    spark = df.sparkSession
    path = scratch_path(spark, "running")
    df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    laid = spark.read.schema(df.withColumn("_part", F.lit(0)).schema).parquet(path)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a shuffle partition
    starts = laid.groupBy("_part").agg(F.sum(weight).alias("_t")).select(
        "_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return laid.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("_start") + F.sum(weight).over(inside)).alias(name))
