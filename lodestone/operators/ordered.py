"""Checkpoints of loops, and sums along a total order of a whole table without a window over all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import shared_dir


def cut(df: DataFrame) -> DataFrame:
    """Materialises a loop's state in the checkpoint folder, so that lineage does not grow with the rounds."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds name: the sum of value over the rows up to and with each one, in an order without ties.

    Rows are dealt by range and written down; sums run inside the parts, and over one row
    per part. A null value counts as nothing.
    """
    parted = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parted.groupBy("_part").agg(F.sum(value).alias("_total"))
    totals = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))  # a row per part
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = parted.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(F.broadcast(totals), "_part").withColumn(name, F.col("_base") + F.col("_inside")).drop("_part", "_base", "_inside")
