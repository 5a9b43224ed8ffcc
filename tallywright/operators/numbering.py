"""Positions in a total order without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.sources.files import shared_folder


def numbered(df: DataFrame, *order: str, name: str = "pos", start: int = 1) -> DataFrame:
    """df with each row's position in the order of the columns, which should be unique; equal rows get positions in any order.

    Rows are dealt by ranges and written once, so that the ranges stay as they are; the ranges' sizes, one row
    for each task, give where a range begins.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "ranges")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.select("_range", before.alias("_before"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    # at most one row for each shuffle partition
    return dealt.withColumn("_in", inside).join(F.broadcast(begins), "_range").withColumn(name, F.col("_before") + F.col("_in") + F.lit(start - 1)).drop("_range", "_in", "_before")
