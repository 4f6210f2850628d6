"""Ranks inside groups without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.sinks.tables import materialize


def ranked_in_groups(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``place``, the row's number (from 0) inside its group by ``order``, which must be unique there.

    Rows are dealt by ranges of (group, order), whose bounds Spark samples, so a
    group with a third of all rows spans many tasks.  A row's place is its number
    in its own range, plus the group's rows in earlier ranges: one row per group
    and range, of which a group has at most as many as there are ranges.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order]
    ordered = materialize(df.repartitionByRange(width, *keys).sortWithinPartitions(*keys).withColumns(
        {"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "ranked")
    starts = ordered.groupBy("_range", *group).agg(F.min("_row").alias("_start"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return ordered.join(starts, ["_range", *group]).withColumn(
        "place", (F.col("_row") - F.col("_start") + F.col("_before")).cast("long")).drop("_range", "_row", "_start", "_before")
