"""Numbering the rows of groups, some of which may be most of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.storage import written


def numbered_rows(rows: DataFrame, by: str, order: Column, name: str) -> DataFrame:
    """rows with ``name``: 1, 2, ... in each group, in an order.

    Rows are dealt to ranges of (by, order), written, and counted in each range;
    the counts of the ranges before are added to a row's place in its own. So a
    group has as many tasks as its rows fill ranges, and no window spans it. The
    written table keeps a rerun task from seeing other ranges.
    """
    ranged = rows.repartitionByRange(F.col(by), order).withColumn("_range", F.spark_partition_id())
    kept = written(ranged, "numbered")
    across = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = kept.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_count"))
    before = counts.select(F.col(by).alias("_by"), F.col("_range").alias("_at"), F.coalesce(F.sum("_count").over(across), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(by, "_range").orderBy(order))
    placed = kept.withColumn("_place", inside)
    joined = placed.join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_at")))
    return joined.select(*rows.columns, (F.col("_before") + F.col("_place")).cast("bigint").alias(name))
