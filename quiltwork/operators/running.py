"""Running aggregates over a whole ordered table without one task that sees every row.

Rows are put in buckets that follow the order.  Buckets' totals are accumulated (a row a bucket), rows are accumulated
inside their bucket, and the two are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltwork.sources.scratch import Scratch


def ordered_buckets(df: DataFrame, order: list, name: str = "_bucket") -> DataFrame:
    """``df`` with ``name``: buckets of about equal size that follow the order, whatever the values' spread."""
    dealt = df.repartitionByRange(*order).withColumn(name, F.spark_partition_id())
    return Scratch(df.sparkSession, "buckets").keep(dealt)  # written, so that a bucket's rows stay the same


def running_sum(df: DataFrame, bucket: list[str], order: list, value: str, name: str) -> DataFrame:
    """``name``: sum of ``value`` over this row and all before it; ``bucket`` columns come first in the order."""
    totals = df.groupBy(*bucket).agg(F.sum(value).alias("_t"))
    before = totals.select(*bucket, F.coalesce(F.sum("_t").over(Window.orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = Window.partitionBy(*bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_own", F.sum(value).over(own)).join(before, bucket).withColumn(name, F.col("_before") + F.col("_own")).drop("_own", "_before")


def slots(df: DataFrame, bucket: str, order: list, arrival: str, interval: int, name: str = "slot") -> DataFrame:
    """Leaky slots: each arrival gets max(its time, the slot before + interval), over the whole ordered table."""
    inner = Window.partitionBy(bucket).orderBy(*order)
    rows = df.withColumn("_i", F.row_number().over(inner) - 1).withColumn("_lead", F.max(F.col(arrival) - F.col("_i") * interval).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    per = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n"), F.max("_lead").alias("_m"))
    past = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_first", F.coalesce(F.sum("_n").over(past), F.lit(0)))
    per = per.withColumn("_past", F.max(F.col("_m") - F.col("_first") * interval).over(past)).select(bucket, "_first", "_past")
    rows = rows.join(per, bucket).withColumn("_lead", F.greatest(F.col("_past"), F.col("_lead") - F.col("_first") * interval))
    return rows.withColumn(name, F.col("_lead") + (F.col("_first") + F.col("_i")) * interval).drop("_i", "_lead", "_first", "_past")
