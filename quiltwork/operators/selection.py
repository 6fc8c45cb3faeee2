"""Selections in a list of shown rows: ranges, all or none, walking to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltwork.operators.running import running_sum


def places(shown: DataFrame, order: str, bucket: str) -> DataFrame:
    """``place`` of each row in the shown order, from 0; ``bucket`` grows with the order and keeps the sums two-level."""
    return running_sum(shown.withColumn("_one", F.lit(1)), [bucket], [F.col(order)], "_one", "place").withColumn("place", (F.col("place") - 1).cast("long")).drop("_one")


def extend(placed: DataFrame, order: str, anchor: int, target: int) -> DataFrame:
    """The rows between anchor and target, both included; an anchor that is not shown counts as the target.

    A target that is not shown gives no rows.
    """
    ends = placed.agg(F.max(F.when(F.col(order) == target, F.col("place"))).alias("to"), F.max(F.when(F.col(order) == anchor, F.col("place"))).alias("at")).first()  # two numbers
    if ends["to"] is None:
        return placed.limit(0)
    at = ends["to"] if ends["at"] is None else ends["at"]
    return placed.where(F.col("place").between(min(at, ends["to"]), max(at, ends["to"])))


def toggle_all(shown: DataFrame, picked: DataFrame, key: str) -> DataFrame:
    """All shown rows join the selection; if all are in it already, they leave it."""
    if shown.join(picked, key, "left_anti").isEmpty():
        return picked.select(key).join(shown, key, "left_anti")
    return picked.select(key).union(shown.select(key)).distinct()


def next_flagged(flagged: DataFrame, project: str, order: str) -> DataFrame:
    """``next``: the flagged row after each flagged one, the first after the last (a project has at most 200 rows)."""
    w = Window.partitionBy(project).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return flagged.withColumn("next", F.coalesce(F.lead(order).over(w), F.first(order).over(whole)))
