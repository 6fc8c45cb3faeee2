"""Snapshots of a project: an append-only table keyed by version, with undo and redo."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltwork.config import CONFIG


class History:
    """Each push writes one folder; undo and redo move a cursor; a push drops what could be redone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.versions, self.at, self.next = spark, path.rstrip("/"), [], -1, 0

    def push(self, board: DataFrame) -> int:
        board.write.mode("overwrite").parquet(f"{self.path}/version={self.next}")
        self.versions = [*self.versions[: self.at + 1], self.next][-CONFIG.history :]
        self.at, self.next = len(self.versions) - 1, self.next + 1
        return self.versions[-1]

    def current(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={self.versions[self.at]}")

    def undo(self) -> bool:
        moved = self.at > 0
        self.at -= moved
        return moved

    def redo(self) -> bool:
        moved = self.at < len(self.versions) - 1
        self.at += moved
        return moved


def mark_printed(board: DataFrame, marks: DataFrame) -> DataFrame:
    """``printed`` set or cleared by (ord, printed); territories without a row stay as they are."""
    m = marks.select("ord", F.col("printed").alias("_new"), F.lit(True).alias("_set"))
    return board.join(m, "ord", "left").withColumn("printed", F.when(F.col("_set"), F.col("_new")).otherwise(F.col("printed"))).drop("_new", "_set")


def carry(before: DataFrame, after: DataFrame) -> DataFrame:
    """Marks survive only where the ring is the same."""
    old = before.select("ord", F.col("ring").alias("_ring"), F.col("printed").alias("_printed"))
    return after.join(old, "ord", "left").withColumn("printed", F.when(F.col("ring").eqNullSafe(F.col("_ring")), F.col("_printed"))).drop("_ring", "_printed")


def with_default(board: DataFrame, outer: DataFrame) -> DataFrame:
    """The board, or the whole area as one placeholder if the board has no territory."""
    some = board.select(F.lit(1).alias("_one")).limit(1)
    return board.unionByName(outer.withColumn("_k", F.lit(1)).join(some, F.col("_k") == F.col("_one"), "left_anti").drop("_k"), allowMissingColumns=True)
