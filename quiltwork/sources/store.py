"""A project's stored state: a key-value table, a session in three tables, and payloads attached to cards."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltwork.config import CONFIG
from quiltwork.sources import payload


class Store:
    """Keys and values in versions of one table; each change writes the next version, readers see the last one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.version = spark, path.rstrip("/"), 0
        self._write(spark.createDataFrame([], "key string, value string"))

    def _write(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.path}/{self.version + 1}")
        self.version += 1

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.version}")

    def put(self, rows: DataFrame) -> None:
        """Set (key, value); of a key's several rows the largest value counts."""
        new = rows.groupBy("key").agg(F.max("value").alias("value"))
        self._write(self.table().join(new, "key", "left_anti").unionByName(new))

    def remove(self, keys: DataFrame) -> None:
        self._write(self.table().join(keys.select("key"), "key", "left_anti"))

    def get(self, keys: DataFrame) -> DataFrame:
        """key, value of the wanted keys; null where there is none."""
        return keys.select("key").distinct().join(self.table(), "key", "left")


def save_session(path: str, version: int, territories: DataFrame, data: DataFrame, dirty: bool = True) -> None:
    """Meta, territories, and the map data only where it changed."""
    spark = territories.sparkSession
    spark.range(1).select(F.lit(version).alias("version")).write.mode("overwrite").parquet(f"{path}/meta")
    territories.write.mode("overwrite").parquet(f"{path}/territories")
    if dirty:
        data.write.mode("overwrite").parquet(f"{path}/data")


def restore_session(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """Territories and data, or None if the session is of another version."""
    if spark.read.parquet(f"{path}/meta").where(F.col("version") == CONFIG.payload_version).isEmpty():
        return None
    return spark.read.parquet(f"{path}/territories"), spark.read.parquet(f"{path}/data")


def attach(features: DataFrame, card: str, most: int = 8 << 20) -> DataFrame:
    """``card`` and ``blob``: the features of each card as gzipped lines; null where that is larger than ``most`` bytes.

    A card is one project, whose payload is bounded by the domain's limits.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        blob = gzip.compress("\n".join(sorted(rows["value"])).encode(), mtime=0)
        return pd.DataFrame({card: [rows[card].iloc[0]], "blob": [blob if len(blob) <= most else None]})

    return features.groupBy(card).applyInPandas(run, f"{card} {features.schema[card].dataType.simpleString()}, blob binary")


def extract(cards: DataFrame, card: str, most: int = 32 << 20) -> DataFrame:
    """``card`` and the features in its blob; cards without one, with a broken one or one above ``most`` bytes give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out: tuple[list, list] = ([], [])
            for name, blob in zip(rows[card], rows["blob"], strict=True):
                try:
                    text = gzip.decompress(blob) if blob is not None else b""
                except (OSError, EOFError):
                    text = b""
                for line in text.decode("utf-8", "replace").split("\n") if 0 < len(text) <= most else ():
                    out[0].append(name)
                    out[1].append(line)
            yield pd.DataFrame({card: out[0], "value": out[1]})

    lines = cards.select(card, "blob").mapInPandas(run, f"{card} {cards.schema[card].dataType.simpleString()}, value string")
    f = lines.select(card, F.from_json("value", payload.SCHEMA, {"mode": "PERMISSIVE"}).alias("f")).select(card, "f.*")
    return f.where(F.col("layer").isNotNull() & (F.coalesce("version", F.lit(CONFIG.payload_version)) == CONFIG.payload_version))
