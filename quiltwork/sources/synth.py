"""A deterministic geography over the star-schema tables: pure integer-seeded arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buildings(spark: SparkSession, sf_dir: str, outliers: bool = False) -> DataFrame:
    """id, x, y, city, place, suburb: a building for each customer; every 11th lacks tags in one way or another."""
    shift = "+ CASE WHEN c_custkey % 500 = 499 THEN 0.02D ELSE 0.0D END" if outliers else ""
    c = read(spark, sf_dir, "customer")
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    gap = "CASE c_custkey % 11 WHEN 3 THEN NULL WHEN 5 THEN 'nan' WHEN 7 THEN '  ' ELSE {} END"
    return c.join(n, F.expr("c_nationkey = n_nationkey")).selectExpr(
        "c_custkey AS id",
        f"19.9D + ((c_custkey * 7919) % 20011) / 1000000D {shift} AS x",
        "50.0D + ((c_custkey * 104729) % 20021) / 1000000D AS y",
        f"{gap.format('n_name')} AS city",
        f"{gap.format('c_mktsegment')} AS place",
        "CASE WHEN c_custkey % 11 = 9 THEN NULL ELSE r_name END AS suburb",
    )


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, box: a square of half-size (4 + id mod 7) 1e-5 degrees around each building."""
    return buildings(spark, sf_dir).selectExpr("id", "x - (4 + id % 7) * 0.00001D AS minx", "y - (4 + id % 7) * 0.00001D AS miny", "x + (4 + id % 7) * 0.00001D AS maxx", "y + (4 + id % 7) * 0.00001D AS maxy")


def territories(spark: SparkSession, sf_dir: str, side: float = 0.00401) -> DataFrame:
    """ord, name, box: 25 cells of a board, one for each nation, overlapping by a hair."""
    return read(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS ord", "n_name AS name", "19.9D + (n_nationkey % 5) * 0.004D AS minx", "50.0D + (n_nationkey DIV 5) * 0.004D AS miny").selectExpr("*", f"minx + {side}D AS maxx", f"miny + {side}D AS maxy")


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ax, ay, bx, by: even suppliers run west-east, odd ones south-north."""
    k = "((s_suppkey * 37) % 200) * 0.0001D"
    even = "s_suppkey % 2 = 0"
    return read(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS id",
        f"CASE WHEN {even} THEN 19.9D ELSE 19.9D + {k} END AS ax",
        f"CASE WHEN {even} THEN 50.0D + {k} ELSE 50.0D END AS ay",
        f"CASE WHEN {even} THEN 19.92D ELSE 19.9D + {k} END AS bx",
        f"CASE WHEN {even} THEN 50.0D + {k} ELSE 50.02D END AS by",
    )
