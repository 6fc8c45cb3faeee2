"""The versioned project payload: features as JSON lines, one folder a project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltwork.config import CONFIG

SCHEMA = "version int, layer string, ord long, ring array<struct<x:double,y:double>>, props map<string,string>"


def build(territories: DataFrame, streets: DataFrame, buildings: DataFrame, partial: bool = False) -> DataFrame:
    """``value``: a JSON feature for each row of the layers; ``partial`` leaves the map data out."""
    from quiltwork.functions.ring import box_ring

    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    rows = territories.select(F.lit("clusters").alias("layer"), F.col("ord").cast("long").alias("ord"), box_ring(*map(F.col, ("minx", "miny", "maxx", "maxy"))).alias("ring"), F.create_map(F.lit("name"), F.col("name")).alias("props"))
    if not partial:
        rows = rows.unionByName(streets.select(F.lit("streets").alias("layer"), F.col("id").cast("long").alias("ord"), F.array(point("ax", "ay"), point("bx", "by")).alias("ring"), F.create_map(F.lit("kind"), F.lit("residential")).alias("props")))
        tags = F.map_filter(F.create_map(F.lit("city"), F.col("city"), F.lit("place"), F.col("place")), lambda _, v: v.isNotNull())
        rows = rows.unionByName(buildings.select(F.lit("buildings").alias("layer"), F.col("id").cast("long").alias("ord"), F.array(point("x", "y")).alias("ring"), tags.alias("props")))
    return rows.select(F.to_json(F.struct(F.lit(CONFIG.payload_version).alias("version"), "layer", "ord", "ring", "props")).alias("value"))


def parse(lines: DataFrame) -> DataFrame:
    """Features of this version; a missing version is accepted, any other one and broken lines are not."""
    f = lines.select(F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}).alias("f")).select("f.*")
    return f.where(F.col("layer").isNotNull() & (F.coalesce("version", F.lit(CONFIG.payload_version)) == CONFIG.payload_version))


def write(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").text(path, compression="gzip")


def read(spark, path: str) -> DataFrame:
    return parse(spark.read.text(path))
