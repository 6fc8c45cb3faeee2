"""Locality votes and address ladders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltwork.functions.tags import tag_text

#: Weight of each address key (fixed values).
WEIGHTS = {"city": 1.0, "place": 1.0, "suburb": 0.5}


def votes(buildings: DataFrame, group: str) -> DataFrame:
    """group, name (case-folded), n, score: what the buildings of a group call their place."""
    cast = F.array(*[F.struct(tag_text(F.col(k)).alias("v"), F.lit(w).alias("w")) for k, w in WEIGHTS.items()])
    said = buildings.select(group, F.explode(cast).alias("e")).where("e.v IS NOT NULL")
    return said.groupBy(group, F.lower("e.v").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum("e.w").alias("score"))


def ranked(voted: DataFrame, group: str, top: int | None) -> DataFrame:
    """Votes with their rank in the group: score descending, then name."""
    out = voted.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "name")).cast("long"))
    return out if top is None else out.where(F.col("rank") <= top)


def ladder(rows: DataFrame, key: str) -> DataFrame:
    """key, n, best: of ``values`` in order, trimmed and not empty, without case-folded repeats."""
    said = F.filter(F.transform(F.col("values"), lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))
    kept = rows.select(key, said.alias("said")).where(F.size("said") > 0)
    return kept.select(key, F.size(F.array_distinct(F.transform("said", lambda v: F.lower(v)))).cast("long").alias("n"), F.get("said", F.lit(0)).alias("best"))
