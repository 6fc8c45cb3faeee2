"""Ends of a cutting line pushed out to the next boundary, and the fields of a printed card."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltwork.config import CONFIG
from quiltwork.functions import metric
from quiltwork.operators.spatial_join import box_cells

#: How far a pushed end goes past the boundary, and where its ray starts, in metres (fixed values).
OVERSHOOT_M, START_M = 1.5, 0.2


def push_out(ends: DataFrame, edges: DataFrame, key: str, reach: float, size: float) -> DataFrame:
    """``x``, ``y``: each end (fx, fy to tx, ty) on its way out, just past the first edge (ax, ay, bx, by) that it meets.

    Without an edge within ``reach`` degrees it goes just past itself; an end without a direction stays where it is.
    """
    c = F.col
    length = F.sqrt((c("tx") - c("fx")) * (c("tx") - c("fx")) + (c("ty") - c("fy")) * (c("ty") - c("fy")))
    rays = ends.withColumn("_l", length).withColumn("_ux", F.coalesce(F.try_divide(c("tx") - c("fx"), c("_l")), F.lit(0.0))).withColumn("_uy", F.coalesce(F.try_divide(c("ty") - c("fy"), c("_l")), F.lit(0.0)))
    first = START_M / CONFIG.lat_m
    rays = rays.withColumns({"_sx": c("tx") + c("_ux") * first, "_sy": c("ty") + c("_uy") * first, "_gx": c("tx") + c("_ux") * reach, "_gy": c("ty") + c("_uy") * reach})

    def boxed(df: DataFrame, ax: str, ay: str, bx: str, by: str) -> DataFrame:
        return box_cells(df.withColumns({"minx": F.least(ax, bx), "miny": F.least(ay, by), "maxx": F.greatest(ax, bx), "maxy": F.greatest(ay, by)}), size).drop("minx", "miny", "maxx", "maxy")

    pairs = boxed(rays.where("_l > 0"), "_sx", "_sy", "_gx", "_gy").join(boxed(edges.select("ax", "ay", "bx", "by"), "ax", "ay", "bx", "by"), ["cx", "cy"])
    pairs = pairs.withColumn("_p", metric.crossing_point((c("_sx"), c("_sy")), (c("_gx"), c("_gy")), (c("ax"), c("ay")), (c("bx"), c("by")))).where("_p IS NOT NULL")
    far = (c("_p.x") - c("tx")) * c("_ux") + (c("_p.y") - c("ty")) * c("_uy")
    hit = pairs.groupBy(key).agg(F.min(F.struct(far.alias("d"), c("_p").alias("p"))).alias("_hit"))
    over = OVERSHOOT_M / CONFIG.lat_m
    out = rays.join(hit, key, "left")
    return out.select(key, (F.coalesce("_hit.p.x", "tx") + c("_ux") * over).alias("x"), (F.coalesce("_hit.p.y", "ty") + c("_uy") * over).alias("y"))


def card_fields(items: DataFrame, page: str) -> DataFrame:
    """The first two runs of leader dots of a page (text, x, y, size, ord), from the left: locality, then territory."""
    c = F.col
    leaders = items.where(c("text").rlike("^[.…]{4,}$")).withColumn("_k", F.row_number().over(Window.partitionBy(page).orderBy("x", "ord"))).where("_k <= 2")
    name = F.when(c("_k") == 1, "locality").otherwise("territory")
    return leaders.select(page, name.alias("field"), metric.round_half_up(c("x") + 3, 2).alias("x"), metric.round_half_up(c("y") + 5, 2).alias("y"), metric.round_half_up(c("size"), 1).alias("size"))
