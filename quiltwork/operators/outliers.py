"""Isolated groups of buildings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltwork.config import CONFIG
from quiltwork.functions import metric
from quiltwork.operators import graph
from quiltwork.operators import spatial_join as sj
from quiltwork.sources.scratch import Scratch


def scale(points: DataFrame) -> tuple[float, float]:
    """Median distance to the third neighbour, and the linking distance."""
    near = sj.kth_distance(points, "id", CONFIG.outlier_k, metric.dist)
    median = near.agg(F.coalesce(F.median("d"), F.lit(0.0)).alias("m")).first()["m"]
    return median, max(CONFIG.outlier_link * median, CONFIG.outlier_floor_m / 2)


def groups(points: DataFrame, link: float) -> DataFrame:
    """id, x, y, root: single-linkage groups at ``link`` metres.

    Points of a cell whose diagonal is no longer than ``link`` are of one group, so groups are components of cells.  Two
    cells are linked if their outermost points are near enough; only pairs of cells that are still of different groups
    look at their points, and at those only that may be near enough to the other cell.
    """
    c = F.col
    scratch = Scratch(points.sparkSession, "groups")
    size = 0.999999 * link / math.hypot(CONFIG.lng_m, CONFIG.lat_m)
    placed = sj.point_cells(points.select("id", "x", "y"), size)
    outer = [f("id", F.struct(v, "id")).alias(f"{f.__name__}_{v}") for v in ("x", "y") for f in (F.min_by, F.max_by)]
    box = [f(v).alias(f"{n}{v}") for v in ("x", "y") for f, n in ((F.min, "min"), (F.max, "max"))]
    cells = scratch.keep(placed.groupBy("cx", "cy").agg(F.min("id").alias("head"), *box, *outer))
    placed = scratch.keep(placed.join(cells.select("cx", "cy", "head"), ["cx", "cy"]).select("id", "x", "y", "head"))
    ends = cells.select("head", F.explode(F.array_distinct(F.array("min_by_x", "max_by_x", "min_by_y", "max_by_y"))).alias("id")).join(placed.select("id", "x", "y"), "id").select("head", "x", "y")
    right, up = math.ceil(2 * link / CONFIG.lng_m / size), math.ceil(link / CONFIG.lat_m / size)  # up to 60 degrees of latitude
    near = cells.withColumn("_i", F.explode(F.sequence(F.lit(-right), F.lit(right)))).withColumn("_j", F.explode(F.sequence(F.lit(-up), F.lit(up))))
    near = near.select((c("cx") + c("_i")).alias("cx"), (c("cy") + c("_j")).alias("cy"), c("head").alias("src"), *[c(f"{m}{v}").alias(f"s_{m}{v}") for v in ("x", "y") for m in ("min", "max")])
    pairs = scratch.keep(near.join(cells.withColumnRenamed("head", "dst"), ["cx", "cy"]).where("src < dst").select("src", "dst", *[c(f"s_{m}{v}") for v in ("x", "y") for m in ("min", "max")], "minx", "maxx", "miny", "maxy"))

    named = lambda df, key, x, y: df.select(c("head").alias(key), c("x").alias(x), c("y").alias(y))
    close = metric.dist(c("x"), c("y"), c("tx"), c("ty")) <= link
    sure = scratch.keep(pairs.select("src", "dst").join(named(ends, "src", "x", "y"), "src").join(named(ends, "dst", "tx", "ty"), "dst").where(close).select("src", "dst").distinct())
    known = scratch.keep(graph.components(sure))
    side = lambda k: known.select(c("node").alias(k), c("root").alias(f"r_{k}"))
    unsure = pairs.join(side("src"), "src", "left").join(side("dst"), "dst", "left").where(F.coalesce("r_src", "src") != F.coalesce("r_dst", "dst"))
    unsure = scratch.keep(unsure.drop("r_src", "r_dst"))
    # a point further from the other cell's box, in latitude or, at 60 degrees, in longitude, is linked with none of its points
    dx, dy = 2.000001 * link / CONFIG.lng_m, 1.000001 * link / CONFIG.lat_m
    within = lambda x, y, p: c(x).between(c(f"{p}minx") - dx, c(f"{p}maxx") + dx) & c(y).between(c(f"{p}miny") - dy, c(f"{p}maxy") + dy)
    left = unsure.join(named(placed, "src", "x", "y"), "src").where(within("x", "y", "")).select("src", "dst", "x", "y")
    right_ = unsure.join(named(placed, "dst", "tx", "ty"), "dst").where(within("tx", "ty", "s_")).select("src", "dst", "tx", "ty")
    more = left.join(right_, ["src", "dst"]).where(close).select("src", "dst").distinct()
    roots = graph.components(sure.union(scratch.keep(more))).withColumnRenamed("node", "head")
    return placed.join(roots, "head", "left").select("id", "x", "y", F.coalesce("root", "head").alias("root"))


def find(points: DataFrame) -> DataFrame:
    """root, n, gap_m, outlier for every group but the home group (the largest, ties to the lower root).

    A group is an outlier if it has at most 8 buildings and lies further than unit * factor from home; what has no home
    building within max(4 * threshold, 2000 m) is infinitely far.  Fewer than 3 buildings give no rows.
    """
    scratch = Scratch(points.sparkSession, "outliers")
    points = scratch.keep(points.select("id", "x", "y"))
    if points.limit(3).count() < 3:
        return points.sparkSession.createDataFrame([], "root long, n long, gap_m double, outlier boolean")
    median, link = scale(points)
    grouped = scratch.keep(groups(points, link))
    sizes = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    home = sizes.orderBy(F.desc("n"), "root").limit(1).withColumn("span", metric.dist(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).first()
    unit = max(median, CONFIG.outlier_floor_m / 3, CONFIG.outlier_span * home["span"])
    threshold = unit * CONFIG.outlier_factor
    reach = max(4 * threshold, 2000.0)
    away = grouped.where(F.col("root") != home["root"]).select("id", "x", "y", "root")
    base = grouped.where(F.col("root") == home["root"]).select("id", "x", "y")
    near = sj.nearest(away.select("id", "x", "y"), base, "id", "id", metric.dist, 2 * link / CONFIG.lng_m)
    gap = near.join(away.select("id", "root"), "id").groupBy("root").agg(F.min("d").alias("gap")).where(F.col("gap") <= reach)
    out = sizes.where(F.col("root") != home["root"]).join(gap, "root", "left").select("root", "n", F.coalesce("gap", F.lit(float("inf"))).alias("gap_m"))
    return out.withColumn("outlier", (F.col("n") <= CONFIG.outlier_group) & (F.col("gap_m") > threshold))
