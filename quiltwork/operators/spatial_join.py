"""Spatial joins on a uniform grid.

Both sides get cell columns, the join is an equi-join on cells with the exact predicate as residual, so Spark plans a
hash or sort-merge join (broadcast where the statistics allow it) and never a nested loop.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltwork.config import CONFIG
from quiltwork.sources.scratch import Scratch


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def point_cells(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumn("cx", cell(F.col(x), size)).withColumn("cy", cell(F.col(y), size))


def box_cells(df: DataFrame, size: float, pad: float = 0.0, box: tuple[str, str, str, str] = ("minx", "miny", "maxx", "maxy")) -> DataFrame:
    """A row for each cell that the box, grown by ``pad``, meets."""
    minx, miny, maxx, maxy = map(F.col, box)
    return df.withColumn("cx", F.explode(F.sequence(cell(minx - pad, size), cell(maxx + pad, size)))).withColumn("cy", F.explode(F.sequence(cell(miny - pad, size), cell(maxy + pad, size))))


def ring_cells(df: DataFrame, radius_cells: int) -> DataFrame:
    """A row for each cell within ``radius_cells`` of a point's own."""
    near = F.sequence(F.lit(-radius_cells), F.lit(radius_cells))
    return df.withColumn("_i", F.explode(near)).withColumn("_j", F.explode(near)).withColumn("cx", F.col("cx") + F.col("_i")).withColumn("cy", F.col("cy") + F.col("_j")).drop("_i", "_j")


def shell_cells(df: DataFrame, rings: int) -> DataFrame:
    """As ``ring_cells``, with the number of the square shell around the point's own cell as ``shell``."""
    own = df.withColumn("_x", F.col("cx")).withColumn("_y", F.col("cy"))
    return ring_cells(own, rings).withColumn("shell", F.greatest(F.abs(F.col("cx") - F.col("_x")), F.abs(F.col("cy") - F.col("_y")))).drop("_x", "_y")


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """All pairs (n:m) of points (x, y) and boxes (half-open) with the columns of both."""
    p, b = point_cells(points, size), box_cells(boxes, size)
    inside = (F.col("x") >= F.col("minx")) & (F.col("x") < F.col("maxx")) & (F.col("y") >= F.col("miny")) & (F.col("y") < F.col("maxy"))
    return p.join(b, ["cx", "cy"]).where(inside).drop("cx", "cy")


def first_match(pairs: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key's rows the first by ``order``."""
    best = F.min_by(F.struct(*[c for c in pairs.columns if c != key]), F.col(order))
    return pairs.groupBy(key).agg(best.alias("_m")).select(key, "_m.*")


def boxes_touch(left: DataFrame, right: DataFrame, size: float, left_key: str, right_key: str, pad: float = 0.0) -> DataFrame:
    """Pairs of keys whose closed boxes meet; right columns are prefixed with r_."""
    r = box_cells(right, size, pad)
    r = r.select("cx", "cy", *[F.col(c).alias(f"r_{c}") for c in right.columns])
    meet = (F.col("minx") <= F.col("r_maxx") + pad) & (F.col("r_minx") - pad <= F.col("maxx")) & (F.col("miny") <= F.col("r_maxy") + pad) & (F.col("r_miny") - pad <= F.col("maxy"))
    return box_cells(left, size).join(r, ["cx", "cy"]).where(meet).drop("cx", "cy").dropDuplicates([left_key, f"r_{right_key}"])


def _reach_m(y: Column, cells: float) -> Column:
    """Metres from a point to the edge of the 3 x 3 cells around it, at least."""
    return F.lit(cells) * F.least(F.lit(CONFIG.lat_m), CONFIG.lng_m * F.cos(F.radians(F.least(F.lit(90.0), F.abs(y) + cells))))


def _dense_size(points: DataFrame, a_cell: float) -> float | None:
    """Width of cells that hold so many points each, were they spread evenly over their box; None without points."""
    box = points.agg(F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()  # one row
    return max(1e-6, math.sqrt(max(box["w"], 1e-6) * max(box["h"], 1e-6) * a_cell / box["n"])) if box["n"] else None


def _widening(points: DataFrame, key: str, size: float, pick) -> DataFrame:
    """Points meet targets in 3 x 3 cells; ``pick(rest, size, first)`` gives key and d of the hits; points whose d may be
    beaten by a target outside these cells go on with cells four times as wide.  Each round sees only what is not settled."""
    scratch = Scratch(points.sparkSession, "nearest")
    rest, found = points.select(key, "x", "y"), None
    while True:
        hits = pick(point_cells(rest, size), size, found is None)
        last = size >= 720  # all targets are in reach
        judged = scratch.keep(rest.join(hits, key, "left").withColumn("_settled", F.lit(last) | F.coalesce(F.col("d") <= _reach_m(F.col("y"), size), F.lit(False))))
        done = judged.where(F.col("_settled") & F.col("d").isNotNull()).drop("x", "y", "_settled")
        found = done if found is None else found.union(done)
        rest = judged.where(~F.col("_settled")).select(key, "x", "y")
        if last or rest.isEmpty():
            return found
        size *= 4


def _may_hold(fine: float) -> Column:
    """No more than the metres (``metric.dist``) from a point (x, y) to any place in the fine cell (fx, fy)."""
    x0, y0 = F.col("fx") * fine, F.col("fy") * fine
    dx = F.greatest(x0 - F.col("x"), F.col("x") - x0 - fine, F.lit(0.0))
    dy = F.greatest(y0 - F.col("y"), F.col("y") - y0 - fine, F.lit(0.0))
    far = F.least(F.lit(90.0), F.greatest(F.abs("y"), F.abs(y0), F.abs(y0 + fine)))
    dx, dy = dx * CONFIG.lng_m * F.cos(F.radians(far)), dy * CONFIG.lat_m
    return F.sqrt(dx * dx + dy * dy) * (1 - 1e-9) - 1e-6


def nearest(points: DataFrame, targets: DataFrame, key: str, target_key: str, distance, size: float) -> DataFrame:
    """Each point's nearest target, ties to the smaller key; ``distance`` gets (x, y, tx, ty).  Without targets no rows.

    Cells are ``size`` wide, or as narrow as the targets are dense.  In the wider cells of later rounds a point first
    meets one target from each fine cell, 16 to a cell's width, and then all targets of the fine cells that may hold a
    nearer one; so a point far from a dense crowd doesn't meet all of the crowd.
    """
    t = targets.select(F.col(target_key).alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    d = distance(F.col("x"), F.col("y"), F.col("tx"), F.col("ty"))

    def best(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy(key).agg(F.min(F.struct(d.alias("d"), "target")).alias("m")).select(key, F.col("m.target").alias("target"), F.col("m.d").alias("d"))

    def pick(rest: DataFrame, size: float, first: bool) -> DataFrame:
        if first:
            return best(rest.join(ring_cells(point_cells(t, size, "tx", "ty"), 1), ["cx", "cy"]))
        fine = size / 16
        own = t.withColumn("fx", cell(F.col("tx"), fine)).withColumn("fy", cell(F.col("ty"), fine))
        some = own.groupBy("fx", "fy").agg(F.min(F.struct("tx", "ty")).alias("p")).select("fx", "fy", "p.*")
        asked = rest.join(ring_cells(point_cells(some, size, "tx", "ty"), 1), ["cx", "cy"]).select(key, "x", "y", "fx", "fy", d.alias("d"))
        near = asked.groupBy(key).agg(F.min("d").alias("most"))
        open_ = asked.join(near, key).where(_may_hold(fine) <= F.col("most")).select(key, "x", "y", "fx", "fy")
        return best(open_.join(own, ["fx", "fy"]))

    return _widening(points, key, min(size, _dense_size(targets, 2) or size), pick)


def kth_distance(points: DataFrame, key: str, k: int, distance) -> DataFrame:
    """Distance to the k-th nearest other point; none if there are fewer.  Cells are as wide as the points are dense."""
    size = _dense_size(points, k + 1)
    if size is None:
        return points.select(key, F.lit(None).cast("double").alias("d"))
    others = points.select(F.col(key).alias("other"), F.col("x").alias("tx"), F.col("y").alias("ty"))

    def pick(rest: DataFrame, size: float, first: bool) -> DataFrame:
        pairs = rest.join(ring_cells(point_cells(others, size, "tx", "ty"), 1), ["cx", "cy"])
        ranked = pairs.where(F.col(key) != F.col("other")).withColumn("d", distance(F.col("x"), F.col("y"), F.col("tx"), F.col("ty")))
        return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("d", "other"))).where(F.col("rank") == k).select(key, "d")

    return _widening(points, key, size, pick)
