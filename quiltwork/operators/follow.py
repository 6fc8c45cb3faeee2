"""Drawing a boundary along the streets: its vertices move onto them, and its edges run along them where they can."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltwork.config import CONFIG
from quiltwork.functions import facts, metric
from quiltwork.operators import spatial_join as sj
from quiltwork.operators import ways
from quiltwork.sources.scratch import Scratch

#: Metres: how far a vertex moves, how far a way strays from the ring, the shortest edge that is led along streets.
SNAP_M, SLACK_M, LEAST_M = 25.0, 40.0, 15.0
#: Ways sought for a ring, and pops of each.
WAYS, POPS = 400, 6000
POINT = "struct<x:double,y:double>"


def _pad(points: DataFrame, meters: float) -> float:
    """Degrees that hold so many metres in either direction at the points' latitudes."""
    top = points.agg(F.max(F.abs("y"))).first()[0] or 0.0  # one row
    return meters / (CONFIG.lng_m * math.cos(math.radians(min(89.0, top))))


def near_segments(points: DataFrame, segments: DataFrame, keys: list[str], same: list[str], meters: float) -> DataFrame:
    """``keys`` and at (x, y, t, d): each point's nearest place on a segment (ax, ay, bx, by), not beyond ``meters``.

    ``same``: columns that a point and a segment share to meet; points with none within reach are left out, and ties go to
    the least place.
    """
    c, pad = F.col, _pad(points, meters)
    boxes = segments.select(*same, "ax", "ay", "bx", "by", F.least("ax", "bx").alias("minx"), F.least("ay", "by").alias("miny"), F.greatest("ax", "bx").alias("maxx"), F.greatest("ay", "by").alias("maxy"))
    cells = sj.box_cells(boxes, 2 * pad, pad).drop("minx", "miny", "maxx", "maxy")
    met = sj.point_cells(points.select(*keys, "x", "y"), 2 * pad).join(cells, [*same, "cx", "cy"])
    at = metric.closest_on_segment(c("x"), c("y"), c("ax"), c("ay"), c("bx"), c("by"))
    met = met.select(*keys, at.alias("at")).where(c("at.d") <= meters)
    return met.groupBy(*keys).agg(F.min_by("at", F.struct("at.d", "at.x", "at.y")).alias("at"))


def anchors(rings: DataFrame, edges: DataFrame, snap: float = SNAP_M) -> DataFrame:
    """key, i, n, x, y, node: each ring's vertices, on the nearest street within ``snap`` metres, and the node near there.

    ``rings``: key, ring (open or closed array of points); a vertex without a street stays and has no node.
    """
    c = F.col
    size = F.size("ring")
    open_ring = F.when((size > 1) & (F.get("ring", F.lit(0)) == F.get("ring", size - 1)), F.slice("ring", F.lit(1), size - 1)).otherwise(c("ring"))
    vertices = rings.select("key", open_ring.alias("ring")).select("key", F.size("ring").alias("n"), F.posexplode("ring").alias("i", "p")).select("key", "n", "i", c("p.x").alias("x"), c("p.y").alias("y"))
    on = near_segments(vertices, edges, ["key", "i"], [], snap)
    moved = vertices.join(on, ["key", "i"], "left").select("key", "n", "i", F.coalesce("at.x", "x").alias("x"), F.coalesce("at.y", "y").alias("y"), c("at").isNotNull().alias("hit"))
    nodes = edges.select(c("src").alias("node"), c("ax").alias("nx"), c("ay").alias("ny")).union(edges.select("dst", "bx", "by")).distinct()
    pad = _pad(moved, snap)
    ringed = sj.ring_cells(sj.point_cells(nodes, pad, "nx", "ny"), 1)
    d = metric.dist(c("x"), c("y"), c("nx"), c("ny"))
    near = sj.point_cells(moved.where("hit"), pad).join(ringed, ["cx", "cy"]).select("key", "i", "node", "nx", "ny", d.alias("d")).where(c("d") <= snap)
    near = near.groupBy("key", "i").agg(F.min(F.struct("d", "node", "nx", "ny")).alias("at"))
    return moved.join(near, ["key", "i"], "left").select("key", "n", "i", "x", "y", "hit", c("at.node").alias("node"), c("at.nx").alias("nx"), c("at.ny").alias("ny"))


def follow(rings: DataFrame, edges: DataFrame, snap: float = SNAP_M, slack: float = SLACK_M, most: int = WAYS) -> DataFrame:
    """key, ring, moved, routed: each ring along the streets, how many vertices have moved and how many edges follow.

    An edge of at least ``LEAST_M`` between two vertices with different nodes is led along the shortest way between
    these, unless that is too long a way round, has no node in between, or strays more than ``slack`` metres from the
    ring as it was; of a ring's edges the first ``most`` are tried.  Rings of fewer than three vertices have no result.
    ``edges`` as in ``ways.routes``.
    """
    c = F.col
    scratch = Scratch(rings.sparkSession, "follow")
    edges = scratch.keep(edges)
    rings = scratch.keep(rings.select("key", "ring"))
    own = scratch.keep(anchors(rings, edges, snap).where("n > 2"))
    after = own.select("key", F.pmod(c("i") - 1, c("n")).alias("i"), c("x").alias("tx"), c("y").alias("ty"), c("node").alias("dst"), c("nx").alias("dx"), c("ny").alias("dy"))
    hops = own.join(after, ["key", "i"]).withColumn("direct", metric.dist(c("x"), c("y"), c("tx"), c("ty")))
    hops = hops.where((c("node") != c("dst")) & (c("direct") >= LEAST_M))
    hops = hops.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("i"))).where(c("rank") <= most)
    hops = scratch.keep(hops.withColumn("way", F.xxhash64("key", "i")))
    asked = hops.select(c("way").alias("key"), c("node").alias("src"), "dst", c("nx").alias("sx"), c("ny").alias("sy"), c("dx").alias("tx"), c("dy").alias("ty"), F.lit(None).alias("bearing"))
    found = scratch.keep(ways.routes(edges, asked, budget=POPS).select(c("key").alias("way"), "meters", "path"))
    led = hops.join(found, "way").where((F.size("path") > 2) & facts.accepts_detour(c("meters"), c("direct"))).select("key", "i", "path")
    nodes = edges.select(c("src").alias("node"), c("ax").alias("x"), c("ay").alias("y")).union(edges.select("dst", "bx", "by")).distinct()
    inner = led.select("key", "i", F.size("path").alias("size"), F.posexplode("path").alias("k", "node")).where((c("k") > 0) & (c("k") < c("size") - 1)).join(nodes, "node")
    inner = scratch.keep(inner.select("key", "i", "k", "x", "y"))
    ring = F.when(F.get("ring", F.lit(0)) == F.get("ring", F.size("ring") - 1), c("ring")).otherwise(F.concat("ring", F.slice("ring", 1, 1)))
    steps = rings.select("key", F.explode(F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("a"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("b"))).alias("s"))
    steps = steps.select("key", c("s.a.x").alias("ax"), c("s.a.y").alias("ay"), c("s.b.x").alias("bx"), c("s.b.y").alias("by"))
    close = near_segments(inner, steps, ["key", "i", "k"], ["key"], slack).select("key", "i", "k", F.lit(True).alias("close"))
    judged = inner.join(close, ["key", "i", "k"], "left").groupBy("key", "i").agg(F.sort_array(F.collect_list(F.struct("k", F.struct("x", "y").alias("p")))).alias("middle"), F.every(F.coalesce("close", F.lit(False))).alias("ok"))
    middle = judged.where("ok").select("key", "i", F.transform("middle", lambda m: m["p"]).alias("middle"))
    legs = own.join(middle, ["key", "i"], "left").groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("i", F.concat(F.array(F.struct("x", "y")), F.coalesce("middle", F.array().cast(f"array<{POINT}>"))).alias("leg")))).alias("legs"),
        F.sum(c("hit").cast("long")).alias("moved"),
        F.count("middle").alias("routed"),
    )
    line = legs.withColumn("line", F.flatten(F.transform("legs", lambda e: e["leg"])))
    away = lambda p, q: (F.abs(p["x"] - q["x"]) > 1e-9) | (F.abs(p["y"] - q["y"]) > 1e-9)
    none = F.array().cast(f"array<{POINT}>")
    tidy = F.aggregate("line", none, lambda out, p: F.when((F.size(out) == 0) | away(F.element_at(out, -1), p), F.concat(out, F.array(p))).otherwise(out))
    return line.select("key", F.concat(tidy, F.slice("line", 1, 1)).alias("ring"), "moved", "routed")
