"""Rings: arrays of struct(x, y), closed or not, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiltwork.config import CONFIG


def box_ring(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(point(minx, miny), point(maxx, miny), point(maxx, maxy), point(minx, maxy), point(minx, miny))


def close(ring: Column) -> Column:
    """Repeat the first position at the end, if it isn't there."""
    first = F.slice(ring, 1, 1)
    return F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, first))


def edges(ring: Column) -> Column:
    """array<struct<a, b>> of a closed ring."""
    return F.transform(F.slice(ring, F.lit(1), F.size(ring) - 1), lambda p, i: F.struct(p.alias("a"), F.get(ring, i + 1).alias("b")))


def signed_area(ring: Column) -> Column:
    """Shoelace sum of a closed ring; positive if counter-clockwise."""
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2


def area_m2(ring: Column) -> Column:
    """Planar area in square metres at the ring's mid-latitude; 0 for a null."""
    mid = (F.array_min(F.transform(ring, lambda p: p["y"])) + F.array_max(F.transform(ring, lambda p: p["y"]))) / 2
    return F.coalesce(F.abs(signed_area(ring)) * CONFIG.lat_m * CONFIG.lng_m * F.cos(F.radians(mid)), F.lit(0.0))


def bbox(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def centroid(ring: Column) -> Column:
    """Mean of the vertices without the closing one."""
    body = F.slice(ring, F.lit(1), F.size(ring) - 1)
    n = F.size(body)
    mean = lambda k: F.aggregate(body, F.lit(0.0), lambda s, p: s + p[k]) / n
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule on a closed ring."""
    crossing = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"])
    return F.size(F.filter(edges(ring), lambda e: F.coalesce(crossing(e), F.lit(False)))) % 2 == 1


def drop_collinear(ring: Column) -> Column:
    """A closed ring without vertices on the line between their neighbours."""
    body = F.slice(ring, F.lit(1), F.size(ring) - 1)
    n = F.size(body)

    def bends(p, i):
        a, b = F.get(body, (i + n - 1) % n), F.get(body, (i + 1) % n)
        return (p["x"] - a["x"]) * (b["y"] - p["y"]) - (p["y"] - a["y"]) * (b["x"] - p["x"]) != 0

    kept = F.filter(body, bends)
    return F.concat(kept, F.slice(kept, 1, 1))


def dedup(coords: Column, tolerance: float) -> Column:
    """Drop positions within ``tolerance`` of the last one kept."""
    near = lambda p, q: (F.abs(p["x"] - q["x"]) < tolerance) & (F.abs(p["y"] - q["y"]) < tolerance)
    return F.aggregate(coords, F.slice(coords, 1, 0), lambda acc, p: F.when((F.size(acc) > 0) & near(F.get(acc, F.size(acc) - 1), p), acc).otherwise(F.concat(acc, F.array(p))))
