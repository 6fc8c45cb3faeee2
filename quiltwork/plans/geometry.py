"""Repair of drawn rings, and opening with a round element, on shapes made from the tables' rows."""

from __future__ import annotations

import math

from quiltwork.functions import morph, repair, snap
from quiltwork.functions import overlay as ov
from quiltwork.operators import boards
from quiltwork.plans.registry import query
from quiltwork.sources import synth

#: Rings of seven kinds: plain, bow-tie, run twice, touching itself, loops inside with and against its way, flat.
_SIZES = "100 + c_custkey % 53 + CAST(floor(abs(c_acctbal)) AS BIGINT) % 97 AS w, 80 + c_custkey % 37 AS h, 20 + c_custkey % 29 AS a, 10 + c_custkey % 31 AS b"
_RINGS = {
    0: "0 0, w 0, w h, 0 h, 0 0",
    1: "0 0, w a, w 0, 0 b, 0 0",
    2: "0 0, w 0, w h, 0 h, 0 0, w 0, w h, 0 h, 0 0",
    3: "0 0, w h, 3*w 0, 3*w 2*h, w h, 0 2*h, 0 0",
    4: "0 0, 4*w 0, 4*w 4*h, 0 4*h, 0 0, w h, 2*w h, 2*w 2*h, w 2*h, w h, 0 0",
    5: "0 0, 4*w 0, 4*w 4*h, 0 4*h, 0 0, w h, w 2*h, 2*w 2*h, 2*w h, w h, 0 0",
    6: "0 0, w 0, 0 0, w 0, 0 0",
}
_MILLI = "CAST(floor(({}) * 1000 + 0.31e0) AS BIGINT)"


def _ring(text: str) -> str:
    return "array({})".format(", ".join("array(CAST({} AS DOUBLE), CAST({} AS DOUBLE))".format(*p.split()) for p in text.split(", ")))


def _drawn(spark, sf_dir):
    shapes = "CASE id % 7 {} END AS ring".format(" ".join(f"WHEN {k} THEN {_ring(r)}" for k, r in _RINGS.items()))
    return synth.read(spark, sf_dir, "customer").selectExpr("c_custkey AS id", *[s.strip() for s in _SIZES.split(", ")]).selectExpr("id", shapes)


def _points(ring) -> list[ov.Point]:
    return [(float(p[0]), float(p[1])) for p in ring]


@query(
    f"""WITH s AS (SELECT c_custkey AS id, c_custkey % 7 AS kind, {_SIZES} FROM customer),
    z AS (SELECT id, kind, CASE kind WHEN 0 THEN w * h WHEN 1 THEN w * (a * a + b * b) / (2e0 * (a + b)) WHEN 2 THEN w * h WHEN 3 THEN 3 * w * h WHEN 4 THEN 16 * w * h WHEN 5 THEN 15 * w * h ELSE 0 END AS ground,
      CASE kind WHEN 0 THEN w * h WHEN 1 THEN w * greatest(a * a, b * b) / (2e0 * (a + b)) WHEN 2 THEN w * h WHEN 3 THEN 2 * w * h WHEN 4 THEN 16 * w * h WHEN 5 THEN 15 * w * h ELSE 0 END AS kept FROM s)
    SELECT id, CASE WHEN kind = 6 THEN 'empty' WHEN kind IN (0, 5) THEN 'ok' ELSE 'repaired' END AS verdict, CAST(CASE kind WHEN 1 THEN 2 WHEN 3 THEN 2 WHEN 6 THEN 0 ELSE 1 END AS BIGINT) AS lobes, {_MILLI.format('ground')} AS ground, {_MILLI.format('kept')} AS kept FROM z"""
)
def ring_repairs(spark, sf_dir):
    """Rings of all customers, as drawn: what they enclose by winding number, in how many lobes, and the lobe that is kept."""

    def milli(area: float) -> int:
        return math.floor(area * 1000 + 0.31)

    def run(r):
        ring = _points(r.ring)
        verdict, lobes, shape = repair.repaired([[ring]])
        return [(r.id, verdict, lobes, milli(ov.area(repair.ground([ring]))), milli(ov.area(ov.union_all([shape]))))]

    return boards.each(_drawn(spark, sf_dir), run, "id long, verdict string, lobes long, ground long, kept long")


#: Square degrees to square kilometres at the equator, where the requests of the query lie.
_KM2 = "110.574e0 * 111.32e0 * cos(radians({mid}))"


@query(
    f"""WITH p AS (SELECT s_nationkey AS id, s_suppkey AS part, 0.01e0 + s_suppkey % 17 * 1e-3 AS w, 0.01e0 + s_suppkey % 13 * 5e-4 AS h, s_suppkey % 3 = 1 AS bow FROM supplier),
    a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY floor(CASE WHEN bow THEN w * h / 3 ELSE w * h END * 1e12 + 0.5e0) DESC, part) AS k FROM p),
    c AS (SELECT id, part, CASE WHEN bow THEN w * h * 0.375e0 ELSE w * h END * {_KM2.format(mid='CASE WHEN bow THEN 0.375e0 * h ELSE h / 2 END')} AS km2 FROM a WHERE k = 1)
    SELECT id, part, CAST(floor(km2 * 1000 + 0.31e0) AS BIGINT) AS milli_km2, CASE WHEN km2 > 2 THEN 'too large' END AS error FROM c"""
)
def request_repairs(spark, sf_dir):
    """Requests of several drawn parts (each nation's suppliers): the largest part, repaired, and the limit's verdict.

    A bow-tie is written with the difference of its lobes, and kept with the larger one.
    """
    from pyspark.sql import functions as F

    c = F.col
    parts = synth.read(spark, sf_dir, "supplier").selectExpr("CAST(s_nationkey AS INT) AS id", "s_suppkey AS part", "0.01D + s_suppkey % 17 * 0.001D AS w", "0.01D + s_suppkey % 13 * 0.0005D AS h", "s_suppkey % 3 = 1 AS bow")
    asked = parts.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("part", "w", "h", "bow"))).alias("parts"))  # a request's parts

    def drawn(p) -> ov.Polygon:
        w, h = p["w"], p["h"]
        if not p["bow"]:
            return [[(0.0, 0.0), (w, 0.0), (w, h), (0.0, h), (0.0, 0.0)]]
        # a base of w and a top of a third cross at three quarters of the height
        return [[(0.0, 0.0), (w, 0.0), (0.0, h), (w / 3, h), (0.0, 0.0)]]

    def run(r):
        shapes = [drawn(p) for p in r.parts]
        first = max(range(len(shapes)), key=lambda k: (math.floor(abs(repair.signed(shapes[k][0])) * 1e12 + 0.5), -k))
        verdict, _, shape = repair.repaired([shapes[first]])
        ys = [y for ring in shape for _, y in ring]
        km2 = ov.area(ov.union_all([shape])) * 110.574 * 111.32 * math.cos(math.radians((min(ys) + max(ys)) / 2))
        return [(r.id, r.parts[first]["part"], math.floor(km2 * 1000 + 0.31), "too large" if km2 > 2 else None)]

    return boards.each(asked.select("id", c("parts")), run, "id int, part long, milli_km2 long, error string")


_ARC = 16 * math.sin(math.pi / 16)
_GAP = "40 + c_custkey % 41 AS w, 6 + c_custkey % 23 AS h, 1 + c_custkey % 4 AS r"


@query(
    f"""WITH s AS (SELECT c_custkey AS id, c_custkey % 5 AS kind, {_GAP} FROM customer), z AS (SELECT id, CASE kind WHEN 0 THEN h > 2 * r WHEN 1 THEN FALSE WHEN 2 THEN TRUE WHEN 3 THEN TRUE ELSE h > 2 * r END AS stays,
      CASE kind WHEN 2 THEN w * 2.4e0 * r WHEN 3 THEN w * (h + 2 * r) ELSE w * CAST(h AS DOUBLE) END AS whole, CASE kind WHEN 4 THEN 2 ELSE 1 END AS lobes, r FROM s)
    SELECT id, CAST(CASE WHEN stays THEN lobes ELSE 0 END AS BIGINT) AS lobes, {_MILLI.format(f"CASE WHEN stays THEN lobes * (whole - (4 - {_ARC!r}e0) * r * r) ELSE 0 END")} AS size FROM z"""
)
def round_openings(spark, sf_dir):
    """Gaps opened by a disc: boxes, bars and slivers at 45 degrees, boxes with a thorn, and pairs joined by a thread.

    A slanted sliver of 1.8 radii goes, and a slanted bar of 2.4 stays, into which no square of two radii fits upright.
    """

    def turned(length: float, width: float) -> ov.Polygon:
        c = math.sqrt(0.5)
        return [[(0.0, 0.0), (length * c, length * c), (length * c - width * c, length * c + width * c), (-width * c, width * c), (0.0, 0.0)]]

    def run(row):
        w, h, r = float(row.w), float(row.h), float(row.r)
        kind = row.kind
        if kind == 0:
            part = ov.union_all([morph.box(0, 0, w, h)])
        elif kind in (1, 2):
            part = ov.union_all([turned(w, 1.8 * r if kind == 1 else 2.4 * r)])
        elif kind == 3:  # a thorn that no disc fits into
            part = ov.union_all([morph.box(0, 0, w, h + 2 * r), morph.box(w / 2, h + 2 * r, w / 2 + 1e-3, h + 6 * r)])
        else:
            part = ov.union_all([morph.box(0, 0, w, h), morph.box(w, h / 2, w + 10 * r, h / 2 + 1e-3), morph.box(w + 10 * r, 0, 2 * w + 10 * r, h)])
        lobes = [g for g in morph.opened(part, r, morph.DISC) if ov.area(g) > 1e-6]
        return [(row.kind, row.w, row.h, row.r, len(lobes), math.floor(sum(map(ov.area, lobes)) * 1000 + 0.31))]

    rows = synth.read(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_custkey % 5 AS kind", *[s.strip() for s in _GAP.split(", ")])
    names = ["kind", "w", "h", "r"]
    shapes = rows.select(names).distinct()  # equal shapes are opened once
    opened = boards.each(shapes, run, "kind long, w long, h long, r long, lobes long, size long")
    return rows.join(opened, names).select("id", "lobes", "size")


@query("SELECT c_custkey AS id, CAST(2 + c_custkey % 3 AS BIGINT) AS cuts, CAST(1 AS BIGINT) AS rings, CAST(5 AS BIGINT) AS corners, CAST((30 + c_custkey % 47) * (20 + c_custkey % 31) AS BIGINT) AS size, TRUE AS apart FROM customer")
def snapped_cuts(spark, sf_dir):
    """Boxes cut up by slanted lines on a grid of a hundredth and joined again: one ring without a seam.

    ``apart``: no piece lies on another by more than a cell's width along their border.
    """

    def run(r):
        w, h = 30 + r.id % 47, 20 + r.id % 31
        pieces = [morph.box(0, 0, w, h)]
        for k in range(2 + r.id % 3):
            t = 0.3 + (r.id * 7 + k * 11) % 23 / 9
            x, y = w * (0.3 + 0.07 * ((r.id + k) % 6)), h * (0.35 + 0.05 * ((r.id + 2 * k) % 7))
            dx, dy = 500 * math.cos(t), 500 * math.sin(t)
            half = [[(x - dx, y - dy), (x + dx, y + dy), (x + dx - dy, y + dy + dx), (x - dx - dy, y - dy + dx), (x - dx, y - dy)]]
            j = (r.id + k) % len(pieces)
            pieces = snap.cut(pieces, j, half, 0.01)
        whole = snap.union(pieces, 0.01)
        apart = all(snap.area(snap.intersect(a, b, 0.01)) < 0.01 * (w + h) for i, a in enumerate(pieces) for b in pieces[:i])
        return [(r.id, 2 + r.id % 3, len(whole), len(whole[0]), round(snap.area(whole)), apart)]

    return boards.each(synth.read(spark, sf_dir, "customer").selectExpr("c_custkey AS id"), run, "id long, cuts long, rings long, corners long, size long, apart boolean")
