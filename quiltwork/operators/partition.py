"""Partitioning an area into balanced territories, and repairing a board of territories."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltwork.config import CONFIG
from quiltwork.functions import board, heal, kernels, metric, morph, planar, ring
from quiltwork.functions import overlay as ov
from quiltwork.functions.judge import Rule
from quiltwork.functions.settle import Sizes
from quiltwork.operators import footprints
from quiltwork.operators import spatial_join as sj
from quiltwork.operators import ways
from quiltwork.sources.scratch import Scratch

#: Width in degrees of the cells by which footprints are freed; no multiple of it is a round number.
ROOF_CELL = 7e-5 * math.sqrt(2)
#: Smaller parts and holes of a territory are specks of rounding.
SPECK_M2 = 1e-6


def _tidy(x):
    return F.floor(x * 1e9 + 0.5) / 1e9


def sample_points(k: int, *sources: DataFrame) -> DataFrame:
    """id, x, y of the first sources (id, x, y) that have 2k points together: buildings, street middles, ring points."""
    out = None
    for n, source in enumerate(sources):
        own = source.select(F.struct(F.lit(n).alias("s"), F.col("id").cast("long").alias("i")).alias("id"), "x", "y")
        out = own if out is None else out.unionByName(own)
        if out.limit(2 * k).count() >= 2 * k:
            break
    return out


def lloyd(points: DataFrame, k: int, rounds: int, id_col: str = "id", lat: float = 50.01) -> DataFrame:
    """cluster, x, y after so many rounds of Lloyd's algorithm; it starts at the first ``k`` points by id.

    Distances are metres, with longitudes scaled at ``lat``.

    Ties go to the lower number, an empty cluster keeps its place, centres are rounded to 9 digits.  The centres
    (``k`` is at most 200) travel as literals, so a round is one scan and one small aggregation.
    """
    k = min(k, CONFIG.max_partitions)
    centres = [(i, r["x"], r["y"]) for i, r in enumerate(points.orderBy(id_col).limit(k).select("x", "y").collect())]
    for _ in range(rounds):
        rows = assign(points, centres, lat).groupBy("cluster").agg(_tidy(F.avg("x")).alias("x"), _tidy(F.avg("y")).alias("y")).collect()
        moved = {r["cluster"]: (r["x"], r["y"]) for r in rows}
        centres = [(i, *moved.get(i, (x, y))) for i, x, y in centres]
    return points.sparkSession.createDataFrame(centres, "cluster int, x double, y double")


def assign(points: DataFrame, centres: list[tuple[int, float, float]], lat: float = 50.01) -> DataFrame:
    """Points with ``cluster``, the nearest of at most 200 centres."""
    kx, ky = CONFIG.lng_m * math.cos(math.radians(lat)), CONFIG.lat_m
    near = F.array(*[F.struct((((F.col("x") - x) * kx) * ((F.col("x") - x) * kx) + ((F.col("y") - y) * ky) * ((F.col("y") - y) * ky)).alias("d"), F.lit(i).alias("i")) for i, x, y in centres])
    return points.withColumn("cluster", F.array_min(near)["i"])


def voronoi_cells(centres: DataFrame, box: tuple[float, float, float, float], lat: float = 50.01) -> DataFrame:
    """cluster, x, y, ring (array of struct x, y), area: Voronoi cells of at most 200 centres, clipped to a box."""
    x0, y0, x1, y1 = box
    k = CONFIG.lng_m * math.cos(math.radians(lat)) / CONFIG.lat_m
    ring = [(x0 * k, y0), (x1 * k, y0), (x1 * k, y1), (x0 * k, y1), (x0 * k, y0)]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cluster").drop_duplicates(["x", "y"])
        cells = [[(x / k, y) for x, y in c] for c in kernels.voronoi(list(zip(rows["x"] * k, rows["y"], strict=True)), ring)]
        return pd.DataFrame({"cluster": rows["cluster"], "x": rows["x"], "y": rows["y"], "ring": [[{"x": x, "y": y} for x, y in c] for c in cells], "area": [kernels.ring_area(c) for c in cells]})

    return centres.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(run, "cluster int, x double, y double, ring array<struct<x:double,y:double>>, area double")


def cell_borders(cells: DataFrame, box: tuple[float, float, float, float], digits: int = 7) -> DataFrame:
    """border, ax, ay, bx, by: the cells' edges, each once whichever cell it is from, without those on the box."""
    c, f = F.col, float(10**digits)
    r = lambda v: F.floor(v * f + 0.5) / f
    e = cells.select(F.explode(ring.edges(ring.close(c("ring")))).alias("e"))
    e = e.select(F.struct(r(c("e.a.x")).alias("x"), r(c("e.a.y")).alias("y")).alias("a"), F.struct(r(c("e.b.x")).alias("x"), r(c("e.b.y")).alias("y")).alias("b")).where("a <> b")
    e = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    slack = 2 / f
    on = lambda v, at: (F.abs(c(f"a.{v}") - at) < slack) & (F.abs(c(f"b.{v}") - at) < slack)
    e = e.where(~(on("x", box[0]) | on("x", box[2]) | on("y", box[1]) | on("y", box[3])))
    return e.select(F.xxhash64("a", "b").alias("border"), c("a.x").alias("ax"), c("a.y").alias("ay"), c("b.x").alias("bx"), c("b.y").alias("by"))


def follow_streets(borders: DataFrame, edges: DataFrame, nodes: DataFrame, reach: float = CONFIG.snap_reach_m, near: float = 2.0) -> DataFrame:
    """border, line: each border along the street graph, between the nodes nearest to its ends within ``reach`` metres.

    A step off the border's direction costs more, so that a border keeps to it.  An end more than ``near`` metres from
    its node stays as the line's end; a border without a way stays straight.  ``edges``: src, dst, w between node names;
    ``nodes``: node, x, y.
    """
    c = F.col
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    both = borders.select(F.concat_ws("|", c("border").cast("string"), F.lit("a")).alias("end"), c("ax").alias("x"), c("ay").alias("y")).union(borders.select(F.concat_ws("|", c("border").cast("string"), F.lit("b")), "bx", "by"))
    snapped = sj.nearest(both, nodes, "end", "node", metric.dist, 0.001).where(c("d") <= reach).select(F.split("end", "[|]").alias("e"), "target", "d")
    snapped = snapped.select(c("e")[0].cast("long").alias("border"), c("e")[1].alias("side"), "target", "d")
    ends = snapped.groupBy("border").agg(*[F.max(F.when(c("side") == s, c(v))).alias(f"{v}_{s}") for s in ("a", "b") for v in ("target", "d")])
    ends = ends.where("target_a IS NOT NULL AND target_b IS NOT NULL AND target_a <> target_b")
    place = lambda n, x, y: nodes.select(c("node").alias(n), c("x").alias(x), c("y").alias(y))
    placed = edges.join(place("src", "ax", "ay"), "src").join(place("dst", "bx", "by"), "dst")
    asked = ends.select(c("border").alias("key"), c("target_a").alias("src"), c("target_b").alias("dst")).join(borders.select(c("border").alias("key"), metric.bearing(c("ax"), c("ay"), c("bx"), c("by")).alias("bearing")), "key")
    asked = asked.join(place("src", "sx", "sy"), "src").join(place("dst", "tx", "ty"), "dst")
    found = ways.routes(placed, asked, budget=10**6).where("path IS NOT NULL")
    steps = found.select(c("key").alias("border"), F.posexplode("path").alias("k", "node")).join(nodes, "node").groupBy("border").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", point("x", "y").alias("p")))), lambda s: s["p"]).alias("way"))
    found = ends.join(steps, "border").select("border", "way", "d_a", "d_b")
    none = F.array().cast("array<struct<x:double,y:double>>")
    end = lambda s: F.when(c(f"d_{s}") > near, F.array(point(f"{s}x", f"{s}y"))).otherwise(none)
    straight = F.array(point("ax", "ay"), point("bx", "by"))
    return borders.join(found, "border", "left").select("border", F.when(c("way").isNotNull(), F.concat(end("a"), "way", end("b"))).otherwise(straight).alias("line"))


def emit_territories(cells: DataFrame, lines: DataFrame, roofs: DataFrame, box: tuple[float, float, float, float], reach: float = 5e-6) -> DataFrame:
    """cluster, ring_count, area, parts, fallback: territories bounded by lines instead of the cells' straight borders.

    Lines and the box are cut at their crossings; each face goes to the cell that holds its interior point, else to the
    nearest centre; a cell's faces are joined and clipped, what nobody holds joins the touching territory with the
    nearest centre, each territory is brought into one piece, and crossed footprints (id, box) go to one claimant, the
    smallest first.  An area has at most 200 cells, which meet in one task; footprints are freed block by block, and one
    task gets a territory's shape.
    """
    m2 = CONFIG.lat_m * CONFIG.lng_m * math.cos(math.radians((box[1] + box[3]) / 2))

    def run(cells: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        outer = morph.box(*box)
        segments = [s for r in outer for s in zip(r, r[1:], strict=False)]
        for line in lines["line"]:
            points = [(p["x"], p["y"]) for p in line]
            segments += zip(points, points[1:], strict=False)
        rows = sorted(cells.itertuples(), key=lambda r: r.cluster)
        rings = [[(p["x"], p["y"]) for p in r.ring] for r in rows]
        own: list[list] = [[] for _ in rows]
        far = [0] * len(rows)
        for face in planar.faces(planar.node(segments)):
            x, y = kernels.interior_point(face)
            if not kernels.inside(outer[0], x, y):
                continue
            k = next((k for k, ring in enumerate(rings) if kernels.inside(ring, x, y)), None)
            if k is None:
                k = min(range(len(rows)), key=lambda j: ((rows[j].x - x) ** 2 + (rows[j].y - y) ** 2, j))
                far[k] += 1
            own[k].append([face])
        shapes = [board.as_polygon(ov.intersect(board.as_polygon(ov.union_all(f)), outer)) if f else [] for f in own]
        names = [r.cluster for r in rows]
        for gap in ov.parts(ov.uncovered(outer, [s for s in shapes if s])):
            shape = board.as_polygon(gap)
            x, y = gap[0][2], gap[0][0]
            touching = [k for k, s in enumerate(shapes) if s and board.contact(shape, s, reach) > 0]
            if touching:
                k = min(touching, key=lambda j: ((rows[j].x - x) ** 2 + (rows[j].y - y) ** 2, j))
                shapes[k] = board.as_polygon(ov.union(shapes[k], shape))
        names, shapes = [n for n, s in zip(names, shapes, strict=True) if s], [s for s in shapes if s]
        joined = board.connect(shapes, reach, CONFIG.sliver_m2 / m2, CONFIG.territory_fraction, CONFIG.passes)
        names += [max(names) + 1 + k for k in range(len(joined) - len(names))]
        near = dict(zip((r.cluster for r in rows), far, strict=True))
        # places are kept relative to the box and in whole nanodegrees, so that what lies on one line has equal numbers
        near_box = [[[(round(x - box[0], 9), round(y - box[1], 9)) for x, y in r] for r in s] for s in joined]
        disc = []
        for s in near_box:  # specks of rounding are neither parts nor holes
            ground = ov.union_all([s])
            disc.append(sum(ov.area(p) * m2 > SPECK_M2 for p in ov.parts(ground, close=1e-11)) == 1 and all(ov.area(h) * m2 <= SPECK_M2 for h in morph.holes(ground)))
        out = [(n, footprints._cell(s), d, near.get(n, 0)) for n, s, d in zip(names, near_box, disc, strict=True)]
        return pd.DataFrame(out, columns=["ord", "rings", "disc", "fallback"])

    scratch = Scratch(cells.sparkSession, "territories")
    one = lambda df: df.withColumn("_one", F.lit(1))
    drawn = one(cells).groupBy("_one").cogroup(one(lines.select("line")).groupBy("_one")).applyInPandas(run, f"ord long, rings {footprints.RINGS}, disc boolean, fallback long")
    drawn = scratch.keep(drawn)
    rule = Rule(Sizes(unit=1 / m2, slice=CONFIG.slice_m2, share=CONFIG.slice_share, crumb=0.0, nothing=-1.0), claims=True, strands=False, discs=bool(drawn.agg(F.min("disc")).first()[0]))  # one row
    place = lambda v, at: F.round(F.col(v) - at, 9).alias(v)
    size = F.expr("(maxy - miny) * (maxx - minx + maxx - minx) / 2").alias("roof")
    local = roofs.select("id", size, place("minx", box[0]), place("miny", box[1]), place("maxx", box[0]), place("maxy", box[1]))
    changed = footprints.free_claimed(local, drawn.select("ord", "rings"), ROOF_CELL, rule, scratch)

    def whole(mine: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
        """A territory with its changed cells in place of what it held of them."""
        first = mine.iloc[0]
        squares = [r for x, y in zip(now["cx"], now["cy"], strict=True) for r in morph.box(x * ROOF_CELL, y * ROOF_CELL, (x + 1) * ROOF_CELL, (y + 1) * ROOF_CELL)]
        held = [r for shape in now["shape"] for r in footprints._shape(shape)]
        ground = ov.overlay([footprints._rings(first["rings"]), squares, held], lambda s: s[2] if s[1] else s[0])
        parts = [p for p in ov.parts(ground, close=1e-11) if ov.area(p) * m2 > SPECK_M2]
        rings = [[{"x": x + box[0], "y": y + box[1]} for x, y in r] for r in board.as_polygon(ground)]
        return pd.DataFrame([(first["ord"], rings, ov.area(ground) * m2, len(parts), first["fallback"])], columns=["cluster", "rings", "m2", "parts", "fallback"])

    return drawn.groupBy("ord").cogroup(changed.groupBy("ord")).applyInPandas(whole, "cluster long, rings array<array<struct<x:double,y:double>>>, m2 double, parts long, fallback long")


def heal_plan(slots: DataFrame, points: DataFrame, roofs: DataFrame, outer: tuple[float, float, float, float], project: str = "project", reach: float = 5e-6) -> DataFrame:
    """project, ord, host, size, adopted, split, detached, merged: where each territory (ord, box) went, gaps included.

    Gaps of the board are adopted, then territories in pieces are split, crossed footprints freed and empty territories
    merged, for up to three rounds.  Without points nothing is merged.  A project has at most 200 territories.
    """
    m2 = CONFIG.lat_m * CONFIG.lng_m * math.cos(math.radians((outer[1] + outer[3]) / 2))

    def whole(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = [(int(r.ord), morph.box(r.minx, r.miny, r.maxx, r.maxy)) for r in left.sort_values("ord").itertuples()]
        found = [board.as_polygon(g) for g in morph.gaps(morph.box(*outer), [s for _, s in own], CONFIG.gap_floor_m2 / m2, 2e-5)]
        places = [(r.x, r.y) for r in right.itertuples() if not pd.isna(r.x)]
        footprints = [morph.box(r.minx, r.miny, r.maxx, r.maxy) for r in right.itertuples() if not pd.isna(r.minx)]
        slots, hosts, report = heal.plan(own, places, footprints, found, CONFIG.slice_m2 / m2, CONFIG.slice_share, reach)
        size = {n: board.area(s) * m2 for n, s in slots}
        free = max(n for n, _ in own) + 1
        names = sorted({*size, *hosts, *(n for n, _ in own), *range(free, free + len(found))})
        return pd.DataFrame([(key[0], n, hosts.get(n, n), size.get(hosts.get(n, n)), *report.values()) for n in names], columns=[project, "ord", "host", "m2", *report])

    rest = points.select(project, "x", "y").unionByName(roofs.select(project, "minx", "miny", "maxx", "maxy"), allowMissingColumns=True)
    return slots.groupBy(project).cogroup(rest.groupBy(project)).applyInPandas(whole, f"{project} long, ord long, host long, m2 double, adopted long, split long, detached long, merged long")
