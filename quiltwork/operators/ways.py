"""Ways along a street graph of any size: each task sees the streets around its own ends only.

A way is sought inside a window around its two ends.  Whoever leaves the window has to go at least to its edge and back,
so a way that costs no more than that is the best of the whole graph; only the others are sought again, in a window
twice as wide.  Ends of about the same span that lie in one tile share a window and a task.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltwork.config import CONFIG
from quiltwork.sources.scratch import Scratch

#: Width in degrees of the smallest tiles; ways that one task seeks in a window.
LEAST_TILE, WAYS_A_TASK = 0.001, 200

Place = tuple[float, float]


def meters(a: Place, b: Place) -> float:
    k = CONFIG.lng_m * math.cos(math.radians((a[1] + b[1]) / 2))
    return math.hypot((b[0] - a[0]) * k, (b[1] - a[1]) * CONFIG.lat_m)


def turn(a: Place, b: Place, bearing: float) -> float:
    """Acute angle in degrees between the way from a to b and a bearing."""
    k = CONFIG.lng_m * math.cos(math.radians((a[1] + b[1]) / 2))
    d = abs(math.degrees(math.atan2((b[0] - a[0]) * k, (b[1] - a[1]) * CONFIG.lat_m)) - bearing) % 180
    return 180 - d if d > 90 else d


def seek(near: dict, places: dict, start, goal, bearing: float | None, weight: float, budget: int) -> tuple[float, float, list] | None:
    """Cost, length and nodes of the best way by A*; a step costs ``1 + weight * angle / 90`` of its length.

    ``budget``: pops, stale ones included, after which there is no answer.
    """
    if start not in places or goal not in places:
        return None
    end = places[goal]
    best, came, done = {start: 0.0}, {}, set()
    heap, pops = [(meters(places[start], end), start)], 0
    while heap and pops < budget:
        _, at = heapq.heappop(heap)
        pops += 1
        if at == goal:
            path = [at]
            while at in came:
                at = came[at][0]
                path.append(at)
            return best[goal], sum(came[n][1] for n in path[:-1]), path[::-1]
        if at in done:
            continue
        done.add(at)
        for to, w in near.get(at, ()):
            if to in done:
                continue
            cost = best[at] + (w if bearing is None else w * (1 + weight * turn(places[at], places[to], bearing) / 90))
            if cost < best.get(to, math.inf):
                best[to], came[to] = cost, (at, w)
                heapq.heappush(heap, (cost + meters(places[to], end), to))
    return None


def _leaving(a: Place, b: Place, box: tuple[float, float, float, float]) -> float:
    """Meters that a way from a to b is long at least if it leaves the box: to the mirror image behind the nearest side."""
    x0, y0, x1, y1 = box
    k = CONFIG.lng_m * math.cos(math.radians(min(89.0, max(abs(y0), abs(y1)))))
    dx, dy = (b[0] - a[0]) * k, (b[1] - a[1]) * CONFIG.lat_m
    across = [math.hypot(dy, (a[0] - x0 + b[0] - x0) * k), math.hypot(dy, (x1 - a[0] + x1 - b[0]) * k)]
    along = [math.hypot(dx, (a[1] - y0 + b[1] - y0) * CONFIG.lat_m), math.hypot(dx, (y1 - a[1] + y1 - b[1]) * CONFIG.lat_m)]
    return 0.999 * min(across + along)  # mid-latitude lengths add up to within that


def _runner(box: tuple, pad: int, weight: float, budget: int):
    """Ways of one window."""

    def run(streets: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        places: dict = {}
        for a, b, w, ax, ay, bx, by in zip(*(streets[n] for n in ("src", "dst", "w", "ax", "ay", "bx", "by")), strict=True):
            near.setdefault(a, []).append((b, w))
            near.setdefault(b, []).append((a, w))
            places[a], places[b] = (ax, ay), (bx, by)
        out = []
        for r in asked.itertuples(index=False):
            size = LEAST_TILE * 2.0**r.level
            frame = ((r.ix - pad) * size, (r.iy - pad) * size, (r.ix + 2 + pad) * size, (r.iy + 2 + pad) * size)
            all_in = frame[0] <= box[0] and frame[1] <= box[1] and frame[2] >= box[2] and frame[3] >= box[3]
            way = seek(near, places, r.src, r.dst, None if math.isnan(r.bearing) else r.bearing, weight, budget)
            sure = all_in or (way is not None and way[0] <= _leaving((r.sx, r.sy), (r.tx, r.ty), frame))
            out.append((r.key, *((way[0], way[1], len(way[2]) - 1, way[2]) if way else (None, None, None, None)), sure))
        return pd.DataFrame(out, columns=["key", "cost", "meters", "hops", "path", "settled"]).astype({"hops": "Int64"})

    return run


def routes(edges: DataFrame, asked: DataFrame, weight: float = 0.3, budget: int = CONFIG.route_budget) -> DataFrame:
    """key, cost, meters, hops, path (nodes) of each way asked for; nulls where there is none within the budget.

    ``edges``: src, dst, w and the ends' places ax, ay, bx, by, undirected; ``asked``: key, src, dst, sx, sy, tx, ty and
    ``bearing``, the wanted direction in degrees (null: none).  Nodes that aren't in the graph have no way.  A task holds
    the streets of one window, which is as large as the ways in it have to be.
    """
    c = F.col
    scratch = Scratch(edges.sparkSession, "ways")
    edges = scratch.keep(edges.select("src", "dst", "w", "ax", "ay", "bx", "by"))
    box = edges.agg(F.min(F.least("ax", "bx")), F.min(F.least("ay", "by")), F.max(F.greatest("ax", "bx")), F.max(F.greatest("ay", "by"))).first()  # one row
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("cost", "double"), ("meters", "double"), ("hops", "long"), ("path", "array<string>"))]
    if box[0] is None:
        return asked.select("key", *nothing)
    span = F.greatest(F.abs(c("tx") - c("sx")), F.abs(c("ty") - c("sy")), F.lit(LEAST_TILE))
    level = F.ceil(F.log2(span / LEAST_TILE) - 1e-9).cast("int")
    rest = asked.select("key", "src", "dst", "sx", "sy", "tx", "ty", c("bearing").cast("double").alias("bearing"), F.greatest(level, F.lit(0)).alias("level"))
    schema = "key long, cost double, meters double, hops long, path array<string>, settled boolean"
    pad, found = 1, None
    while True:
        size = F.lit(LEAST_TILE) * F.pow(F.lit(2.0), c("level"))
        tiled = rest.withColumns({"ix": F.floor(F.least("sx", "tx") / size).cast("long"), "iy": F.floor(F.least("sy", "ty") / size).cast("long")})
        counts = tiled.groupBy("level", "ix", "iy").agg(F.ceil(F.count("*") / WAYS_A_TASK).cast("int").alias("copies"))
        mine = scratch.keep(tiled.join(counts, ["level", "ix", "iy"]).withColumn("copy", F.pmod(F.xxhash64("key"), c("copies")).cast("int")))
        levels = [r["level"] for r in mine.select("level").distinct().collect()]  # powers of two of degrees: some thirty at most
        if not levels:
            return found if found is not None else mine.select("key", *nothing)
        window = mine.select(*[c(n).alias(n) for n in ("level", "ix", "iy", "copy")]).distinct()
        reach = F.sequence(F.lit(-pad).cast("long"), F.lit(pad + 1).cast("long"))
        cells = window.withColumn("cx", F.explode(F.transform(reach, lambda d: c("ix") + d))).withColumn("cy", F.explode(F.transform(reach, lambda d: c("iy") + d)))
        at = lambda v: F.floor(v / size).cast("long")
        spread = edges.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels])))
        spread = spread.withColumn("cx", F.explode(F.sequence(at(F.least("ax", "bx")), at(F.greatest("ax", "bx"))))).withColumn("cy", F.explode(F.sequence(at(F.least("ay", "by")), at(F.greatest("ay", "by")))))
        streets = spread.join(cells, ["level", "cx", "cy"]).drop("cx", "cy").distinct()

        judged = scratch.keep(streets.groupBy("level", "ix", "iy", "copy").cogroup(mine.groupBy("level", "ix", "iy", "copy")).applyInPandas(_runner(tuple(box), pad, weight, budget), schema))
        done = judged.where("settled").drop("settled")
        found = done if found is None else found.union(done)
        rest = scratch.keep(rest.join(judged.where("NOT settled").select("key"), "key", "left_semi"))
        if rest.isEmpty():
            return found
        pad *= 2
