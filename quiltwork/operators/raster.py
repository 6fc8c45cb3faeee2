"""Boolean rasters as sets of cells, and kernels for what needs a whole raster."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltwork.functions import metric
from quiltwork.operators import graph


def cell_size(width_m: float, height_m: float, size: float, cap: int) -> float:
    """A cell size grown by half until the raster has at most ``cap`` cells."""
    while (width_m / size) * (height_m / size) > cap:
        size *= 1.5
    return size


def stamp_discs(points: DataFrame, x0: float, y0: float, degrees: float, radius_m: float, reach: int) -> DataFrame:
    """cx, cy: cells with their centre within ``radius_m`` of a point, and each point's own; ``reach`` cells suffice."""
    own = points.select("x", "y", F.floor((F.col("x") - x0) / degrees).alias("px"), F.floor((F.col("y") - y0) / degrees).alias("py"))
    near = F.sequence(F.lit(-reach), F.lit(reach))
    cells = own.withColumn("i", F.explode(near)).withColumn("j", F.explode(near)).select("x", "y", "i", "j", (F.col("px") + F.col("i")).alias("cx"), (F.col("py") + F.col("j")).alias("cy"))
    centre = metric.dist(F.col("x"), F.col("y"), x0 + (F.col("cx") + 0.5) * degrees, y0 + (F.col("cy") + 0.5) * degrees)
    return cells.where(((F.col("i") == 0) & (F.col("j") == 0)) | (centre <= radius_m)).select("cx", "cy").distinct()


def fill_rings(edges: DataFrame, key: str, x0: float, y0: float, degrees: float) -> DataFrame:
    """key, cx, cy: cells with their centre inside the rings (even-odd), from edges (key, ax, ay, bx, by), row by row."""
    c = F.col
    row = lambda v: F.ceil((v - y0) / degrees - 0.5)
    lo, hi = row(F.least("ay", "by")), row(F.greatest("ay", "by")) - 1
    met = edges.where("ay <> by").withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi").withColumn("cy", F.explode(F.sequence("lo", "hi")))
    yc = y0 + (c("cy") + 0.5) * degrees
    met = met.withColumn("x", c("ax") + (c("bx") - c("ax")) * (yc - c("ay")) / (c("by") - c("ay")))
    w = Window.partitionBy(key, "cy").orderBy("x")
    spans = met.withColumn("k", F.row_number().over(w)).withColumn("to", F.lead("x").over(w)).where("k % 2 = 1 AND to IS NOT NULL")
    first, last = F.ceil((c("x") - x0) / degrees - 0.5), F.ceil((c("to") - x0) / degrees - 0.5) - 1
    return spans.select(key, "cy", first.alias("a"), last.alias("b")).where("a <= b").select(key, F.explode(F.sequence("a", "b")).alias("cx"), "cy").distinct()


def label_cells(cells: set[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """4-connected components, numbered in the order of their first cell (row by row)."""
    out: dict[tuple[int, int], int] = {}
    n = 0
    for start in sorted(cells, key=lambda c: (c[1], c[0])):
        if start in out:
            continue
        out[start] = n
        queue = deque([start])
        while queue:
            x, y = queue.popleft()
            for near in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if near in cells and near not in out:
                    out[near] = n
                    queue.append(near)
        n += 1
    return out


def spread_components(cells: DataFrame) -> DataFrame:
    """cx, cy, label (the least of a component's cells, as cx * 2**20 + cy): 4-connected, over any number of tasks."""
    name = F.col("cx") * 1048576 + F.col("cy")
    own = cells.select("cx", "cy").distinct().withColumn("n", name)
    ahead = own.select((F.col("cx") - 1).alias("cx"), "cy", F.col("n").alias("dst")).union(own.select("cx", F.col("cy") - 1, "n"))
    links = own.join(ahead, ["cx", "cy"]).select(F.col("n").alias("src"), "dst")
    roots = graph.components(links)
    return own.join(roots, own["n"] == roots["node"], "left").select("cx", "cy", F.coalesce("root", "n").alias("label"))


def components(cells: DataFrame, project: str) -> DataFrame:
    """project, cx, cy, label: a project's raster is capped in size (``cell_size``) and labelled in one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        labels = label_cells(set(zip(rows["cx"], rows["cy"], strict=True)))
        return rows.assign(label=[labels[c] for c in zip(rows["cx"], rows["cy"], strict=True)])[[project, "cx", "cy", "label"]]

    return cells.groupBy(project).applyInPandas(run, f"{project} long, cx long, cy long, label long")


def rings_of(cells: set[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Boundary rings, exteriors counter-clockwise and holes clockwise; cells that meet at a corner stay apart."""
    ahead: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x, y in sorted(cells):
        for a, b, across in (((x, y), (x + 1, y), (x, y - 1)), ((x + 1, y), (x + 1, y + 1), (x + 1, y)), ((x + 1, y + 1), (x, y + 1), (x, y + 1)), ((x, y + 1), (x, y), (x - 1, y))):
            if across not in cells:
                ahead.setdefault(a, []).append(b)
    rings = []
    while ahead:
        start = min(ahead)
        ring, at = [start], ahead[start].pop(0)
        if not ahead[start]:
            del ahead[start]
        while at != start or False:
            before = ring[-1]
            ring.append(at)
            ways = ahead[at]
            d = (at[0] - before[0], at[1] - before[1])
            # at a corner that two cells share, turn left, so as to stay with the same cell
            left = (at[0] - d[1], at[1] + d[0])
            k = ways.index(left) if left in ways else 0
            nxt = ways.pop(k)
            if not ways:
                del ahead[at]
            at = nxt
        ring.append(start)
        rings.append(ring)
    return rings


def route_cells(cells: set[tuple[int, int]], start: tuple[int, int], goal: tuple[int, int]) -> list[tuple[int, int]] | None:
    """Shortest 4-connected way over marked cells."""
    came, queue = {start: None}, deque([start])
    while queue:
        at = queue.popleft()
        if at == goal:
            path = []
            while at is not None:
                path.append(at)
                at = came[at]
            return path[::-1]
        x, y = at
        for near in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if near in cells and near not in came:
                came[near] = at
                queue.append(near)
    return None


def snap(cells: set[tuple[int, int]], at: tuple[int, int], rings: int = 4) -> tuple[int, int] | None:
    """The nearest marked cell within so many rings."""
    near = [(max(abs(x - at[0]), abs(y - at[1])), (x - at[0]) ** 2 + (y - at[1]) ** 2, (x, y)) for x in range(at[0] - rings, at[0] + rings + 1) for y in range(at[1] - rings, at[1] + rings + 1) if (x, y) in cells]
    return min(near)[2] if near else None


def visible(cells: set[tuple[int, int]], a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Are all cells on the line marked, sampled at half cells?"""
    n = max(1, int(np.ceil(2 * np.hypot(b[0] - a[0], b[1] - a[1]))))
    return all((int(np.floor(a[0] + 0.5 + (b[0] - a[0]) * k / n)), int(np.floor(a[1] + 0.5 + (b[1] - a[1]) * k / n))) in cells for k in range(n + 1))


def pull(cells: set[tuple[int, int]], path: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Greedy string pulling: from each point to the furthest visible one."""
    out, at = [path[0]], 0
    while at < len(path) - 1:
        far = next(k for k in range(len(path) - 1, at, -1) if k == at + 1 or visible(cells, path[at], path[k]))
        out.append(path[far])
        at = far
    return out


def stamp_path(path: list[tuple[float, float]], radius: float, taper: float = 1.0) -> set[tuple[int, int]]:
    """Cells (unit squares) within discs set every half cell along a path; the radius goes evenly to ``taper`` times
    itself at the end, but not below one cell."""
    out: set[tuple[int, int]] = set()
    lengths = [float(np.hypot(b[0] - a[0], b[1] - a[1])) for a, b in zip(path, path[1:], strict=False)]
    whole, gone = sum(lengths), 0.0
    for (a, b), length in zip(zip(path, path[1:], strict=False), lengths, strict=True):
        n = max(1, int(np.ceil(2 * length)))
        for k in range(n + 1):
            at = (gone + length * k / n) / whole if whole else 0.0
            r = max(1.0, radius * (1 + (taper - 1) * at))
            x, y = a[0] + (b[0] - a[0]) * k / n, a[1] + (b[1] - a[1]) * k / n
            reach = range(-int(np.ceil(r)) - 1, int(np.ceil(r)) + 2)
            cx, cy = int(np.floor(x)), int(np.floor(y))
            out |= {(cx + i, cy + j) for i in reach for j in reach if np.hypot(cx + i + 0.5 - x, cy + j + 0.5 - y) <= r}
        gone += length
    return out
