"""Proposing a tighter boundary around the buildings that are kept."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame

from quiltwork.config import CONFIG
from quiltwork.functions import kernels, links
from quiltwork.operators import raster

#: Width of a corridor in metres, and how much wider its tip is.
CORRIDOR_M, TIP = 12.0, 2.0


def _cells(points: list[tuple[float, float]], x0: float, y0: float, sx: float, sy: float, reach: float, size: float) -> set[tuple[int, int]]:
    r = int(math.ceil(reach / size))
    out = set()
    for x, y in points:
        px, py = (x - x0) / sx, (y - y0) / sy
        cx, cy = math.floor(px), math.floor(py)
        out.add((cx, cy))
        out |= {(cx + i, cy + j) for i in range(-r, r + 1) for j in range(-r, r + 1) if math.hypot(cx + i + 0.5 - px, cy + j + 0.5 - py) * size <= reach}
    return out


def propose(points: DataFrame, project: str, reach: float = CONFIG.reach_m, detail: float = 6.0, outers: DataFrame | None = None) -> DataFrame:
    """project, ring, kept_inside, kept_outside, ignored_inside, links for points (x, y, ignored).

    Discs of ``reach`` around the kept points; the component that holds most of them is home, and the others are linked
    to it by corridors between their closest points, in at most ``CONFIG.bridge_rounds`` rounds and only while there are
    no more than ``CONFIG.bridge_groups`` groups; the outer ring of home, simplified; counts are measured.  ``outers``
    (project, outer: closed ring of points) keeps all of it inside a boundary: a corridor is straight if that stays
    inside, else it goes round.  Without kept points the ring is null.  A project's raster has at most
    ``CONFIG.cell_cap`` cells, so it fits one task.
    """
    schema = f"{project} long, ring array<struct<x:double,y:double>>, kept_inside long, kept_outside long, ignored_inside long, links long"

    def both(rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame(columns=[part.split()[0] for part in schema.split(", ")])
        return run(rows, [(p["x"], p["y"]) for p in given["outer"].iloc[0]] if len(given) else None)

    def run(rows: pd.DataFrame, outer: list[tuple[float, float]] | None = None) -> pd.DataFrame:
        keep = list(zip(rows["x"][~rows["ignored"]], rows["y"][~rows["ignored"]], strict=True))
        drop = list(zip(rows["x"][rows["ignored"]], rows["y"][rows["ignored"]], strict=True))
        name = rows[project].iloc[0]
        if not keep:
            return pd.DataFrame({project: [name], "ring": [None], "kept_inside": [0], "kept_outside": [0], "ignored_inside": [0], "links": [0]})
        lat = (min(p[1] for p in keep) + max(p[1] for p in keep)) / 2
        kx, ky = CONFIG.lng_m * math.cos(math.radians(lat)), CONFIG.lat_m
        width, height = ((max(p[i] for p in keep) - min(p[i] for p in keep)) * k + 2 * reach + 8 * CONFIG.cell_m for i, k in ((0, kx), (1, ky)))
        size = raster.cell_size(width, height, CONFIG.cell_m, CONFIG.cell_cap)
        sx, sy = size / kx, size / ky
        x0, y0 = min(p[0] for p in keep) - (reach + 4 * size) / kx, min(p[1] for p in keep) - (reach + 4 * size) / ky
        cells = _cells(keep, x0, y0, sx, sy, reach, size)
        own_cells = [(math.floor((x - x0) / sx), math.floor((y - y0) / sy)) for x, y in keep]
        inside = links.fill([((x - x0) / sx, (y - y0) / sy) for x, y in outer]) if outer else None
        made = 0
        for _ in range(CONFIG.bridge_rounds):
            labels = raster.label_cells(cells)
            groups: dict[int, list[tuple[int, int]]] = {}  # the cells of each component's points
            for c in own_cells:
                groups.setdefault(labels[c], []).append(c)
            if not 1 < len(groups) <= CONFIG.bridge_groups:
                break
            held = Counter(labels[c] for c in own_cells)
            home = max(groups, key=lambda k: (held[k], -k))
            for k, own in groups.items():
                if k != home:
                    far, near = links.nearest_pair(own, groups[home])
                    legs = [(x + 0.5, y + 0.5) for x, y in links.corridor(near, far, inside)]
                    tip = max(CORRIDOR_M * TIP, 2 * size)
                    cells |= raster.stamp_path(legs, reach / size, min(1.0, tip / reach))
                    made += 1
        if inside is not None:
            cells = {c for c in cells if c in inside} or cells
            own_cells = [c for c in own_cells if c in cells]
        labels = raster.label_cells(cells)
        held = Counter(labels[c] for c in own_cells) or Counter(labels.values())
        home = max(held, key=lambda k: (held[k], -k))
        outline = max(raster.rings_of({c for c, k in labels.items() if k == home}), key=kernels.ring_area)
        ring = [(x0 + x * sx, y0 + y * sy) for x, y in outline]
        ring = kernels.simplify_ring(ring, max(6.0, min(detail, reach - 15)) / CONFIG.lat_m)
        hit = [kernels.inside(ring, *p) for p in keep]
        return pd.DataFrame({project: [name], "ring": [[{"x": x, "y": y} for x, y in ring]], "kept_inside": [sum(hit)], "kept_outside": [len(hit) - sum(hit)], "ignored_inside": [sum(kernels.inside(ring, *p) for p in drop)], "links": [made]})

    if outers is None:
        return points.groupBy(project).applyInPandas(lambda rows: run(rows), schema)
    return points.groupBy(project).cogroup(outers.groupBy(project)).applyInPandas(both, schema)
