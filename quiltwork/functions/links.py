"""Corridors between components of a raster: the shortest link of two groups, inside a boundary if there is one."""

from __future__ import annotations

import math

from quiltwork.operators import raster

Cell = tuple[int, int]
#: Cells of a bucket side in the search for the nearest pair.
BUCKET = 16


def nearest_pair(own: list[Cell], home: list[Cell]) -> tuple[Cell, Cell]:
    """The closest two cells of two groups (ties: the least pair), exactly.

    A wave goes out from every cell of ``own`` over buckets of ``home``, and stops where no bucket can hold a closer one.
    """
    held: dict[Cell, list[Cell]] = {}
    for x, y in home:
        held.setdefault((x // BUCKET, y // BUCKET), []).append((x, y))
    span = max(max(abs(bx - x // BUCKET), abs(by - y // BUCKET)) for x, y in own for bx, by in ((min(b[0] for b in held), min(b[1] for b in held)), (max(b[0] for b in held), max(b[1] for b in held))))
    best: tuple[int, Cell, Cell] | None = None
    for p in sorted(own):
        cx, cy = p[0] // BUCKET, p[1] // BUCKET
        for ring in range(span + 1):
            if best and max(0, (ring - 1) * BUCKET) ** 2 > best[0]:
                break
            for bx in range(cx - ring, cx + ring + 1):
                step = 1 if abs(bx - cx) == ring else 2 * ring or 1
                for by in range(cy - ring, cy + ring + 1, step):
                    for q in held.get((bx, by), ()):
                        d = ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2, p, q)
                        if best is None or d < best:
                            best = d
    return best[1], best[2]


def fill(ring: list[tuple[float, float]]) -> set[Cell]:
    """Unit cells whose centres lie inside a closed ring, by the even-odd rule, row by row."""
    out: set[Cell] = set()
    ys = [y for _, y in ring]
    for row in range(math.floor(min(ys)), math.ceil(max(ys)) + 1):
        y = row + 0.5
        cuts = sorted(ax + (bx - ax) * (y - ay) / (by - ay) for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False) if (ay <= y) != (by <= y))
        for a, b in zip(cuts[::2], cuts[1::2], strict=True):
            out |= {(x, row) for x in range(math.ceil(a - 0.5), math.ceil(b - 0.5))}
    return out


def corridor(start: Cell, goal: Cell, inside: set[Cell] | None) -> list[Cell]:
    """Straight, unless that leaves ``inside`` anywhere: then the way over its cells, pulled straight.

    Ends off ``inside`` go in at the nearest of its cells; where there is no way round, the line is straight all the same.
    """
    if inside is None or raster.visible(inside, start, goal):
        return [start, goal]
    a, b = (p if p in inside else raster.snap(inside, p) for p in (start, goal))
    way = raster.route_cells(inside, a, b) if a and b else None
    if not way or len(way) < 2:
        return [start, goal]
    legs = raster.pull(inside, way)
    return [start, *legs[1:-1], goal]
