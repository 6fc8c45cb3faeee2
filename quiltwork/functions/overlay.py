"""Boolean overlay of polygons, exact up to floating point, by horizontal slabs.

The plane is cut at every vertex and crossing height, so inside a slab no two edges cross; there the even-odd rule of
each operand is read from left to right, and the result is a list of trapezoids (y0, y1, left at y0, left at y1,
right at y0, right at y1).  Polygons are lists of closed rings; holes are rings of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from quiltwork.functions import kernels

Point = tuple[float, float]
Polygon = list[list[Point]]
Trapezoid = tuple[float, float, float, float, float, float]


def _edges(polygon: Polygon, owner: int) -> list[tuple[float, float, float, float, int]]:
    """Edges from their lower to their upper end."""
    out = []
    for ring in polygon:
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            if ay != by:
                out.append((ax, ay, bx, by, owner) if ay < by else (bx, by, ax, ay, owner))
    return out


def _heights(edges: list[tuple[float, float, float, float, int]]) -> list[float]:
    ys = {v for e in edges for v in (e[1], e[3])}
    if all(e[0] == e[2] for e in edges):  # upright edges don't cross
        return sorted(ys)
    order = sorted(edges, key=lambda e: e[1])
    for i, (ax, ay, bx, by, _) in enumerate(order):
        for cx, cy, dx, dy, _ in order[i + 1 :]:
            if cy >= by:
                break
            if max(cx, dx) < min(ax, bx) or min(cx, dx) > max(ax, bx):
                continue
            det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if det:
                t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det
                u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / det
                if 0 < t < 1 and 0 <= u <= 1:
                    ys.add(ay + (by - ay) * t)
    return sorted(ys)


def _at(e: tuple, y: float) -> float:
    return e[0] + (e[2] - e[0]) * (y - e[1]) / (e[3] - e[1])


def _slabs(edges: list[tuple]) -> Iterator[tuple[float, float, list[tuple]]]:
    """Each slab's heights and its edges from left to right; an edge is looked at only between its own ends."""
    ys = _heights(edges)
    order = sorted(range(len(edges)), key=lambda k: edges[k][1])
    live: list[int] = []
    begun = 0
    for y0, y1 in zip(ys, ys[1:], strict=False):
        mid = (y0 + y1) / 2
        live = [k for k in live if edges[k][3] >= y1]
        while begun < len(order) and edges[order[begun]][1] <= y0:
            if edges[order[begun]][3] >= y1:
                live.append(order[begun])
            begun += 1
        live.sort(key=lambda k: (_at(edges[k], mid), k))
        yield y0, y1, [edges[k] for k in live]


def _cover(edges: list[tuple], state: list[int], step: Callable[[list[int], tuple], None], keep: Callable[[list[int]], bool]) -> list[Trapezoid]:
    """Where ``keep`` holds for the state that ``step`` changes at each edge, from left to right."""
    out: list[Trapezoid] = []
    for y0, y1, live in _slabs(edges):
        now, spans, begin = list(state), [], None
        for e in live:
            step(now, e)
            inside = keep(now)
            if inside and begin is None:
                begin = (_at(e, y0), _at(e, y1))
            elif not inside and begin is not None:
                end = (_at(e, y0), _at(e, y1))
                if spans and abs(spans[-1][1][0] - begin[0]) + abs(spans[-1][1][1] - begin[1]) < 1e-12:  # two operands that meet
                    spans[-1] = (spans[-1][0], end)
                else:
                    spans.append((begin, end))
                begin = None
        out += [(y0, y1, a[0], a[1], b[0], b[1]) for a, b in spans]
    return [t for t in out if t[4] > t[2] or t[5] > t[3]]


def overlay(polygons: list[Polygon], keep: Callable[[list[bool]], bool]) -> list[Trapezoid]:
    """Where ``keep`` holds for the list of which operands cover the place."""

    def step(state: list, e: tuple) -> None:
        state[e[4]] = not state[e[4]]

    return _cover([e for k, p in enumerate(polygons) for e in _edges(p, k)], [False] * len(polygons), step, keep)


def wound(ring: list[Point]) -> list[Trapezoid]:
    """Where a ring winds around a place, however often: self-crossing and doubled rings cover what they enclose."""

    def step(state: list, e: tuple) -> None:
        state[0] += e[4]

    ways = [1 if a[1] < b[1] else -1 for a, b in zip(ring, ring[1:], strict=False) if a[1] != b[1]]
    edges = [(*e[:4], way) for e, way in zip(_edges([ring], 0), ways, strict=True)]
    return _cover(edges, [0], step, lambda state: state[0] != 0)


def area(parts: list[Trapezoid]) -> float:
    return sum((t[1] - t[0]) * (t[4] - t[2] + t[5] - t[3]) / 2 for t in parts)


def union(a: Polygon, b: Polygon) -> list[Trapezoid]:
    return overlay([a, b], any)


def clip(shape: Polygon, frame: tuple[float, float, float, float]) -> Polygon:
    """Rings cut to a box one by one; under the even-odd rule holes and the seams along the box stay right."""
    x0, y0, x1, y1 = frame
    out = []
    for ring in shape:
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        if min(xs) >= x0 and max(xs) <= x1 and min(ys) >= y0 and max(ys) <= y1:
            out.append(ring)
            continue
        for nx, ny, c in ((-1.0, 0.0, -x0), (1.0, 0.0, x1), (0.0, -1.0, -y0), (0.0, 1.0, y1)):
            ring = kernels.clip_half_plane(ring, nx, ny, c)
            if not ring:
                break
        if len(ring) > 3:
            out.append(ring)
    return out


def _within(a: Polygon, b: Polygon) -> Polygon:
    """``a`` cut to the box around ``b`` where that spares sweeping a long ring's far side."""
    if sum(map(len, a)) <= 200 or not any(b):
        return a
    xs, ys = [x for r in b for x, _ in r], [y for r in b for _, y in r]
    return clip(a, (min(xs), min(ys), max(xs), max(ys)))


def intersect(a: Polygon, b: Polygon) -> list[Trapezoid]:
    a = _within(a, b)
    return overlay([a, _within(b, a)] if any(a) else [a, b], all)


def difference(a: Polygon, b: Polygon) -> list[Trapezoid]:
    return overlay([a, b], lambda s: s[0] and not s[1])


def union_all(polygons: list[Polygon]) -> list[Trapezoid]:
    return overlay(polygons, any)


def uncovered(outer: Polygon, polygons: list[Polygon]) -> list[Trapezoid]:
    return overlay([outer, *polygons], lambda s: s[0] and not any(s[1:]))


def parts(trapezoids: list[Trapezoid], slack: float = 1e-12, close: float = 0.0) -> list[list[Trapezoid]]:
    """Groups of trapezoids that share a stretch of a border, largest area first.

    ``close``: heights that differ by no more are one; where slanted edges meet, rounding can lose a slab of that height.
    """
    order = sorted(trapezoids)
    up = list(range(len(order)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    floor: dict[float, list[int]] = {}
    level = lambda y: math.floor(y / close) if close else y
    for k, t in enumerate(order):
        floor.setdefault(level(t[0]), []).append(k)
    for k, t in enumerate(order):
        top = level(t[1])
        for m in [m for y in ((top - 1, top, top + 1) if close else (top,)) for m in floor.get(y, ())]:
            if m == k or abs(order[m][0] - t[1]) > close:
                continue
            if min(t[5], order[m][4]) - max(t[3], order[m][2]) > slack:
                up[root(m)] = root(k)
    groups: dict[int, list[Trapezoid]] = {}
    for k, t in enumerate(order):
        groups.setdefault(root(k), []).append(t)
    return sorted(groups.values(), key=lambda g: (-area(g), g[0]))


def outline(trapezoids: list[Trapezoid], slack: float = 1e-12, close: float = 1e-10) -> Polygon:
    """The rings around trapezoids of one overlay: exteriors counter-clockwise, holes clockwise, no vertex on a straight line.

    Sides that two trapezoids share, and the stretches of heights that lie between two of them, are no border.
    Vertices on a line within ``slack`` go, and vertices at one height within ``close`` are one; no rings are given where
    they do not close.
    """
    ahead: dict[Point, list[Point]] = {}
    levels: dict[float, list[tuple[float, int]]] = {}
    # crossing edges give their crossing with different rounding: close places at one height are one
    heights: dict[float, list[float]] = {}
    for y0, y1, l0, l1, r0, r1 in trapezoids:
        heights.setdefault(y0, []).extend((l0, r0))
        heights.setdefault(y1, []).extend((l1, r1))
    same: dict[Point, float] = {}
    for y, xs in heights.items():
        held = before = None
        for x in sorted(set(xs)):
            held = x if before is None or x - before > close else held
            same[x, y], before = held, x
    for y0, y1, l0, l1, r0, r1 in trapezoids:
        l0, l1, r0, r1 = same[l0, y0], same[l1, y1], same[r0, y0], same[r1, y1]
        ahead.setdefault((r0, y0), []).append((r1, y1))
        ahead.setdefault((l1, y1), []).append((l0, y0))
        for y, left, right, turn in ((y0, l0, r0, 1), (y1, l1, r1, -1)):
            if right > left:
                levels.setdefault(y, []).extend(((left, turn), (right, -turn)))
    for y, marks in levels.items():
        # +1 where ground begins above, -1 where it ends below; both cancel out
        state, since = 0, 0.0
        for x, turn in sorted(marks):
            if state > 0 and x > since:
                ahead.setdefault((since, y), []).append((x, y))
            elif state < 0 and x > since:
                ahead.setdefault((x, y), []).append((since, y))
            state, since = state + turn, x
    rings = []
    while ahead:
        start = min(ahead)
        ring = [start]
        while True:
            at = ring[-1]
            ways = ahead[at]
            k = 0
            if len(ways) > 1 and len(ring) > 1:  # the sharpest left turn stays with the same ground
                dx, dy = at[0] - ring[-2][0], at[1] - ring[-2][1]
                k = max(range(len(ways)), key=lambda j: math.atan2(dx * (ways[j][1] - at[1]) - dy * (ways[j][0] - at[0]), dx * (ways[j][0] - at[0]) + dy * (ways[j][1] - at[1])))
            near = ways.pop(k)
            if not ways:
                del ahead[at]
            if near == start:
                break
            if near not in ahead:  # rounding has broken the ring
                return []
            ring.append(near)
        body, moved = ring, True
        while moved and len(body) > 2:
            keep = []
            for j, p in enumerate(body):
                a, b = keep[-1] if keep else body[-1], body[(j + 1) % len(body)]
                n = math.hypot(b[0] - a[0], b[1] - a[1])
                if p != a and (not n or abs((p[0] - a[0]) * (b[1] - a[1]) - (p[1] - a[1]) * (b[0] - a[0])) > slack * n):
                    keep.append(p)
            moved, body = len(keep) < len(body), keep
        if len(body) > 2:
            rings.append([*body, body[0]])
    return rings


def perimeter(group: list[Trapezoid]) -> float:
    """Length of the outline: sides, and the parts of horizontal borders that no neighbour shares."""
    from math import hypot

    total = sum(hypot(t[1] - t[0], t[3] - t[2]) + hypot(t[1] - t[0], t[5] - t[4]) + (t[4] - t[2]) + (t[5] - t[3]) for t in group)
    for a in group:
        for b in group:
            if a[1] == b[0]:
                total -= 2 * max(0.0, min(a[5], b[4]) - max(a[3], b[2]))
    return total


def gaps(outer: Polygon, polygons: list[Polygon], floor: float, thin: float) -> list[list[Trapezoid]]:
    """Uncovered parts of at least ``floor`` area that are thicker (area by perimeter) than ``thin``, largest first."""
    return [g for g in parts(uncovered(outer, polygons)) if area(g) >= floor and area(g) / perimeter(g) >= thin]
