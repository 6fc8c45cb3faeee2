"""Geometry kernels on lists of (x, y); rings are closed."""

from __future__ import annotations

import math

Point = tuple[float, float]


def ring_area(ring: list[Point]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def inside(ring: list[Point], x: float, y: float) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def clip_half_plane(ring: list[Point], nx: float, ny: float, c: float) -> list[Point]:
    """The part of a convex ring with nx x + ny y <= c."""
    out: list[Point] = []
    for a, b in zip(ring, ring[1:], strict=False):
        da, db = nx * a[0] + ny * a[1] - c, nx * b[0] + ny * b[1] - c
        if da <= 0:
            out.append(a)
        if (da < 0 < db) or (db < 0 < da):
            t = da / (da - db)
            out.append((a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t))
    return [*out, out[0]] if len(out) >= 3 else []


def clip_convex(ring: list[Point], clip: list[Point]) -> list[Point]:
    """The part of a ring inside a convex counter-clockwise ring."""
    for a, b in zip(clip, clip[1:], strict=False):
        if len(ring) < 4:
            return []
        nx, ny = b[1] - a[1], a[0] - b[0]
        ring = clip_half_plane(ring, nx, ny, nx * a[0] + ny * a[1])
    return ring


def voronoi(centroids: list[Point], box: list[Point]) -> list[list[Point]]:
    """Each centroid's cell in a convex box: the box cut by all bisectors."""
    cells = []
    for i, (px, py) in enumerate(centroids):
        cell = box
        for j, (qx, qy) in enumerate(centroids):
            if i != j and cell:
                nx, ny = qx - px, qy - py
                cell = clip_half_plane(cell, nx, ny, (qx * qx + qy * qy - px * px - py * py) / 2)
        cells.append(cell)
    return cells


def despike(ring: list[Point], area: float) -> list[Point]:
    """Drop vertices at which the ring doubles back with a triangle of at most ``area``; the same ring if there is none."""
    body, moved = ring[:-1], True
    while moved and len(body) > 3:
        moved = False
        for k in range(len(body)):
            a, b, c = body[k - 1], body[k], body[(k + 1) % len(body)]
            dot = (b[0] - a[0]) * (c[0] - b[0]) + (b[1] - a[1]) * (c[1] - b[1])
            cross = (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])
            if dot < 0 and abs(cross) / 2 <= area or a == b:
                body = body[:k] + body[k + 1 :]
                moved = True
                break
    return [*body, body[0]] if len(body) < len(ring) - 1 else ring


def simplify(line: list[Point], tolerance: float) -> list[Point]:
    """Douglas-Peucker without recursion."""
    keep, stack = {0, len(line) - 1}, [(0, len(line) - 1)]
    while stack:
        a, b = stack.pop()
        (ax, ay), (bx, by) = line[a], line[b]
        n = math.hypot(bx - ax, by - ay)
        far, most = -1, tolerance
        for k in range(a + 1, b):
            x, y = line[k]
            d = abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / n if n else math.hypot(x - ax, y - ay)
            if d > most:
                far, most = k, d
        if far > 0:
            keep.add(far)
            stack += [(a, far), (far, b)]
    return [line[k] for k in sorted(keep)]


def simplify_ring(ring: list[Point], tolerance: float) -> list[Point]:
    """A simplified ring, or the ring itself if too little is left of it."""
    far = max(range(len(ring)), key=lambda k: (ring[k][0] - ring[0][0]) ** 2 + (ring[k][1] - ring[0][1]) ** 2)
    out = simplify(ring[: far + 1], tolerance)[:-1] + simplify(ring[far:], tolerance)
    return out if len(out) >= 4 and abs(ring_area(out)) > 0 else ring


def interior_point(ring: list[Point]) -> Point:
    """The middle of the widest span on the scan line through the box's middle."""
    ys = [p[1] for p in ring]
    y = (min(ys) + max(ys)) / 2
    if any(p[1] == y for p in ring):
        y += (max(ys) - min(ys)) * 1e-3
    xs = sorted((bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False) if (ay > y) != (by > y))
    spans = [(b - a, (a + b) / 2) for a, b in zip(xs[::2], xs[1::2], strict=False)]
    return (max(spans)[1], y) if spans else ring[0]


def rect_union(rects: list[tuple[float, float, float, float]]) -> tuple[list[tuple[float, float, float, float]], float]:
    """A union of axis-aligned boxes as disjoint boxes, and its area."""
    xs, ys = sorted({v for r in rects for v in (r[0], r[2])}), sorted({v for r in rects for v in (r[1], r[3])})
    out = [(x0, y0, x1, y1) for x0, x1 in zip(xs, xs[1:], strict=False) for y0, y1 in zip(ys, ys[1:], strict=False) if any(r[0] <= x0 and x1 <= r[2] and r[1] <= y0 and y1 <= r[3] for r in rects)]
    return out, sum((r[2] - r[0]) * (r[3] - r[1]) for r in out)


def rect_difference(outer: tuple[float, float, float, float], rects: list[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
    """What of a box no other box covers, as disjoint boxes."""
    left = [outer]
    for r in rects:
        cut = []
        for x0, y0, x1, y1 in left:
            a0, b0, a1, b1 = max(x0, r[0]), max(y0, r[1]), min(x1, r[2]), min(y1, r[3])
            if a0 >= a1 or b0 >= b1:
                cut.append((x0, y0, x1, y1))
                continue
            cut += [p for p in ((x0, y0, a0, y1), (a1, y0, x1, y1), (a0, y0, a1, b0), (a0, b1, a1, y1)) if p[0] < p[2] and p[1] < p[3]]
        left = cut
    return left
