"""Planar line work: cutting lines at their crossings, and the faces that they enclose."""

from __future__ import annotations

import math

from quiltwork.functions.kernels import ring_area
from quiltwork.functions.overlay import Point

Segment = tuple[Point, Point]


def node(segments: list[Segment], digits: int = 9) -> set[Segment]:
    """The segments cut where they cross or touch: unique undirected edges between rounded points."""
    tidy = lambda p: (round(p[0], digits), round(p[1], digits))
    own = sorted({tuple(sorted((tidy(a), tidy(b)))) for a, b in segments if tidy(a) != tidy(b)})
    slack = 10.0**-digits
    cuts: list[set[Point]] = [{a, b} for a, b in own]
    for i, ((ax, ay), (bx, by)) in enumerate(own):
        low, high = min(ay, by) - slack, max(ay, by) + slack
        for j in range(i + 1, len(own)):
            (cx, cy), (dx, dy) = own[j]
            if cx > bx + slack:
                break
            if max(cy, dy) < low or min(cy, dy) > high:
                continue
            det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if abs(det) > 1e-24:
                t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det
                u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / det
                if -1e-9 <= t <= 1 + 1e-9 and -1e-9 <= u <= 1 + 1e-9:
                    p = tidy((ax + (bx - ax) * t, ay + (by - ay) * t))
                    cuts[i].add(p)
                    cuts[j].add(p)
            else:  # side by side: ends that lie on the other one
                for k, (p, q), ends in ((i, own[i], own[j]), (j, own[j], own[i])):
                    n = math.hypot(q[0] - p[0], q[1] - p[1])
                    for e in ends:
                        along = ((e[0] - p[0]) * (q[0] - p[0]) + (e[1] - p[1]) * (q[1] - p[1])) / n
                        if 0 < along < n and abs((e[0] - p[0]) * (q[1] - p[1]) - (e[1] - p[1]) * (q[0] - p[0])) <= slack * n:
                            cuts[k].add(e)
    out: set[Segment] = set()
    for (a, _), points in zip(own, cuts, strict=True):
        line = sorted(points, key=lambda p, a=a: (p[0] - a[0]) ** 2 + (p[1] - a[1]) ** 2)
        out |= {tuple(sorted((p, q))) for p, q in zip(line, line[1:], strict=False) if p != q}
    return out


def faces(edges: set[Segment]) -> list[list[Point]]:
    """Rings, counter-clockwise, of the ground that the edges enclose; dead ends enclose nothing."""
    near: dict[Point, set[Point]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    ends = [p for p, q in near.items() if len(q) == 1]
    while ends:
        p = ends.pop()
        for q in near.pop(p, ()):
            near[q].discard(p)
            if len(near[q]) == 1:
                ends.append(q)
            elif not near[q]:
                near.pop(q)
    turn = {p: sorted(q, key=lambda o, p=p: math.atan2(o[1] - p[1], o[0] - p[0])) for p, q in near.items()}
    place = {p: {q: k for k, q in enumerate(order)} for p, order in turn.items()}
    left = {(p, q) for p, order in turn.items() for q in order}
    out = []
    while left:
        start = at = min(left)
        ring = []
        while at in left:
            left.discard(at)
            ring.append(at[0])
            p, q = at
            at = (q, turn[q][place[q][p] - 1])  # the next way clockwise keeps the face on the left
        ring.append(ring[0])
        if at == start and ring_area(ring) > 0:
            out.append(ring)
    return out
