"""Repair of rings that cross, touch or repeat themselves: what they enclose, by winding number.

A ring is cut at its own crossings, and its ground is wherever it winds around, once or more, either way: both lobes of
a bow-tie count, a loop run twice counts once, and a loop against the ring's own way is a hole.
"""

from __future__ import annotations

from quiltwork.functions import overlay as ov
from quiltwork.functions.board import as_polygon
from quiltwork.functions.overlay import Point, Polygon, Trapezoid


def signed(ring: list[Point]) -> float:
    """Signed area of a closed ring as it is written, crossings and all."""
    x0, y0 = ring[0]
    return sum((ax - x0) * (by - y0) - (bx - x0) * (ay - y0) for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False)) / 2


def closed(ring: list[Point]) -> list[Point]:
    """A ring without repeated neighbours, ending where it begins."""
    out: list[Point] = []
    for p in ring:
        if not out or p != out[-1]:
            out.append(p)
    return out if len(out) > 1 and out[0] == out[-1] else [*out, *out[:1]]


def ground(rings: Polygon) -> list[Trapezoid]:
    """The first ring's ground without that of the others, its courtyards."""
    if not rings or len(set(rings[0])) < 3:
        return []
    own = ov.wound(closed(rings[0]))
    holes = [t for r in rings[1:] if len(set(r)) > 2 for t in ov.wound(closed(r))]
    return ov.difference(as_polygon(own), as_polygon(ov.union_all([as_polygon([t]) for t in holes]))) if holes and own else own


def is_simple(rings: Polygon, slack: float = 1e-9) -> bool:
    """Does the ring wind around all its ground once, in one piece?  Then the area that it is written with is right."""
    own = ground(rings[:1])
    return bool(own) and abs(abs(signed(closed(rings[0]))) - ov.area(own)) <= slack * ov.area(own) and len(ov.parts(own)) == 1


def repaired(parts: list[Polygon]) -> tuple[str, int, Polygon]:
    """Verdict, number of lobes and the shape of a drawn boundary.

    Of several parts the one that is written with the largest area is taken (ties: the first).  'ok': it is simple;
    'repaired': its largest lobe; 'empty': it encloses nothing.
    """
    chosen = max(parts, key=lambda p: abs(signed(closed(p[0]))) if p and p[0] else 0.0, default=[])
    lobes = ov.parts(ground(chosen)) if chosen else []
    if not lobes or ov.area(lobes[0]) <= 0:
        return "empty", 0, []
    if is_simple(chosen):
        return "ok", len(lobes), chosen
    return "repaired", len(lobes), as_polygon(lobes[0])
