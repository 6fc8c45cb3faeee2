"""Growing and shrinking polygons, and what follows from it: opening, healed unions, holes.

Shapes are lists of trapezoids as in ``overlay``.  The element is a convex polygon around the origin: ``DISC`` has 32
corners on the unit circle (arcs of eight steps a quarter), ``SQUARE`` is the unit square.  A convex piece grown by it
is the hull of the piece's corners moved to all corners of the element, so the grown shape is a union of hulls;
shrinking is growing what lies around it.
"""

from __future__ import annotations

import math

from quiltwork.functions import overlay as ov
from quiltwork.functions.board import as_polygon
from quiltwork.functions.overlay import Point, Polygon, Trapezoid

Element = tuple[Point, ...]
SQUARE: Element = ((-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0))
#: The corners in the directions of the axes are exact, so that a box shrinks to a box.
DISC: Element = tuple((round(math.cos(k * math.pi / 16), 15), round(math.sin(k * math.pi / 16), 15)) for k in range(32))


def _hull(points: list[Point]) -> list[Point]:
    """The convex hull as a closed ring."""
    halves = []
    for order in (sorted(set(points)), sorted(set(points), reverse=True)):
        side: list[Point] = []
        for p in order:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]):
                side.pop()
            side.append(p)
        halves += side[:-1]
    return [*halves, halves[0]]


def box(x0: float, y0: float, x1: float, y1: float) -> Polygon:
    return [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]


def _frame(shape: list[Trapezoid], pad: float) -> Polygon:
    return box(min(min(t[2], t[3]) for t in shape) - pad, min(t[0] for t in shape) - pad, max(max(t[4], t[5]) for t in shape) + pad, max(t[1] for t in shape) + pad)


def grow(shape: list[Trapezoid], r: float, by: Element = SQUARE) -> list[Trapezoid]:
    corners = [[(t[2], t[0]), (t[4], t[0]), (t[5], t[1]), (t[3], t[1])] for t in shape]
    return ov.union_all([[_hull([(x + r * dx, y + r * dy) for x, y in c for dx, dy in by])] for c in corners])


def shrink(shape: list[Trapezoid], r: float, by: Element = SQUARE) -> list[Trapezoid]:
    if not shape:
        return []
    frame = _frame(shape, 4 * r)
    around = grow(ov.difference(frame, as_polygon(shape)), r, by)
    return [t for t in ov.difference(frame, as_polygon(around)) if ov.area([t]) > 0]


def thickness(part: list[Trapezoid]) -> float:
    """Area by length of outline."""
    return ov.area(part) / ov.perimeter(part)


def opened(part: list[Trapezoid], r: float, by: Element = SQUARE) -> list[list[Trapezoid]]:
    """The lobes of a part that hold the element of size r; a part that holds none stays if it is thick all the same.

    Each lobe of what is left is grown back by itself, clipped to the part, and of that the largest piece is taken.
    """
    core = shrink(part, r, by)
    if not core:
        return [part] if thickness(part) >= r else []
    whole, out = as_polygon(part), []
    for lobe in ov.parts(core, close=1e-9 * r):
        if ov.area(lobe) <= 1e-12 * r * r:  # a speck of rounding at a tip
            continue
        back = ov.parts(ov.intersect(as_polygon(grow(lobe, r, by)), whole))
        out += back[:1]
    return sorted(out, key=lambda g: (-ov.area(g), g[0]))


def gaps(outer: Polygon, polygons: list[Polygon], floor: float, r: float, by: Element = SQUARE) -> list[list[Trapezoid]]:
    """Uncovered parts of at least ``floor``, opened, and their lobes of at least ``floor``, largest first."""
    left = [g for g in ov.parts(ov.uncovered(outer, polygons)) if ov.area(g) >= floor]
    lobes = [g for part in left for g in opened(part, r, by) if ov.area(g) >= floor]
    return sorted(lobes, key=lambda g: (-round(ov.area(g), 12), min(t[0] for t in g), min(t[2] for t in g)))


def healed(polygons: list[Polygon], eps: float, drift: float = 0.02, by: Element = SQUARE) -> list[Trapezoid]:
    """One shape with hairline seams closed; the plain union where growing and shrinking moves the area too far."""
    plain = ov.union_all(polygons)
    closed = shrink(grow(plain, eps, by), eps, by)
    return closed if closed and abs(ov.area(closed) - ov.area(plain)) <= drift * ov.area(plain) else plain


def holes(shape: list[Trapezoid]) -> list[list[Trapezoid]]:
    """Enclosed ground, largest first."""
    if not shape:
        return []
    pad = max(t[1] for t in shape) - min(t[0] for t in shape)
    frame = _frame(shape, pad)
    edge = frame[0][0][1]
    return [g for g in ov.parts(ov.difference(frame, as_polygon(shape))) if min(t[0] for t in g) > edge]


def without_holes(shape: list[Trapezoid], below: float = float("inf")) -> list[Trapezoid]:
    """Holes smaller than ``below`` filled."""
    small = [as_polygon(g) for g in holes(shape) if ov.area(g) < below]
    return ov.union_all([as_polygon(shape), *small]) if small else shape


def covered(part: Polygon, whole: Polygon, share: float = 0.99) -> bool:
    """Does so much of a part lie inside the whole?"""
    return ov.area(ov.intersect(part, whole)) >= share * ov.area(ov.union_all([part]))


def meets_outline(part: list[Trapezoid], outer: Polygon, eps: float) -> bool:
    """Does a part, grown by twice ``eps``, reach beyond the outline?"""
    return bool(part) and ov.area(ov.difference(as_polygon(grow(part, 2 * eps)), outer)) > 0


def trim_outer(outer: Polygon, gap: list[Trapezoid], board: list[Polygon], eps: float) -> list[Trapezoid]:
    """The boundary without a gap that lies on it, grown by ``eps`` but not into territories."""
    grown = ov.overlay([as_polygon(grow(gap, eps)), *board], lambda s: s[0] and not any(s[1:]))
    return ov.difference(outer, as_polygon(grown))
