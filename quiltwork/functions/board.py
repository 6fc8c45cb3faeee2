"""Boards of territories: cutting, merging, adopting gaps, moving footprints.  Polygons as in ``overlay``.

Every step is a pure function that returns the new shapes or None where it refuses, so an audit and a repair that run
the same steps cannot disagree.
"""

from __future__ import annotations

from quiltwork.functions import kernels
from quiltwork.functions import overlay as ov
from quiltwork.functions.overlay import Point, Polygon, Trapezoid


def as_polygon(trapezoids: list[Trapezoid]) -> Polygon:
    """Trapezoids as the rings around them; where rounding breaks a ring, or changes the area, as rings of their own."""
    rings = ov.outline(trapezoids)
    whole = ov.area(trapezoids)
    signed = sum((a[0] - rings[0][0][0]) * (b[1] - rings[0][0][1]) - (b[0] - rings[0][0][0]) * (a[1] - rings[0][0][1]) for r in rings for a, b in zip(r, r[1:], strict=False)) / 2
    if rings and abs(signed - whole) <= 1e-6 * whole:
        return rings
    return [[(t[2], t[0]), (t[4], t[0]), (t[5], t[1]), (t[3], t[1]), (t[2], t[0])] for t in trapezoids]


def area(p: Polygon) -> float:
    return ov.area(ov.union_all([p]))


def pieces(p: Polygon) -> list[Polygon]:
    """Connected parts, largest first."""
    return [as_polygon(g) for g in ov.parts(ov.union_all([p]))]


def shared(a: Polygon, b: Polygon) -> float:
    p, q = _box(a), _box(b)
    if p[0] >= q[2] or q[0] >= p[2] or p[1] >= q[3] or q[1] >= p[3]:
        return 0.0
    return ov.area(ov.intersect(a, b))


def _box(p: Polygon) -> tuple[float, float, float, float]:
    xs, ys = [x for r in p for x, _ in r], [y for r in p for _, y in r]
    return min(xs), min(ys), max(xs), max(ys)


def cut(p: Polygon, a: Point, b: Point, crumb: float) -> list[Polygon] | None:
    """The parts of ``p`` on either side of the line through a and b; None unless the number of parts of at least ``crumb`` grows."""
    x0, y0, x1, y1 = _box(p)
    m = max(x1 - x0, y1 - y0) + 1
    board = [(x0 - m, y0 - m), (x1 + m, y0 - m), (x1 + m, y1 + m), (x0 - m, y1 + m), (x0 - m, y0 - m)]
    nx, ny = b[1] - a[1], a[0] - b[0]
    out = []
    for s in (1, -1):
        side = kernels.clip_half_plane(board, s * nx, s * ny, s * (nx * a[0] + ny * a[1]))
        if side:
            out += [as_polygon(g) for g in ov.parts(ov.intersect(p, [side])) if ov.area(g) >= crumb]
    return out if len(out) > len([q for q in pieces(p) if area(q) >= crumb]) else None


def merge(polygons: list[Polygon], cover: float = 0.99) -> Polygon | None:
    """One shape of two or more; None if any of them would be lost in part."""
    if len(polygons) < 2:
        return None
    whole = as_polygon(ov.union_all(polygons))
    return whole if all(shared(p, whole) >= cover * area(p) for p in polygons) else None


def contact(a: Polygon, b: Polygon, reach: float) -> float:
    """Ground of ``b`` within about ``reach`` of ``a``'s parts, sideways and upwards: the size of their common border."""
    total = 0.0
    for dx, dy in ((reach, 0.0), (-reach, 0.0), (0.0, reach), (0.0, -reach)):
        total += shared([[(x + dx, y + dy) for x, y in r] for r in a], b)
    return total


def adopt(board: list[Polygon], gaps: list[Polygon]) -> list[Polygon]:
    """Gaps as territories of their own."""
    return [*board, *gaps]


def absorb(board: list[Polygon], gap: Polygon, reach: float) -> list[Polygon] | None:
    """The gap joins the territory that it touches most (ties to the first); None if it touches none."""
    sizes = [round(contact(gap, t, reach), 14) for t in board]
    if not sizes or max(sizes) <= 0:
        return None
    k = sizes.index(max(sizes))
    return [as_polygon(ov.union(t, gap)) if j == k else t for j, t in enumerate(board)]


def shares(board: list[Polygon], footprint: Polygon, least: float, part: float) -> list[tuple[int, float, bool]]:
    """Who holds how much of a footprint, largest first, and who claims it (at least ``least`` and ``part`` of it)."""
    floor = max(least, part * area(footprint))
    found = [(k, shared(t, footprint)) for k, t in enumerate(board)]
    return [(k, s, s >= floor) for k, s in sorted(found, key=lambda e: (-e[1], e[0])) if s > 0]


def detach(board: list[Polygon], footprint: Polygon, least: float, part: float) -> list[Polygon] | None:
    """A crossed footprint moves to one claimant, the largest first, if no donor vanishes or breaks; None if there is no way."""
    held = shares(board, footprint, least, part)
    if sum(c for _, _, c in held) < 2:
        return None
    for owner, _, claims in held:
        if not claims:
            continue
        after, fine = list(board), True
        for k, _, _ in held:
            if k != owner:
                left = ov.difference(board[k], footprint)
                fine &= bool(left) and len(ov.parts(left)) <= len(pieces(board[k]))
                after[k] = as_polygon(left)
        grown = as_polygon(ov.union(board[owner], footprint))
        if fine and len(pieces(grown)) <= len(pieces(board[owner])):
            after[owner] = grown
            return after
    return None


def replace_outer(board: list[tuple[Polygon, bool]], outer: Polygon, least: float, moved: float) -> tuple[list[tuple[Polygon, bool]], int, int]:
    """Territories (shape, printed) clipped to a new boundary; how many were dropped and how many lost their mark."""
    out, dropped, unmarked = [], 0, 0
    for shape, printed in board:
        got = ov.intersect(shape, outer)
        if ov.area(got) < least:
            dropped += 1
            continue
        lost = printed and abs(ov.area(got) - area(shape)) > moved
        unmarked += lost
        out.append((as_polygon(got), printed and not lost))
    return out or [(outer, False)], dropped, unmarked


def add_inner(board: list[tuple[Polygon, bool]], new: Polygon, outer: Polygon, overlap: float, least: float) -> list[tuple[Polygon, bool]] | None:
    """A drawn territory, clipped; None if it overlaps a deliberate one; placeholders (shape, True) keep what is left of them."""
    shape = as_polygon(ov.intersect(new, outer))
    if not shape or any(not auto and shared(p, shape) > overlap for p, auto in board):
        return None
    out = []
    for p, auto in board:
        rest = ov.difference(p, shape) if auto else None
        if rest is None:
            out.append((p, auto))
        elif ov.area(rest) >= least:
            out.append((as_polygon(rest), auto))
    return [*out, (shape, False)]


def keep_inhabited(outer: Polygon, board: list[Polygon], overlap: float) -> list[Polygon]:
    """Parts of a boundary that hold some territory, else the largest part."""
    own = pieces(outer)
    return [p for p in own if any(shared(p, t) > overlap for t in board)] or own[:1]


def connect(board: list[Polygon], reach: float, least: float, fraction: float, passes: int) -> list[Polygon]:
    """Each territory keeps its largest part; orphans join the territory that they touch most, stay on their own if they
    touch none and are large enough, else go.  At most ``passes`` rounds."""
    floor = max(least, fraction * sum(map(area, board)) / max(1, len(board)))
    for _ in range(passes):
        split = [(k, pieces(t)) for k, t in enumerate(board)]
        if all(len(p) <= 1 for _, p in split):
            break
        orphans = [(k, q) for k, p in split for q in p[1:]]
        board = [p[0] for _, p in split if p]
        for k, q in orphans:
            others = [t for j, t in enumerate(board) if j != k]
            sizes = [contact(q, t, reach) for t in others]
            if sizes and max(sizes) > 0:
                host = others[sizes.index(max(sizes))]
                board = [as_polygon(ov.union(t, q)) if t is host else t for t in board]
            elif area(q) >= floor:
                board = [*board, q]
    return board
