"""A footprint that lies on several territories goes to one of them, whole, or nothing changes.

A change is a transaction: an attempt works on copies and returns the slots that it would replace, so a refusal leaves
the board as it was.  Sizes are in the polygons' own square units.

The same code judges whole territories and windows of them.  In a window (``frame``) the parts of a territory may hang
together outside, so a part that touches the frame is never a crumb, and a refusal proves nothing; but where a window
accepts, its parts have not grown in number, and then the whole territory's haven't either.
"""

from __future__ import annotations

from dataclasses import dataclass

from quiltwork.functions import board, morph
from quiltwork.functions import overlay as ov
from quiltwork.functions.overlay import Polygon, Trapezoid

Frame = tuple[float, float, float, float]


@dataclass(frozen=True)
class Sizes:
    """Fixed limits: least slice and share of a claim, crumbs, ground that doesn't count, rounding and seam widths."""

    unit: float  # one square metre
    slice: float = 1.0
    share: float = 0.02
    crumb: float = 5.0
    nothing: float = 0.01
    grid: float = 0.0
    seam: float = 0.0

    def floor(self, roof: float) -> float:
        return max(self.slice * self.unit, self.share * roof)


def _parts(shape: Polygon) -> list[list[Trapezoid]]:
    return ov.parts(ov.union_all([shape]))


def _meets(part: list[Trapezoid], frame: Frame | None) -> bool:
    if frame is None:
        return False
    x0, y0, x1, y1 = frame
    return any(min(t[2], t[3]) <= x0 or max(t[4], t[5]) >= x1 or t[0] <= y0 or t[1] >= y1 for t in part)


def _join(parts: list[list[Trapezoid]]) -> Polygon:
    return [r for p in parts for r in board.as_polygon(p)]


def sweep(parts: list[list[Trapezoid]], before: int, crumb: float, frame: Frame | None = None) -> tuple[list, list] | None:
    """What stays and the crumbs, if without crumbs there are no more parts than before; None else."""
    if len(parts) <= before:
        return parts, []
    small = [p for p in parts if ov.area(p) < crumb and not _meets(p, frame)]
    keep = [p for p in parts if p not in small]
    return (keep, small) if 0 < len(keep) <= before else None


def strand(parts: list[list[Trapezoid]], before: int) -> tuple[list, list]:
    """The largest parts, as many as before, and those that are cut off from them (parts come largest first)."""
    return parts[:before], parts[before:]


def onto(host: Polygon, roof: Polygon, spare: Polygon | None, extra: list[Polygon], gain: float, sizes: Sizes) -> Polygon | None:
    """The host with the roof, without what nobody held and with what was cut off.

    The exact union is tried first, then one of rounded corners, then one with seams closed; the first that gains the
    ground and has no more parts than the host is taken.
    """
    least, before = board.area(host) + 0.9 * gain - sizes.unit, len(_parts(host))
    ways = [lambda: ov.union(host, roof)]
    if sizes.grid:
        snap = lambda p: [[(round(x / sizes.grid) * sizes.grid, round(y / sizes.grid) * sizes.grid) for x, y in r] for r in p]
        ways.append(lambda: ov.union(snap(host), snap(roof)))
    if sizes.seam:
        ways.append(lambda: morph.healed([host, roof], sizes.seam, by=morph.DISC))
    for way in ways:
        shape = board.as_polygon(way())
        if spare:
            shape = board.as_polygon(ov.difference(shape, spare))
        if extra:
            shape = board.as_polygon(ov.union_all([shape, *extra]))
        if shape and board.area(shape) >= least and len(_parts(shape)) <= before:
            return shape
    return None


def attempt(slots: dict[int, Polygon], roof: Polygon, held: list[int], owner: int, spare: Polygon | None, strands: bool, sizes: Sizes, frame: Frame | None = None) -> dict[int, Polygon] | None:
    """The slots that change if ``owner`` takes the roof; None where a donor would vanish or break."""
    changed: dict[int, Polygon] = {}
    extra: list[Polygon] = []
    gain = 0.0
    for k in held:
        if k == owner:
            continue
        left = ov.difference(slots[k], roof)
        if not left:
            return None
        parts, before = ov.parts(left), len(_parts(slots[k]))
        split = sweep(parts, before, sizes.crumb * sizes.unit, frame)
        if split is None and strands and frame is None:
            split = strand(parts, before)
        if split is None:
            return None
        keep, over = split
        changed[k] = _join(keep)
        extra += [board.as_polygon(p) for p in over]
        lost = board.as_polygon(ov.difference(slots[k], changed[k]))
        if lost:
            gain += max(0.0, board.area(lost) - board.shared(slots[owner], lost))
    if gain > sizes.nothing * sizes.unit:
        grown = onto(slots[owner], roof, spare, extra, gain, sizes)
        if grown is None:
            return None
        changed[owner] = grown
    return changed


def settle(slots: dict[int, Polygon], roof: Polygon, sizes: Sizes, frame: Frame | None = None) -> tuple[dict[int, Polygon], int | None, bool]:
    """Changed slots, who takes the roof (None: nobody), and whether a window could tell.

    Holders are tried from the largest share on (ties: the smaller key), first without cutting anything off, then with.
    """
    shares = sorted(((-board.shared(p, roof), k) for k, p in slots.items()))
    held = [k for s, k in shares if s < 0]
    if len(held) < 2:
        return {}, None, True
    rest = ov.uncovered(roof, [slots[k] for k in held])
    spare = board.as_polygon(rest) if ov.area(rest) > sizes.crumb * sizes.unit else None
    for strands in (False, True):
        for owner in held:
            changed = attempt(slots, roof, held, owner, spare, strands, sizes, frame)
            if changed is not None:
                return changed, owner, True
            if frame is not None:
                return {}, None, False
    return {}, None, True


def run(slots: dict[int, Polygon], roofs: list[tuple[int, Polygon]], sizes: Sizes, frame: Frame | None = None) -> tuple[dict[int, Polygon], dict[int, int | None]] | None:
    """All roofs in the given order, each on what the ones before have left; None where a window can't tell."""
    now, takers = dict(slots), {}
    for key, roof in roofs:
        changed, owner, sure = settle(now, roof, sizes, frame)
        if not sure:
            return None
        now |= changed
        takers[key] = owner
    return now, takers
