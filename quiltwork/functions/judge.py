"""One footprint judged in a window of the board, by the rules of ``settle`` (or ``board.detach``).

The window is cut once along all borders into trapezoids that know who holds them; shares, pieces and new shapes are sets
of trapezoids.  Ground that touches the window's frame may hang together outside.  The answer is given only where it is
that of the whole board, whatever lies outside: each donor's pieces at the frame stay as many as they were, so ground that
hung together still does, and all other pieces are seen whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from quiltwork.functions import overlay as ov
from quiltwork.functions.overlay import Polygon, Trapezoid
from quiltwork.functions.settle import Frame, Sizes


@dataclass(frozen=True)
class Rule:
    """``claims``: at least two must claim the footprint, and only claimants get it, with what nobody held of it.

    ``discs``: every slot is one part without holes, so ground that a footprint parts in a window is parted.
    """

    sizes: Sizes
    claims: bool = False
    strands: bool = True
    discs: bool = False


@dataclass
class Answer:
    """Who takes the footprint (None: nobody), and the window's trapezoids with holders (bits of ``keys``) before and after."""

    taker: int | None
    keys: list[int]
    traps: list[Trapezoid]
    before: list[int]
    after: list[int]


def arrange(slots: list[Polygon], roof: Polygon, slack: float = 1e-12) -> tuple[list[Trapezoid], list[int], list[list[int]]]:
    """Trapezoids, their holders as bits (the roof's last), and which share a stretch of a border."""
    traps: list[Trapezoid] = []
    masks: list[int] = []
    near: list[list[int]] = []
    below: list[int] = []
    for y0, y1, live in ov._slabs([e for k, p in enumerate([*slots, roof]) for e in ov._edges(p, k)]):
        mask, here = 0, []
        for e, f in zip(live, live[1:], strict=False):
            mask ^= 1 << e[4]
            if not mask:
                continue
            l0, l1, r0, r1 = ov._at(e, y0), ov._at(e, y1), ov._at(f, y0), ov._at(f, y1)
            if r0 - l0 <= slack and r1 - l1 <= slack:
                continue
            k = len(traps)
            traps.append((y0, y1, l0, l1, r0, r1))
            masks.append(mask)
            near.append([])
            if here and abs(traps[here[-1]][4] - l0) + abs(traps[here[-1]][5] - l1) < slack:
                near[k].append(here[-1])
                near[here[-1]].append(k)
            here.append(k)
        j = 0
        if below and traps[below[0]][1] == y0:
            for k in here:
                left, right = traps[k][2], traps[k][4]
                while j < len(below) and traps[below[j]][5] <= left:
                    j += 1
                for m in below[j:]:
                    if traps[m][3] >= right:
                        break
                    if min(traps[m][5], right) - max(traps[m][3], left) > slack:
                        near[k].append(m)
                        near[m].append(k)
        below = here or below
    return traps, masks, near


def pieces(own: set[int], near: list[list[int]]) -> list[list[int]]:
    rest, out = set(own), []
    while rest:
        group = [rest.pop()]
        for k in group:
            for m in near[k]:
                if m in rest:
                    rest.remove(m)
                    group.append(m)
        out.append(group)
    return out


def judge(slots: dict[int, Polygon], roof: Polygon, rule: Rule, frame: Frame | None, others: dict[int, float]) -> Answer | None:
    """The answer of the whole board, or None where this window can't tell.

    ``others``: the smallest part of each slot that lies where no footprint reaches: infinite where the slot is one part,
    0 where that isn't known.
    """
    sizes, keys = rule.sizes, sorted(slots)
    traps, masks, near = arrange([slots[k] for k in keys], roof)
    size = [(t[1] - t[0]) * (t[4] - t[2] + t[5] - t[3]) / 2 for t in traps]
    bit = 1 << len(keys)
    area = lambda group: sum(size[i] for i in group)
    roofed = {i for i, m in enumerate(masks) if m & bit}
    plain = [m & ~bit for m in masks]
    share = {k: area(i for i in roofed if plain[i] >> b & 1) for b, k in enumerate(keys)}
    even = (lambda s: round(s / sizes.unit, 6)) if rule.claims else (lambda s: s)  # equal shares differ by rounding
    held = [k for s, k in sorted((-even(s), k) for k, s in share.items() if s > 0)]
    owners = [k for k in held if even(share[k]) >= even(sizes.floor(area(roofed)))] if rule.claims else held
    if len(owners) < 2:
        return Answer(None, keys, traps, plain, plain)
    at_frame: set[int] = set()
    if frame is not None:
        x0, y0, x1, y1 = frame
        at_frame = {i for i, t in enumerate(traps) if min(t[2], t[3]) <= x0 or max(t[4], t[5]) >= x1 or t[0] <= y0 or t[1] >= y1}
    crumb = sizes.crumb * sizes.unit
    spare = {i for i in roofed if not plain[i]}
    if rule.claims or area(spare) <= crumb:
        spare = set()
    whole = {k: {i for i, m in enumerate(plain) if m >> b & 1} for b, k in enumerate(keys)}
    unsure = object()

    def sorted_out(own: set[int]) -> tuple[list, list]:
        """Pieces at the frame, and the others, largest first."""
        groups = pieces(own, near)
        edge = [g for g in groups if not at_frame.isdisjoint(g)]
        return edge, sorted((g for g in groups if at_frame.isdisjoint(g)), key=lambda g: (-area(g), min(traps[i] for i in g)))

    def attempt(owner: int, strands: bool):
        lost: dict[int, set[int]] = {}
        extra: set[int] = set()
        gain = 0.0
        for k in held:
            if k == owner:
                continue
            left = whole[k] - roofed
            edge, inner = sorted_out(left)
            edge0, inner0 = sorted_out(whole[k])
            if len(edge) != len(edge0):
                return None if rule.discs and len(edge) > len(edge0) else unsure
            if not left and (frame is None or others[k] == float("inf")):
                return None
            if not left and not others[k]:
                return unsure
            over, more = [], len(inner) - len(inner0)
            if more > 0:
                small = [g for g in inner if area(g) < crumb]
                if frame is not None and others[k] < crumb:
                    return unsure
                stay = len(edge) + len(inner) - len(small)
                if len(small) >= more and (stay or (frame is not None and others[k] < float("inf"))):
                    over = small
                elif strands:
                    over = inner[-more:]
                    if any(min([others[k] if frame is not None else float("inf"), *map(area, edge)]) < area(g) for g in over):
                        return unsure
                else:
                    return None
            over = {i for g in over for i in g}
            lost[k] = (whole[k] & roofed) | over
            extra |= over
            gain += max(0.0, area(lost[k]) - area(lost[k] & whole[owner]))
        if gain > sizes.nothing * sizes.unit:
            grown = whole[owner] | (roofed - spare) | extra
            edge, inner = sorted_out(grown)
            edge0, inner0 = sorted_out(whole[owner])
            if rule.discs and len(edge) < len(edge0):
                return unsure  # it may close a ring around others
            if len(inner) > len(inner0) or (not rule.claims and area(grown) < area(whole[owner]) + 0.9 * gain - sizes.unit):
                # rounding and closed seams may do better, and that is seen only on whole shapes
                return None if len(edge) == len(edge0) and not sizes.grid and not sizes.seam else unsure
        else:
            grown = whole[owner]
        after = list(plain)
        for k, gone in lost.items():
            for i in gone:
                after[i] &= ~(1 << keys.index(k))
        for i in grown:
            after[i] |= 1 << keys.index(owner)
        return Answer(owner, keys, traps, plain, after)

    for strands in (False, True) if rule.strands else (False,):
        for owner in owners:
            got = attempt(owner, strands)
            if got is unsure:
                return None
            if got is not None:
                return got
    return Answer(None, keys, traps, plain, plain)
