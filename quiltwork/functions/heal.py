"""Repairing a board: adopting gaps, splitting territories in pieces, freeing crossed footprints, merging empty ones.

A slot is (name, shape).  Every step gives the new slots and what it did, so that a rehearsal and a repair are one.
"""

from __future__ import annotations

from quiltwork.functions import board, kernels
from quiltwork.functions import overlay as ov
from quiltwork.functions.overlay import Point, Polygon

Slot = tuple[int, Polygon]


def holds(shape: Polygon, p: Point) -> bool:
    return sum(kernels.inside(r, *p) for r in shape) % 2 == 1


def counts(slots: list[Slot], points: list[Point]) -> list[int]:
    """Points by the first slot that holds them."""
    out, boxes = [0] * len(slots), [board._box(s) for _, s in slots]
    for x, y in points:
        k = next((k for k, (b, (_, s)) in enumerate(zip(boxes, slots, strict=True)) if b[0] <= x <= b[2] and b[1] <= y <= b[3] and holds(s, (x, y))), None)
        if k is not None:
            out[k] += 1
    return out


def split(slots: list[Slot]) -> tuple[list[Slot], int]:
    """A territory for each piece; the largest keeps the name, others are numbered on."""
    out, free, made = [], max((n for n, _ in slots), default=-1) + 1, 0
    for name, shape in slots:
        parts = board.pieces(shape)
        out.append((name, parts[0] if len(parts) > 1 else shape))
        for part in parts[1:]:
            out.append((free, part))
            free, made = free + 1, made + 1
    return out, made


def free_footprints(slots: list[Slot], roofs: list[Polygon], least: float, part: float) -> tuple[list[Slot], int]:
    """Crossed footprints, smallest first, go to one claimant each."""
    shapes, moved = [s for _, s in slots], 0
    for roof in sorted(roofs, key=board.area):
        after = board.detach(shapes, roof, least, part)
        if after is not None:
            shapes, moved = after, moved + 1
    return [(n, s) for (n, _), s in zip(slots, shapes, strict=True)], moved


def merge_empty(slots: list[Slot], points: list[Point], reach: float) -> tuple[list[Slot], dict[int, int]]:
    """Territories without points, smallest first, join the populated neighbour that they touch most (ties to the first),
    if that stays in one piece and gains most of their ground; until nothing changes.  Who joined whom."""
    slots, hosts, held = list(slots), {}, counts(slots, points)
    if not any(held):
        return slots, hosts
    done = True
    while done:
        done = False
        victims = sorted((k for k in range(len(slots)) if not held[k]), key=lambda k: (round(board.area(slots[k][1]), 13), k))
        for v in victims:
            touch = [(round(board.contact(slots[v][1], s, reach), 14), -k) for k, (_, s) in enumerate(slots) if held[k] and k != v]
            for size, k in sorted(touch, reverse=True):
                whole = ov.union(slots[-k][1], slots[v][1])
                if size > 0 and len(ov.parts(whole)) == 1 and ov.area(whole) - board.area(slots[-k][1]) >= 0.9 * board.area(slots[v][1]):
                    slots[-k] = (slots[-k][0], board.as_polygon(whole))
                    hosts = {a: (slots[-k][0] if b == slots[v][0] else b) for a, b in hosts.items()} | {slots[v][0]: slots[-k][0]}
                    del slots[v], held[v]
                    done = True
                    break
            if done:
                break
    return slots, hosts


def plan(slots: list[Slot], points: list[Point], roofs: list[Polygon], gaps: list[Polygon], least: float, part: float, reach: float, rounds: int = 3) -> tuple[list[Slot], dict[int, int], dict[str, int]]:
    """Adopt, split, then free footprints and merge for a few rounds; the slots, who joined whom, and a report."""
    free = max((n for n, _ in slots), default=-1) + 1
    slots, made = split([*slots, *((free + k, g) for k, g in enumerate(gaps))])
    report, hosts = {"adopted": len(gaps), "split": made, "detached": 0, "merged": 0}, {}
    for _ in range(rounds):
        slots, moved = free_footprints(slots, roofs, least, part)
        slots, joined = merge_empty(slots, points, reach)
        hosts = {a: joined.get(b, b) for a, b in hosts.items()} | joined
        report["detached"] += moved
        report["merged"] += len(joined)
        if not moved and not joined:
            break
    return slots, hosts, report
