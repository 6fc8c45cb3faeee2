"""Footprints that lie on one another along a border, settled block by block: as in sequence, and no block sees them all."""

import math

from quiltwork.functions import blocks, board, settle
from quiltwork.functions.judge import Rule
from quiltwork.functions.morph import box

SIZES = settle.Sizes(unit=126.0, grid=1.0, seam=5.0)
SIDE, ZONE, WIDE, HIGH = 100.0, 40.0, 12, 4


def crowd(n):
    at = lambda k: (150.0 + (k * 7919) % 901, 120.0 + (k * 104729) % 160, 40.0 + 10 * (k % 7))
    return {k: (x - h, y - h, x + h, y + h) for k in range(n) for x, y, h in [at(k)] if y - h < 200 < y + h or x - h < 600 < x + h}


def test_blocks_in_rounds_are_as_in_sequence():
    boxes = crowd(110)
    slots = {1: box(0.0, 0.0, 600.0, 200.0), 2: box(600.0, 0.0, 1200.0, 200.0), 3: box(0.0, 200.0, 600.0, 400.0), 4: box(600.0, 200.0, 1200.0, 400.0)}
    roofs = sorted((board.area(box(*b)), k) for k, b in boxes.items())
    want, takers = settle.run(dict(slots), [(k, box(*boxes[k])) for _, k in roofs], SIZES)
    cells = {(x, y): {k: part for k, s in slots.items() if (part := blocks.cut(s, (x, y), SIDE))} for x in range(WIDE) for y in range(HIGH)}
    rest, moves, most, turn, still = dict.fromkeys(k for _, k in roofs), [], 0, 0, 0
    width = 8
    while rest:
        shift, before = turn % 2 * width // 2, len(rest)
        for b in range((WIDE + shift) // width + 1):
            x0 = b * width - shift
            own = {c: cells[c] for c in cells if x0 <= c[0] < x0 + width}
            near = [blocks.Roof((a, k), box(*boxes[k]), boxes[k]) for a, k in roofs if k in rest and boxes[k][2] + ZONE >= x0 * SIDE and boxes[k][0] - ZONE < (x0 + width) * SIDE]
            span = (x0, x0 + width - 1, -9, 99) if width < WIDE else None
            known = [m for m in moves if m.read[2] > x0 * SIDE and m.read[0] < (x0 + width) * SIDE]
            block = blocks.Block(own, span, SIDE, ZONE, Rule(SIZES), dict.fromkeys(slots, math.inf), known)
            done = block.run(near)
            most = max(most, len(done))
            assert not any(m.broken for m in done)
            moves += done
            for m in done:
                del rest[m.order[1]]
        turn, still = turn + 1, 0 if len(rest) < before else still + 1
        width = 2 * width if still == 2 else width
    assert {m.order[1]: m.taker for m in moves} == takers
    assert most < len(roofs) and len([m for m in moves if m.taker]) > 20
    for k, shape in want.items():
        mine = [ring for own in cells.values() for ring in own.get(k, [])]
        assert abs(board.area(mine) - board.area(shape)) < 1e-6 and abs(board.shared(mine, shape) - board.area(shape)) < 1e-6


def test_freed_footprints_are_those_of_one_board():
    """By the rule of ``board.detach``: two claim it, a claimant gets it, no donor breaks."""
    boxes = crowd(60)
    slots = [box(0.0, 0.0, 600.0, 400.0), box(600.0, 0.0, 1200.0, 400.0)]
    roofs = sorted((board.area(box(*b)), k) for k, b in boxes.items())
    shapes = slots
    for _, k in roofs:
        shapes = board.detach(shapes, box(*boxes[k]), 126.0, 0.02) or shapes
    cells = {(x, y): {k: part for k, s in enumerate(slots) if (part := blocks.cut(s, (x, y), SIDE))} for x in range(WIDE) for y in range(HIGH)}
    rule = Rule(settle.Sizes(unit=126.0, crumb=0.0, nothing=-1.0), claims=True, strands=False)
    block = blocks.Block(cells, None, SIDE, ZONE, rule, {0: math.inf, 1: math.inf})
    block.run([blocks.Roof((a, k), box(*boxes[k]), boxes[k]) for a, k in roofs])
    for k, shape in enumerate(shapes):
        mine = [ring for own in cells.values() for ring in own.get(k, [])]
        assert board.area(shape) != board.area(slots[k]) and abs(board.area(mine) - board.area(shape)) < 1e-6 and abs(board.shared(mine, shape) - board.area(shape)) < 1e-6
