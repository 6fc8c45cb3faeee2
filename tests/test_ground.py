"""Footprints on discs, by atoms: as in sequence, and without the windows that grow with what lies on one another."""

import math

import numpy as np

from quiltwork.functions import blocks, board, ground, settle
from quiltwork.functions.judge import Rule
from quiltwork.functions.morph import box
from quiltwork.operators import footprints
from quiltwork.sources.scratch import Scratch

SIZES = settle.Sizes(unit=126.0, crumb=0.0, nothing=-1.0)
RULE = Rule(SIZES, claims=True, strands=False, discs=True)
SIDE, WIDE, HIGH = 70 * math.sqrt(2), 14, 5


def crowd(n):
    at = lambda k: (150.0 + (k * 7919) % 901, 120.0 + (k * 104729) % 160, 40.0 + 10 * (k % 7))
    return {k: (x - h, y - h, x + h, y + h) for k in range(n) for x, y, h in [at(k)]}


def board_of_three():
    """A slanted border between two of them."""
    return [box(0.0, 0.0, 1200.0, 200.0), [[(0.0, 200.0), (560.0, 200.0), (640.0, 450.0), (0.0, 450.0), (0.0, 200.0)]], [[(560.0, 200.0), (1200.0, 200.0), (1200.0, 450.0), (640.0, 450.0), (560.0, 200.0)]]]


def in_sequence(boxes, slots):
    shapes, crossed = slots, 0
    for _, k in sorted((board.area(box(*b)), k) for k, b in boxes.items()):
        after = board.detach(shapes, box(*boxes[k]), 126.0, 0.02)
        shapes, crossed = after or shapes, crossed + (after is not None)
    assert crossed > 20
    return shapes


def test_blocks_of_atoms_are_as_in_sequence():
    boxes, slots = crowd(70), board_of_three()
    want = in_sequence(boxes, slots)
    cells = {(x, y): held for x in range(WIDE) for y in range(HIGH) if (held := {k: part for k, s in enumerate(slots) if (part := blocks.cut(s, (x, y), SIDE))})}
    ids = np.array(sorted(boxes))
    rest, alone = set(ids.tolist()), []
    for turn in range(40):
        width, shift = (8, turn % 2 * 4) if turn < 8 else (40, 0)
        settled = set()
        for b in range((WIDE + shift) // width + 1):
            x0 = b * width - shift
            near = np.array([k for k in sorted(rest) if boxes[k][2] >= x0 * SIDE and boxes[k][0] <= (x0 + width) * SIDE], dtype=int)
            if not len(near):
                continue
            at = np.array([boxes[k] for k in near])
            own = {c: s for c, s in cells.items() if x0 <= c[0] < x0 + width}
            held = ground.Ground(own, at, (x0, x0 + width - 1, -2, HIGH + 2), SIDE, RULE)
            done = held.run(np.lexsort((near, [board.area(box(*boxes[k])) for k in near])), at)
            assert not held.broken
            cells |= held.changed()
            settled |= set(near[done].tolist())
        alone.append(len(settled))
        rest -= settled
        if not rest:
            break
    assert not rest and 0 < alone[0] < len(boxes)
    for k, shape in enumerate(want):
        mine = [ring for own in cells.values() for ring in own.get(k, [])]
        assert abs(board.area(mine) - board.area(shape)) < 1e-6 and abs(board.shared(mine, shape) - board.area(shape)) < 1e-6


def test_a_neck_is_parted_and_a_corner_is_not():
    assert ground._stretches([[1, 2, 1], [1, 2, 1], [1, 2, 1]], 2) == [2]
    assert ground._stretches([[1, 2, 2], [1, 2, 2], [1, 1, 1]], 2) == [1]
    assert ground._stretches([[2, 1, 2], [2, 2, 2], [1, 1, 1]], 2) == [2]


def test_discs_on_spark_need_no_windows(spark, monkeypatch):
    monkeypatch.setattr(footprints, "_rounds", None)
    boxes, slots = crowd(70), board_of_three()
    want = in_sequence(boxes, slots)
    roofs = spark.createDataFrame([(k, board.area(box(*b)), *b) for k, b in boxes.items()], "id long, roof double, minx double, miny double, maxx double, maxy double")
    rows = spark.createDataFrame([(k, footprints._cell(s)) for k, s in enumerate(slots)], f"ord long, rings {footprints.RINGS}")
    got = footprints.free_claimed(roofs, rows, SIDE, RULE, Scratch(spark, "test-ground"), reach=1).collect()
    for k, shape in enumerate(want):
        new = sum(board.area(footprints._shape(np.array(r["shape"]))) for r in got if r.ord == k and r["shape"])
        old = sum(board.area(blocks.cut(slots[k], (r.cx, r.cy), SIDE)) for r in got if r.ord == k)
        assert abs(board.area(slots[k]) + new - old - board.area(shape)) < 1e-3
