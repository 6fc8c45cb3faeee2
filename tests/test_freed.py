"""Crossed footprints freed block by block: as in sequence, and what a window sees parted is parted."""

import math

from quiltwork.functions import board, judge, settle
from quiltwork.functions import overlay as ov
from quiltwork.functions.morph import box
from quiltwork.operators import footprints
from quiltwork.sources.scratch import Scratch

SIZES = settle.Sizes(unit=126.0, crumb=0.0, nothing=-1.0)


def test_a_window_can_tell_that_a_disc_would_be_parted():
    """The neck of slot 1 is cut by the footprint, and both sides of it reach the window's frame."""
    slots = {1: box(40.0, 0.0, 60.0, 100.0), 2: box(60.0, 0.0, 100.0, 100.0), 3: box(0.0, 0.0, 40.0, 100.0)}
    roof, frame, others = box(35.0, 40.0, 95.0, 60.0), (0.0, 0.0, 100.0, 100.0), dict.fromkeys((1, 2, 3), math.inf)
    ask = lambda **how: judge.judge(slots, roof, judge.Rule(settle.Sizes(unit=1.0, crumb=0.0, nothing=-1.0), claims=True, strands=False, **how), frame, others)
    assert ask() is None
    assert ask(discs=True).taker == 1


def test_freed_in_blocks_is_as_in_sequence(spark):
    at = lambda k: (150.0 + (k * 7919) % 3901, 120.0 + (k * 104729) % 160, 40.0 + 10 * (k % 7))
    boxes = {k: (x - h, y - h, x + h, y + h) for k in range(160) for x, y, h in [at(k)]}
    slots = [box(0.0, 0.0, 4200.0, 200.0), box(0.0, 200.0, 2000.0, 400.0), box(2000.0, 200.0, 4200.0, 400.0)]
    shapes, crossed = slots, 0
    for _, k in sorted((board.area(box(*b)), k) for k, b in boxes.items()):
        after = board.detach(shapes, box(*boxes[k]), 126.0, 0.02)
        shapes, crossed = after or shapes, crossed + (after is not None)
    side = 10 * math.sqrt(2)
    roofs = spark.createDataFrame([(k, board.area(box(*b)), *b) for k, b in boxes.items()], "id long, roof double, minx double, miny double, maxx double, maxy double")
    board_rows = spark.createDataFrame([(k, [(0, x, y) for x, y in s[0]]) for k, s in enumerate(slots)], f"ord long, rings {footprints.RINGS}")
    rule = judge.Rule(SIZES, claims=True, strands=False, discs=True)
    # cells only one away are looked at first: what moved farther is done anew
    rows = footprints.free_claimed(roofs, board_rows, side, rule, Scratch(spark, "test-freed"), reach=1).collect()
    assert crossed > 40
    for k, shape in enumerate(shapes):
        mine = [r for r in rows if r.ord == k]
        squares = [ring for r in mine for ring in box(r.cx * side, r.cy * side, (r.cx + 1) * side, (r.cy + 1) * side)]
        held = []
        for r in mine:
            values, i = r["shape"] or [], 0
            while i < len(values):
                end = i + 1 + 2 * int(values[i])
                held.append(list(zip(values[i + 1 : end : 2], values[i + 2 : end : 2], strict=True)))
                i = end
        got = ov.overlay([slots[k], squares, held], lambda s: s[2] if s[1] else s[0])
        want = board.area(shape)
        assert abs(ov.area(got) - want) < 1e-3 and abs(board.shared(board.as_polygon(got), shape) - want) < 1e-3
