"""Rings that cross, touch or repeat themselves; opening and healing by a disc; long rings."""

import math
import random
import time

import pytest

from quiltwork.functions import morph, repair
from quiltwork.functions import overlay as ov

BOX = [(0, 0), (10, 0), (10, 6), (0, 6), (0, 0)]


def area(shape):
    return ov.area(ov.union_all([shape]))


def winding(ring, x, y):
    """How often a ring goes around a point, by the definition: signed crossings of a ray."""
    n = 0
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        if (ay <= y) != (by <= y) and ax + (bx - ax) * (y - ay) / (by - ay) > x:
            n += 1 if by > ay else -1
    return n


def test_bow_tie_keeps_its_larger_lobe():
    verdict, lobes, shape = repair.repaired([[[(0, 0), (10, 4), (10, 0), (0, 6), (0, 0)]]])
    assert (verdict, lobes) == ("repaired", 2) and abs(area(shape) - 10 * 36 / 20) < 1e-9


def test_a_loop_run_twice_counts_once_and_holes_stay():
    assert repair.repaired([[BOX + BOX[1:]]])[:2] == ("repaired", 1)
    assert abs(ov.area(repair.ground([BOX + BOX[1:]])) - 60) < 1e-9
    yard = [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]
    assert repair.repaired([[BOX, yard]]) == ("ok", 1, [BOX, yard]) and abs(ov.area(repair.ground([BOX, yard])) - 56) < 1e-9
    assert repair.repaired([[BOX[::-1]]])[0] == "ok"


def test_parts_and_empties():
    assert repair.repaired([]) == repair.repaired([[]]) == repair.repaired([[[]]]) == ("empty", 0, [])
    assert repair.repaired([[[(0, 0), (5, 0), (0, 0)]]])[0] == "empty"
    small = [(20, 0), (21, 0), (21, 1), (20, 1), (20, 0)]
    assert repair.repaired([[small], [BOX]])[2] == [BOX]
    assert repair.repaired([[[(0, 0), (0, 0), (10, 0), (10, 6), (10, 6), (0, 6)]]])[0] == "ok"


@pytest.mark.parametrize("seed", range(12))
def test_random_rings_cover_what_they_wind_around(seed):
    """Tangled rings against the winding number of random places."""
    rnd = random.Random(seed)
    ring = [(rnd.randint(0, 40), rnd.randint(0, 40)) for _ in range(rnd.randint(4, 14))]
    ring.append(ring[0])
    ground = ov.wound(ring)
    for _ in range(300):
        x, y = rnd.uniform(-1, 41), rnd.uniform(-1, 41)
        inside = any(t[0] <= y < t[1] and t[2] + (t[3] - t[2]) * (y - t[0]) / (t[1] - t[0]) <= x < t[4] + (t[5] - t[4]) * (y - t[0]) / (t[1] - t[0]) for t in ground)
        assert inside == (winding(ring, x, y) != 0)


def test_a_disc_opens_slanted_slivers_away_and_keeps_bars():
    c, arc = math.sqrt(0.5), 16 * math.sin(math.pi / 16)
    bar = lambda w: ov.union_all([[[(0, 0), (20 * c, 20 * c), (20 * c - w * c, 20 * c + w * c), (-w * c, w * c), (0, 0)]]])
    assert morph.opened(bar(1.9), 1.0, morph.DISC) == []
    (kept,) = morph.opened(bar(2.2), 1.0, morph.DISC)
    assert abs(ov.area(kept) - (44 - (4 - arc))) < 1e-6
    assert morph.opened(bar(2.2), 1.0) == []  # upright squares don't fit


def test_a_barbell_opens_into_two_round_lobes():
    bell = ov.union_all([morph.box(0, 0, 4, 4), morph.box(4, 1.9, 8, 2.1), morph.box(8, 0, 11, 4)])
    lobes = morph.opened(bell, 0.5, morph.DISC)
    assert len(lobes) == 2 and all(0.95 * w < ov.area(g) <= w for g, w in zip(lobes, (16, 12), strict=True))


def test_healing_by_a_disc_closes_hairlines_in_any_direction():
    c = math.sqrt(0.5)
    slab = lambda a, b: [[(a * c, a * c), (b * c, b * c), (b * c - 6 * c, b * c + 6 * c), (a * c - 6 * c, a * c + 6 * c), (a * c, a * c)]]
    whole = morph.healed([slab(0, 5), slab(5.002, 10)], 0.05, by=morph.DISC)
    assert len(ov.parts(whole, close=1e-9)) == 1 and abs(ov.area(whole) - 60) < 0.05
    assert len(ov.parts(morph.healed([slab(0, 4), slab(6, 10)], 0.05, by=morph.DISC), close=1e-9)) == 2


def test_long_rings_are_swept_along_their_own_edges():
    n, rnd = 11500, random.Random(1)
    ring = [(math.cos(2 * math.pi * k / n) * (1 + 0.05 * rnd.random()), math.sin(2 * math.pi * k / n) * (1 + 0.05 * rnd.random())) for k in range(n)]
    ring.append(ring[0])
    whole, began = area([ring]), time.time()
    cells = [morph.box(x / 4, y / 4, x / 4 + 0.25, y / 4 + 0.25) for x in (-5, 0, 3, 4) for y in (-5, 0, 2, 4)]
    parts = [ov.area(ov.intersect([ring], b)) for b in cells]
    assert time.time() - began < 10 and max(parts) == pytest.approx(0.0625)
    quarters = [ov.area(ov.intersect([ring], morph.box(*b))) for b in ((-2, -2, 0, 0), (0, -2, 2, 0), (-2, 0, 0, 2), (0, 0, 2, 2))]
    assert sum(quarters) == pytest.approx(whole)
