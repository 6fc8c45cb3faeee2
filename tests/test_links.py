"""Corridors: exact shortest links, kept inside a boundary, in a village with outlying farms."""

import math
import random

from quiltwork.functions import kernels, links
from quiltwork.operators import trim

KX, KY = 111320 * math.cos(math.radians(50.0)), 110540


def test_nearest_pair_is_that_of_all_pairs():
    rnd = random.Random(3)
    for _ in range(60):
        spread = rnd.choice((5, 40, 400))
        own = [(rnd.randint(-spread, spread), rnd.randint(-spread, spread)) for _ in range(rnd.randint(1, 40))]
        home = [(rnd.randint(-spread, spread) + rnd.choice((0, 3 * spread)), rnd.randint(-spread, spread)) for _ in range(rnd.randint(1, 40))]
        p, q = links.nearest_pair(own, home)
        assert ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2, p, q) == min(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2, a, b) for a in own for b in home)


def test_filled_cells_are_those_with_their_centre_inside():
    ring = [(0.2, 0.1), (9.7, 2.3), (6.1, 9.9), (4.5, 4.2), (1.0, 8.0), (0.2, 0.1)]
    got = links.fill(ring)
    assert got == {(x, y) for x in range(-2, 12) for y in range(-2, 12) if kernels.inside(ring, x + 0.5, y + 0.5)}


def test_a_corridor_goes_round_what_blocks_it():
    wide = {(x, y) for x in range(20) for y in range(20)}
    assert links.corridor((1, 1), (18, 12), None) == links.corridor((1, 1), (18, 12), wide) == [(1, 1), (18, 12)]
    walled = wide - {(10, y) for y in range(18)}
    legs = links.corridor((1, 1), (18, 1), walled)
    assert legs[0] == (1, 1) and legs[-1] == (18, 1) and max(y for _, y in legs) >= 18 and len(legs) <= 6
    apart = wide - {(10, y) for y in range(20)}
    assert links.corridor((1, 1), (18, 1), apart) == [(1, 1), (18, 1)]


def village(x, y, n=5, step=40):
    return [(19.9 + (x + i * step) / KX, 50.0 + (y + j * step) / KY) for i in range(n) for j in range(n)]


def test_farms_are_linked_and_the_boundary_is_kept(spark):
    """A farm 600 m off, and a boundary whose notch lies between the two."""
    points = [(1, *p, False) for p in village(0, 0)] + [(1, 19.9 + 700 / KX, 50.0, False)] + [(2, *p, False) for p in village(0, 0)]
    df = spark.createDataFrame(points, "project long, x double, y double, ignored boolean")
    plain = {r.project: r for r in trim.propose(df, "project").collect()}
    assert (plain[1].kept_outside, plain[1].links, plain[2].links) == (0, 1, 0)
    ring = [(-200, -200), (400, -200), (400, 260), (500, 260), (500, -200), (900, -200), (900, 500), (-200, 500), (-200, -200)]
    outer = [{"x": 19.9 + x / KX, "y": 50.0 + y / KY} for x, y in ring]
    outers = spark.createDataFrame([(1, outer)], "project long, outer array<struct<x:double,y:double>>")
    held = {r.project: r for r in trim.propose(df, "project", outers=outers).collect()}
    assert held[1].kept_outside == 0 and held[1].links == 1 and held[2].kept_inside == 25
    got = [((p.x - 19.9) * KX, (p.y - 50.0) * KY) for p in held[1].ring]
    assert max(y for x, y in got if 410 < x < 490) > 255  # the corridor leads around the notch
    assert all(y > 230 for x, y in got if 420 < x < 480)
