"""A boundary along the streets: a ring road, a road through the middle, and none at all."""

import math

from quiltwork.operators import follow, ways

LNG, LAT = 19.9, 50.0
KX, KY = 111320 * math.cos(math.radians(50.005)), 110540


def at(x, y):
    return LNG + x / KX, LAT + y / KY


def road(points, step=20.0):
    """Edges of a street through points in metres, with a node every ``step``."""
    out = []
    for (ax, ay), (bx, by) in zip(points, points[1:], strict=False):
        n = max(1, round(math.hypot(bx - ax, by - ay) / step))
        line = [at(ax + (bx - ax) * k / n, ay + (by - ay) * k / n) for k in range(n + 1)]
        for p, q in zip(line, line[1:], strict=False):
            name = lambda v: f"{v[0]:.7f},{v[1]:.7f}"
            out.append((name(p), name(q), ways.meters(p, q), *p, *q))
    return out


def square(x, y, size):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]


def run(spark, ring, edges):
    e = spark.createDataFrame(edges, "src string, dst string, w double, ax double, ay double, bx double, by double")
    r = spark.createDataFrame([(1, [{"x": p[0], "y": p[1]} for p in (at(*q) for q in ring)])], "key long, ring array<struct<x:double,y:double>>")
    return follow.follow(r, e).collect()


def metres(ring):
    return [((p.x - LNG) * KX, (p.y - LAT) * KY) for p in ring]


def area(p):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:], strict=False))) / 2


def test_a_ring_road_becomes_the_edge(spark):
    """The ring ten metres inside moves out onto the road and takes its corners."""
    (got,) = run(spark, square(110, 110, 240), road(square(100, 100, 260)))
    ring = metres(got.ring)
    assert got.moved == 4 and got.routed == 4 and ring[0] == ring[-1]
    assert all(min(abs(x - 100), abs(x - 360), abs(y - 100), abs(y - 360)) < 0.05 for x, y in ring)
    assert abs(area(ring) - 260 * 260) < 260 * 260 * 0.02 and len(ring) > 40


def test_a_road_that_loops_away_is_not_adopted(spark):
    """Both ends of an edge lie on a road, which makes a bow of 60 m between them: within the limits of detours, but too far off."""
    bow = [(100, 100), (150, 100), (150, 160), (310, 160), (310, 100), (360, 100)]
    (got,) = run(spark, [(105, 95), (355, 95), (355, 400), (105, 400)], road(bow))
    assert got.moved == 2 and got.routed == 0 and len(got.ring) == 5
    flat = [(100, 100), (150, 100), (150, 120), (310, 120), (310, 100), (360, 100)]
    (got,) = run(spark, [(105, 95), (355, 95), (355, 400), (105, 400)], road(flat))
    assert got.routed == 1 and any(abs(y - 120) < 0.05 for _, y in metres(got.ring))


def test_without_streets_the_ring_stays(spark):
    (got,) = run(spark, square(0, 0, 200)[:4], road(square(5000, 5000, 100)))
    assert (got.moved, got.routed) == (0, 0) and len(got.ring) == 5
    assert [tuple(round(v, 6) for v in p) for p in metres(got.ring)] == [(0, 0), (200, 0), (200, 200), (0, 200), (0, 0)]
    assert run(spark, [(0, 0), (10, 10)], road(square(0, 0, 100))) == []
