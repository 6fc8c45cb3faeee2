import math
import random

from quiltwork.functions import kernels
from quiltwork.operators import cache, graph, raster

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]


def test_clip_and_voronoi():
    assert abs(kernels.ring_area(kernels.clip_convex(SQUARE, [(2.0, 2.0), (6.0, 2.0), (6.0, 6.0), (2.0, 6.0), (2.0, 2.0)])) - 4) < 1e-9
    rng = random.Random(1)
    seeds = [(rng.uniform(0, 4), rng.uniform(0, 4)) for _ in range(30)]
    cells = kernels.voronoi(seeds, SQUARE)
    assert abs(sum(map(kernels.ring_area, cells)) - 16) < 1e-6
    assert all(kernels.inside(c, *s) for c, s in zip(cells, seeds, strict=True))


def test_despike_simplify_interior():
    spiked = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 4.0), (2.0, 9.0), (2.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    out = kernels.despike(spiked, 0.01)
    assert abs(kernels.ring_area(out) - 16) < 1e-9 and (2.0, 9.0) not in out
    assert kernels.despike(SQUARE, 0.01) is SQUARE
    circle = [(math.cos(k / 100 * 2 * math.pi), math.sin(k / 100 * 2 * math.pi)) for k in range(100)]
    circle.append(circle[0])
    simple = kernels.simplify_ring(circle, 0.05)
    assert len(simple) < 30 and abs(kernels.ring_area(simple) - math.pi) < 0.3
    horseshoe = [(0.0, 0.0), (6.0, 0.0), (6.0, 5.0), (4.0, 5.0), (4.0, 1.0), (2.0, 1.0), (2.0, 5.0), (0.0, 5.0), (0.0, 0.0)]
    assert kernels.inside(horseshoe, *kernels.interior_point(horseshoe))


def test_rectangles():
    parts, area = kernels.rect_union([(0, 0, 2, 2), (1, 1, 3, 3), (5, 5, 6, 6)])
    assert area == 8
    left = kernels.rect_difference((0, 0, 4, 4), [(0, 0, 2, 2), (1, 1, 3, 3)])
    assert sum((r[2] - r[0]) * (r[3] - r[1]) for r in left) == 9


def test_raster_kernels():
    cells = {(0, 0), (1, 1), (2, 1), (2, 2), (5, 5)}
    labels = raster.label_cells(cells)
    assert len(set(labels.values())) == 3 and labels[1, 1] == labels[2, 2] != labels[0, 0]
    rings = raster.rings_of({(0, 0), (1, 1)})
    assert len(rings) == 2 and all(abs(kernels.ring_area(r)) == 1 for r in rings)
    block = {(x, y) for x in range(5) for y in range(5)} - {(2, 2)}
    rings = raster.rings_of(block)
    assert sorted(kernels.ring_area(r) for r in rings) == [-1, 25]
    assert raster.route_cells({(0, 0), (2, 0)}, (0, 0), (2, 0)) is None
    path = raster.route_cells(block, (1, 2), (3, 2))
    assert len(path) == 5 + 0 and len(raster.pull(block, path)) <= len(path)
    assert raster.snap(cells, (7, 7)) == (5, 5) and raster.snap(cells, (50, 50)) is None
    assert raster.visible(block, (0, 0), (4, 0)) and not raster.visible(block, (0, 2), (4, 2))
    assert raster.cell_size(10_000, 10_000, 10, 400_000) == 22.5


def test_routing_budget_and_gaps():
    line = {k: [(k - 1, 1.0), (k + 1, 1.0)] for k in range(1, 50)} | {0: [(1, 1.0)], 50: [(49, 1.0)]}
    assert graph.shortest(line, 0, 50, 1000)[0] == 50
    assert graph.shortest(line, 0, 50, 10) is None and graph.shortest(line, 0, 99, 1000) is None


def test_lru_keeps_old_recency_on_overwrite():
    lru = cache.Lru(2)
    lru.put("a")
    lru.put("b")
    lru.put("a")
    lru.put("c")
    assert lru.get("a") is None and lru.get("b")


def test_payload_gate(spark):
    from quiltwork.sources import payload

    rows = ['{"version":3,"layer":"clusters","ord":1}', '{"layer":"clusters","ord":2}', '{"version":2,"layer":"clusters","ord":3}', "broken"]
    got = payload.parse(spark.createDataFrame([(r,) for r in rows], "value string"))
    assert sorted(r.ord for r in got.collect()) == [1, 2]


def test_ring_expressions(spark):
    from pyspark.sql import functions as F

    from quiltwork.functions import metric, ring

    bent = [(0.0, 0.0), (2.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in bent],)], "r array<struct<x:double,y:double>>")
    row = df.select(ring.signed_area(F.col("r")).alias("a"), F.size(ring.drop_collinear(F.col("r"))).alias("n"), ring.contains(F.col("r"), F.lit(1.0), F.lit(1.0)).alias("i"), ring.contains(F.col("r"), F.lit(5.0), F.lit(1.0)).alias("o"), F.size(ring.dedup(F.col("r"), 2.5)).alias("d"), metric.round_half_up(F.lit(-2.5)).alias("h")).first()
    assert (row.a, row.n, row.i, row.o, row.h) == (16.0, 5, True, False, -2.0) and row.d < 6
    p = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    got = spark.range(1).select(metric.segments_meet(p(0, 0), p(4, 4), p(0, 4), p(4, 0)).alias("x"), metric.segments_meet(p(0, 0), p(1, 0), p(1, 0), p(2, 5)).alias("t"), metric.segments_meet(p(0, 0), p(1, 0), p(2, 0), p(3, 0)).alias("n")).first()
    assert (got.x, got.t, got.n) == (True, True, False)
