"""Work on dense tables: how many pairs meet, and that the answers are those of all pairs."""

import math
import random

from pyspark.sql import functions as F

from quiltwork.functions import metric
from quiltwork.operators import outliers
from quiltwork.operators import spatial_join as sj


def metres(ax, ay, bx, by):
    return math.hypot((bx - ax) * 111320.0 * math.cos(math.radians((ay + by) / 2)), (by - ay) * 110540.0)


def counted(spark):
    """The metric as a function that counts its calls."""
    calls = spark.sparkContext.accumulator(0)

    def one(ax, ay, bx, by):  # workers don't import this module
        calls.add(1)
        return math.hypot((bx - ax) * 111320.0 * math.cos(math.radians((ay + by) / 2)), (by - ay) * 110540.0)

    return F.udf(one, "double"), calls


def places(rnd, n, x, y, side, start=0):
    return [(start + k, x + rnd.random() * side, y + rnd.random() * side) for k in range(n)]


def test_nearest_among_dense_targets_meets_few_of_them(spark):
    rnd = random.Random(3)
    targets = places(rnd, 1200, 19.9, 50.0, 0.001)
    points = places(rnd, 600, 19.9, 50.0, 0.001) + places(rnd, 100, 19.93, 50.01, 0.01, 600)  # inside the crowd, and far from it
    dist, calls = counted(spark)
    p, t = (spark.createDataFrame(rows, "id long, x double, y double") for rows in (points, targets))
    got = {r.id: r.target for r in sj.nearest(p, t, "id", "id", dist, 0.002).collect()}
    assert got == {k: min((metres(x, y, tx, ty), j) for j, tx, ty in targets)[1] for k, x, y in points}
    assert calls.value < len(points) * len(targets) / 2


def test_nearest_in_sparse_and_clustered_places_is_that_of_all_pairs(spark):
    rnd = random.Random(4)
    targets = places(rnd, 60, 19.9, 50.0, 0.0005) + places(rnd, 40, 21.0, 48.0, 3, 60) + [(200, -60.0, -70.0), (201, 100.0, 85.0)]
    targets += [(300 + k, x, y) for k, x, y in targets[:30]]  # ties
    points = places(rnd, 80, 18.0, 47.0, 6) + [(900, 0.0, 0.0), (901, -60.0, -69.0), (902, 99.0, 60.0)]
    p, t = (spark.createDataFrame(rows, "id long, x double, y double") for rows in (points, targets))
    got = {r.id: r.target for r in sj.nearest(p, t, "id", "id", metric.dist, 0.002).collect()}
    assert got == {k: min((metres(x, y, tx, ty), j) for j, tx, ty in targets)[1] for k, x, y in points}


def linked(points, link):
    root = {k: k for k, _, _ in points}
    for k, x, y in points:
        for j, tx, ty in points:
            if j < k and root[j] != root[k] and metres(x, y, tx, ty) <= link:
                low, high = sorted((root[j], root[k]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


def test_groups_of_dense_points_meet_few_pairs(spark, monkeypatch):
    rnd = random.Random(5)
    points = places(rnd, 900, 19.9, 50.0, 0.0012) + places(rnd, 10, 19.91, 50.0, 0.004, 900)
    dist, calls = counted(spark)
    monkeypatch.setattr(outliers.metric, "dist", dist)
    got = {r.id: r.root for r in outliers.groups(spark.createDataFrame(points, "id long, x double, y double"), 60.0).collect()}
    assert got == linked(points, 60.0)
    assert calls.value < len(points) ** 2 / 20


def test_groups_at_the_edge_of_the_linking_distance_are_those_of_all_pairs(spark):
    rnd = random.Random(6)
    for n, side, link in ((150, 0.01, 60.0), (120, 0.006, 40.0), (60, 0.02, 130.0)):
        points = places(rnd, n, 19.9, 50.0, side)
        got = {r.id: r.root for r in outliers.groups(spark.createDataFrame(points, "id long, x double, y double"), link).collect()}
        assert got == linked(points, link)
