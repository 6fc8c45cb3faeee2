"""Every query with an SQL form against DuckDB; the others against brute force or invariants."""

import math

import duckdb
import pytest

from quiltwork import plans
from quiltwork.sources import synth

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_oracle(spark, sf_dir, con, name):
    df = plans.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    r = con.execute(plans.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=repr)


def _points(spark, sf_dir, outliers=False):
    return [(r.id, r.x, r.y) for r in synth.buildings(spark, sf_dir, outliers).collect()]


def _dist(a, b):
    k = 111320 * math.cos(math.radians((a[2] + b[2]) / 2))
    return math.hypot((b[1] - a[1]) * k, (b[2] - a[2]) * 110540)


def test_partition_tiles_the_box(spark, sf_dir):
    rows = plans.queries()["partition_pipeline"](spark, sf_dir).collect()
    box = 0.04 * 110540 * 0.04 * 111320 * math.cos(math.radians(50.01))
    assert abs(sum(r.m2 for r in rows) / box - 1) < 1e-4
    assert sum(r.buildings for r in rows) == len(_points(spark, sf_dir))
    assert all(r.parts == 1 for r in rows)


def test_borders_follow_the_streets(spark, sf_dir):
    from quiltwork.operators import graph, partition

    edges = spark.createDataFrame([(x, y, x + dx, y + dy) for x in (0.0, 0.001, 0.002) for y in (50.0, 50.001) for dx, dy in ((0.001, 0.0), (0.0, 0.001))], "ax double, ay double, bx double, by double")
    nodes = edges.selectExpr("ax AS x", "ay AS y").union(edges.selectExpr("bx", "by")).distinct().selectExpr("concat_ws(',', CAST(floor(x * 1e5 + 0.5) AS BIGINT), CAST(floor(y * 1e5 + 0.5) AS BIGINT)) AS node", "x", "y").dropDuplicates(["node"])
    borders = spark.createDataFrame([(1, 0.0001, 50.0, 0.002, 50.001), (2, 5.0, 10.0, 6.0, 10.0)], "border long, ax double, ay double, bx double, by double")
    got = {r.border: [(round(p.x, 6), round(p.y, 6)) for p in r.line] for r in partition.follow_streets(borders, graph.build(edges), nodes).collect()}
    assert got[1][0] == (0.0001, 50.0) and got[1][1] == (0.0, 50.0) and got[1][-1] == (0.002, 50.001) and len(got[1]) == 5
    assert got[2] == [(5.0, 10.0), (6.0, 10.0)]


def test_raster_components_cover_all_cells(spark, sf_dir):
    q = plans.queries()
    cells = sum(r.cells for r in q["raster_coverage"](spark, sf_dir).collect())
    assert sum(r.cells for r in q["raster_components"](spark, sf_dir).collect()) == cells


def test_outlier_groups_are_single_linkage(spark, sf_dir):
    from quiltwork.operators import outliers

    points = synth.buildings(spark, sf_dir, True).select("id", "x", "y")
    _, link = outliers.scale(points)
    got = {r.id: r.root for r in outliers.groups(points, link).collect()}
    p = _points(spark, sf_dir, True)
    up = {i: i for i, _, _ in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(p):
        for b in p[i + 1 :]:
            if _dist(a, b) <= link:
                x, y = root(a[0]), root(b[0])
                up[max(x, y)] = min(x, y)
    assert got == {i: root(i) for i in up}


def test_heal_leaves_no_reachable_territory_empty(spark, sf_dir):
    rows = {r.ord: r.host for r in plans.queries()["heal_plan"](spark, sf_dir).collect()}
    assert len(rows) == 25 and all(rows[h] == h for h in rows.values())
    assert all(o % 3 != 1 for o in rows.values())


def test_lru_hits_add_up(spark, sf_dir):
    rows = plans.queries()["lru_hits"](spark, sf_dir).collect()
    assert sum(r.hits + r.misses for r in rows) == synth.read(spark, sf_dir, "events").count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25
    assert set(plans.queries()) <= set(__spark_entry__.queries())


def test_gap_list_is_the_ground_left_out(spark, sf_dir):
    rows = plans.queries()["gap_list"](spark, sf_dir).collect()
    cell = 0.00399 * 0.00399 * 110540 * 111320 * 0.6427  # neighbours overlap a gap by a hair
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert sum(r.m2 for r in rows) == pytest.approx(4 * cell, rel=0.02)


def test_trim_keeps_all_kept_buildings_and_no_shifted_ones(spark, sf_dir):
    r = plans.queries()["trim_proposal"](spark, sf_dir).first()
    assert r.kept_inside > 0 and r.ignored_inside == 0 and r.vertices > 3


def test_union_find(spark):
    from quiltwork.operators.graph import contract
    from quiltwork.sources.scratch import Scratch

    links = [(k, k + 1) for k in range(0, 200)] + [(500, k) for k in range(501, 900)] + [(3, 3), (1000, 999)]
    got = {r.node: r.root for r in contract(spark.createDataFrame(links, "a long, b long").repartition(9), Scratch(spark, "t")).collect()}
    assert all(got[k] == 0 for k in range(201)) and all(got[k] == 500 for k in range(500, 900)) and got[1000] == 999
