"""Tiles, limits, graphs, rasters, geometry, partitioning and persistence."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiltwork.functions import mercator, metric, ring
from quiltwork.operators import boards, cache, graph, outliers, partition, raster, running, ways
from quiltwork.plans.registry import LAYERS, layers, query
from quiltwork.plans.spatial import independent_counts, point_lookup
from quiltwork.sources import payload, synth
from quiltwork.sources.scratch import Scratch

_EV = "e AS (SELECT event_id AS id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS ts, CAST(floor(value * 100) AS BIGINT) AS size FROM events)"


def _events(spark, sf_dir):
    e = synth.read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), "user_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long").alias("ts"), F.floor(F.col("value") * 100).cast("long").alias("size"))


@query(
    f"""WITH {_EV}, n AS (SELECT max(ts) AS now FROM e), a AS (SELECT e.*, ts < now - 20 * 86400 AS old, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS base FROM e CROSS JOIN n),
    l AS (SELECT *, sum(size) OVER (ORDER BY base, ts, id ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM a WHERE NOT old),
    r AS (SELECT base, CASE WHEN total - (upto - size) > 3000000 THEN 'evicted' ELSE 'kept' END AS action, size FROM l UNION ALL SELECT base, 'expired', size FROM a WHERE old)
    SELECT base AS is_base, action, CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM r GROUP BY 1, 2"""
)
def tile_cache_prune(spark, sf_dir):
    """Expired tiles go first, then other layers before the basemap, oldest first, until the budget is met."""
    e = _events(spark, sf_dir).withColumn("is_base", (F.col("event_type") == "view").cast("int")).withColumn("mtime", F.col("ts"))
    now = e.agg(F.max("ts").alias("m")).first()["m"]
    judged = cache.prune(e.select("id", "is_base", "mtime", "size"), F.lit(now), 20, 3_000_000)
    return judged.groupBy("is_base", "action").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query(f"WITH {_EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, ts // 3600 ORDER BY ts, id) AS k FROM e) SELECT user_id, CAST(count(*) AS BIGINT) AS asked, CAST(count(*) FILTER (WHERE k > 1) AS BIGINT) AS rejected FROM r GROUP BY user_id")
def rate_limit(spark, sf_dir):
    """Requests beyond one an hour and user."""
    r = cache.fixed_window(_events(spark, sf_dir), "user_id", 3600, 1)
    return r.groupBy("user_id").agg(F.count(F.lit(1)).alias("asked"), F.count_if(~F.col("allowed")).alias("rejected"))


@query(f"WITH {_EV}, o AS (SELECT *, row_number() OVER (ORDER BY ts, id) - 1 AS i FROM e), s AS (SELECT id, ts, max(ts - i * 300) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) + i * 300 AS slot FROM o) SELECT id, CAST(slot - ts AS BIGINT) AS wait FROM s")
def slot_gate(spark, sf_dir):
    """Waiting times at a gate that lets one request through every 300 seconds."""
    e = running.ordered_buckets(_events(spark, sf_dir).select("id", "ts"), ["ts", "id"])
    return running.slots(e, "_bucket", ["ts", "id"], "ts", 300).select("id", (F.col("slot") - F.col("ts")).alias("wait"))


@query(f"WITH {_EV}, n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, id) AS later FROM e) SELECT user_id, CAST(count(*) AS BIGINT) AS bursts FROM n WHERE later IS NULL OR later - ts > 7200 GROUP BY user_id")
def debounce_sessions(spark, sf_dir):
    """Bursts of each user with pauses of at most two hours."""
    return cache.debounce(_events(spark, sf_dir), "user_id", 7200).groupBy("user_id").agg(F.count(F.lit(1)).alias("bursts"))


_PX = "(x / 360e0 + 0.5e0) * 256e0 * 65536e0"
_PY = "(0.5e0 - ln((1e0 + sin(radians(y))) / (1e0 - sin(radians(y)))) / (4e0 * pi())) * 256e0 * 65536e0"


@query(f"{layers('b')}, p AS (SELECT id, CAST(floor({_PX} / 256) AS BIGINT) AS tx, CAST(floor({_PY} / 256) AS BIGINT) AS ty FROM b) SELECT tx, ty, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY 1, 2")
def tile_cover(spark, sf_dir):
    """Buildings by the tile of zoom 16 that shows them."""
    x, y = mercator.project(F.col("x"), F.col("y"), F.lit(16.0))
    return synth.buildings(spark, sf_dir).select(F.floor(x / 256).alias("tx"), F.floor(y / 256).alias("ty")).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""{layers('b')}, w AS (SELECT DISTINCT CAST(floor(({_PX} - 400e0) / 256) AS BIGINT) AS x0, CAST(floor(({_PX} + 400e0) / 256) AS BIGINT) AS x1, CAST(floor(({_PY} - 300e0) / 256) AS BIGINT) AS y0, CAST(floor(({_PY} + 300e0) / 256) AS BIGINT) AS y1 FROM b)
    SELECT CAST(count(*) AS BIGINT) AS tiles FROM (SELECT DISTINCT i, j FROM w, (SELECT range AS a FROM range(8)) p, (SELECT range AS b FROM range(8)) q, LATERAL (SELECT x0 + a AS i, y0 + b AS j) WHERE x0 + a <= x1 AND y0 + b <= y1)"""
)
def tiles_needed(spark, sf_dir):
    """Distinct tiles of 800 x 600 pixel views around all buildings."""
    x, y = mercator.project(F.col("x"), F.col("y"), F.lit(16.0))
    view = synth.buildings(spark, sf_dir).select(*[F.floor(v / 256).alias(n) for n, v in (("x0", x - 400), ("x1", x + 400), ("y0", y - 300), ("y1", y + 300))]).distinct()
    cover = view.select(F.explode(F.sequence("x0", "x1")).alias("tx"), "y0", "y1").select(F.pmod("tx", F.lit(65536)).alias("tx"), F.explode(F.sequence("y0", "y1")).alias("ty"))
    return cover.distinct().agg(F.count(F.lit(1)).alias("tiles"))


@query(f"{layers('b')} SELECT id, CAST(floor(40075016.686e0 * cos(radians(y)) / (256e0 * pow(2e0, 12 + id % 6)) * 1000 + 0.5e0) AS BIGINT) AS mm_per_px, CAST(floor(sin(radians((id * 37) % 360)) * 1e6 + 0.5e0) AS BIGINT) AS east, CAST(((id * 37) % 720 + 180) % 360 - 180 AS BIGINT) AS wrapped FROM b")
def meters_per_pixel(spark, sf_dir):
    """Ground resolution, compass vector and wrapped angle."""
    z = (12 + F.col("id") % 6).cast("double")
    mm = F.floor(mercator.meters_per_pixel(F.col("y"), z) * 1000 + 0.5)
    deg = (F.col("id") * 37) % 720
    return synth.buildings(spark, sf_dir).select("id", mm.alias("mm_per_px"), F.floor(F.sin(F.radians((F.col("id") * 37 % 360).cast("double"))) * 1e6 + 0.5).alias("east"), mercator.wrap180(deg.cast("double")).cast("long").alias("wrapped"))


@query("WITH m AS (SELECT c_custkey AS id, 3e0 + (c_custkey * 97) % 9973 AS most FROM customer), p AS (SELECT id, most, pow(10e0, floor(log10(most))) AS u FROM m) SELECT id, CAST(CASE WHEN u * 5 <= most THEN u * 5 WHEN u * 2 <= most THEN u * 2 ELSE u END AS BIGINT) AS meters FROM p")
def scale_bar(spark, sf_dir):
    """The largest round length that fits."""
    most = 3.0 + (F.col("c_custkey") * 97) % 9973
    return synth.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), mercator.nice_distance(most).cast("long").alias("meters"))


_NODED = """h AS (SELECT DISTINCT CAST(floor(ay * 1e5 + 0.5e0) AS BIGINT) AS y FROM s WHERE id % 2 = 0), v AS (SELECT DISTINCT CAST(floor(ax * 1e5 + 0.5e0) AS BIGINT) AS x FROM s WHERE id % 2 = 1),
    hx AS (SELECT x FROM v UNION SELECT 1990000 UNION SELECT 1992000), vy AS (SELECT y FROM h UNION SELECT 5000000 UNION SELECT 5002000),
    hn AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx FROM hx), vn AS (SELECT y, lead(y) OVER (ORDER BY y) AS ny FROM vy),
    n AS (SELECT x AS ax, y AS ay, nx AS bx, y AS by_ FROM hn CROSS JOIN h WHERE nx IS NOT NULL UNION SELECT x, y, x, ny FROM vn CROSS JOIN v WHERE ny IS NOT NULL)"""


def _noded(spark, sf_dir):
    return graph.node_segments(synth.streets(spark, sf_dir), 0.002)


@query(f"{layers('s')}, {_NODED} SELECT CAST(ax AS BIGINT) AS ax, CAST(ay AS BIGINT) AS ay, CAST(bx AS BIGINT) AS bx, CAST(by_ AS BIGINT) AS b_y FROM n")
def noded_edges(spark, sf_dir):
    """The streets cut at their crossings: unique edges, coordinates in 1e-5 degrees."""
    r = lambda c: F.floor(F.col(c) * 1e5 + 0.5)
    return _noded(spark, sf_dir).select(r("ax").alias("ax"), r("ay").alias("ay"), r("bx").alias("bx"), r("by").alias("b_y"))


@query(f"{layers('s')}, {_NODED}, k AS (SELECT ax AS x, ay AS y FROM n UNION SELECT bx, by_ FROM n) SELECT (SELECT CAST(count(*) AS BIGINT) FROM k) AS nodes, CAST(count(*) AS BIGINT) AS edges, CAST(sum(floor(sqrt(pow((bx - ax) / 1e5 * 111320e0 * cos(radians((ay + by_) / 2e5)), 2) + pow((by_ - ay) / 1e5 * 110540e0, 2)) * 10 + 0.5e0)) AS BIGINT) AS dm FROM n")
def street_graph(spark, sf_dir):
    """Nodes, edges and summed length of the street graph."""
    e = graph.build(_noded(spark, sf_dir)).withColumn("dm", F.floor(F.col("w") * 10 + 0.5))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("n")).distinct().agg(F.count(F.lit(1)).alias("nodes"))
    return nodes.join(F.broadcast(e.agg(F.count(F.lit(1)).alias("edges"), F.sum("dm").cast("long").alias("dm"))), F.lit(True))


@query(
    f"""{layers('s')}, {_NODED}, c AS (SELECT v.x, h.y, row_number() OVER (ORDER BY v.x, h.y) AS k FROM v CROSS JOIN h), p AS (SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM c a JOIN c b ON b.k = a.k - 37)
    SELECT ax || ',' || ay AS src, bx || ',' || by_ AS dst, CAST(floor(abs(by_ - ay) / 1e5 * 110540e0 + abs(bx - ax) / 1e5 * 111320e0 * cos(radians(greatest(ay, by_) / 1e5)) + 0.5e0) AS BIGINT) AS meters FROM p"""
)
def shortest_paths(spark, sf_dir):
    """Shortest ways from each crossing of the street board to the one 37 places before it."""
    from quiltwork.plans import routes

    c = F.col
    nodes = routes._crossings(spark, sf_dir)
    to = nodes.select((c("k") + 37).alias("k"), c("node").alias("dst"), c("x").alias("tx"), c("y").alias("ty"))
    asked = nodes.join(to, "k").select(c("k").alias("key"), c("node").alias("src"), "dst", c("x").alias("sx"), c("y").alias("sy"), "tx", "ty", F.lit(None).alias("bearing"))
    found = ways.routes(routes.placed(spark, sf_dir), asked, budget=10**7)
    return asked.select("key", "src", "dst").join(found, "key").select("src", "dst", F.floor(c("meters") + 0.5).alias("meters"))


@query(f"{layers('b', 't')}, l AS (SELECT 19.901e0 AS ax, 50.0007e0 AS ay, 19.9193e0 AS bx, 50.0183e0 AS b_y), e AS (SELECT ord, minx AS px, miny AS py, maxx AS qx, miny AS qy FROM t UNION ALL SELECT ord, maxx, miny, maxx, maxy FROM t UNION ALL SELECT ord, maxx, maxy, minx, maxy FROM t UNION ALL SELECT ord, minx, maxy, minx, miny FROM t), d AS (SELECT ord, (bx - ax) * (py - ay) - (b_y - ay) * (px - ax) AS d1, (bx - ax) * (qy - ay) - (b_y - ay) * (qx - ax) AS d2, (qx - px) * (ay - py) - (qy - py) * (ax - px) AS d3, (qx - px) * (b_y - py) - (qy - py) * (bx - px) AS d4 FROM e CROSS JOIN l) SELECT ord, CAST(count(*) AS BIGINT) AS crossings, count(*) >= 2 AS separates FROM d WHERE d1 * d2 < 0 AND d3 * d4 < 0 GROUP BY ord")
def crossing_report(spark, sf_dir):
    """How often a drawn line crosses each territory's border; two crossings separate it."""
    t = synth.territories(spark, sf_dir)
    e = t.select("ord", F.explode(ring.edges(ring.box_ring(*map(F.col, ("minx", "miny", "maxx", "maxy"))))).alias("e"))
    line = ((F.lit(19.901), F.lit(50.0007)), (F.lit(19.9193), F.lit(50.0183)))
    meets = metric.segments_meet(*line, (F.col("e.a.x"), F.col("e.a.y")), (F.col("e.b.x"), F.col("e.b.y")))
    return e.where(meets).groupBy("ord").agg(F.count(F.lit(1)).alias("crossings")).withColumn("separates", F.col("crossings") >= 2)


_DISC = f"""{layers('b')}, o AS (SELECT range - 2 AS k FROM range(5)), p AS (SELECT x, y, CAST(floor((x - 19.89e0) / 4e-4) AS BIGINT) + i.k AS cx, CAST(floor((y - 49.99e0) / 4e-4) AS BIGINT) + j.k AS cy, i.k = 0 AND j.k = 0 AS own FROM b CROSS JOIN o i CROSS JOIN o j),
    c AS (SELECT DISTINCT cx, cy FROM p WHERE own OR sqrt(pow((19.89e0 + (cx + 0.5e0) * 4e-4 - x) * 111320e0 * cos(radians((y + 49.99e0 + (cy + 0.5e0) * 4e-4) / 2)), 2) + pow((49.99e0 + (cy + 0.5e0) * 4e-4 - y) * 110540e0, 2)) <= 40)"""


def _discs(spark, sf_dir):
    return raster.stamp_discs(synth.buildings(spark, sf_dir, outliers=True), 19.89, 49.99, 4e-4, 40.0, 2)


@query(_DISC.replace(" AS y,\n", " AS y,\n", 1).replace("19.9e0 + ((c_custkey * 7919) % 20011) / 1e6 AS x", "19.9e0 + ((c_custkey * 7919) % 20011) / 1e6 + CASE WHEN c_custkey % 500 = 499 THEN 2e-2 ELSE 0e0 END AS x") + " SELECT cy, CAST(count(*) AS BIGINT) AS cells, CAST(min(cx) AS BIGINT) AS first, CAST(max(cx) AS BIGINT) AS last FROM c GROUP BY cy")
def raster_coverage(spark, sf_dir):
    """Cells within 40 m of a building, row by row."""
    return _discs(spark, sf_dir).groupBy("cy").agg(F.count(F.lit(1)).alias("cells"), F.min("cx").alias("first"), F.max("cx").alias("last"))


@query(
    _DISC.replace("WITH ", "WITH RECURSIVE ", 1).replace("19.9e0 + ((c_custkey * 7919) % 20011) / 1e6 AS x", "19.9e0 + ((c_custkey * 7919) % 20011) / 1e6 + CASE WHEN c_custkey % 500 = 499 THEN 2e-2 ELSE 0e0 END AS x")
    + """, k AS (SELECT cx, cy, cx * 1048576 + cy AS n FROM c), e AS (SELECT a.n AS a, b.n AS b FROM k a JOIN k b ON abs(a.cx - b.cx) + abs(a.cy - b.cy) = 1),
    r AS (SELECT n AS node, n AS root FROM k UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node AND r.root < e.b), m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
    SELECT CAST(root AS BIGINT) AS label, CAST(count(*) AS BIGINT) AS cells FROM m GROUP BY root"""
)
def raster_components(spark, sf_dir):
    """Sizes of the connected components of the covered ground, each named by its least cell."""
    return raster.spread_components(_discs(spark, sf_dir)).groupBy("label").agg(F.count(F.lit(1)).alias("cells"))


@query(f"{layers('t')}, g AS (SELECT i.range AS cx, j.range AS cy FROM range(100) i CROSS JOIN range(100) j) SELECT ord, CAST(count(*) AS BIGINT) AS cells, CAST(sum(cx * 1000 + cy) AS BIGINT) AS mark FROM t JOIN g ON 19.9e0 + (cx + 0.5e0) * 2.1e-4 >= minx AND 19.9e0 + (cx + 0.5e0) * 2.1e-4 < maxx AND 50e0 + (cy + 0.5e0) * 2.1e-4 >= miny AND 50e0 + (cy + 0.5e0) * 2.1e-4 < maxy GROUP BY ord")
def raster_fill(spark, sf_dir):
    """Territories filled row by row on a grid of 2.1e-4 degrees."""
    t = synth.territories(spark, sf_dir)
    e = t.select("ord", F.explode(ring.edges(ring.box_ring(*map(F.col, ("minx", "miny", "maxx", "maxy"))))).alias("e")).select("ord", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))
    return raster.fill_rings(e, "ord", 19.9, 50.0, 2.1e-4).groupBy("ord").agg(F.count(F.lit(1)).alias("cells"), F.sum(F.col("cx") * 1000 + F.col("cy")).alias("mark"))


@query(f"{layers('t')} SELECT ord, CAST(floor((maxx - minx) * (maxy - miny) * 110540e0 * 111320e0 * cos(radians((miny + maxy) / 2)) + 0.5e0) AS BIGINT) AS m2, CAST(5 AS BIGINT) AS vertices, CAST(floor((minx + maxx) / 2 * 1e6 + 0.5e0) AS BIGINT) AS cx, TRUE AS holds FROM t")
def ring_area(spark, sf_dir):
    """Area, vertices and centroid of each territory's ring, which holds its centroid."""
    r = ring.box_ring(*map(F.col, ("minx", "miny", "maxx", "maxy")))
    t = synth.territories(spark, sf_dir).select("ord", r.alias("ring")).withColumn("c", ring.centroid(F.col("ring")))
    return t.select("ord", F.floor(ring.area_m2(F.col("ring")) + 0.5).alias("m2"), F.size("ring").cast("long").alias("vertices"), F.floor(F.col("c.x") * 1e6 + 0.5).alias("cx"), ring.contains(F.col("ring"), F.col("c.x"), F.col("c.y")).alias("holds"))


def _lloyd_sql(rounds: int, k: int) -> str:
    parts = [LAYERS["b"], f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS cluster, x, y FROM b WHERE id IN (SELECT id FROM b ORDER BY id LIMIT {k}))"]
    for n in range(rounds):
        parts.append(f"d{n} AS (SELECT b.id, b.x, b.y, c.cluster, row_number() OVER (PARTITION BY b.id ORDER BY ((b.x - c.x) * 111320e0 * cos(radians(50.01e0))) * ((b.x - c.x) * 111320e0 * cos(radians(50.01e0))) + ((b.y - c.y) * 110540e0) * ((b.y - c.y) * 110540e0), c.cluster) AS r FROM b CROSS JOIN c{n} c)")
        parts.append(f"m{n} AS (SELECT cluster, floor(avg(x) * 1e9 + 0.5e0) / 1e9 AS x, floor(avg(y) * 1e9 + 0.5e0) / 1e9 AS y FROM d{n} WHERE r = 1 GROUP BY cluster)")
        parts.append(f"c{n + 1} AS (SELECT c.cluster, coalesce(m.x, c.x) AS x, coalesce(m.y, c.y) AS y FROM c{n} c LEFT JOIN m{n} m ON m.cluster = c.cluster)")
    return "WITH " + ", ".join(parts) + f" SELECT cluster, CAST(floor(x * 1e5 + 0.5e0) AS BIGINT) AS cx, CAST(floor(y * 1e5 + 0.5e0) AS BIGINT) AS cy FROM c{rounds}"


@query(_lloyd_sql(3, 8))
def kmeans_lloyd(spark, sf_dir):
    """Centres of eight clusters of buildings after three rounds."""
    c = partition.lloyd(synth.buildings(spark, sf_dir).select("id", "x", "y"), 8, 3)
    return c.select("cluster", F.floor(F.col("x") * 1e5 + 0.5).alias("cx"), F.floor(F.col("y") * 1e5 + 0.5).alias("cy"))


@query()
def partition_pipeline(spark, sf_dir):
    """Twelve territories: sample points, centres, Voronoi cells, borders along the streets, faces, and whole territories.

    For each: the buildings nearest to its centre, its area, its pieces, and the faces that only the nearest centre claimed.
    """
    area, k = (19.89, 49.99, 19.93, 50.03), 12
    scratch = Scratch(spark, "partition")
    b, s = scratch.keep(boards.dealt(synth.buildings(spark, sf_dir).select("id", "x", "y"))), synth.streets(spark, sf_dir)
    middles = s.where("id % 5 = 0").select("id", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
    corners = spark.range(4 * k).select("id", (area[0] + (area[2] - area[0]) * (F.col("id") % 7) / 7).alias("x"), (area[1] + (area[3] - area[1]) * (F.col("id") % 5) / 5).alias("y"))
    points = partition.sample_points(k, b, middles, corners)
    centres = scratch.keep(partition.lloyd(points, k, 4))
    held = partition.assign(b, [(r["cluster"], r["x"], r["y"]) for r in centres.collect()]).groupBy("cluster").agg(F.count(F.lit(1)).alias("buildings"))  # k centres
    cells = scratch.keep(partition.voronoi_cells(centres, area))
    noded = scratch.keep(_noded(spark, sf_dir))
    r = lambda v: F.floor(F.col(v) * 1e5 + 0.5).cast("long").cast("string")
    nodes = noded.select(F.col("ax").alias("x"), F.col("ay").alias("y")).union(noded.select("bx", "by")).distinct()
    nodes = scratch.keep(nodes.select(F.concat_ws(",", r("x"), r("y")).alias("node"), "x", "y").dropDuplicates(["node"]))
    lines = partition.follow_streets(partition.cell_borders(cells, area), graph.build(noded), nodes)
    out = partition.emit_territories(cells, scratch.keep(lines), synth.footprints(spark, sf_dir), area)
    return out.join(held.withColumn("cluster", F.col("cluster").cast("long")), "cluster", "left").select("cluster", F.coalesce("buildings", F.lit(0)).cast("long").alias("buildings"), F.floor(F.col("m2") + 0.5).alias("m2"), "parts", "fallback")


_SHIFTED = LAYERS["b"].replace("19.9e0 + ((c_custkey * 7919) % 20011) / 1e6 AS x", "19.9e0 + ((c_custkey * 7919) % 20011) / 1e6 + CASE WHEN c_custkey % 500 = 499 THEN 2e-2 ELSE 0e0 END AS x")
_M = "sqrt(pow(({q}x - {p}x) * 111320e0 * cos(radians(({p}y + {q}y) / 2)), 2) + pow(({q}y - {p}y) * 110540e0, 2))"


@query(
    f"""WITH RECURSIVE {_SHIFTED}, p AS MATERIALIZED (SELECT a.id AS a, o.id AS o, {_M.format(p='a.', q='o.')} AS m FROM b a JOIN b o ON a.id <> o.id),
    k AS (SELECT m, row_number() OVER (PARTITION BY a ORDER BY m, o) AS r FROM p), s AS (SELECT coalesce(median(m), 0e0) AS med FROM k WHERE r = 3), e AS MATERIALIZED (SELECT a, o FROM p, s WHERE m <= greatest(1.5e0 * med, 60e0)),
    r AS (SELECT id AS node, id AS root FROM b UNION SELECT e.o, r.root FROM r JOIN e ON e.a = r.node AND r.root < e.o), g AS MATERIALIZED (SELECT node, min(root) AS root FROM r GROUP BY node),
    z AS (SELECT root, count(*) AS n, min(x) AS px, min(y) AS py, max(x) AS qx, max(y) AS qy FROM g JOIN b ON b.id = node GROUP BY root), h AS (SELECT root AS home, {_M.format(p='p', q='q')} AS span FROM z ORDER BY n DESC, root LIMIT 1),
    u AS (SELECT home, 3 * greatest(med, 40e0, 0.025e0 * span) AS far FROM h, s), d AS (SELECT x.root, min(m) AS gap FROM p JOIN g x ON x.node = a JOIN g y ON y.node = o, u WHERE y.root = home AND x.root <> home AND m <= greatest(4 * far, 2000e0) GROUP BY 1)
    SELECT z.root, CAST(n AS BIGINT) AS n, CAST(floor(gap) AS BIGINT) AS gap_m, n <= 8 AND (gap IS NULL OR gap > far) AS outlier FROM z CROSS JOIN u LEFT JOIN d ON d.root = z.root WHERE z.root <> home"""
)
def outlier_groups(spark, sf_dir):
    """Groups of buildings away from the largest one, and which of them are isolated."""
    out = outliers.find(synth.buildings(spark, sf_dir, outliers=True))
    return out.select("root", "n", F.when(F.col("gap_m") == float("inf"), None).otherwise(F.floor("gap_m")).alias("gap_m"), "outlier")


@query()
def heal_plan(spark, sf_dir):
    """A board with a hole, territories without buildings and a footprint across each border: where each territory goes.

    Buildings of every third territory are left out on purpose; the hole is adopted as a territory of its own.
    """
    one = F.lit(1).cast("long").alias("project")
    t = synth.territories(spark, sf_dir, 0.004).where("ord <> 12")
    b = point_lookup(spark, sf_dir).where("ord % 3 <> 1 AND ord <> 12").select("id").join(synth.buildings(spark, sf_dir).select("id", "x", "y"), "id")
    roofs = t.where("ord % 5 < 4").select(one, (F.col("maxx") - 6e-5).alias("minx"), ((F.col("miny") + F.col("maxy")) / 2).alias("miny"), (F.col("maxx") + 4e-5).alias("maxx"), ((F.col("miny") + F.col("maxy")) / 2 + 1e-4).alias("maxy"))
    out = partition.heal_plan(t.withColumn("project", one), b.withColumn("project", one), roofs, (19.9, 50.0, 19.92, 50.02))
    return out.select("ord", "host", F.floor(F.col("m2") + 0.5).alias("m2"), "adopted", "split", "detached", "merged")


@query(f"{layers('t', 's')} SELECT 'clusters' AS layer, CAST(count(*) AS BIGINT) AS n, CAST(min(ord) AS BIGINT) AS first FROM t UNION ALL SELECT 'streets', count(*), min(id) FROM s UNION ALL SELECT 'buildings', count(*), min(c_custkey) FROM customer")
def payload_roundtrip(spark, sf_dir):
    """All layers written as features of a versioned payload, and read again."""
    features = payload.build(synth.territories(spark, sf_dir), synth.streets(spark, sf_dir), synth.buildings(spark, sf_dir))
    return payload.parse(features).groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))


@query("WITH v AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) SELECT o_custkey, CAST(count(*) AS BIGINT) AS snapshots, CAST(max(CASE WHEN k = 1 THEN o_orderkey END) AS BIGINT) AS newest FROM v WHERE k <= 30 GROUP BY o_custkey")
def version_history(spark, sf_dir):
    """The 30 newest snapshots of each project, and the newest."""
    from pyspark.sql import Window

    o = synth.read(spark, sf_dir, "orders").withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))).where("k <= 30")
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("snapshots"), F.max(F.when(F.col("k") == 1, F.col("o_orderkey"))).alias("newest"))


@query("WITH a AS (SELECT c_custkey AS id, c_acctbal < 0 AS auto, CASE WHEN c_custkey % 7 = 0 THEN TRUE WHEN c_custkey % 7 = 1 THEN FALSE END AS manual FROM customer) SELECT auto, manual, coalesce(manual, auto) AS ignored, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY 1, 2, 3")
def selection_state(spark, sf_dir):
    """Ignored buildings: automatic ones and manual ones, without those kept by hand."""
    c = synth.read(spark, sf_dir, "customer")
    manual = F.when(F.col("c_custkey") % 7 == 0, True).when(F.col("c_custkey") % 7 == 1, False)
    a = c.select((F.col("c_acctbal") < 0).alias("auto"), manual.alias("manual"))
    return a.groupBy("auto", "manual", F.coalesce("manual", "auto").alias("ignored")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{layers('b', 't')} SELECT ord, CAST(count(*) AS BIGINT) AS buildings FROM b JOIN t ON x >= minx AND x < maxx AND y >= miny AND y < maxy WHERE ord IN (2, 7, 24) GROUP BY ord")
def scoped_counts(spark, sf_dir):
    """Counts for a list of territories; numbers beyond the list are dropped."""
    wanted = spark.createDataFrame([(2,), (7,), (24,), (999,)], "ord long")
    return independent_counts(spark, sf_dir).join(F.broadcast(wanted), "ord", "left_semi")
