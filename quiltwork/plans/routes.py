"""Ways on the street graph, on rasters, and stored state."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiltwork.config import CONFIG
from quiltwork.functions import facts, metric
from quiltwork.operators import boards, follow, graph, raster, ways
from quiltwork.operators import spatial_join as sj
from quiltwork.plans.areas import _EV, _NODED, _noded
from quiltwork.plans.registry import layers, query
from quiltwork.plans.spatial import _D2
from quiltwork.sources import history, payload, store, synth
from quiltwork.sources.scratch import shared_folder

c = F.col


def _nodes(spark, sf_dir):
    e = _noded(spark, sf_dir)
    ends = e.select(c("ax").alias("x"), c("ay").alias("y")).union(e.select("bx", "by")).distinct()
    r = lambda v: F.floor(c(v) * 1e5 + 0.5).cast("long")
    return ends.select("x", "y", F.concat_ws(",", r("x").cast("string"), r("y").cast("string")).alias("node"))


@query(
    f"""{layers('b', 's')}, {_NODED}, k AS (SELECT ax AS x, ay AS y FROM n UNION SELECT bx, by_ FROM n), d AS (SELECT b.id, k.x || ',' || k.y AS node, sqrt({_D2.format(ax='b.x', ay='b.y', bx='(k.x / 1e5)', by='(k.y / 1e5)')}) AS m FROM b CROSS JOIN k),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY floor(m * 1e4), node) AS p FROM d) SELECT id, CAST(floor(m * 100 + 0.5e0) AS BIGINT) AS cm FROM r WHERE p = 1 AND m <= 60"""
)
def nearest_nodes(spark, sf_dir):
    """Distance to the nearest node of the street graph, within 60 m."""
    near = sj.nearest(synth.buildings(spark, sf_dir).select("id", "x", "y"), _nodes(spark, sf_dir), "id", "node", metric.dist, 0.0005)
    return near.where(c("d") <= CONFIG.reach_m).select("id", F.floor(c("d") * 100 + 0.5).alias("cm"))


def _crossings(spark, sf_dir):
    """k, node, x, y of the crossings of the street board, numbered from west to east and south to north."""
    r = lambda v: F.floor(c(v) * 1e5 + 0.5).cast("long")
    lines = synth.streets(spark, sf_dir).agg(F.sort_array(F.collect_set(F.when(c("id") % 2 == 1, r("ax")))).alias("xs"), F.sort_array(F.collect_set(F.when(c("id") % 2 == 0, r("ay")))).alias("ys"))  # at most 200 lines
    at = lines.select("xs", "ys", F.explode(F.sequence(F.lit(1).cast("long"), F.size("xs").cast("long") * F.size("ys"))).alias("k"))
    x, y = F.get("xs", F.floor((c("k") - 1) / F.size("ys")).cast("int")), F.get("ys", ((c("k") - 1) % F.size("ys")).cast("int"))
    return at.select("k", F.concat_ws(",", x.cast("string"), y.cast("string")).alias("node"), (x / 1e5).alias("x"), (y / 1e5).alias("y"))


def placed(spark, sf_dir):
    """src, dst, w of the street graph with its nodes' places."""
    nodes = _nodes(spark, sf_dir)
    end = lambda n, x, y: nodes.select(c("node").alias(n), c("x").alias(x), c("y").alias(y))
    return graph.build(_noded(spark, sf_dir)).join(end("src", "ax", "ay"), "src").join(end("dst", "bx", "by"), "dst")


_HOP = "abs({b}.y - {a}.y) / 1e5 * 110540e0 + abs({b}.x - {a}.x) / 1e5 * 111320e0 * cos(radians(greatest({a}.y, {b}.y) / 1e5))"


@query(
    f"""{layers('s')}, {_NODED}, c AS (SELECT v.x, h.y, row_number() OVER (ORDER BY v.x, h.y) AS k FROM v CROSS JOIN h),
    p AS (SELECT a.k, {_HOP.format(a='a', b='b')} AS m1, {_HOP.format(a='b', b='d')} AS m2, sqrt({_D2.format(ax='(a.x / 1e5)', ay='(a.y / 1e5)', bx='(b.x / 1e5)', by='(b.y / 1e5)')}) AS d1, sqrt({_D2.format(ax='(b.x / 1e5)', ay='(b.y / 1e5)', bx='(d.x / 1e5)', by='(d.y / 1e5)')}) AS d2 FROM c a JOIN c b ON b.k = a.k - 13 JOIN c d ON d.k = a.k - 26)
    SELECT k, CAST(floor(CASE WHEN m1 <= d1 * 1.75e0 AND m1 - d1 <= 300 THEN m1 ELSE d1 END + CASE WHEN m2 <= d2 * 1.75e0 AND m2 - d2 <= 300 THEN m2 ELSE d2 END + 0.5e0) AS BIGINT) AS meters, m1 <= d1 * 1.75e0 AND m1 - d1 <= 300 AS first_routed, m2 <= d2 * 1.75e0 AND m2 - d2 <= 300 AS second_routed FROM p"""
)
def routed_lines(spark, sf_dir):
    """Lines of two hops between crossings: each hop follows the streets unless that is too long a way round."""
    nodes = _crossings(spark, sf_dir)
    to = nodes.select((c("k") + 13).alias("k"), c("node").alias("dst"), c("x").alias("tx"), c("y").alias("ty"))
    hops = nodes.join(to, "k").select("k", c("node").alias("src"), "dst", c("x").alias("sx"), c("y").alias("sy"), "tx", "ty", metric.dist(c("x"), c("y"), c("tx"), c("ty")).alias("direct"))
    found = ways.routes(placed(spark, sf_dir), hops.withColumnRenamed("k", "key").withColumn("bearing", F.lit(None)), budget=10**7).withColumnRenamed("key", "k")
    taken = hops.join(found, "k").withColumn("ok", facts.accepts_detour(c("meters"), c("direct")))
    taken = taken.select("k", "ok", F.when(c("ok"), c("meters")).otherwise(c("direct")).alias("m"))
    after = taken.select((c("k") + 13).alias("k"), c("ok").alias("ok2"), c("m").alias("m2"))
    return taken.join(after, "k").select("k", F.floor(c("m") + c("m2") + 0.5).alias("meters"), c("ok").alias("first_routed"), c("ok2").alias("second_routed"))


_TURNED = "(1 + 0.3e0 * (CASE WHEN {d} > 90 THEN 180 - {d} ELSE {d} END) / 90)"


@query(
    f"""{layers('s')}, {_NODED}, c AS (SELECT v.x, h.y, row_number() OVER (ORDER BY v.x, h.y) AS k FROM v CROSS JOIN h), p AS (SELECT a.k, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM c a JOIN c b ON b.k = a.k - 29),
    m AS (SELECT k, abs(b_y - ay) / 1e5 * 110540e0 AS up, abs(bx - ax) / 1e5 * 111320e0 * cos(radians(greatest(ay, b_y) / 1e5)) AS side, degrees(atan2((bx - ax) / 1e5 * 111320e0 * cos(radians((ay + b_y) / 2e5)), (b_y - ay) / 1e5 * 110540e0)) AS way FROM p)
    SELECT k, CAST(floor((up * {_TURNED.format(d='(abs(0 - way) % 180)')} + side * {_TURNED.format(d='(abs(90 - way) % 180)')}) * 10 + 0.5e0) AS BIGINT) AS cost, CAST(floor((up + side) * 10 + 0.5e0) AS BIGINT) AS dm FROM m"""
)
def bearing_routes(spark, sf_dir):
    """Ways between crossings 29 places apart that keep to the direction asked for: cost and length in decimetres."""
    nodes = _crossings(spark, sf_dir)
    to = nodes.select((c("k") + 29).alias("k"), c("node").alias("dst"), c("x").alias("tx"), c("y").alias("ty"))
    asked = nodes.join(to, "k").select(c("k").alias("key"), c("node").alias("src"), "dst", c("x").alias("sx"), c("y").alias("sy"), "tx", "ty", metric.bearing(c("x"), c("y"), c("tx"), c("ty")).alias("bearing"))
    return ways.routes(placed(spark, sf_dir), asked, budget=10**7).select(c("key").alias("k"), F.floor(c("cost") * 10 + 0.5).alias("cost"), F.floor(c("meters") * 10 + 0.5).alias("dm"))


_INSET = "(1 + ord % 3) * 1.3e-4{d}"


def _drawn_rings(spark, sf_dir):
    """Territories drawn by hand: each a little inside its box, with a vertex in the middle of its west side."""
    m = _INSET.format(d="D")
    at = lambda x, y: f"named_struct('x', {x}, 'y', {y})"
    corners = [at(f"minx + {m}", f"miny + {m}"), at(f"maxx - {m}", f"miny + {m}"), at(f"maxx - {m}", f"maxy - {m}"), at(f"minx + {m}", f"maxy - {m}"), at(f"minx + {m}", "(miny + maxy) / 2")]
    return synth.territories(spark, sf_dir).selectExpr("ord AS key", f"array({', '.join(corners)}) AS ring")


_M = _INSET.format(d="")


@query(
    f"""{layers('s', 't')}, {_NODED}, r AS (SELECT ord, 0 AS i, minx + {_M} AS x, miny + {_M} AS y FROM t UNION ALL SELECT ord, 1, maxx - {_M}, miny + {_M} FROM t UNION ALL SELECT ord, 2, maxx - {_M}, maxy - {_M} FROM t UNION ALL SELECT ord, 3, minx + {_M}, maxy - {_M} FROM t UNION ALL SELECT ord, 4, minx + {_M}, (miny + maxy) / 2 FROM t),
    a AS (SELECT ord, i, r.x, r.y, least(greatest(r.x, 19.9e0), 19.92e0) AS px, h.y / 1e5 AS py FROM r CROSS JOIN h UNION ALL SELECT ord, i, r.x, r.y, v.x / 1e5, least(greatest(r.y, 50e0), 50.02e0) FROM r CROSS JOIN v),
    d AS (SELECT *, sqrt(pow((px - x) * 111320e0 * cos(radians(y)), 2) + pow((py - y) * 110540e0, 2)) AS m FROM a),
    b AS (SELECT *, row_number() OVER (PARTITION BY ord, i ORDER BY m, px, py) AS k FROM d WHERE m <= 25),
    p AS (SELECT r.ord, r.i, coalesce(b.px, r.x) AS x, coalesce(b.py, r.y) AS y, b.px IS NOT NULL AS hit FROM r LEFT JOIN b ON b.ord = r.ord AND b.i = r.i AND b.k = 1),
    k AS (SELECT ax AS x, ay AS y FROM n UNION SELECT bx, by_ FROM n), e AS (SELECT p.ord, p.i, k.x || ',' || k.y AS node, sqrt({_D2.format(ax='p.x', ay='p.y', bx='(k.x / 1e5)', by='(k.y / 1e5)')}) AS m FROM p CROSS JOIN k WHERE p.hit),
    f AS (SELECT *, row_number() OVER (PARTITION BY ord, i ORDER BY m, node) AS q FROM e WHERE m <= 25)
    SELECT p.ord AS key, p.i, CAST(floor(p.x * 1e7 + 0.5e0) AS BIGINT) AS lng, CAST(floor(p.y * 1e7 + 0.5e0) AS BIGINT) AS lat, p.hit, f.node FROM p LEFT JOIN f ON f.ord = p.ord AND f.i = p.i AND f.q = 1"""
)
def ring_anchors(spark, sf_dir):
    """Vertices of drawn rings, on the nearest street within 25 m, and the nodes at which ways along streets begin."""
    at = lambda v: F.floor(c(v) * 1e7 + 0.5)
    return follow.anchors(_drawn_rings(spark, sf_dir), placed(spark, sf_dir)).select("key", "i", at("x").alias("lng"), at("y").alias("lat"), "hit", "node")


@query()
def followed_rings(spark, sf_dir):
    """Drawn rings led along the streets: points, vertices moved, edges that follow."""
    return follow.follow(_drawn_rings(spark, sf_dir), placed(spark, sf_dir)).select("key", F.size("ring").alias("points"), "moved", "routed")


@query(f"{layers('t')}, w AS (SELECT ord, 5 + ord % 4 AS w, 4 + ord % 3 AS h FROM t) SELECT ord, CAST(w * h - 1 AS BIGINT) AS cells, CAST(w + h - 1 AS BIGINT) AS steps, CAST(2 AS BIGINT) AS rings, CAST(5 AS BIGINT) AS corners, CAST(w * h AS BIGINT) AS outer_size, TRUE AS along, FALSE AS across, CAST(0 AS BIGINT) AS snapped, CAST(2 AS BIGINT) AS pulled, CAST(1 AS BIGINT) AS labels FROM w")
def raster_ways(spark, sf_dir):
    """Boards of cells with a hole: ways, sight lines, snapping, outlines and components."""

    def run(r):
        w, h = 5 + r.ord % 4, 4 + r.ord % 3
        cells = {(x, y) for x in range(w) for y in range(h)} - {(1, 1)}
        way = raster.route_cells(cells, (0, 0), (w - 1, h - 1))
        rings = sorted(raster.rings_of(cells), key=len, reverse=True)
        body = rings[0][:-1]
        bends = [p for k, p in enumerate(body) if (p[0] - body[k - 1][0]) * (body[(k + 1) % len(body)][1] - p[1]) != (p[1] - body[k - 1][1]) * (body[(k + 1) % len(body)][0] - p[0])]
        size = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(rings[0], rings[0][1:], strict=False))) // 2
        snapped = raster.snap(cells, (-2, 0))
        pulled = raster.pull(cells, raster.route_cells(cells, (0, 0), (w - 1, 0)))
        labels = raster.label_cells(cells)
        return [(r.ord, len(cells), len(way), len(rings), len(bends) + 1, size, raster.visible(cells, (0, 0), (w - 1, 0)), raster.visible(cells, (0, 1), (2, 1)), snapped[0] + snapped[1], len(pulled), len(set(labels.values())))]

    return boards.each(synth.territories(spark, sf_dir), run, "ord long, cells long, steps long, rings long, corners long, outer_size long, along boolean, across boolean, snapped long, pulled long, labels long")


@query(
    f"""{layers('t')}, p AS (SELECT ord, k.range AS k, (4 + ord % 5) * 2 AS n, 2.5e0 + ord % 3 AS r0, 0.5e0 + k.range / 2e0 AS x FROM t, range(40) k WHERE k.range <= (4 + ord % 5) * 2),
    q AS (SELECT *, greatest(1e0, r0 * (1 - 0.5e0 * (k / CAST(n AS DOUBLE)))) AS r FROM p), g AS (SELECT DISTINCT ord, i.range - 8 AS cx, j.range - 8 AS cy FROM q, range(40) i, range(18) j WHERE sqrt(pow(i.range - 8 + 0.5e0 - x, 2) + pow(j.range - 8 + 0.5e0 - 0.25e0, 2)) <= r)
    SELECT ord, CAST(count(*) AS BIGINT) AS cells, CAST(min(cx) AS BIGINT) AS west, CAST(max(cx) AS BIGINT) AS east, CAST(sum(cy) AS BIGINT) AS mark FROM g GROUP BY ord"""
)
def stamped_paths(spark, sf_dir):
    """Corridors that taper along a line, as cells."""

    def run(r):
        cells = raster.stamp_path([(0.5, 0.25), (0.5 + 4 + r.ord % 5, 0.25)], 2.5 + r.ord % 3, 0.5)
        return [(r.ord, len(cells), min(x for x, _ in cells), max(x for x, _ in cells), sum(y for _, y in cells))]

    return boards.each(synth.territories(spark, sf_dir), run, "ord long, cells long, west long, east long, mark long")


@query(f"{layers('b', 't')}, p AS (SELECT id, floor((x - 19.9e0) / 2e-4) AS cx, floor((y - 50e0) / 2e-4) AS cy FROM b) SELECT id, CAST(CASE WHEN EXISTS (SELECT 1 FROM t WHERE ord % 2 = 0 AND 19.9e0 + (cx + 0.5e0) * 2e-4 >= minx AND 19.9e0 + (cx + 0.5e0) * 2e-4 < maxx AND 50e0 + (cy + 0.5e0) * 2e-4 >= miny AND 50e0 + (cy + 0.5e0) * 2e-4 < maxy) THEN 1 ELSE 0 END AS BIGINT) AS value FROM p")
def mask_values(spark, sf_dir):
    """The value of a boundary's raster under each building; 0 off the raster."""
    from quiltwork.functions import ring

    t = synth.territories(spark, sf_dir).where("ord % 2 = 0")
    e = t.select("ord", F.explode(ring.edges(ring.box_ring(*map(c, ("minx", "miny", "maxx", "maxy"))))).alias("e")).select("ord", c("e.a.x").alias("ax"), c("e.a.y").alias("ay"), c("e.b.x").alias("bx"), c("e.b.y").alias("by"))
    mask = raster.fill_rings(e, "ord", 19.9, 50.0, 2e-4).select("cx", "cy").distinct().withColumn("value", F.lit(1).cast("long"))
    at = lambda v, o: F.floor((c(v) - o) / 2e-4)
    b = synth.buildings(spark, sf_dir).select("id", at("x", 19.9).alias("cx"), at("y", 50.0).alias("cy"))
    return b.join(mask, ["cx", "cy"], "left").select("id", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


@query(
    f"""WITH {_EV}, o AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, id) AS i FROM e), p AS (SELECT *, lag(i) OVER (PARTITION BY event_type, user_id ORDER BY i) AS before FROM o),
    d AS (SELECT p.event_type, p.i, count(DISTINCT o.user_id) AS k FROM p JOIN o ON o.event_type = p.event_type AND o.i > p.before AND o.i < p.i GROUP BY 1, 2),
    h AS (SELECT p.event_type, p.before IS NOT NULL AND coalesce(d.k, 0) < 64 AS hit FROM p LEFT JOIN d ON d.event_type = p.event_type AND d.i = p.i)
    SELECT event_type AS cache, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS hits, CAST(count(*) FILTER (WHERE NOT hit) AS BIGINT) AS misses FROM h GROUP BY 1""",
    name="lru_hits",
)
def lru_hits(spark, sf_dir):
    """Hits of an LRU cache of 64 users for each event type; a cache is one sequential state."""
    from quiltwork.operators import cache
    from quiltwork.plans.areas import _events

    return cache.lru_hits(_events(spark, sf_dir), "event_type", "user_id", 64)


# ---------------------------------------------------------------- stored state


def _folder(spark, name: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT 'K' || c_custkey % 10 AS key, CASE WHEN c_custkey % 10 IN (3, 4) THEN NULL WHEN c_custkey % 10 = 5 THEN 'new' ELSE max(c_name) END AS value FROM customer GROUP BY c_custkey % 10")
def key_values(spark, sf_dir):
    """A table of keys and values: set, set anew, removed, read; a missing key has no value."""
    kv = store.Store(spark, _folder(spark, "kv"))
    rows = synth.read(spark, sf_dir, "customer").select(F.concat(F.lit("K"), (c("c_custkey") % 10).cast("string")).alias("key"), c("c_name").alias("value"))
    kv.put(rows)
    kv.put(spark.createDataFrame([("K5", "new")], "key string, value string"))
    kv.remove(spark.createDataFrame([("K3",), ("K4",), ("K99",)], "key string"))
    return kv.get(rows)


@query(f"{layers('t', 'b')} SELECT 3 AS version, (SELECT CAST(count(*) AS BIGINT) FROM t WHERE ord < 20) AS territories, (SELECT CAST(count(*) AS BIGINT) FROM b) AS data, TRUE AS refused")
def session_roundtrip(spark, sf_dir):
    """A session saved twice, the second time without its data, and restored; one of another version is refused."""
    path, t, b = _folder(spark, "session"), synth.territories(spark, sf_dir), synth.buildings(spark, sf_dir).select("id", "x", "y")
    store.save_session(path, CONFIG.payload_version, t, b)
    store.save_session(path, CONFIG.payload_version, t.where("ord < 20"), b.limit(0), dirty=False)
    territories, data = store.restore_session(spark, path)
    old = _folder(spark, "session")
    store.save_session(old, 1, t, b.limit(0))
    refused = store.restore_session(spark, old) is None
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(territories, "territories").join(F.broadcast(count(data, "data")), F.lit(True)).select(F.lit(CONFIG.payload_version).alias("version"), "territories", "data", F.lit(refused).alias("refused"))


@query("SELECT * FROM (VALUES ('undone', CAST(10 AS BIGINT)), ('undone twice', 5), ('redone', 10), ('pushed', 20), ('no redo', 20)) v(state, territories)")
def undo_redo(spark, sf_dir):
    """Snapshots of a board, walked back and forth; a new one drops what could be redone."""
    log, t = history.History(spark, _folder(spark, "history")), synth.territories(spark, sf_dir)
    for n in (5, 10, 15):
        log.push(t.where(c("ord") < n))
    out = None

    def note(state: str) -> None:
        nonlocal out
        row = log.current().agg(F.count(F.lit(1)).alias("territories")).select(F.lit(state).alias("state"), "territories")
        out = row if out is None else out.union(row)

    log.undo()
    note("undone")
    log.undo()
    note("undone twice")
    log.redo()
    note("redone")
    log.push(t.where("ord < 20"))
    note("pushed")
    log.redo()
    note("no redo")
    return out


@query(f"{layers('t')} SELECT ord // 5 AS card, CAST(count(*) AS BIGINT) AS territories, CAST(min(ord) AS BIGINT) AS first, CAST(0 AS BIGINT) AS data FROM t WHERE ord // 5 <> 3 GROUP BY 1")
def card_attachments(spark, sf_dir):
    """Territories attached to cards as gzipped payloads, without map data, and extracted again; a broken one gives nothing."""
    t = synth.territories(spark, sf_dir)
    features = payload.build(t, synth.streets(spark, sf_dir), synth.buildings(spark, sf_dir), partial=True)
    features = features.withColumn("card", F.expr("CAST(get_json_object(value, '$.ord') AS BIGINT) DIV 5"))
    cards = store.attach(features, "card").withColumn("blob", F.when(c("card") == 3, F.lit(b"no gzip")).otherwise(c("blob")))
    back = store.extract(cards, "card")
    return back.groupBy("card").agg(F.count_if(c("layer") == "clusters").alias("territories"), F.min("ord").alias("first"), F.count_if(c("layer") != "clusters").alias("data"))

