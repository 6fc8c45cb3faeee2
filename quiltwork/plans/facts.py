"""Facts about features, views, templates and settings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quiltwork.functions import facts, labels, mercator, ring, tags
from quiltwork.operators import spatial_join as sj
from quiltwork.plans.registry import layers, query
from quiltwork.plans.spatial import _D2, first_territory
from quiltwork.sources import history, synth
from quiltwork.sources import layers as osm

SIDE = 0.004
c = F.col


def _t(spark, sf_dir):
    return synth.territories(spark, sf_dir)


def _ring():
    return ring.box_ring(*map(F.col, ("minx", "miny", "maxx", "maxy")))


# ---------------------------------------------------------------- sources


@query("SELECT p_partkey AS osmid, trim(p_type) AS building, CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS levels FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 1")
def building_layer(spark, sf_dir):
    """Areas with a building tag, cleaned, with the first id that is present."""
    areas = synth.read(spark, sf_dir, "part").selectExpr(
        "CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS id", "p_partkey AS element_id", "CASE WHEN p_partkey % 3 <> 0 THEN concat(' ', p_type) END AS building",
        "CASE WHEN p_size % 4 = 0 THEN 'nan' ELSE CAST(p_size AS STRING) END AS `building:levels`", "CASE WHEN p_partkey % 5 = 1 THEN 'LineString' ELSE 'Polygon' END AS geom_type", "p_brand AS unknown",
    )
    p = osm.buildings(areas).select("props")
    return p.select(c("props")["osmid"].cast("long").alias("osmid"), c("props")["building"].alias("building"), c("props")["building:levels"].alias("levels"))


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/webp' ELSE 'image/png' END AS kind, sha1('https://tiles/' || p_brand) AS root, p_partkey % 2 = 0 AS own FROM part")
def tile_facts(spark, sf_dir):
    """Kinds of tiles by their first bytes, the folder of their store, and whether a path lies in it."""
    p = synth.read(spark, sf_dir, "part")
    data = F.when(c("p_partkey") % 3 == 0, F.unhex(F.lit("FFD8FFE0"))).when(c("p_partkey") % 3 == 1, F.unhex(F.lit("524946460000000057454250"))).otherwise(F.unhex(F.lit("89504E470D0A1A0A")))
    root = facts.store_root(F.concat(F.lit("https://tiles/"), c("p_brand")))
    path = F.concat(F.when(c("p_partkey") % 2 == 0, root).otherwise(F.lit("other")), F.lit("/12/3/4.png"))
    return p.select(c("p_partkey").alias("id"), osm.mime_type(data).alias("kind"), root.alias("root"), facts.in_store(path, root).alias("own"))


@query("SELECT c_custkey AS id, c_custkey % 3 > 0 AND c_custkey % 7 <> 0 AS wanted, CASE WHEN c_custkey % 4 = 0 THEN c_custkey * 1e0 WHEN c_custkey % 4 = 1 THEN CAST(c_custkey % 90 AS DOUBLE) END AS west, CAST(CASE WHEN c_custkey % 3 > 0 AND c_custkey % 7 <> 0 THEN 1 + c_custkey % 3 END AS BIGINT) AS parts FROM customer")
def boundary_lookup(spark, sf_dir):
    """Objects that may have an outline, looked up in a cached table; their bounds from the outline, else from text."""
    k = c("c_custkey")
    rows = synth.read(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 3 == 0, "node").when(k % 3 == 1, "way").otherwise("relation").alias("kind"), F.when(k % 7 != 0, k).alias("osm_id"),
        F.when(k % 4 == 1, F.array(F.lit("1"), F.lit("2"), (k % 90).cast("string"), F.lit("4"))).when(k % 4 == 2, F.array(F.lit("1"), F.lit("?"), F.lit("3"), F.lit("4"))).alias("given"),
    )
    outlines = synth.read(spark, sf_dir, "customer").select(k.alias("osm_id"), (1 + k % 3).alias("parts"))
    own = F.when(c("id") % 4 == 0, F.struct(c("id").cast("double").alias("minx"), F.lit(0.0).alias("miny"), F.lit(1.0).alias("maxx"), F.lit(1.0).alias("maxy")))
    rows = rows.withColumn("wanted", facts.may_have_outline(c("kind"), c("osm_id")))
    found = rows.join(outlines, F.when(c("wanted"), rows["osm_id"]) == outlines["osm_id"], "left")
    return found.select("id", "wanted", facts.bounds_of(own, c("given"))["minx"].alias("west"), c("parts").cast("long").alias("parts"))


@query("SELECT * FROM (VALUES ('osm', 'Map', CAST(19 AS INTEGER), '/tiles/osm/{z}/{x}/{y}.png'), ('sat', 'Photo', 18, '/tiles/sat/{z}/{x}/{y}.png')) v(layer, label, max_zoom, path)")
def basemap_layers(spark, sf_dir):
    """Descriptions of the map layers for clients: own paths, never the addresses that they come from."""
    table = spark.createDataFrame([("osm", "Map", 19, "https://upstream/osm", True), ("sat", "Photo", 18, "https://upstream/sat", True), ("old", "Old", 10, "https://upstream/old", False)], "layer string, label string, max_zoom int, upstream string, listed boolean")
    return table.where("listed").select("layer", "label", "max_zoom", F.format_string("/tiles/%s/{z}/{x}/{y}.png", "layer").alias("path"))


@query("SELECT lang, '/' || CASE WHEN lang = 'en' THEN '' ELSE lang || '/' END AS path FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)")
def language_addresses(spark, sf_dir):
    """The path of each language; the first language has the root."""
    d = synth.read(spark, sf_dir, "documents").where("lang IS NOT NULL").select("lang").distinct()
    return d.select("lang", F.concat(F.lit("/"), F.when(c("lang") == "en", "").otherwise(F.concat("lang", F.lit("/")))).alias("path"))


# ---------------------------------------------------------------- texts


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Service road' WHEN 1 THEN 'Yes / Residential area' WHEN 2 THEN NULL ELSE 'Track' END AS tag, TRUE AS grouped, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'none' END AS from_json, trim(p_type || ', ' || p_brand || ', x') AS short FROM part""")
def text_facts(spark, sf_dir):
    """Labels of tag values, numbers in groups, a field of a JSON text or its fallback, and short names."""
    k = c("p_partkey")
    raw = F.when(k % 4 == 0, "service_road").when(k % 4 == 1, "yes;residential_area").when(k % 4 == 3, "track")
    text = F.when(k % 3 == 0, F.to_json(F.struct(c("p_name").alias("name")))).otherwise(F.lit("{broken"))
    return synth.read(spark, sf_dir, "part").select(
        k.alias("id"), tags.label(raw).alias("tag"), facts.number_text(k * 7919, " ").isNotNull().alias("grouped"), facts.json_or(text, "name", F.lit("none")).alias("from_json"),
        tags.short_name(F.concat_ws(",", "p_type", F.concat(F.lit(" "), "p_brand"), F.lit(" x"), F.lit("left out"))).alias("short"),
    )


@query("SELECT c_custkey AS id, format('{:,}', c_custkey * 104729) AS grouped, replace(format('{:,}', c_custkey * 104729), ',', ' ') AS spaced FROM customer")
def number_texts(spark, sf_dir):
    """Numbers as languages write them."""
    n = c("c_custkey") * 104729
    return synth.read(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), facts.number_text(n, ",").alias("grouped"), facts.number_text(n, " ").alias("spaced"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN substr(sha256(o_orderstatus), 1, 16) ELSE regexp_replace('card ' || o_orderkey || '.pdf:' || o_custkey || ':7', '[^A-Za-z0-9:._-]', '_', 'g') END AS template, o_orderkey % 5 = 0 OR o_orderkey % 3 = 2 AS is_current FROM orders")
def template_facts(spark, sf_dir):
    """Names of templates by content or by file, and whether a stored layout still holds."""
    k = c("o_orderkey")
    content = F.when(k % 2 == 0, c("o_orderstatus").cast("binary"))
    name = F.concat(F.lit("card "), k.cast("string"), F.lit(".pdf"))
    return synth.read(spark, sf_dir, "orders").select(k.alias("id"), facts.template_id(name, c("o_custkey"), F.lit(7), content).alias("template"), facts.layout_is_current(k % 3, k % 5 == 0, 2).alias("is_current"))


@query(f"{layers('t')} SELECT ord, CASE WHEN ord < 9 THEN [CAST(ord + 1 AS VARCHAR), '0' || CAST(ord + 1 AS VARCHAR), name || ' ' || CAST(ord + 1 AS VARCHAR)] ELSE [CAST(ord + 1 AS VARCHAR), name || ' ' || CAST(ord + 1 AS VARCHAR)] END[-1] AS longest, CAST(CASE WHEN ord < 9 THEN 3 ELSE 2 END AS BIGINT) AS names, (SELECT max(ord) + 1 FROM t) AS next_key FROM t")
def territory_names(spark, sf_dir):
    """Names that a territory could have, and the next free key."""
    t = _t(spark, sf_dir).withColumn("names", facts.territory_names(c("ord") + 1, c("name")))
    top = _t(spark, sf_dir).agg((F.max("ord") + 1).alias("next_key"))
    return t.select("ord", F.element_at("names", -1).alias("longest"), F.size("names").cast("long").alias("names")).join(F.broadcast(top), F.lit(True))


# ---------------------------------------------------------------- pools, selections, marks


@query(f"""{layers('b', 't', 'f')}, k AS (SELECT b.id, CASE WHEN b.id % 3 = 0 THEN 'ix:' || b.id ELSE 'osm:' || (b.id * 10) END AS key, (f.maxx - f.minx) * 111320e0 * cos(radians((f.miny + f.maxy) / 2)) > 16 OR (f.maxy - f.miny) * 110540e0 > 16 AS big,
  b.x < 19.905e0 AS ranged, floor(greatest(1e0, (f.maxx - f.minx) * (f.maxy - f.miny) * 7.9e9 * 0.02e0) * 100 + 0.5e0) AS floor_cm2 FROM b JOIN f ON f.id = b.id WHERE b.x >= 19.902e0 AND b.x < 19.918e0 AND b.y >= 50.002e0 AND b.y < 50.018e0)
  SELECT id, key, big, ranged OR id % 4 = 0 AS ignored, CAST(floor_cm2 AS BIGINT) AS claim FROM k""")
def trim_pool(spark, sf_dir):
    """Buildings inside a boundary: keys, large ones, those that a rectangle adds to the ignored ones, and claim floors."""
    outer = spark.createDataFrame([(19.902, 50.002, 19.918, 50.018)], "minx double, miny double, maxx double, maxy double")
    inside = sj.points_in_boxes(synth.buildings(spark, sf_dir).select("id", "x", "y"), outer, SIDE).select("id", "x")
    f = synth.footprints(spark, sf_dir).join(inside, "id")
    key = facts.pool_key(F.when(c("id") % 3 != 0, c("id") * 10), c("id"))
    area = (c("maxx") - c("minx")) * (c("maxy") - c("miny")) * 7.9e9
    return f.select("id", key.alias("key"), facts.is_big(*map(c, ("minx", "miny", "maxx", "maxy")), 8.0).alias("big"), ((c("x") < 19.905) | (c("id") % 4 == 0)).alias("ignored"), F.floor(facts.claim_floor(area) * 100 + 0.5).alias("claim"))


@query("SELECT p AS printed_axis, q AS flag_axis, p <= 0 AND q >= 0 AS shown FROM (SELECT unnest([-1, 0, 1])::BIGINT AS p) CROSS JOIN (SELECT unnest([-1, 0, 1])::BIGINT AS q)")
def gap_filters(spark, sf_dir):
    """Settings of the two filters under which gaps are shown."""
    states = F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)])
    rows = spark.range(1).select(F.explode(states).alias("printed_axis")).withColumn("flag_axis", F.explode(states))
    return rows.withColumn("shown", facts.gap_matches(c("printed_axis"), c("flag_axis")))


@query("SELECT CAST(1 AS BIGINT) AS step, CAST(sum(CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS ignored FROM customer UNION ALL SELECT 2, CAST(sum(CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) FROM customer UNION ALL SELECT 3, 0 FROM range(1) UNION ALL SELECT 4, CAST(sum(CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) FROM customer UNION ALL SELECT 5, CAST(sum(CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) FROM customer")
def selection_undo(spark, sf_dir):
    """Snapshots of a selection: found, widened by hand, cleared, and restored step by step."""
    ids = synth.read(spark, sf_dir, "customer").select(c("c_custkey").alias("id"))
    shots = F.array(F.struct(F.lit(1).cast("long").alias("step"), (c("id") % 5 == 0).alias("on")), F.struct(F.lit(2).cast("long").alias("step"), ((c("id") % 5 == 0) | (c("id") % 7 == 0)).alias("on")), F.struct(F.lit(3).cast("long").alias("step"), F.lit(False).alias("on")))
    rows = ids.select("id", F.explode(shots).alias("s")).select("id", "s.step", "s.on")
    # an undo shows the snapshot before: step 4 is step 2 again, step 5 is step 1
    again = rows.where("step < 3").withColumn("step", 6 - c("step"))
    return rows.unionByName(again).groupBy("step").agg(F.count_if("on").alias("ignored"))


@query(f"{layers('t')}, m AS (SELECT ord, ord % 2 = 0 AS printed, ord % 3 = 0 AS moved FROM t) SELECT ord, printed AND NOT moved AS carried, CASE WHEN ord % 5 = 1 THEN TRUE ELSE printed AND NOT moved END AS marked, FALSE AS cleared, (SELECT CAST(count(*) FILTER (WHERE CASE WHEN ord % 5 = 1 THEN TRUE ELSE printed AND NOT moved END) AS BIGINT) FROM m) AS reset FROM m")
def mark_updates(spark, sf_dir):
    """Marks carried over a change of shapes, set by hand, and cleared; how many were reset."""
    before = _t(spark, sf_dir).select("ord", _ring().alias("ring"), (c("ord") % 2 == 0).alias("printed"))
    after = _t(spark, sf_dir).withColumn("maxx", c("maxx") + F.when(c("ord") % 3 == 0, 1e-4).otherwise(0.0)).select("ord", _ring().alias("ring"))
    carried = history.carry(before, after).withColumn("carried", F.coalesce("printed", F.lit(False)))
    marks = _t(spark, sf_dir).where("ord % 5 = 1").select("ord", F.lit(True).alias("printed"))
    marked = history.mark_printed(carried.select("ord", "carried", c("carried").alias("printed")), marks).withColumnRenamed("printed", "marked")
    reset = marked.agg(F.count_if("marked").alias("reset"))
    return marked.select("ord", "carried", "marked", F.lit(False).alias("cleared")).join(F.broadcast(reset), F.lit(True))


@query(f"{layers('t')} SELECT 'board' AS source, CAST(count(*) AS BIGINT) AS slots FROM t UNION ALL SELECT 'empty', 1")
def default_territory(spark, sf_dir):
    """A board without territories gets the whole area as one; others are left alone."""
    t = _t(spark, sf_dir).select("ord", "minx")
    outer = spark.createDataFrame([(0, 19.9)], "ord long, minx double")
    count = lambda name, b: history.with_default(b, outer).agg(F.count(F.lit(1)).alias("slots")).select(F.lit(name).alias("source"), "slots")
    return count("board", t).union(count("empty", t.where("ord < 0")))


@query(f"{layers('b', 's', 't')} SELECT (SELECT CAST(count(*) AS BIGINT) FROM s) AS streets, (SELECT CAST(count(*) AS BIGINT) FROM b) AS buildings, (SELECT CAST(count(*) AS BIGINT) FROM t) AS territories, (SELECT CAST(count(*) AS BIGINT) FROM t WHERE ord % 3 = 0) AS printed")
def info_row(spark, sf_dir):
    """The summary row of a project."""
    one = lambda df, name, cond=None: df.agg((F.count(F.lit(1)) if cond is None else F.count_if(cond)).alias(name))
    t = _t(spark, sf_dir).agg(F.count(F.lit(1)).alias("territories"), F.count_if(c("ord") % 3 == 0).alias("printed"))
    return one(synth.streets(spark, sf_dir), "streets").join(F.broadcast(one(synth.buildings(spark, sf_dir), "buildings")), F.lit(True)).join(F.broadcast(t), F.lit(True))


# ---------------------------------------------------------------- geometry


@query(f"{layers('b')} SELECT id, CAST(3 AS BIGINT) AS kept, CAST(floor(floor(x * 1e7 + 0.5e0) / 1e7 * 1e7 + 0.5e0) AS BIGINT) AS x7, floor(x * 1e5 + 0.5e0) / 1e5 AS x5, TRUE AS same, FALSE AS other FROM b")
def coordinate_cleanup(spark, sf_dir):
    """Lines without repeats, rounded coordinates, and equality with a tolerance."""
    p = lambda dx, dy: F.struct((c("x") + dx).alias("x"), (c("y") + dy).alias("y"))
    line = F.array(p(0.0, 0.0), p(1e-7, 0.0), p(1e-3, 0.0), p(1e-3, 1e-7), p(2e-3, 0.0))
    return synth.buildings(spark, sf_dir).select(
        "id", F.size(ring.dedup(line, 1e-6)).cast("long").alias("kept"), F.floor(facts.rounded(c("x"), 7) * 1e7 + 0.5).alias("x7"), facts.rounded(c("x"), 0).alias("x5"),
        facts.same_place(c("x"), c("y"), c("x") + 1e-10, c("y")).alias("same"), facts.same_place(c("x"), c("y"), c("x") + 1e-8, c("y")).alias("other"),
    )


@query(f"{layers('t')} SELECT ord, minx < 19.9e0 - 1e-6 OR miny < 50.002e0 - 1e-6 OR maxx > 19.916e0 + 1e-6 OR maxy > 50.03e0 + 1e-6 AS grew, ord % 5 > 0 AS inside, TRUE AS on_edge, FALSE AS off_edge, CAST(floor((maxx - minx) * 111320e0 * cos(radians(miny)) * 10 + (maxy - miny) * 110540e0 * 10 + 0.5e0) AS BIGINT) AS dm, CAST(4 AS BIGINT) AS corners FROM t")
def ring_predicates(spark, sf_dir):
    """Boxes beyond the data, vertices in another shape, points on a ring, and the length of a line."""
    t = _t(spark, sf_dir).withColumn("ring", _ring())
    big = ring.box_ring(F.lit(19.9035), F.lit(49.0), F.lit(21.0), F.lit(51.0))
    body = F.slice("ring", 1, 4)
    inside = F.exists(F.filter(body, lambda p: p["x"] > 19.9041), lambda p: ring.contains(big, p["x"], p["y"]))
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    line = F.array(p(c("minx"), c("miny")), p(c("maxx"), c("miny")), p(c("maxx"), c("maxy")))
    return t.select(
        "ord", facts.grew_beyond(*map(c, ("minx", "miny", "maxx", "maxy")), (19.9, 50.002, 19.916, 50.03)).alias("grew"), inside.alias("inside"),
        facts.near_ring(c("ring"), (c("minx") + c("maxx")) / 2, c("miny") - 4e-5, 5e-5).alias("on_edge"), facts.near_ring(c("ring"), (c("minx") + c("maxx")) / 2, c("miny") - 6e-5, 5e-5).alias("off_edge"),
        F.floor(facts.path_length(line) * 10 + 0.5).alias("dm"), F.size(body).cast("long").alias("corners"),
    )


@query(f"{layers('b', 't')}, m AS (SELECT b.id, min(ord) AS ord FROM b JOIN t ON x >= minx AND x < maxx AND y >= miny AND y < maxy AND ord % 2 = 0 GROUP BY b.id), n AS (SELECT b.id, ord, row_number() OVER (PARTITION BY b.id ORDER BY sqrt({_D2.format(ax='x', ay='y', bx='(minx + maxx) / 2', by='(miny + maxy) / 2')}), ord) AS k FROM b JOIN t ON ord % 2 = 0) SELECT b.id, coalesce(m.ord, n.ord) AS owner, m.ord IS NULL AS fallback FROM b JOIN n ON n.id = b.id AND k = 1 LEFT JOIN m ON m.id = b.id")
def piece_owners(spark, sf_dir):
    """Each piece goes to the cell that holds it, else to the nearest centre; a cell is one of at most 200."""
    from quiltwork.functions import metric

    b, t = synth.buildings(spark, sf_dir).select("id", "x", "y"), _t(spark, sf_dir).where("ord % 2 = 0")
    held = sj.points_in_boxes(b, t, SIDE).groupBy("id").agg(F.min("ord").alias("ord"))
    centres = t.select("ord", ((c("minx") + c("maxx")) / 2).alias("x"), ((c("miny") + c("maxy")) / 2).alias("y"))
    lost = b.join(held, "id", "left_anti")
    near = sj.nearest(lost, centres, "id", "ord", metric.dist, SIDE)
    return held.select("id", c("ord").alias("owner"), F.lit(False).alias("fallback")).union(near.select("id", "target", F.lit(True)))


@query(f"{layers('b')}, p AS (SELECT id, (id % 2000) * 1e0 AS u, (id % 1700) * 1e0 AS v FROM b) SELECT id, CAST(floor((floor((19.9e0 + (u * cos(radians(12e0)) - v * sin(radians(12e0))) / (111320e0 * cos(radians(50e0)))) * 1e6 + 0.5e0) / 1e6) * 1e6 + 0.5e0) AS BIGINT) AS lng, CAST(floor((floor((50e0 + (u * sin(radians(12e0)) + v * cos(radians(12e0))) / 110540e0) * 1e6 + 0.5e0) / 1e6) * 1e6 + 0.5e0) AS BIGINT) AS lat, CAST(floor(u * v * 75 + 0.5e0) AS BIGINT) AS notch, CAST(7 AS BIGINT) AS vertices FROM p")
def local_metres(spark, sf_dir):
    """Local metres on a turned grid as places, and boxes without a quarter."""
    u, v = (c("id") % 2000).cast("double"), (c("id") % 1700).cast("double")
    x, y = facts.rotated(u, v, 12.0, 19.9, 50.0)
    shape = facts.notched(F.lit(0.0), F.lit(0.0), u, v)
    return synth.buildings(spark, sf_dir).select("id", F.floor(x * 1e6 + 0.5).alias("lng"), F.floor(y * 1e6 + 0.5).alias("lat"), F.floor(F.abs(ring.signed_area(shape)) * 100 + 0.5).alias("notch"), F.size(shape).cast("long").alias("vertices"))


# ---------------------------------------------------------------- a sample village


def village_streets(spark):
    """id, name, ax, ay, bx, by in metres: four avenues, five streets across and a farm track."""
    rows = spark.range(10)
    k = c("id")
    return rows.select(
        "id", F.when(k < 4, F.format_string("Avenue %d", k + 1)).when(k < 9, F.format_string("Street %d", k - 3)).otherwise("Farm track").alias("name"),
        F.when(k < 4, 0.0).when(k < 9, (k - 4) * 200.0).otherwise(800.0).alias("ax"), F.when(k < 4, k * 150.0).when(k < 9, 0.0).otherwise(225.0).alias("ay"),
        F.when(k < 4, 800.0).when(k < 9, (k - 4) * 200.0).otherwise(1400.0).alias("bx"), F.when(k < 4, k * 150.0).when(k < 9, 450.0).otherwise(225.0).alias("by"),
    )


def village_buildings(spark):
    """street, number, x, y in metres: houses on both sides of the avenues, odd and even, none near a junction; farms on the track."""
    lots = spark.range(4).select(c("id").alias("street")).withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(31)))).withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    x = c("lot") * 25.0 + 12.5
    junction = F.exists(F.array(*[F.lit(200.0 * j) for j in range(5)]), lambda j: F.abs(x - j) < 30)
    houses = lots.where(~junction).select("street", (c("lot") * 2 + F.when(c("side") > 0, 2).otherwise(1)).cast("long").alias("number"), x.alias("x"), (c("street") * 150.0 + c("side") * 15.0).alias("y"))
    farms = spark.range(3).select(F.lit(9).cast("long").alias("street"), (c("id") + 1).alias("number"), (c("id") * 200.0 + 950).alias("x"), F.lit(250.0).alias("y"))
    return houses.union(farms)


def village_territories(spark):
    """ord and box in metres: five territories that tile the village; the last one holds the farms."""
    k = c("id")
    return spark.range(5).select(k.alias("ord"), F.when(k < 4, k % 2 * 400.0).otherwise(800.0).alias("minx"), F.when(k < 4, F.floor(k / 2) * 225.0).otherwise(0.0).alias("miny"), F.when(k < 4, k % 2 * 400.0 + 400).otherwise(1400.0).alias("maxx"), F.when(k < 4, F.floor(k / 2) * 225.0 + 225).otherwise(450.0).alias("maxy"))


@query("""WITH h AS (SELECT s.range AS street, l.range * 25e0 + 12.5e0 AS x, l.range AS lot, d.d FROM range(4) s, range(32) l, (SELECT unnest([-1, 1]) AS d) d), k AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM range(5) j WHERE abs(x - j.range * 200e0) < 30)),
  b AS (SELECT street, lot * 2 + CASE WHEN d > 0 THEN 2 ELSE 1 END AS number, x, street * 150e0 + d * 15e0 AS y FROM k UNION ALL SELECT 9, range + 1, range * 200e0 + 950, 250e0 FROM range(3)),
  t AS (SELECT range AS ord, CASE WHEN range < 4 THEN range % 2 * 400e0 ELSE 800e0 END AS minx, CASE WHEN range < 4 THEN range // 2 * 225e0 ELSE 0e0 END AS miny, CASE WHEN range < 4 THEN range % 2 * 400e0 + 400 ELSE 1400e0 END AS maxx, CASE WHEN range < 4 THEN range // 2 * 225e0 + 225 ELSE 450e0 END AS maxy FROM range(5))
  SELECT t.ord, CAST(count(b.street) AS BIGINT) AS buildings, CAST(sum(number) AS BIGINT) AS numbers, CAST(max(maxx) AS BIGINT) AS east, CAST(10 AS BIGINT) AS streets FROM t LEFT JOIN b ON x >= minx AND x < maxx AND y >= miny AND y < maxy GROUP BY t.ord""")
def sample_village(spark, sf_dir):
    """A made-up village: streets, houses with numbers, farms, and five territories."""
    t = village_territories(spark)
    held = sj.points_in_boxes(village_buildings(spark), t, 200.0).groupBy("ord").agg(F.count(F.lit(1)).alias("buildings"), F.sum("number").alias("numbers"))
    streets = village_streets(spark).agg(F.count(F.lit(1)).alias("streets"))
    return t.select("ord", c("maxx").cast("long").alias("east")).join(held, "ord", "left").select("ord", F.coalesce("buildings", F.lit(0)).cast("long").alias("buildings"), "numbers", "east").join(F.broadcast(streets), F.lit(True))


# ---------------------------------------------------------------- pages and pixels


@query("""WITH m AS (SELECT p_partkey AS id, p_size * 1e0 AS s, (p_partkey % 40) * 1e0 AS x, (p_partkey % 30) * 1e0 AS y FROM part)
  SELECT id, CAST(floor((x * 2 + 5) * 10 + 0.5e0) AS BIGINT) AS left, CAST(floor((-(y + s) * 2 + 7) * 10 + 0.5e0) AS BIGINT) AS low, CAST(floor(20 * 2 * 10 + 0.5e0) AS BIGINT) AS width, CAST(floor(s * 2 * 10 + 0.5e0) AS BIGINT) AS height, x * 2 + 5 <= 50 AND 50 <= x * 2 + 45 AND -(y + s) * 2 + 7 <= -20 AND -20 <= -y * 2 + 7 AS holds FROM m""")
def page_rectangles(spark, sf_dir):
    """Rectangles through two transforms, and whether they hold a mark."""
    k = c("p_partkey")
    num = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    m = facts.affine(num(2, 0, 0, 2, 5, 7), num(1, 0, 0, -1, 0, 0))
    b = facts.affine_box(m, (k % 40).cast("double"), (k % 30).cast("double"), F.lit(20.0), c("p_size").cast("double"))
    rows = synth.read(spark, sf_dir, "part").select(k.alias("id"), b.alias("b"))
    ten = lambda f: F.floor(c(f"b.{f}") * 10 + 0.5)
    return rows.select("id", ten("x").alias("left"), ten("y").alias("low"), ten("w").alias("width"), ten("h").alias("height"), facts.holds_all(c("b"), F.array(F.struct(F.lit(50.0).alias("x"), F.lit(-20.0).alias("y")))).alias("holds"))


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 256 AS r, p_partkey * 7 % 256 AS g, p_partkey * 13 % 256 AS b FROM part), s AS (SELECT *, least(255, greatest(0, floor(r * 3e0 - (g + b + g + b) * 0.5e0 + 0.5e0))) AS sharp FROM p), q AS (SELECT *, r / 255e0 * 2 AS u FROM s)
  SELECT id, CAST(least(255, floor(r * 0.2126e0 + g * 0.7152e0 + b * 0.0722e0 + 0.5e0)) AS BIGINT) AS grey, CAST(sharp AS BIGINT) AS sharp, CAST(least(255, greatest(0, floor(CASE WHEN u < 1 THEN u * 0.25e0 ELSE 0.25e0 + 0.75e0 * (u - 1) END * 255 + 0.5e0))) AS BIGINT) AS curved FROM q""")
def pixel_filters(spark, sf_dir):
    """Grey values, sharpened ones and those of a contrast curve."""
    k = c("p_partkey")
    r, g, b = k % 256, k * 7 % 256, k * 13 % 256
    return synth.read(spark, sf_dir, "part").select(k.alias("id"), facts.luma(r, g, b).cast("long").alias("grey"), facts.sharpen(r, g, b, g, b, 0.5).cast("long").alias("sharp"), facts.curve(r, [0.0, 0.25, 1.0]).cast("long").alias("curved"))


@query("SELECT p_partkey AS id, CAST(CASE WHEN abs(d - floor(d / 15 + 0.5e0) * 15) <= 3 THEN floor(d / 15 + 0.5e0) * 15 ELSE d END AS BIGINT) AS turned, s * 0.5e0 < 24 AS tiny, greatest(2e0, least(40e0, s * 0.7e0)) AS radius, greatest(0e0, least(12e0, s - 15)) AS detail FROM (SELECT p_partkey, (p_partkey % 360) * 1e0 AS d, p_size * 2e0 AS s FROM part)")
def view_facts(spark, sf_dir):
    """Rotations pulled to round angles, tiny spans, snap radii and the detail of an outline."""
    s = c("p_size") * 2.0
    return synth.read(spark, sf_dir, "part").select(c("p_partkey").alias("id"), facts.snap_rotation((c("p_partkey") % 360).cast("double")).cast("long").alias("turned"), facts.is_tiny(s * 0.5).alias("tiny"), facts.snap_radius(s, F.lit(0.7)).alias("radius"), facts.detail(s, F.lit(12.0)).alias("detail"))


@query(f"""{layers('t')}, v AS (SELECT ord, CAST(floor(((minx + maxx) / 2 / 360e0 + 0.5e0) * 65536e0) AS BIGINT) AS tx, CAST(floor((0.5e0 - ln((1e0 + sin(radians((miny + maxy) / 2))) / (1e0 - sin(radians((miny + maxy) / 2)))) / (4e0 * pi())) * 65536e0) AS BIGINT) AS ty FROM t),
  w AS (SELECT DISTINCT tx + i.range - 2 AS tx, ty + j.range - 2 AS ty FROM v, range(5) i, range(5) j), k AS (SELECT *, row_number() OVER (ORDER BY tx, ty) AS n FROM w)
  SELECT CAST(count(*) AS BIGINT) AS wanted, CAST(count(*) FILTER (WHERE (tx + ty) % 3 <> 0) AS BIGINT) AS pending FROM k WHERE n <= 900""")
def prefetch(spark, sf_dir):
    """Tiles around the views with a margin of two, at most 900 of them (the feature's limit), and those not done yet."""
    x, y = mercator.project((c("minx") + c("maxx")) / 2, (c("miny") + c("maxy")) / 2, F.lit(16.0))
    margin = F.sequence(F.lit(-2), F.lit(2))
    v = _t(spark, sf_dir).select(F.floor(x / 256).alias("x0"), F.floor(y / 256).alias("y0"))
    wanted = v.withColumn("i", F.explode(margin)).withColumn("j", F.explode(margin)).select((c("x0") + c("i")).alias("tx"), (c("y0") + c("j")).alias("ty")).distinct().orderBy("tx", "ty").limit(900)
    return wanted.agg(F.count(F.lit(1)).alias("wanted"), F.count_if((c("tx") + c("ty")) % 3 != 0).alias("pending"))


@query("""WITH r AS (SELECT user_id, event_type, max(ts) AS last FROM events GROUP BY 1, 2), a AS (SELECT user_id, event_type AS name, 1 AS source, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, event_type) AS pos FROM r UNION ALL SELECT DISTINCT user_id, 'view', 0, 0 FROM events UNION ALL SELECT DISTINCT user_id, 'u' || user_id, 2, 0 FROM events),
  f AS (SELECT user_id, name, min(source * 100 + pos) AS rank FROM a GROUP BY 1, 2) SELECT user_id, string_agg(name, '|' ORDER BY rank) AS names FROM f GROUP BY user_id""")
def suggested_names(spark, sf_dir):
    """Names to suggest: found ones, recent ones, then that of the place; each once, at its best rank."""
    e = synth.read(spark, sf_dir, "events")
    r = e.groupBy("user_id", "event_type").agg(F.max("ts").alias("last"))
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last"), "event_type"))
    users = e.select("user_id").distinct()
    every = r.select("user_id", c("event_type").alias("name"), (pos + 100).alias("rank"))
    every = every.union(users.select("user_id", F.lit("view"), F.lit(0))).union(users.select("user_id", F.concat(F.lit("u"), c("user_id").cast("string")), F.lit(200)))
    best = every.groupBy("user_id", "name").agg(F.min("rank").alias("rank"))
    return best.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]), "|").alias("names"))


@query(f"{layers('t')} SELECT ord, CAST(2 AS BIGINT) AS parts, CAST(floor((maxx - minx) * 2 / 3 * (maxy - miny) * 1e12 + 0.5e0) AS BIGINT) AS largest, CAST(floor((minx + (maxx - minx) * 2 / 3) * 1e6 + 0.5e0) AS BIGINT) AS anchor FROM t")
def part_anchors(spark, sf_dir):
    """Parts of a territory by area, largest first, with a point in each."""
    w = (c("maxx") - c("minx")) / 3
    part = lambda x0, x1: F.struct(((x1 - x0) * (c("maxy") - c("miny"))).alias("area"), ((x0 + x1) / 2).alias("anchor"))
    parts = F.sort_array(F.array(part(c("minx"), c("minx") + w), part(c("minx") + w, c("maxx"))), asc=False)
    t = _t(spark, sf_dir).withColumn("parts", parts)
    return t.select("ord", F.size("parts").cast("long").alias("parts"), F.floor(c("parts")[0]["area"] * 1e12 + 0.5).alias("largest"), F.floor(c("parts")[0]["anchor"] * 1e6 + 0.5).alias("anchor"))
