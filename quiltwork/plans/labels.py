"""Labels, file names, page boxes and selections over the synthetic layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiltwork.functions import labels, mercator, metric, tags
from quiltwork.operators import cutting, selection, spatial_join
from quiltwork.plans.registry import layers, query
from quiltwork.sources import synth


def _told(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) IN ('', 'nan', 'none') THEN NULL ELSE trim({c}) END"


@query(
    f"""{layers('b')}, p AS (SELECT id, CASE WHEN id % 5 = 0 THEN {_told('city')} END AS name, {_told('place')} AS street, CASE WHEN id % 2 = 0 THEN CAST(id AS VARCHAR) END AS number,
    CASE WHEN id % 6 = 0 THEN CAST(id % 9 AS VARCHAR) END AS unit, CASE WHEN id % 3 = 0 THEN 'yes' ELSE {_told('suburb')} END AS kind FROM b),
    a AS (SELECT *, nullif(concat_ws(' ', street, number), '') || coalesce('/' || unit, '') AS address FROM p)
    SELECT id, address, coalesce(name, address, CASE WHEN kind <> 'yes' THEN kind END, 'building') AS title FROM a"""
)
def building_titles(spark, sf_dir):
    """Address and title of each building: name, else address, else kind."""
    c, k = F.col, F.col("id")
    p = synth.buildings(spark, sf_dir).select("id", F.when(k % 5 == 0, tags.tag_text(c("city"))).alias("name"), tags.tag_text(c("place")).alias("street"), F.when(k % 2 == 0, k.cast("string")).alias("number"), F.when(k % 6 == 0, (k % 9).cast("string")).alias("unit"), F.when(k % 3 == 0, "yes").otherwise(tags.tag_text(c("suburb"))).alias("kind"))
    p = p.withColumn("address", labels.address(c("street"), c("number"), c("unit")))
    return p.select("id", "address", labels.title(c("name"), c("address"), c("kind"), "building").alias("title"))


@query("WITH f AS (SELECT p_partkey AS id, p_size * 1.37e0 - 5 AS length, CASE WHEN p_size % 4 > 0 THEN CAST(p_size % 4 AS VARCHAR) END AS lanes, CASE p_size % 3 WHEN 0 THEN '50' WHEN 1 THEN 'DE:urban' END AS speed FROM part) SELECT id, concat_ws(' · ', CASE WHEN length > 0 THEN CAST(floor(length + 0.5e0) AS BIGINT) || ' m' END, lanes || ' lanes', CASE WHEN speed = '50' THEN '50 km/h' ELSE speed END) AS facts FROM f")
def street_facts(spark, sf_dir):
    """Length, lanes and speed of a street in one line."""
    c = F.col
    p = synth.read(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_size * 1.37D - 5 AS length", "CASE WHEN p_size % 4 > 0 THEN CAST(p_size % 4 AS STRING) END AS lanes", "CASE p_size % 3 WHEN 0 THEN '50' WHEN 1 THEN 'DE:urban' END AS speed")
    return p.select("id", labels.street_facts(c("length"), c("lanes"), c("speed")).alias("facts"))


@query(
    f"""{layers('t')}, a AS (SELECT ord, (ord * ord * ord + 1) * 12345.6e0 - 20000 AS m2 FROM t), k AS (SELECT *, m2 / 1e6 AS km2 FROM a)
    SELECT ord, CAST(CASE WHEN m2 >= 1e6 THEN floor(m2 / 1e4 + 0.5e0) WHEN m2 > 0 THEN floor(m2 + 0.5e0) * 100 END AS BIGINT) AS hundredths, CASE WHEN m2 >= 1e6 THEN 'km²' WHEN m2 > 0 THEN 'm²' END AS unit,
    concat_ws(' · ', 'old town', CASE WHEN ord % 2 = 0 THEN 'level ' || ord END, regexp_replace(CAST(CASE WHEN km2 >= 100 THEN floor(km2 + 0.5e0) ELSE floor(km2 * 100 + 0.5e0) / 100 END AS VARCHAR), '\\.0$', '') || ' km²') AS meta FROM k"""
)
def area_labels(spark, sf_dir):
    """Areas in the unit that suits them, and the line below a place's name."""
    o, m2 = F.col("ord"), F.col("m2")
    a = synth.territories(spark, sf_dir).select("ord", ((o * o * o + 1) * 12345.6 - 20000).alias("m2"))
    level = F.when(o % 2 == 0, o.cast("string"))
    return a.select("ord", F.floor(labels.area_value(m2) * 100 + 0.5).alias("hundredths"), labels.area_unit(m2).alias("unit"), labels.meta_line(F.lit("old_town"), level, m2 / 1e6).alias("meta"))


@query("SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'yesterday ' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def printed_days(spark, sf_dir):
    """Days of ISO marks; other texts keep their first ten characters."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    mark = F.when(k % 5 == 0, "yesterday at noon").when(k % 5 == 1, F.concat(day, F.lit("T12:30:00"))).otherwise(day)
    return synth.read(spark, sf_dir, "orders").select(labels.day(mark).alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS id, 'territory_map' || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '-new_' || lower(c_mktsegment) END || '-' || CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey * 1000 AS VARCHAR) ELSE 'nr_' || c_custkey || '__' END || '.png' AS file FROM customer")
def file_names(spark, sf_dir):
    """Safe names of exported cards."""
    k = F.col("c_custkey")
    locality = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("New  "), F.col("c_mktsegment")))
    territory = F.when(k % 3 != 0, F.concat(F.lit("Nr "), k.cast("string"), F.lit("é/")))
    return synth.read(spark, sf_dir, "customer").select(k.alias("id"), labels.file_name(locality, territory, k * 1000, "png").alias("file"))


def _pull(name: str, of: str, x: int, y: int, w: int, h: int) -> str:
    return f"""{name}x AS (SELECT id, CASE WHEN abs(x - {x}) < 4 THEN {x} ELSE x END AS x, CASE WHEN abs(y - {y}) < 4 THEN {y} ELSE y END AS y, w, h FROM {of}),
    {name} AS (SELECT id, x, y, CASE WHEN abs(x + w - {x + w}) < 4 THEN {x + w} - x ELSE w END AS w, CASE WHEN abs(y + h - {y + h}) < 4 THEN {y + h} - y ELSE h END AS h FROM {name}x)"""


@query(
    f"""WITH r AS (SELECT p_partkey AS id, p_partkey % 90 * 7 - 20 AS x, p_partkey % 70 * 11 - 30 AS y, greatest(10, least(300, p_partkey % 110 * 3 - 5)) AS w, greatest(10, least(400, p_partkey % 50 * 5)) AS h FROM part),
    c AS (SELECT id, greatest(0, least(x, 300 - w)) AS x, greatest(0, least(y, 400 - h)) AS y, w, h FROM r),
    {_pull('s', 'c', 0, 0, 100, 50)}, {_pull('z', 's', 60, 40, 120, 80)}
    SELECT id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h, CAST((400 - y - h) * 2 AS BIGINT) AS top FROM z"""
)
def page_boxes(spark, sf_dir):
    """Boxes clamped to a page and pulled on detected rectangles, on the screen and back."""
    k = F.col("p_partkey")
    raw = labels.box(*[(v).cast("double") for v in (k % 90 * 7 - 20, k % 70 * 11 - 30, k % 110 * 3 - 5, k % 50 * 5)])
    targets = F.array(*[labels.box(*[F.lit(float(v)) for v in t]) for t in ((0, 0, 100, 50), (60, 40, 120, 80))])
    p = synth.read(spark, sf_dir, "part").select(k.alias("id"), labels.to_screen(labels.snap_box(labels.clamp_box(raw, 300.0, 400.0), targets), 2.0, 400.0).alias("s"))
    b = labels.to_page(F.col("s"), 2.0, 400.0)
    return p.select("id", *[b[f].cast("long").alias(n) for f, n in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))], F.col("s.top").cast("long").alias("top"))


@query(f"{layers('b', 't')}, p AS (SELECT CAST(floor(x / 5e-4) AS BIGINT) AS cx, CAST(floor(y / 5e-4) AS BIGINT) AS cy FROM b), m AS (SELECT ord, CAST(floor((minx + 2e-3) / 5e-4) AS BIGINT) AS mx, CAST(floor((miny + 2e-3) / 5e-4) AS BIGINT) AS my FROM t) SELECT ord, greatest(abs(cx - mx), abs(cy - my)) AS shell, CAST(count(*) AS BIGINT) AS buildings FROM p JOIN m ON abs(cx - mx) <= 3 AND abs(cy - my) <= 3 GROUP BY 1, 2")
def shells(spark, sf_dir):
    """Buildings in each square shell of cells around the middle of a territory."""
    middle = synth.territories(spark, sf_dir).select("ord", (F.col("minx") + 2e-3).alias("x"), (F.col("miny") + 2e-3).alias("y"))
    around = spatial_join.shell_cells(spatial_join.point_cells(middle, 5e-4), 3).select("ord", "shell", "cx", "cy")
    return spatial_join.point_cells(synth.buildings(spark, sf_dir), 5e-4).join(around, ["cx", "cy"]).groupBy("ord", "shell").agg(F.count(F.lit(1)).alias("buildings"))


@query("WITH s AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer WHERE c_custkey % 3 <> 0) SELECT id, CAST(place AS BIGINT) AS place FROM s WHERE id BETWEEN 20 AND 100")
def shown_range(spark, sf_dir):
    """The rows between an anchor and a target, in the order that is shown."""
    shown = synth.read(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").selectExpr("c_custkey AS id", "c_custkey DIV 1000 AS bucket")
    return selection.extend(selection.places(shown, "id", "bucket"), "id", 100, 20).select("id", "place")


@query("SELECT 'joined' AS act, c_custkey AS id FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 6 = 0 UNION ALL SELECT 'left', c_custkey FROM customer WHERE c_custkey % 4 = 2")
def toggled_selection(spark, sf_dir):
    """All shown rows join a selection, or leave one that has them all."""
    c = synth.read(spark, sf_dir, "customer").selectExpr("c_custkey AS id")
    joined, left = (selection.toggle_all(c.where("id % 4 = 0"), c.where(f"id % {n} = 0"), "id") for n in (6, 2))
    return joined.select(F.lit("joined").alias("act"), "id").union(left.select(F.lit("left"), "id"))


@query("WITH f AS (SELECT c_custkey AS id, c_custkey // 50 AS project FROM customer WHERE c_acctbal < 3000) SELECT id, coalesce(lead(id) OVER (PARTITION BY project ORDER BY id), min(id) OVER (PARTITION BY project)) AS next FROM f")
def flagged_walk(spark, sf_dir):
    """From each flagged row to the next, and from the last to the first."""
    f = synth.read(spark, sf_dir, "customer").where("c_acctbal < 3000").selectExpr("c_custkey AS id", "c_custkey DIV 50 AS project")
    return selection.next_flagged(f, "project", "id").select("id", "next")


@query(
    f"""{layers('s')}, d AS (SELECT id, ax, ay, bx - ax AS vx, "by" - ay AS vy, 19.901e0 AS rx, 50.0007e0 AS ry, 19.9193e0 - 19.901e0 AS wx, 50.0183e0 - 50.0007e0 AS wy FROM s),
    c AS (SELECT *, vy * wx - vx * wy AS across FROM d), p AS (SELECT *, ((ry - ay) * wx - (rx - ax) * wy) / across AS t, ((ry - ay) * vx - (rx - ax) * vy) / across AS u FROM c WHERE abs(across) >= 1e-14)
    SELECT id, CAST(floor((ax + t * vx) * 1e7 + 0.5e0) AS BIGINT) AS x, CAST(floor((ay + t * vy) * 1e7 + 0.5e0) AS BIGINT) AS y FROM p WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1"""
)
def line_crossings(spark, sf_dir):
    """Where a cutting line meets each street."""
    c = F.col
    at = metric.crossing_point((c("ax"), c("ay")), (c("bx"), c("by")), (F.lit(19.901), F.lit(50.0007)), (F.lit(19.9193), F.lit(50.0183)))
    p = synth.streets(spark, sf_dir).select("id", at.alias("p")).where("p IS NOT NULL")
    return p.select("id", F.floor(c("p.x") * 1e7 + 0.5).alias("x"), F.floor(c("p.y") * 1e7 + 0.5).alias("y"))


_MERC = "(0.5e0 - ln((1 + sin(radians({y}))) / (1 - sin(radians({y})))) / (4 * pi())) * 256"


@query(
    f"""{layers('t')}, e AS (SELECT ord, (maxx + 180) / 360 * 256 - (minx + 180) / 360 * 256 AS w, {_MERC.format(y='miny')} - {_MERC.format(y='maxy')} AS h FROM t),
    z AS (SELECT ord, greatest(3, least(19, ln(least(1200 * 0.9e0 / w, 800 * 0.9e0 / h)) / ln(2))) AS z FROM e) SELECT ord, CAST(floor(z * 1000 + 0.5e0) AS BIGINT) AS milli_zoom, CAST(floor(11 * 72 / 300e0 * pow(2, z - 15) * 1000 + 0.5e0) AS BIGINT) AS milli_points FROM z"""
)
def fitted_views(spark, sf_dir):
    """The zoom at which a territory fills a picture, and the printed height of its tiles' labels."""
    c, zero = F.col, F.lit(0.0)
    (ax, ay), (bx, by) = mercator.project(c("minx"), c("miny"), zero), mercator.project(c("maxx"), c("maxy"), zero)
    z = synth.territories(spark, sf_dir).select("ord", mercator.fit_zoom(bx - ax, ay - by, (1200.0, 800.0)).alias("z"))
    return z.select("ord", F.floor(c("z") * 1000 + 0.5).alias("milli_zoom"), F.floor(mercator.label_points(c("z"), F.lit(15.0), 11.0, 300.0) * 1000 + 0.5).alias("milli_points"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'pl' WHEN c_custkey % 3 = 0 THEN 'en' WHEN c_custkey % 2 = 0 THEN 'pl' ELSE 'en' END AS lang FROM customer")
def language_choice(spark, sf_dir):
    """The language of a page: override, path, preferences, default."""
    k = F.col("c_custkey")
    forced, path = F.when(k % 5 == 0, "pl").when(k % 5 == 1, "xx"), F.when(k % 3 == 0, "/en/map").otherwise("/map")
    wishes = F.when(k % 2 == 0, F.array(F.lit("de-DE"), F.lit("PL-pl"), F.lit("en"))).otherwise(F.array(F.lit("de")))
    return synth.read(spark, sf_dir, "customer").select(k.alias("id"), labels.language(("en", "pl"), forced, path, wishes, "en").alias("lang"))


@query(
    f"""{layers('b', 't')}, r AS (SELECT id, id % 2 = 0 AS east, CASE WHEN id % 2 = 0 THEN x + 3e-4 ELSE x END AS tx, CASE WHEN id % 2 = 0 THEN y ELSE y + 3e-4 END AS ty FROM b),
    e AS (SELECT minx AS v, miny AS lo, maxy AS hi, TRUE AS upright FROM t UNION ALL SELECT maxx, miny, maxy, TRUE FROM t UNION ALL SELECT miny, minx, maxx, FALSE FROM t UNION ALL SELECT maxy, minx, maxx, FALSE FROM t),
    h AS (SELECT id, min(v) AS v FROM r JOIN e ON east = upright AND v BETWEEN CASE WHEN east THEN tx ELSE ty END + 0.2e0 / 110540 AND CASE WHEN east THEN tx ELSE ty END + 3.0005e-3 AND CASE WHEN east THEN ty ELSE tx END BETWEEN lo AND hi GROUP BY id),
    o AS (SELECT r.id, CASE WHEN east THEN coalesce(v, tx) + 1.5e0 / 110540 ELSE tx END AS x, CASE WHEN east THEN ty ELSE coalesce(v, ty) + 1.5e0 / 110540 END AS y FROM r LEFT JOIN h ON h.id = r.id)
    SELECT id, CAST(floor(x * 1e6 + 0.5e0) AS BIGINT) AS x, CAST(floor(y * 1e6 + 0.5e0) AS BIGINT) AS y FROM o"""
)
def pushed_ends(spark, sf_dir):
    """Ends of cutting lines, pushed just past the next side of a territory."""
    c, east = F.col, F.col("id") % 2 == 0
    ends = synth.buildings(spark, sf_dir).select("id", c("x").alias("fx"), c("y").alias("fy"), F.when(east, c("x") + 3e-4).otherwise(c("x")).alias("tx"), F.when(east, c("y")).otherwise(c("y") + 3e-4).alias("ty"))
    corners = (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"))
    sides = F.array(*[F.struct(c(a[0]).alias("ax"), c(a[1]).alias("ay"), c(b[0]).alias("bx"), c(b[1]).alias("by")) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)])
    edges = synth.territories(spark, sf_dir).select(F.explode(sides).alias("e")).select("e.*")
    out = cutting.push_out(ends, edges, "id", 3.0005e-3, 1e-3)
    return out.select("id", F.floor(c("x") * 1e6 + 0.5).alias("x"), F.floor(c("y") * 1e6 + 0.5).alias("y"))


@query("WITH i AS (SELECT p_partkey AS ord, p_partkey // 20 AS page, (p_partkey * 37) % 101 AS x, p_partkey % 13 AS y, p_size AS size FROM part WHERE p_partkey % 4 < 2), k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY x, ord) AS k FROM i) SELECT page, CASE WHEN k = 1 THEN 'locality' ELSE 'territory' END AS field, CAST(x + 3 AS BIGINT) AS x, CAST(y + 5 AS BIGINT) AS y, CAST(size * 10 AS BIGINT) AS tenths FROM k WHERE k <= 2")
def card_fields(spark, sf_dir):
    """Places of the two fields of a card, found by their leader dots."""
    items = synth.read(spark, sf_dir, "part").selectExpr("p_partkey AS ord", "p_partkey DIV 20 AS page", "CASE p_partkey % 4 WHEN 0 THEN '......' WHEN 1 THEN '…………' WHEN 2 THEN '...' ELSE p_name END AS text", "CAST((p_partkey * 37) % 101 AS DOUBLE) AS x", "CAST(p_partkey % 13 AS DOUBLE) AS y", "CAST(p_size AS DOUBLE) AS size")
    f, c = cutting.card_fields(items, "page"), F.col
    return f.select("page", "field", c("x").cast("long").alias("x"), c("y").cast("long").alias("y"), F.round(c("size") * 10).cast("long").alias("tenths"))
