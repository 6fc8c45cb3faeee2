"""Sources, requests, projections and repairs over the synthetic layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiltwork.functions import mercator, metric
from quiltwork.operators import trim
from quiltwork.plans.registry import layers, query
from quiltwork.sources import layers as osm
from quiltwork.sources import synth


@query(
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 403 WHEN event_id % 23 > 19 THEN 400 WHEN user_id < 0 OR user_id >= pow(2, event_id % 23) OR event_id % 100 >= pow(2, event_id % 23) THEN 400 ELSE 200 END AS status FROM events"""
)
def tile_requests(spark, sf_dir):
    """Status of tile requests: origin, zoom, then place."""
    e = synth.read(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 7 = 0 THEN 'https://other/' ELSE 'https://own:80/map' END AS referer", "CAST(event_id % 23 AS INT) AS z", "user_id AS x", "event_id % 100 AS y")
    return osm.check_tile(e, "own:80").select("event_id", "status")


_WAYS = "CASE p_partkey % 5 WHEN 0 THEN 'residential' WHEN 1 THEN 'footway' WHEN 2 THEN 'primary' WHEN 3 THEN 'cycleway' ELSE 'unclassified' END"


@query(f"WITH w AS (SELECT p_partkey, {_WAYS} AS highway, p_name, p_size FROM part) SELECT p_partkey AS osmid, highway, trim(p_name) AS name, CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS lanes FROM w WHERE highway IN ('residential', 'primary', 'unclassified')")
def street_layer(spark, sf_dir):
    """Drivable ways with cleaned tags; 'nan' is missing."""
    ways = synth.read(spark, sf_dir, "part").selectExpr("p_partkey AS element_id", f"{_WAYS} AS highway", "array(p_name, concat(' ', p_name, ' ')) AS name", "CASE WHEN p_size % 4 = 0 THEN 'nan' ELSE CAST(p_size AS STRING) END AS lanes", "p_brand AS unknown")
    p = osm.streets(ways).select("props")
    return p.select(F.col("props")["osmid"].cast("long").alias("osmid"), F.col("props")["highway"].alias("highway"), F.col("props")["name"].alias("name"), F.col("props")["lanes"].alias("lanes"))


@query(f"{layers('t')}, r AS (SELECT ord, (maxx - minx) * (1 + ord % 5 * 10) AS w, (maxy - miny) * (1 + ord % 5 * 10) AS h, miny FROM t), a AS (SELECT ord, w * h * 110.574e0 * 111.32e0 * cos(radians((miny + (miny + h)) / 2)) AS km2 FROM r) SELECT ord, CAST(floor(km2 * 1000 + 0.5e0) AS BIGINT) AS milli_km2, CASE WHEN km2 > 50 THEN 'too large' END AS error FROM a")
def request_areas(spark, sf_dir):
    """Areas of requested boxes and the refusal of those above the limit."""
    from quiltwork.functions.ring import box_ring

    k = 1 + F.col("ord") % 5 * 10
    c = F.col
    r = synth.territories(spark, sf_dir).select("ord", box_ring(c("minx"), c("miny"), c("minx") + (c("maxx") - c("minx")) * k, c("miny") + (c("maxy") - c("miny")) * k).alias("ring"))
    return osm.check_request(r).select("ord", F.floor(osm.area_km2(F.col("ring")) * 1000 + 0.5).alias("milli_km2"), "error")


@query("SELECT c_custkey AS id, CAST(floor((c_custkey % 180 - 90) * 10) AS BIGINT) AS lat10, CAST(c_custkey AS DOUBLE) AS west, abs(c_custkey % 400 - 200) <= 180 AS usable FROM customer WHERE c_custkey % 9 <> 4")
def geocode_rows(spark, sf_dir):
    """Parsed hits; rows without numbers go, coordinates out of range are flagged."""
    c = synth.read(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS STRING) AS name", "CASE WHEN c_custkey % 9 = 4 THEN 'n/a' ELSE CAST(c_custkey % 180 - 90 AS STRING) END AS lat", "CAST(c_custkey % 400 - 200 AS STRING) AS lon", "array('0', '1', CAST(c_custkey AS STRING), '3') AS boundingbox")
    h = osm.geocode_hits(c)
    return h.select(F.col("name").cast("long").alias("id"), F.floor(F.col("lat") * 10).alias("lat10"), F.col("bounds.west").alias("west"), osm.in_range(F.col("lat"), F.col("lng")).alias("usable"))


@query(f"{layers('b')} SELECT id, CAST(floor(x * 1e6 + 0.5e0) AS BIGINT) AS lng, CAST(floor(y * 1e6 + 0.5e0) AS BIGINT) AS lat, CAST(greatest(3, least(19, floor(14.2e0 + id % 7 + 0.5e0) - id % 3)) AS INTEGER) AS tile_zoom FROM b")
def projection_round_trip(spark, sf_dir):
    """Projected, rotated there and back, and unprojected: the same place again; and the zoom of its tiles."""
    c = F.col
    z = F.lit(17.5)
    px, py = mercator.project(c("x"), c("y"), z)
    turn = (c("id") * 13 % 360).cast("double")
    rx, ry = mercator.rotate(px, py, F.lit(1e6), F.lit(2e6), turn)
    b = synth.buildings(spark, sf_dir).select("id", rx.alias("rx"), ry.alias("ry"), (-turn).alias("back"))
    ux, uy = mercator.rotate(c("rx"), c("ry"), F.lit(1e6), F.lit(2e6), c("back"))
    lng, lat = mercator.unproject(ux, uy, z)
    return b.select("id", F.floor(lng * 1e6 + 0.5).alias("lng"), F.floor(lat * 1e6 + 0.5).alias("lat"), mercator.tile_zoom(14.2 + c("id") % 7, c("id") % 3).alias("tile_zoom"))


@query(f"{layers('s')}, a AS (SELECT id, degrees(atan2((bx - ax) * 111320e0 * cos(radians((ay + \"by\") / 2)), (\"by\" - ay) * 110540e0)) AS bearing FROM s), d AS (SELECT *, abs(bearing - id * 7) - 180 * floor(abs(bearing - id * 7) / 180) AS r FROM a) SELECT id, CAST(floor(bearing * 1000 + 0.5e0) AS BIGINT) AS bearing, CAST(floor(CASE WHEN r > 90 THEN 180 - r ELSE r END * 1000 + 0.5e0) AS BIGINT) AS off FROM d")
def street_bearings(spark, sf_dir):
    """Bearing of each street, and its acute angle with another direction."""
    b = synth.streets(spark, sf_dir).select("id", metric.bearing(*map(F.col, ("ax", "ay", "bx", "by"))).alias("b"))
    return b.select("id", F.floor(F.col("b") * 1000 + 0.5).alias("bearing"), F.floor(metric.angle_diff(F.col("b"), F.col("id") * 7.0) * 1000 + 0.5).alias("off"))


@query("WITH k AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'count' WHEN 1 THEN 'hello' ELSE 'missing' END AS key FROM customer) SELECT id, CASE key WHEN 'count' THEN id || ' domów' WHEN 'hello' THEN 'hello' ELSE 'missing' END AS text FROM k")
def translations(spark, sf_dir):
    """Texts from a dictionary, its fallback, or the key itself, with their variables filled in."""
    keys = synth.read(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "CASE c_custkey % 3 WHEN 0 THEN 'count' WHEN 1 THEN 'hello' ELSE 'missing' END AS key", "map('n', CAST(c_custkey AS STRING)) AS vars")
    words = spark.createDataFrame([("count", "{n} domów")], "key string, text string")
    other = spark.createDataFrame([("count", "{n} houses"), ("hello", "hello")], "key string, text string")
    return osm.translate(keys, words, other).select("id", "text")


@query()
def trim_proposal(spark, sf_dir):
    """A tighter boundary around the buildings without the shifted ones: vertices, and what it holds."""
    b = synth.buildings(spark, sf_dir, outliers=True).selectExpr("CAST(1 AS BIGINT) AS project", "x", "y", "id % 500 = 499 AS ignored")
    return trim.propose(b, "project").select(F.size("ring").alias("vertices"), "kept_inside", "kept_outside", "ignored_inside")
