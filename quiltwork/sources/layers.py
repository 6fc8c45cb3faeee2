"""Map layers as they come from extracts, requests and tile stores: normalise, validate, reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltwork.config import CONFIG
from quiltwork.functions import ring as rings
from quiltwork.functions.tags import clean_list

#: Tag columns that a layer keeps (fixed values).
STREET_FIELDS = ("osmid", "name", "highway", "ref", "oneway", "lanes", "maxspeed", "surface", "bridge", "tunnel", "junction", "access", "width", "service", "length")
BUILDING_FIELDS = ("osmid", "building", "name", "addr:street", "addr:place", "addr:housenumber", "addr:unit", "addr:city", "addr:suburb", "building:levels", "amenity")


def normalize(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Allowed columns that exist, cleaned, as ``props`` without empty keys; other columns but ``geom_type``/geometry go."""
    have = [f for f in fields if f in df.columns]
    value = lambda f: clean_list(F.col(f"`{f}`").cast("array<string>")) if df.schema[f].dataType.typeName() == "array" else clean_list(F.array(F.col(f"`{f}`").cast("string")))
    props = F.map_filter(F.map_from_arrays(F.array(*[F.lit(f) for f in have]), F.array(*[value(f) for f in have])), lambda _, v: v.isNotNull())
    rest = [f"`{c}`" for c in df.columns if c not in have and c in ("ord", "geom_type", "parts", "minx", "miny", "maxx", "maxy")]
    return df.select(*rest, props.alias("props"))


def with_osm_id(df: DataFrame) -> DataFrame:
    """``osmid`` from the first present of id, osmid, element_id."""
    have = [c for c in ("id", "osmid", "element_id") if c in df.columns]
    return df.withColumn("osmid", F.coalesce(*[F.col(c).cast("long") for c in have]) if have else F.lit(None).cast("long"))


def streets(ways: DataFrame) -> DataFrame:
    """Drivable ways."""
    return normalize(with_osm_id(ways.where(F.col("highway").isin(*CONFIG.highways))), STREET_FIELDS)


def buildings(areas: DataFrame) -> DataFrame:
    """Footprints: areas with a building tag; an empty layer keeps its schema."""
    return normalize(with_osm_id(areas.where(F.col("building").isNotNull() & F.col("geom_type").isin("Polygon", "MultiPolygon"))), BUILDING_FIELDS)


def area_km2(ring: Column) -> Column:
    """Planar area with the server's kilometres a degree, at mid-latitude."""
    b = rings.bbox(ring)
    mid = (b["miny"] + b["maxy"]) / 2
    return F.abs(rings.signed_area(ring)) * CONFIG.server_lat_km * CONFIG.server_lng_km * F.cos(F.radians(mid))


def check_request(requests: DataFrame) -> DataFrame:
    """``error`` of each requested ring: 'empty', 'too large' or null."""
    n = F.coalesce(F.size("ring"), F.lit(0))
    return requests.withColumn("error", F.when((n < 4) | F.col("ring").isNull(), "empty").when(area_km2(F.col("ring")) > CONFIG.max_area_km2, "too large"))


def check_tile(tiles: DataFrame, own_host: str) -> DataFrame:
    """``status`` of tile requests (referer, layer, z, x, y): the checks in their fixed order."""
    host = F.regexp_extract(F.coalesce("referer", F.lit("")), r"^[a-z]+://([^/]*)", 1)
    side = F.pow(F.lit(2.0), F.col("z"))
    inside = (F.col("x") >= 0) & (F.col("x") < side) & (F.col("y") >= 0) & (F.col("y") < side)
    return tiles.withColumn("status", F.when(host != own_host, 403).when(~F.col("z").between(0, CONFIG.max_zoom), 400).when(~inside, 400).otherwise(200))


def mime_type(data: Column) -> Column:
    """By the first bytes: JPEG, WebP, else PNG."""
    head = F.hex(F.substring(data, 1, 12))
    return F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("52494646") & head.endswith("57454250"), "image/webp").otherwise("image/png")


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """layer, z, x, y, size, mtime, content of a tile store laid out as layer/z/x/y.png."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(path)
    part = lambda k: F.element_at(F.split("path", "/"), k)
    return files.select(part(-4).alias("layer"), part(-3).cast("int").alias("z"), part(-2).cast("int").alias("x"), F.regexp_extract(part(-1), r"^(\d+)", 1).cast("int").alias("y"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def geocode_hits(rows: DataFrame) -> DataFrame:
    """Hits with usable coordinates; ``boundingbox`` is south, north, west, east as text."""
    num = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    out = rows.withColumn("lat", num("lat")).withColumn("lng", num("lon")).where("lat IS NOT NULL AND lng IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lng)")
    box = [num(f"get(boundingbox, {k})") for k in range(4)]
    return out.select("name", "lat", "lng", F.struct(box[2].alias("west"), box[0].alias("south"), box[3].alias("east"), box[1].alias("north")).alias("bounds"))


def in_range(lat: Column, lng: Column) -> Column:
    return lat.between(-90, 90) & lng.between(-180, 180)


def translate(keys: DataFrame, words: DataFrame, fallback: DataFrame) -> DataFrame:
    """``text`` of each key: the language's, else the fallback's, else the key itself; ``{var}`` is filled from ``vars``."""
    found = keys.join(words.select("key", F.col("text").alias("own")), "key", "left").join(fallback.select("key", F.col("text").alias("other")), "key", "left")
    said = F.coalesce("own", "other", "key")
    filled = F.aggregate(F.map_entries(F.coalesce("vars", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))), said, lambda s, e: F.replace(s, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    return found.select(*keys.columns, filled.alias("text"))
