"""Tags, names, addresses, templates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quiltwork.functions import tags
from quiltwork.operators import naming
from quiltwork.plans.registry import layers, query
from quiltwork.plans.spatial import first_territory
from quiltwork.sources import synth

_MISSING = "CASE WHEN {c} IS NULL OR lower(trim({c})) IN ('', 'nan', 'none') THEN NULL ELSE trim({c}) END"
_VOTES = f"""{layers('b', 't')}, m AS (SELECT b.id, min(ord) AS ord FROM b JOIN t ON x >= minx AND x < maxx AND y >= miny AND y < maxy GROUP BY b.id),
    k AS (SELECT m.ord, {_MISSING.format(c='city')} AS v, 1e0 AS w FROM b JOIN m ON m.id = b.id UNION ALL SELECT m.ord, {_MISSING.format(c='place')}, 1e0 FROM b JOIN m ON m.id = b.id UNION ALL SELECT m.ord, {_MISSING.format(c='suburb')}, 0.5e0 FROM b JOIN m ON m.id = b.id),
    g AS (SELECT ord, lower(v) AS name, count(*) AS n, sum(w) AS score FROM k WHERE v IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY score DESC, name) AS rank FROM g)"""


def _votes(spark, sf_dir):
    return naming.votes(synth.buildings(spark, sf_dir).join(first_territory(spark, sf_dir), "id"), "ord")


@query(f"{_VOTES} SELECT ord, name, CAST(n AS BIGINT) AS n, CAST(score * 2 AS BIGINT) AS half_points, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 12")
def locality_rank(spark, sf_dir):
    """The 12 best locality names of each territory."""
    r = naming.ranked(_votes(spark, sf_dir), "ord", 12)
    return r.select("ord", "name", "n", (F.col("score") * 2).cast("long").alias("half_points"), "rank")


@query(f"{_VOTES} SELECT ord, name FROM r WHERE rank = 1")
def locality_top1(spark, sf_dir):
    """The best locality name of each territory."""
    return naming.ranked(_votes(spark, sf_dir), "ord", 1).select("ord", "name")


@query(
    f"""{_VOTES}, a AS (SELECT name, sum(n) AS n, sum(score) AS score FROM g GROUP BY name), ar AS (SELECT name, row_number() OVER (ORDER BY score DESC, name) AS rank FROM a),
    u AS (SELECT ord, name, 0 AS scope, rank FROM r UNION ALL SELECT t.ord, ar.name, 1, ar.rank FROM t CROSS JOIN ar WHERE ar.rank <= 12),
    d AS (SELECT *, row_number() OVER (PARTITION BY ord, name ORDER BY scope, rank) AS k FROM u), f AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY scope, rank) AS pos FROM d WHERE k = 1)
    SELECT ord, name, CAST(pos AS BIGINT) AS pos FROM f WHERE pos <= 12"""
)
def locality_candidates(spark, sf_dir):
    """A territory's own names first, then the whole area's, without repeats, 12 at most."""
    votes = _votes(spark, sf_dir).cache()
    own = naming.ranked(votes, "ord", None).select("ord", "name", F.lit(0).alias("scope"), "rank")
    area = votes.groupBy("name").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "name").limit(12).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "name")).cast("long"))
    lists = area.agg(F.collect_list(F.struct("name", "rank")).alias("l"))  # one row of 12 names
    every = synth.territories(spark, sf_dir).select("ord").join(F.broadcast(lists), F.lit(True)).select("ord", F.explode("l").alias("e")).select("ord", "e.name", F.lit(1).alias("scope"), "e.rank")
    first = own.union(every).groupBy("ord", "name").agg(F.min(F.struct("scope", "rank")).alias("p"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("ord").orderBy("p")).cast("long")).where("pos <= 12").select("ord", "name", "pos")


@query(
    f"""{layers('b')}, k AS (SELECT id, 0 AS pos, trim(city) AS v FROM b UNION ALL SELECT id, 1, trim(place) FROM b UNION ALL SELECT id, 2, trim(suburb) FROM b UNION ALL SELECT id, 3, upper(trim(city)) FROM b),
    d AS (SELECT id, lower(v) AS folded, min(pos) AS pos, arg_min(v, pos) AS v FROM k WHERE v IS NOT NULL AND v <> '' GROUP BY 1, 2)
    SELECT id, CAST(count(*) AS BIGINT) AS n, arg_min(v, pos) AS best FROM d GROUP BY id"""
)
def address_ladder(spark, sf_dir):
    """Ordered address keys, trimmed, without case-folded repeats; the first one names the place."""
    b = synth.buildings(spark, sf_dir)
    keys = F.array(F.col("city"), F.col("place"), F.col("suburb"), F.upper("city"))
    return naming.ladder(b.select("id", keys.alias("values")), "id")


@query(
    r"""WITH k AS (SELECT p_partkey, list_filter(list_transform([p_type, '  ' || p_brand || ' ', p_type, 'NaN', ''], lambda v: trim(v)), lambda v: v <> '' AND lower(v) <> 'nan') AS l FROM part)
    SELECT p_partkey, l[1] || '; ' || l[2] AS cleaned, upper(substr(l[1], 1, 1)) || replace(substr(l[1], 2), '_', ' ') || ' / ' || upper(substr(l[2], 1, 1)) || replace(substr(l[2], 2), '_', ' ') AS said FROM k"""
)
def tag_clean(spark, sf_dir):
    """List tags: trimmed, distinct, in first-seen order; and how they read."""
    p = synth.read(spark, sf_dir, "part")
    values = F.array("p_type", F.concat(F.lit("  "), "p_brand", F.lit(" ")), "p_type", F.lit("NaN"), F.lit(""))
    return p.select("p_partkey", tags.clean_list(values).alias("cleaned")).select("p_partkey", "cleaned", tags.label(F.col("cleaned")).alias("said"))


@query(
    f"""{layers('b')} SELECT id, {_MISSING.format(c='city')} AS city, coalesce(lower({_MISSING.format(c='place')}) NOT IN ('no', 'false'), FALSE) AS has_place,
    coalesce({_MISSING.format(c='city')}, {_MISSING.format(c='place')}, {_MISSING.format(c='suburb')}, 'building') || CASE WHEN id % 2 = 0 THEN ' ' || id ELSE '' END AS title FROM b"""
)
def tag_text(spark, sf_dir):
    """Missing-value rule of single tags, flags, and the ladder of a building's title."""
    city, place, suburb = (tags.tag_text(F.col(c)) for c in ("city", "place", "suburb"))
    number = F.when(F.col("id") % 2 == 0, F.concat(F.lit(" "), F.col("id").cast("string"))).otherwise("")
    return synth.buildings(spark, sf_dir).select("id", city.alias("city"), tags.flag(F.col("place")).alias("has_place"), F.concat(F.coalesce(city, place, suburb, F.lit("building")), number).alias("title"))


@query(
    r"""SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) = 'example.com' OR split_part(split_part(url, '://', 2), '/', 1) = 'www.example.com' AS same_origin,
    replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped, substr(sha1(split_part(url, '?', 1)), 1, 16) AS root FROM pages"""
)
def same_origin(spark, sf_dir):
    """Host equality by string rules, HTML escapes, and a digest as partition key."""
    host = F.element_at(F.split(F.element_at(F.split(F.col("url"), "://"), 2), "/"), 1)
    return synth.read(spark, sf_dir, "pages").select("page_id", host.isin("example.com", "www.example.com").alias("same_origin"), tags.escape_html(F.col("url")).alias("escaped"), F.substring(F.sha1(F.element_at(F.split(F.col("url"), r"\?"), 1)), 1, 16).alias("root"))


@query("""SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 'one' WHEN c_custkey % 10 BETWEEN 2 AND 4 AND c_custkey % 100 NOT BETWEEN 12 AND 14 THEN 'few' ELSE 'many' END AS pl, CASE WHEN c_custkey = 1 THEN 'one' ELSE 'other' END AS en FROM customer""")
def plural_categories(spark, sf_dir):
    """Plural categories of two languages."""
    n = F.col("c_custkey")
    return synth.read(spark, sf_dir, "customer").select("c_custkey", tags.plural(n, "pl").alias("pl"), tags.plural(n, "en").alias("en"))


@query("WITH r AS (SELECT p_partkey // 1000 AS k, sha256(string_agg(p_partkey || ':' || p_name, '|' ORDER BY p_partkey)) AS digest, count(*) AS n FROM part GROUP BY 1) SELECT substr(sha256(string_agg(digest, '|' ORDER BY k)), 1, 12) AS version, CAST(sum(n) AS BIGINT) AS files FROM r")
def asset_manifest(spark, sf_dir):
    """A digest over all assets in key order: digests of ranges of 1000 keys, then the digest of those."""
    rows = F.sort_array(F.collect_list(F.struct("p_partkey", "p_name")))  # at most 1000
    text = F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["p_partkey"].cast("string"), r["p_name"])), "|")
    ranges = synth.read(spark, sf_dir, "part").groupBy(F.expr("p_partkey DIV 1000").alias("k")).agg(F.sha2(text, 256).alias("digest"), F.count(F.lit(1)).alias("n"))
    every = F.transform(F.sort_array(F.collect_list(F.struct("k", "digest"))), lambda r: r["digest"])  # a digest a range
    return ranges.agg(F.substring(F.sha2(F.array_join(every, "|"), 256), 1, 12).alias("version"), F.sum("n").alias("files"))


@query("""WITH r AS (SELECT user_id, event_type, max(ts) AS last FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, event_type) AS pos FROM r) SELECT user_id, event_type, CAST(pos AS BIGINT) AS pos FROM k WHERE pos <= 8""")
def recent_names(spark, sf_dir):
    """Most recent distinct values first, eight at most."""
    r = synth.read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last"))
    return r.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last"), "event_type")).cast("long")).where("pos <= 8").select("user_id", "event_type", "pos")


@query("""SELECT c_custkey, list_contains([408, 425, 429, 500, 502, 503, 504], 400 + c_custkey % 110) AS retryable, least(30, 2 * pow(2, c_custkey % 6)) AS wait, CAST(least(10, greatest(1, c_custkey % 17 - 3)) AS BIGINT) AS hits FROM customer""")
def retry_policy(spark, sf_dir):
    """Retryable statuses, exponential waits with a cap, and the clamp of a result limit."""
    from quiltwork.config import CONFIG

    k = F.col("c_custkey")
    return synth.read(spark, sf_dir, "customer").select("c_custkey", (400 + k % 110).isin(*CONFIG.retryable).alias("retryable"), F.least(F.lit(30.0), 2 * F.pow(F.lit(2.0), k % 6)).alias("wait"), F.least(F.lit(10), F.greatest(F.lit(1), k % 17 - 3)).cast("long").alias("hits"))
