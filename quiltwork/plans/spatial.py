"""Spatial joins and nearest-neighbour queries over the synthetic geography."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quiltwork.functions import metric
from quiltwork.operators import spatial_join as sj
from quiltwork.plans.registry import layers, query
from quiltwork.sources import synth

SIDE = 0.004
_INSIDE = "x >= minx AND x < maxx AND y >= miny AND y < maxy"
_FIRST = f"m AS (SELECT b.id, min(ord) AS ord FROM b JOIN t ON {_INSIDE} GROUP BY b.id)"


def first_territory(spark, sf_dir):
    pairs = sj.points_in_boxes(synth.buildings(spark, sf_dir), synth.territories(spark, sf_dir), SIDE)
    return pairs.groupBy("id").agg(F.min("ord").alias("ord"))


@query(f"{layers('b', 't')}, {_FIRST} SELECT t.ord, CAST(count(m.id) AS BIGINT) AS buildings FROM t LEFT JOIN m ON m.ord = t.ord GROUP BY t.ord")
def territory_building_counts(spark, sf_dir):
    """Buildings of each territory; a building belongs to the first territory that holds it."""
    counts = first_territory(spark, sf_dir).groupBy("ord").agg(F.count(F.lit(1)).alias("n"))
    return synth.territories(spark, sf_dir).select("ord").join(counts, "ord", "left").select("ord", F.coalesce("n", F.lit(0)).cast("long").alias("buildings"))


@query(f"{layers('s', 't')} SELECT t.ord, CAST(count(*) AS BIGINT) AS streets FROM t JOIN s ON ax <= maxx AND bx >= minx AND ay <= maxy AND \"by\" >= miny GROUP BY t.ord")
def street_touch_counts(spark, sf_dir):
    """Streets of each territory; a street on a boundary counts for both sides."""
    s = synth.streets(spark, sf_dir).select("id", F.col("ax").alias("minx"), F.col("ay").alias("miny"), F.col("bx").alias("maxx"), F.col("by").alias("maxy"))
    return sj.boxes_touch(s, synth.territories(spark, sf_dir), SIDE, "id", "ord").groupBy(F.col("r_ord").alias("ord")).agg(F.count(F.lit(1)).alias("streets"))


@query(f"{layers('b', 't')}, {_FIRST} SELECT b.id, m.ord, coalesce(t.name, 'outside') AS name FROM b LEFT JOIN m ON m.id = b.id LEFT JOIN t ON t.ord = m.ord")
def point_lookup(spark, sf_dir):
    """The first territory at each point, and its name."""
    b, t = synth.buildings(spark, sf_dir).select("id"), synth.territories(spark, sf_dir).select("ord", "name")
    return b.join(first_territory(spark, sf_dir), "id", "left").join(t, "ord", "left").select("id", "ord", F.coalesce("name", F.lit("outside")).alias("name"))


@query(f"{layers('b', 't')} SELECT ord, CAST(count(*) AS BIGINT) AS buildings FROM b JOIN t ON {_INSIDE} GROUP BY ord")
def independent_counts(spark, sf_dir):
    """Buildings inside each territory, shared ones counted for each."""
    return sj.points_in_boxes(synth.buildings(spark, sf_dir), synth.territories(spark, sf_dir), SIDE).groupBy("ord").agg(F.count(F.lit(1)).alias("buildings"))


_D2 = "pow(({bx} - {ax}) * 111320e0 * cos(radians(({ay} + {by}) / 2)), 2) + pow(({by} - {ay}) * 110540e0, 2)"


def _depots(spark, sf_dir):
    return synth.read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS depot", "19.9D + ((s_suppkey * 6151) % 20011) / 1000000D AS x", "50.0D + ((s_suppkey * 86028) % 20021) / 1000000D AS y")


_DEPOTS = "d AS (SELECT s_suppkey AS depot, 19.9e0 + ((s_suppkey * 6151) % 20011) / 1e6 AS dx, 50e0 + ((s_suppkey * 86028) % 20021) / 1e6 AS dy FROM supplier)"


@query(
    f"""{layers('b')}, {_DEPOTS}, p AS (SELECT id, depot, sqrt({_D2.format(ax='x', ay='y', bx='dx', by='dy')}) AS m FROM b CROSS JOIN d),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, depot) AS k FROM p) SELECT id, depot, CAST(floor(m * 100 + 0.5e0) AS BIGINT) AS cm FROM r WHERE k = 1"""
)
def nearest_supplier(spark, sf_dir):
    """The nearest depot of each building, ties to the smaller key."""
    near = sj.nearest(synth.buildings(spark, sf_dir).select("id", "x", "y"), _depots(spark, sf_dir), "id", "depot", metric.dist, 0.002)
    return near.select("id", F.col("target").alias("depot"), F.floor(F.col("d") * 100 + 0.5).alias("cm"))


@query(
    f"""{layers('b')}, p AS (SELECT a.id, o.id AS other, sqrt({_D2.format(ax='a.x', ay='a.y', bx='o.x', by='o.y')}) AS m FROM b a JOIN b o ON a.id <> o.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, other) AS k FROM p) SELECT id, CAST(floor(m * 100 + 0.5e0) AS BIGINT) AS cm FROM r WHERE k = 3"""
)
def knn_spacing(spark, sf_dir):
    """Distance to the third nearest neighbour."""
    near = sj.kth_distance(synth.buildings(spark, sf_dir).select("id", "x", "y"), "id", 3, metric.dist)
    return near.select("id", F.floor(F.col("d") * 100 + 0.5).alias("cm"))


_SEG = """q AS (SELECT b.id, s.id AS street, x, y, ax, ay, bx, "by", 111320e0 * cos(radians(y)) AS k FROM b JOIN s ON x >= ax - 0.0005e0 AND x <= bx + 0.0005e0 AND y >= ay - 0.0005e0 AND y <= "by" + 0.0005e0),
    u AS (SELECT *, greatest(0e0, least(1e0, ((x - ax) * k * (bx - ax) * k + (y - ay) * 110540e0 * ("by" - ay) * 110540e0) / (pow((bx - ax) * k, 2) + pow(("by" - ay) * 110540e0, 2)))) AS p FROM q),
    v AS (SELECT id, street, sqrt(pow((ax + (bx - ax) * p - x) * k, 2) + pow((ay + ("by" - ay) * p - y) * 110540e0, 2)) AS m FROM u)"""


def _street_distances(spark, sf_dir):
    """Buildings with their closest points on the lines around them; a line that several streets follow counts once."""
    pad = 0.0005
    s = synth.streets(spark, sf_dir).select("ax", "ay", "bx", "by").distinct()
    cells = sj.box_cells(s, 0.001, pad, ("ax", "ay", "bx", "by"))
    p = sj.point_cells(synth.buildings(spark, sf_dir).select("id", "x", "y"), 0.001).join(cells, ["cx", "cy"])
    p = p.where((F.col("x") >= F.col("ax") - pad) & (F.col("x") <= F.col("bx") + pad) & (F.col("y") >= F.col("ay") - pad) & (F.col("y") <= F.col("by") + pad))
    return p.withColumn("c", metric.closest_on_segment(*map(F.col, ("x", "y", "ax", "ay", "bx", "by")))).select("id", "c")


@query(f"{layers('b', 's')}, {_SEG} SELECT id, CAST(min(floor(m * 100 + 0.5e0)) AS BIGINT) AS cm FROM v GROUP BY id")
def nearest_street_point(spark, sf_dir):
    """Distance to the nearest point of a centre line within 0.0005 degrees."""
    return _street_distances(spark, sf_dir).groupBy("id").agg(F.min(F.floor(F.col("c.d") * 100 + 0.5)).alias("cm"))


@query(
    f"""{layers('b', 's', 't')}, {_SEG},
    w AS (SELECT id, 'street' AS kind, min(m) AS score FROM v GROUP BY id
      UNION ALL SELECT id, 'edge', min(least(abs(x - minx), abs(maxx - x)) * 111320e0 * cos(radians(y))) * 1.7e0 FROM b JOIN t ON {_INSIDE} GROUP BY id
      UNION ALL SELECT id, 'node', min(sqrt({_D2.format(ax='x', ay='y', bx='nx', by='ny')})) * 0.6e0 FROM b JOIN (SELECT minx AS nx, miny AS ny FROM t) ON abs(x - nx) < 1e-3 AND abs(y - ny) < 1e-3 GROUP BY id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score, kind) AS k FROM w)
    SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(floor(score * 100 + 0.5e0)) AS BIGINT) AS cm FROM r WHERE k = 1 GROUP BY kind"""
)
def snap_contest(spark, sf_dir):
    """Which of street, territory edge and corner wins the weighted contest for each building."""
    b, t = synth.buildings(spark, sf_dir).select("id", "x", "y"), synth.territories(spark, sf_dir)
    street = _street_distances(spark, sf_dir).groupBy("id").agg(F.min("c.d").alias("score")).withColumn("kind", F.lit("street"))
    inside = sj.points_in_boxes(b, t, SIDE)
    edge = inside.groupBy("id").agg((F.min(F.least(F.abs(F.col("x") - F.col("minx")), F.abs(F.col("maxx") - F.col("x"))) * metric.lng_scale(F.col("y"))) * 1.7).alias("score")).withColumn("kind", F.lit("edge"))
    corners = t.select((F.col("minx") - 0.001).alias("minx"), (F.col("miny") - 0.001).alias("miny"), (F.col("minx") + 0.001).alias("maxx"), (F.col("miny") + 0.001).alias("maxy"), F.col("minx").alias("nx"), F.col("miny").alias("ny"))
    close = sj.point_cells(b, 0.001).join(sj.box_cells(corners, 0.001), ["cx", "cy"]).where((F.abs(F.col("x") - F.col("nx")) < 0.001) & (F.abs(F.col("y") - F.col("ny")) < 0.001))
    node = close.groupBy("id").agg((F.min(metric.dist(*map(F.col, ("x", "y", "nx", "ny")))) * 0.6).alias("score")).withColumn("kind", F.lit("node"))
    won = street.unionByName(edge).unionByName(node).groupBy("id").agg(F.min(F.struct("score", "kind")).alias("m"))
    return won.groupBy(F.col("m.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("m.score") * 100 + 0.5)).cast("long").alias("cm"))


@query(
    f"""{layers('b', 't', 'f')}, o AS (SELECT f.id, t.ord, greatest(0e0, least(f.maxx, t.maxx) - greatest(f.minx, t.minx)) * greatest(0e0, least(f.maxy, t.maxy) - greatest(f.miny, t.miny)) / ((f.maxx - f.minx) * (f.maxy - f.miny)) AS share
      FROM f JOIN t ON f.minx <= t.maxx AND t.minx <= f.maxx AND f.miny <= t.maxy AND t.miny <= f.maxy),
    c AS (SELECT id FROM o WHERE share >= 0.02e0 GROUP BY id HAVING count(*) >= 2),
    r AS (SELECT o.*, row_number() OVER (PARTITION BY o.id ORDER BY floor(share * 1e6 + 0.5e0) DESC, ord) AS k, count(*) OVER (PARTITION BY o.id) AS n FROM o JOIN c ON o.id = c.id WHERE share >= 0.02e0)
    SELECT id, ord AS owner, CAST(n AS BIGINT) AS claims, CAST(floor(share * 1e6 + 0.5e0) AS BIGINT) AS ppm FROM r WHERE k = 1"""
)
def building_crossings(spark, sf_dir):
    """Buildings that two or more territories claim by at least 2 % of the footprint; the owner has the largest share."""
    pairs = sj.boxes_touch(synth.footprints(spark, sf_dir), synth.territories(spark, sf_dir), SIDE, "id", "ord")
    c = F.col
    w = F.greatest(F.lit(0.0), F.least(c("maxx"), c("r_maxx")) - F.greatest(c("minx"), c("r_minx")))
    h = F.greatest(F.lit(0.0), F.least(c("maxy"), c("r_maxy")) - F.greatest(c("miny"), c("r_miny")))
    shares = pairs.select("id", F.col("r_ord").alias("ord"), (w * h / ((c("maxx") - c("minx")) * (c("maxy") - c("miny")))).alias("share")).where("share >= 0.02D")
    ppm = F.floor(F.col("share") * 1e6 + 0.5)
    best = shares.groupBy("id").agg(F.count(F.lit(1)).alias("claims"), F.max(F.struct(ppm.alias("ppm"), (-F.col("ord")).alias("o"))).alias("m")).where("claims >= 2")
    return best.select("id", (-F.col("m.o")).alias("owner"), "claims", F.col("m.ppm").alias("ppm"))


@query(f"{layers('t')} SELECT a.ord, CAST(count(*) AS BIGINT) AS neighbours, CAST(min(b.ord) AS BIGINT) AS first FROM t a JOIN t b ON a.ord <> b.ord AND a.minx <= b.maxx + 5e-6 AND b.minx - 5e-6 <= a.maxx AND a.miny <= b.maxy + 5e-6 AND b.miny - 5e-6 <= a.maxy GROUP BY a.ord")
def touching_territories(spark, sf_dir):
    """Neighbours of each territory, with half a metre of slack."""
    t = synth.territories(spark, sf_dir)
    pairs = sj.boxes_touch(t, t, SIDE, "ord", "ord", 5e-6).where("ord <> r_ord")
    return pairs.groupBy("ord").agg(F.count(F.lit(1)).alias("neighbours"), F.min("r_ord").alias("first"))


@query(
    f"""{layers('t')}, h AS (SELECT DISTINCT ord FROM t WHERE ord % 6 = 0), g AS (SELECT i, j, 19.9e0 + (i + 0.5e0) * 1e-4 AS x, 50e0 + (j + 0.5e0) * 1e-4 AS y FROM (SELECT range AS i FROM range(200)) CROSS JOIN (SELECT range AS j FROM range(200)))
    SELECT i // 20 AS bi, j // 20 AS bj, CAST(count(*) AS BIGINT) AS cells FROM g WHERE NOT EXISTS (SELECT 1 FROM t JOIN h ON h.ord <> t.ord AND h.ord = 12 WHERE x >= minx AND x < maxx AND y >= miny AND y < maxy) GROUP BY 1, 2"""
)
def uncovered_ground(spark, sf_dir):
    """Cells of the board that no territory covers when territory 12 is left out, by blocks of 20 cells."""
    axis = spark.range(200)
    cells = axis.select(F.col("id").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(199)))).selectExpr("i", "CAST(j AS BIGINT) AS j", "19.9D + (i + 0.5D) * 0.0001D AS x", "50.0D + (j + 0.5D) * 0.0001D AS y")
    held = sj.points_in_boxes(cells, synth.territories(spark, sf_dir).where("ord <> 12"), SIDE).select("i", "j").distinct()
    return cells.join(held, ["i", "j"], "left_anti").groupBy(F.expr("i DIV 20").alias("bi"), F.expr("j DIV 20").alias("bj")).agg(F.count(F.lit(1)).alias("cells"))


@query(
    f"""{layers('t')}, c AS (SELECT ord, greatest(minx, 19.9015e0) AS x0, greatest(miny, 50.0015e0) AS y0, least(maxx, 19.9165e0) AS x1, least(maxy, 50.0165e0) AS y1, (maxx - minx) * (maxy - miny) AS whole FROM t),
    a AS (SELECT ord, (greatest(0e0, x1 - x0) * greatest(0e0, y1 - y0)) * 110540e0 * 111320e0 * cos(radians(50.01e0)) AS m2, whole * 110540e0 * 111320e0 * cos(radians(50.01e0)) AS was FROM c)
    SELECT ord, CAST(floor(m2 + 0.5e0) AS BIGINT) AS m2, was - m2 > 1 AS unmarked FROM a WHERE m2 >= 50"""
)
def boundary_clip(spark, sf_dir):
    """Territories clipped to a smaller boundary; remainders under 50 square metres go, marks go where the area moved."""
    c = F.col
    scale = F.lit(110540.0 * 111320.0) * F.cos(F.radians(F.lit(50.01)))
    t = synth.territories(spark, sf_dir).where("minx <= 19.9165D AND maxx >= 19.9015D AND miny <= 50.0165D AND maxy >= 50.0015D")
    w = F.greatest(F.lit(0.0), F.least(c("maxx"), F.lit(19.9165)) - F.greatest(c("minx"), F.lit(19.9015)))
    h = F.greatest(F.lit(0.0), F.least(c("maxy"), F.lit(50.0165)) - F.greatest(c("miny"), F.lit(50.0015)))
    t = t.withColumn("m", w * h * scale).withColumn("was", (c("maxx") - c("minx")) * (c("maxy") - c("miny")) * scale).where("m >= 50")
    return t.select("ord", F.floor(c("m") + 0.5).alias("m2"), (c("was") - c("m") > 1).alias("unmarked"))


@query(
    f"""{layers('b', 't')}, {_FIRST}, o AS (SELECT o_custkey, max(o_orderdate) AS marked FROM orders GROUP BY o_custkey),
    a AS (SELECT t.ord, count(m.id) AS n, max(o.marked) AS marked, count(o.marked) AS k FROM t LEFT JOIN m ON m.ord = t.ord LEFT JOIN o ON o.o_custkey = m.id GROUP BY t.ord)
    SELECT ord, CAST(n AS BIGINT) AS buildings, n = 0 AS is_empty, k > 0 AS printed, strftime(marked, '%Y-%m-%d') AS printed_on FROM a"""
)
def printed_round(spark, sf_dir):
    """Marks of territories: the latest order date among their buildings' owners."""
    marks = synth.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("marked"))
    own = first_territory(spark, sf_dir).join(marks, "id", "left")
    got = synth.territories(spark, sf_dir).select("ord").join(own, "ord", "left").groupBy("ord").agg(F.count("id").alias("buildings"), F.max("marked").alias("marked"))
    return got.select("ord", "buildings", (F.col("buildings") == 0).alias("is_empty"), F.col("marked").isNotNull().alias("printed"), F.date_format(F.col("marked").cast("timestamp"), "yyyy-MM-dd").alias("printed_on"))


_AUDIT = f"""{layers('b', 't', 'f')}, {_FIRST}, n AS (SELECT ord, count(*) AS n FROM m GROUP BY ord),
    o AS (SELECT f.id, t.ord, greatest(0e0, least(f.maxx, t.maxx) - greatest(f.minx, t.minx)) * greatest(0e0, least(f.maxy, t.maxy) - greatest(f.miny, t.miny)) / ((f.maxx - f.minx) * (f.maxy - f.miny)) AS share
      FROM f JOIN t ON f.minx <= t.maxx AND t.minx <= f.maxx AND f.miny <= t.maxy AND t.miny <= f.maxy),
    c AS (SELECT ord, count(*) AS k FROM o WHERE share >= 0.02e0 AND id IN (SELECT id FROM o WHERE share >= 0.02e0 GROUP BY id HAVING count(*) >= 2) GROUP BY ord)"""


@query(f"{_AUDIT} SELECT t.ord, CAST(coalesce(n.n, 0) AS BIGINT) AS buildings, CAST(coalesce(c.k, 0) AS BIGINT) AS crossed, coalesce(n.n, 0) = 0 OR coalesce(c.k, 0) > 0 AS flagged FROM t LEFT JOIN n ON n.ord = t.ord LEFT JOIN c ON c.ord = t.ord")
def territory_audit(spark, sf_dir):
    """Per territory: buildings, buildings that its boundary cuts, and whether it is flagged."""
    pairs = sj.boxes_touch(synth.footprints(spark, sf_dir), synth.territories(spark, sf_dir), SIDE, "id", "ord")
    c = F.col
    w = F.greatest(F.lit(0.0), F.least(c("maxx"), c("r_maxx")) - F.greatest(c("minx"), c("r_minx")))
    h = F.greatest(F.lit(0.0), F.least(c("maxy"), c("r_maxy")) - F.greatest(c("miny"), c("r_miny")))
    claims = pairs.where(w * h / ((c("maxx") - c("minx")) * (c("maxy") - c("miny"))) >= 0.02).select("id", F.col("r_ord").alias("ord"))
    # a building has at most four claims, so one array each instead of a second join
    crossed = claims.groupBy("id").agg(F.collect_list("ord").alias("all")).where(F.size("all") >= 2).select(F.explode("all").alias("ord")).groupBy("ord").agg(F.count(F.lit(1)).alias("k"))
    counts = territory_building_counts(spark, sf_dir)
    out = counts.join(crossed, "ord", "left").select("ord", "buildings", F.coalesce("k", F.lit(0)).cast("long").alias("crossed"))
    return out.withColumn("flagged", (c("buildings") == 0) | (c("crossed") > 0))


@query(f"{_AUDIT} SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE n.n IS NULL) AS BIGINT) AS is_empty, CAST(count(*) FILTER (WHERE c.k > 0) AS BIGINT) AS crossed, CAST(coalesce(sum(c.k), 0) AS BIGINT) AS claims FROM t LEFT JOIN n ON n.ord = t.ord LEFT JOIN c ON c.ord = t.ord")
def audit_summary(spark, sf_dir):
    """The board's warnings in one row."""
    a = territory_audit(spark, sf_dir)
    return a.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("buildings") == 0).alias("is_empty"), F.count_if(F.col("crossed") > 0).alias("crossed"), F.coalesce(F.sum("crossed"), F.lit(0)).alias("claims"))


@query(f"{_AUDIT}, a AS (SELECT t.ord, coalesce(c.k, 0) > 0 OR n.n IS NULL AS flagged, t.ord % 3 = 0 AS printed FROM t LEFT JOIN n ON n.ord = t.ord LEFT JOIN c ON c.ord = t.ord), z AS (SELECT range - 1 AS z FROM range(3)) SELECT p.z AS printed_axis, q.z AS flag_axis, CAST(count(*) AS BIGINT) AS shown FROM a CROSS JOIN z p CROSS JOIN z q WHERE (p.z = 0 OR (p.z > 0) = printed) AND (q.z = 0 OR (q.z > 0) = flagged) GROUP BY 1, 2")
def axis_filters(spark, sf_dir):
    """Rows that each setting of the two three-state filters shows."""
    from quiltwork.functions.tags import axis_keeps

    states = F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)])
    a = territory_audit(spark, sf_dir).select("flagged", (F.col("ord") % 3 == 0).alias("printed")).withColumn("printed_axis", F.explode(states)).withColumn("flag_axis", F.explode(states))
    return a.where(axis_keeps(F.col("printed_axis"), F.col("printed")) & axis_keeps(F.col("flag_axis"), F.col("flagged"))).groupBy("printed_axis", "flag_axis").agg(F.count(F.lit(1)).alias("shown"))


@query(f"{layers('t')}, r AS (SELECT ord, row_number() OVER (ORDER BY ord) AS number FROM t WHERE ord % 4 <> 3) SELECT ord, CAST(number AS BIGINT) AS number, CASE WHEN number < 10 THEN '0' || number ELSE CAST(number AS VARCHAR) END AS padded FROM r")
def territory_numbers(spark, sf_dir):
    """Numbers after a set of territories was deleted; a project has at most 200 by policy."""
    kept = synth.territories(spark, sf_dir).where("ord % 4 <> 3").select("ord")
    number = F.row_number().over(Window.orderBy("ord"))
    return kept.select("ord", number.cast("long").alias("number"), F.when(number < 10, F.concat(F.lit("0"), number.cast("string"))).otherwise(number.cast("string")).alias("padded"))
