"""Borders moved onto the walls of the footprints that they cross, over all footprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltwork.functions import board, settle
from quiltwork.operators import boards, footprints
from quiltwork.plans.registry import layers, query
from quiltwork.sources import synth

#: Square metres in a square of a millionth of a degree, at the board's latitude.
UNIT = 1e12 / (110540.0 * 111320.0 * 0.6427)
SIZES = settle.Sizes(unit=UNIT, grid=1.0, seam=5.0)


def _whole(df: DataFrame, key: str) -> DataFrame:
    """Boxes as rings in whole millionths of a degree from the board's corner."""
    at = lambda c, start: F.round((F.col(c) - start) * 1e6)
    x0, x1, y0, y1 = at("minx", 19.9), at("maxx", 19.9), at("miny", 50.0), at("maxy", 50.0)
    corner = lambda x, y: F.struct(F.lit(0).cast("long").alias("r"), x.alias("x"), y.alias("y"))
    return df.select(F.col(key), F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0)).alias("rings"))


def _settled(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    slots = _whole(synth.territories(spark, sf_dir, 0.004), "ord")
    crossings, after = footprints.detach(_whole(synth.footprints(spark, sf_dir), "id"), slots, 400.0, 10.0, SIZES)
    return crossings, slots, after


# Groups of overlapping crossings are cut along all their lines into cells; step by step the next footprint's cells go to
# whoever holds most of them.
_MOVES = f"""{layers('b', 'f')}, i AS (SELECT id, CAST(round((minx - 19.9e0) * 1e6) AS BIGINT) AS x0, CAST(round((maxx - 19.9e0) * 1e6) AS BIGINT) AS x1, CAST(round((miny - 50e0) * 1e6) AS BIGINT) AS y0, CAST(round((maxy - 50e0) * 1e6) AS BIGINT) AS y1 FROM f),
 t AS (SELECT CAST(n_nationkey AS BIGINT) AS ord, (n_nationkey % 5) * 4000 AS x0, (n_nationkey % 5) * 4000 + 4000 AS x1, (n_nationkey // 5) * 4000 AS y0, (n_nationkey // 5) * 4000 + 4000 AS y1 FROM nation),
 o AS (SELECT id, ord, (i.x1 - i.x0) * (i.y1 - i.y0) AS a, (least(i.x1, t.x1) - greatest(i.x0, t.x0)) * (least(i.y1, t.y1) - greatest(i.y0, t.y0)) AS s FROM i JOIN t ON i.x0 < t.x1 AND t.x0 < i.x1 AND i.y0 < t.y1 AND t.y0 < i.y1),
 c AS (SELECT id, max(a) AS a, count(*) FILTER (WHERE s >= greatest({UNIT!r}e0, 0.02e0 * a)) AS claims, arg_max(ord, s * 1000 - ord) AS owner FROM o GROUP BY id HAVING claims > 1),
 q AS (SELECT c.*, x0, x1, y0, y1 FROM c JOIN i USING (id)),
 e AS (SELECT p.id AS p, r.id AS r FROM q p JOIN q r ON p.x0 < r.x1 AND r.x0 < p.x1 AND p.y0 < r.y1 AND r.y0 < p.y1),
 w AS (SELECT id AS node, id AS root FROM q UNION SELECT e.r, w.root FROM w JOIN e ON e.p = w.node AND w.root < e.r),
 k AS (SELECT q.*, g.root, row_number() OVER (PARTITION BY root ORDER BY a, id) AS step FROM q JOIN (SELECT node, min(root) AS root FROM w GROUP BY node) g ON g.node = q.id),
 h AS (SELECT root, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM k GROUP BY root),
 xs AS (SELECT root, v, lead(v) OVER (PARTITION BY root ORDER BY v) AS n FROM (SELECT root, x0 AS v FROM k UNION SELECT root, x1 FROM k UNION SELECT root, m * 4000 FROM h, range(0, 6) r(m) WHERE m * 4000 BETWEEN x0 AND x1)),
 ys AS (SELECT root, v, lead(v) OVER (PARTITION BY root ORDER BY v) AS n FROM (SELECT root, y0 AS v FROM k UNION SELECT root, y1 FROM k UNION SELECT root, m * 4000 FROM h, range(0, 6) r(m) WHERE m * 4000 BETWEEN y0 AND y1)),
 z AS (SELECT xs.root, xs.v AS x, ys.v AS y, (xs.n - xs.v) * (ys.n - ys.v) AS s, coalesce(t.ord, -1) AS own FROM xs JOIN ys ON ys.root = xs.root LEFT JOIN t ON xs.v >= t.x0 AND xs.v < t.x1 AND ys.v >= t.y0 AND ys.v < t.y1 WHERE xs.n IS NOT NULL AND ys.n IS NOT NULL),
 u AS (SELECT root, x, y, s, own, CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS taker FROM z UNION ALL
   SELECT root, x, y, s, CASE WHEN NOT hit OR kinds < 2 OR (own < 0 AND spare > 5 * {UNIT!r}e0) THEN own ELSE best END, step, CASE WHEN kinds > 1 THEN best END FROM (
    SELECT *, first_value(own) OVER (PARTITION BY root ORDER BY CASE WHEN own < 0 THEN 0 ELSE coalesce(held, 0) END DESC, own) AS best, count(DISTINCT CASE WHEN hit AND own >= 0 THEN own END) OVER (PARTITION BY root) AS kinds, coalesce(sum(CASE WHEN hit AND own < 0 THEN s END) OVER (PARTITION BY root), 0) AS spare FROM (
     SELECT u.root, u.x, u.y, u.s, u.own, k.step, u.x >= k.x0 AND u.x < k.x1 AND u.y >= k.y0 AND u.y < k.y1 AS hit, sum(CASE WHEN u.x >= k.x0 AND u.x < k.x1 AND u.y >= k.y0 AND u.y < k.y1 THEN u.s END) OVER (PARTITION BY u.root, u.own) AS held
     FROM u JOIN k ON k.root = u.root AND k.step = u.step + 1)))"""


@query(f"WITH RECURSIVE {_MOVES[5:]} SELECT k.id, CAST(k.claims AS BIGINT) AS claims, k.owner, m.taker FROM k JOIN (SELECT root, step, max(taker) AS taker FROM u GROUP BY root, step) m ON m.root = k.root AND m.step = k.step")
def footprint_moves(spark, sf_dir):
    """Every crossed footprint: how many claim it, who holds most of it, and who gets it in the end."""
    return _settled(spark, sf_dir)[0]


@query(
    f"""WITH RECURSIVE {_MOVES[5:]}, d AS (SELECT own AS ord, CAST(sum(CASE WHEN step = 0 THEN -s ELSE s END) AS BIGINT) AS grown FROM (SELECT u.*, max(step) OVER (PARTITION BY root) AS last FROM u) WHERE step IN (0, last) GROUP BY own)
    SELECT t.ord, CAST(16000000 + coalesce(d.grown, 0) AS BIGINT) AS size, CAST(1 AS BIGINT) AS parts FROM t LEFT JOIN d ON d.ord = t.ord"""
)
def moved_board(spark, sf_dir):
    """The territories once all crossed footprints have been settled: size in square millionths of a degree, and parts."""
    _, _, after = _settled(spark, sf_dir)

    def run(r):
        shape = footprints._rings(r.rings)
        return [(r.ord, round(board.area(shape)), len(board.pieces(shape)))]

    return boards.each(after, run, "ord long, size long, parts long")


@query(
    f"""WITH RECURSIVE {_MOVES[5:]}, pp AS (SELECT k.id, m.taker FROM k JOIN (SELECT root, step, max(taker) AS taker FROM u GROUP BY root, step) m ON m.root = k.root AND m.step = k.step),
    nn AS (SELECT t.ord, count(b.id) AS n FROM t LEFT JOIN (SELECT id, CAST(round((x - 19.9e0) * 1e6) AS BIGINT) AS x, CAST(round((y - 50e0) * 1e6) AS BIGINT) AS y FROM b) b ON b.x >= t.x0 AND b.x < t.x1 AND b.y >= t.y0 AND b.y < t.y1 GROUP BY t.ord),
    zz AS (SELECT o.ord, count(*) AS crossed, bool_or(pp.taker IS NOT NULL) AS moves FROM o JOIN pp ON pp.id = o.id WHERE s >= greatest({UNIT!r}e0, 0.02e0 * a) GROUP BY o.ord)
    SELECT n.ord, CAST(CASE WHEN n.ord % 4 = 1 THEN 2 ELSE 1 END AS BIGINT) AS parts, n.ord % 4 = 1 AS split, n.n = 0 AS is_empty, CAST(coalesce(zz.crossed, 0) AS BIGINT) AS crossed,
     n.ord % 4 = 1 OR coalesce(zz.moves, FALSE) OR (n.n = 0 AND EXISTS (SELECT 1 FROM nn q JOIN t ON t.ord = q.ord JOIN t w ON w.ord = n.ord WHERE q.n > 0 AND q.ord <> n.ord AND t.x0 <= w.x1 AND w.x0 <= t.x1 AND t.y0 <= w.y1 AND w.y0 <= t.y1)) AS fixable FROM nn n LEFT JOIN zz ON zz.ord = n.ord"""
)
def issue_kinds(spark, sf_dir):
    """What is wrong with each territory, by kind, and whether it can be fixed; each fourth territory is in two parts."""
    slots = _whole(synth.territories(spark, sf_dir, 0.004), "ord")
    # a second part inside the first one's box would not lie apart: it is a strip beyond the board
    away = F.transform("rings", lambda p: F.struct((p["r"] + 1).alias("r"), (p["x"] / 10 + 30000 + F.col("ord") * 3000).alias("x"), (p["y"] / 10).alias("y")))
    slots = slots.withColumn("rings", F.when(F.col("ord") % 4 == 1, F.concat("rings", away)).otherwise(F.col("rings")))
    points = synth.buildings(spark, sf_dir).select("id", F.round((F.col("x") - 19.9) * 1e6).alias("x"), F.round((F.col("y") - 50.0) * 1e6).alias("y"))
    return footprints.issues(slots, _whole(synth.footprints(spark, sf_dir), "id"), points, 400.0, 10.0, SIZES)
