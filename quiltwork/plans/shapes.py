"""Overlay of polygons and work on boards of territories."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiltwork.functions import board, kernels, morph
from quiltwork.functions import overlay as ov
from quiltwork.operators import boards
from quiltwork.operators import spatial_join as sj
from quiltwork.plans.registry import layers, query
from quiltwork.sources import synth

SIDE = 0.004
#: Square metres in a square degree, at the board's latitude.
M2 = 110540.0 * 111320.0 * 0.6427


def _unit(area: float, scale: float = 1e12) -> int:
    return int(area * scale + 0.5)


def _box(r, prefix: str = "") -> ov.Polygon:
    return morph.box(*(getattr(r, prefix + c) for c in ("minx", "miny", "maxx", "maxy")))


def _rows(spark, sf_dir, side: float = 0.00401):
    """Territories with the row of the board that they are in, as their project."""
    return synth.territories(spark, sf_dir, side).withColumn("project", F.expr("ord DIV 5"))


def _pairs(spark, sf_dir):
    return sj.boxes_touch(synth.footprints(spark, sf_dir), synth.territories(spark, sf_dir), SIDE, "id", "ord")


_TOUCH = "f.minx <= t.maxx AND t.minx <= f.maxx AND f.miny <= t.maxy AND t.miny <= f.maxy"
_COMMON = "greatest(0e0, least(f.maxx, t.maxx) - greatest(f.minx, t.minx)) * greatest(0e0, least(f.maxy, t.maxy) - greatest(f.miny, t.miny))"
_BIG = "CAST(floor(({}) * 1e12 + 0.5e0) AS BIGINT)"


@query(
    f"""{layers('b', 't', 'f')}, o AS (SELECT f.id, t.ord, {_COMMON} AS i, (f.maxx - f.minx) * (f.maxy - f.miny) AS a, (t.maxx - t.minx) * (t.maxy - t.miny) AS b FROM f JOIN t ON {_TOUCH})
    SELECT id, ord, {_BIG.format('a + b - i')} AS joined, CAST(floor(i * 1e14 + 0.5e0) AS BIGINT) AS common, CAST(floor((a - i) * 1e14 + 0.5e0) AS BIGINT) AS rest, i > 0 AS meet FROM o"""
)
def overlay_areas(spark, sf_dir):
    """Union, intersection and difference of each footprint and each territory that it touches, in 1e-12 and 1e-14 square degrees."""

    def run(r):
        a, b = _box(r), _box(r, "r_")
        common = ov.intersect(a, b)
        return [(r.id, r.r_ord, _unit(ov.area(ov.union(a, b))), _unit(ov.area(common), 1e14), _unit(ov.area(ov.difference(a, b)), 1e14), ov.area(common) > 0)]

    return boards.each(_pairs(spark, sf_dir), run, "id long, ord long, joined long, common long, rest long, meet boolean")


@query(
    f"""{layers('t')}, p AS (SELECT ord // 5 AS project, minx, maxx, maxy - miny AS h, max(maxx) OVER (PARTITION BY ord // 5 ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM t WHERE ord % 7 <> 3),
    c AS (SELECT project, max(h) AS h, sum(maxx - greatest(minx, coalesce(upto, minx))) AS w, count(*) FILTER (WHERE upto IS NULL OR minx > upto) AS n FROM p GROUP BY project)
    SELECT project, {_BIG.format('w * h')} AS covered, {_BIG.format('(2.001e-2 - w) * h')} AS uncovered, CAST(n AS BIGINT) AS parts, CAST(0 AS BIGINT) AS failed FROM c"""
)
def board_cover(spark, sf_dir):
    """What each row of the board covers without every seventh territory, and what subtracting them one by one leaves."""

    def run(project, rows):
        outer = rest = morph.box(19.9, rows[0].miny, 19.92001, rows[0].maxy)
        failed = 0
        for r in rows:
            rest = board.as_polygon(ov.difference(rest, _box(r)))
            failed += ov.area(ov.intersect(outer, _box(r))) <= 0
        whole = ov.union_all([_box(r) for r in rows])
        return [(project, _unit(ov.area(whole)), _unit(board.area(rest)), len(ov.parts(whole)), failed)]

    return boards.project(_rows(spark, sf_dir).where("ord % 7 <> 3"), "project", "ord", run, "project long, covered long, uncovered long, parts long, failed long")


@query(
    f"""{layers('t')}, c AS (SELECT ord, maxx - minx AS w, maxy - miny AS h, CASE ord % 5 WHEN 4 THEN -1e-3 WHEN 3 THEN 1e-8 ELSE (1 + ord % 3) * 1e-3 END AS spot FROM t)
    SELECT ord, CAST(CASE WHEN spot > 1e-7 THEN 2 ELSE 1 END AS BIGINT) AS parts, {_BIG.format('CASE WHEN spot > 1e-7 THEN greatest(spot, w - spot) ELSE w END * h')} AS largest, {_BIG.format('CASE WHEN spot > 1e-7 THEN least(spot, w - spot) ELSE w END * h')} AS smallest FROM c"""
)
def board_cuts(spark, sf_dir):
    """Territories cut by a line; a line that misses one, or cuts a crumb off, leaves it whole."""

    def run(r):
        at = r.minx + (-1e-3 if r.ord % 5 == 4 else 1e-8 if r.ord % 5 == 3 else (1 + r.ord % 3) * 1e-3)
        parts = board.cut(_box(r), (at, r.miny - 1e-3), (at, r.maxy + 1e-3), 5 / M2) or [_box(r)]
        sizes = sorted((board.area(p) for p in parts), reverse=True)
        return [(r.ord, len(parts), _unit(sizes[0]), _unit(sizes[-1]))]

    return boards.each(synth.territories(spark, sf_dir), run, "ord long, parts long, largest long, smallest long")


@query(f"{layers('t')} SELECT ord, CAST(2 AS BIGINT) AS parts, {_BIG.format('(maxx - minx) * (maxy - miny) / 2')} AS half, CAST(floor((maxx - minx) * (maxy - miny) / 8 * 1e14 + 0.5e0) AS BIGINT) AS corner FROM t")
def slanted_cuts(spark, sf_dir):
    """Territories cut along a diagonal, and what a slanted line cuts off at a corner."""

    def run(r):
        w, h = r.maxx - r.minx, r.maxy - r.miny
        halves = board.cut(_box(r), (r.minx - w, r.miny - h), (r.maxx + w, r.maxy + h), 5 / M2)
        off = board.cut(_box(r), (r.minx - w / 2, r.miny + h), (r.maxx, r.miny - h / 2), 5 / M2)
        return [(r.ord, len(halves), _unit(board.area(halves[0])), min(_unit(board.area(p), 1e14) for p in off))]

    return boards.each(synth.territories(spark, sf_dir), run, "ord long, parts long, half long, corner long")


@query(
    f"""{layers('t')}, p AS (SELECT a.ord AS a, b.ord AS b, (a.maxx - a.minx) * (a.maxy - a.miny) + (b.maxx - b.minx) * (b.maxy - b.miny) - greatest(0e0, a.maxx - b.minx) * (a.maxy - a.miny) AS m, b.minx <= a.maxx AS near FROM t a JOIN t b ON a.ord // 5 = b.ord // 5 AND b.ord IN (a.ord + 1, a.ord + 2))
    SELECT a, b, TRUE AS can, {_BIG.format('m')} AS joined, CAST(CASE WHEN near THEN 1 ELSE 2 END AS BIGINT) AS pieces FROM p UNION ALL SELECT ord, NULL, FALSE, NULL, NULL FROM t"""
)
def board_merges(spark, sf_dir):
    """Merging a selection of territories: one alone can't be merged; what lies apart stays in two pieces."""

    def run(project, rows):
        out = []
        for k, a in enumerate(rows):
            for chosen in ([a], *([a, b] for b in rows[k + 1 : k + 3])):
                whole = board.merge([_box(r) for r in chosen])
                b = chosen[1].ord if len(chosen) > 1 else None
                out.append((a.ord, b, len(chosen) > 1, None if whole is None else _unit(board.area(whole)), None if whole is None else len(board.pieces(whole))))
        return out

    return boards.project(_rows(spark, sf_dir), "project", "ord", run, "a long, b long, can boolean, joined long, pieces long")


@query(
    f"""{layers('b', 't', 'f')}, o AS (SELECT f.id, t.ord, floor({_COMMON} * 1e14 + 0.5e0) AS i, {_COMMON} AS raw, (f.maxx - f.minx) * (f.maxy - f.miny) AS a,
      (f.maxx - f.minx) * (f.maxy - f.miny) - greatest(0e0, least(f.maxx, 19.92001e0) - greatest(f.minx, 19.9e0)) * greatest(0e0, least(f.maxy, 50.02001e0) - greatest(f.miny, 50e0)) AS out FROM f JOIN t ON {_TOUCH}),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i DESC, ord) AS k FROM o WHERE i > 0)
    SELECT id, CAST(count(*) AS BIGINT) AS holders, CAST(count(*) FILTER (WHERE raw >= greatest(1 / {M2!r}e0, 0.02e0 * a)) AS BIGINT) AS claims, max(CASE WHEN k = 1 THEN ord END) AS owner, CAST(floor(max(out) * 1e14 + 0.5e0) AS BIGINT) AS unheld FROM r GROUP BY id"""
)
def footprint_shares(spark, sf_dir):
    """Who holds each footprint: slices, claims above the floor, the largest holder, and the ground that nobody holds."""
    pairs = _pairs(spark, sf_dir)
    slots = F.sort_array(F.collect_list(F.struct("r_ord", "r_minx", "r_miny", "r_maxx", "r_maxy")))  # at most four territories meet
    rows = pairs.groupBy("id", "minx", "miny", "maxx", "maxy").agg(slots.alias("slots"))

    def run(r):
        roof, slots = _box(r), [(s["r_ord"], morph.box(s["r_minx"], s["r_miny"], s["r_maxx"], s["r_maxy"])) for s in r.slots]
        held = [(slots[k][0], _unit(size, 1e14), claims) for k, size, claims in board.shares([p for _, p in slots], roof, 1 / M2, 0.02)]
        held = [h for h in held if h[1] > 0]
        if not held:
            return []
        unheld = ov.area(ov.uncovered(roof, [p for _, p in slots]))
        return [(r.id, len(held), sum(h[2] for h in held), min((-h[1], h[0]) for h in held)[1], _unit(unheld, 1e14))]

    return boards.each(rows, run, "id long, holders long, claims long, owner long, unheld long")


_GAPS = """g AS (SELECT a.ord, a.minx + CASE WHEN a.ord % 5 > 0 THEN 1e-5 ELSE 0e0 END AS x0, a.miny + CASE WHEN a.ord >= 5 THEN 1e-5 ELSE 0e0 END AS y0, a.minx + CASE WHEN a.ord % 5 < 4 THEN 4e-3 ELSE 4.01e-3 END AS x1, a.miny + CASE WHEN a.ord < 20 THEN 4e-3 ELSE 4.01e-3 END AS y1 FROM t a WHERE a.ord % 7 = 3)"""


@query(
    f"""{layers('t')}, {_GAPS}, s AS (SELECT * FROM (VALUES (5e-6, 0e0), (-5e-6, 0e0), (0e0, 5e-6), (0e0, -5e-6)) v(dx, dy)),
    c AS (SELECT g.ord AS gap, t.ord, sum(greatest(0e0, least(g.x1 + dx, t.maxx) - greatest(g.x0 + dx, t.minx)) * greatest(0e0, least(g.y1 + dy, t.maxy) - greatest(g.y0 + dy, t.miny))) AS c FROM g CROSS JOIN s JOIN t ON t.ord % 7 <> 3 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY gap ORDER BY floor(c * 1e12 + 0.5e0) DESC, ord) AS k FROM c WHERE c > 0)
    SELECT CAST(row_number() OVER (ORDER BY floor((x1 - x0) * (y1 - y0) * 1e12 + 0.5e0) DESC, y0, x0) AS BIGINT) AS rank, {_BIG.format('(x1 - x0) * (y1 - y0)')} AS size, r.ord AS host, {_BIG.format('(t.maxx - t.minx) * (t.maxy - t.miny) + (x1 - x0) * (y1 - y0)')} AS joined, CAST(25 AS BIGINT) AS adopted
    FROM g JOIN r ON r.gap = g.ord AND k = 1 JOIN t ON t.ord = r.ord"""
)
def gap_adoption(spark, sf_dir):
    """The board without every seventh territory: gaps, the territory that each would join, and the board with all adopted."""

    def run(project, rows):
        own = [_box(r) for r in rows]
        found = morph.gaps(morph.box(19.9, 50.0, 19.92001, 50.02001), own, 200 / M2, 2e-5)
        everything = board.adopt(own, [board.as_polygon(g) for g in found])
        out = []
        for k, g in enumerate(found):
            after = board.absorb(own, board.as_polygon(g), 5e-6)
            host = next(j for j, p in enumerate(after) if p is not own[j])
            out.append((k + 1, _unit(ov.area(g)), rows[host].ord, _unit(board.area(after[host])), len(everything)))
        return out

    t = synth.territories(spark, sf_dir).where("ord % 7 <> 3").withColumn("project", F.lit(1))
    return boards.project(t, "project", "ord", run, "rank long, size long, host long, joined long, adopted long")


_SEAMS = """q AS (SELECT ord, greatest(19.9e0, minx - 1e-5) AS x0, greatest(50e0, miny - 1e-5) AS y0, least(19.92e0, minx + 4e-3) AS x1, least(50.02e0, miny + 4e-3) AS y1 FROM t WHERE ord % 7 = 3)"""


@query(f"{layers('t')}, {_SEAMS} SELECT CAST(row_number() OVER (ORDER BY floor((x1 - x0) * (y1 - y0) * 1e12 + 0.5e0) DESC, y0, x0) AS BIGINT) AS rank, CAST(floor((x1 - x0) * (y1 - y0) * {M2!r}e0 + 0.5e0) AS BIGINT) AS m2, CAST(count(*) OVER () AS BIGINT) AS gaps, CAST(floor(sum((x1 - x0) * (y1 - y0)) OVER () * {M2!r}e0 + 0.5e0) AS BIGINT) AS total FROM q")
def gap_list(spark, sf_dir):
    """Gaps of a board whose territories stand apart by a metre: the seams that join the gaps are opened away."""

    def run(project, rows):
        found = morph.gaps(morph.box(19.9, 50.0, 19.92, 50.02), [_box(r) for r in rows], 200 / M2, 2e-5)
        total = _unit(sum(map(ov.area, found)), M2)
        return [(k + 1, _unit(ov.area(g), M2), len(found), total) for k, g in enumerate(found)]

    t = synth.territories(spark, sf_dir, 0.00399).where("ord % 7 <> 3").withColumn("project", F.lit(1))
    return boards.project(t, "project", "ord", run, "rank long, m2 long, gaps long, total long")


@query(
    f"""{layers('t')}, c AS (SELECT ord, ord % 3 = 0 AS printed, (maxx - minx) * (maxy - miny) AS was, greatest(0e0, least(maxx, 19.9165e0) - greatest(minx, 19.9015e0)) * greatest(0e0, least(maxy, 50.0165e0) - greatest(miny, 50.0015e0)) AS now FROM t)
    SELECT ord // 5 AS project, CAST(count(*) FILTER (WHERE now * {M2!r}e0 >= 50) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE now * {M2!r}e0 < 50) AS BIGINT) AS dropped, CAST(count(*) FILTER (WHERE now * {M2!r}e0 >= 50 AND printed AND (was - now) * {M2!r}e0 > 1) AS BIGINT) AS unmarked, CAST(count(*) FILTER (WHERE (was - now) * {M2!r}e0 > 1) AS BIGINT) AS outside FROM c GROUP BY 1"""
)
def outer_change(spark, sf_dir):
    """A smaller boundary: territories kept, dropped and unmarked, and how many reach outside."""

    def run(project, rows):
        outer = morph.box(19.9015, 50.0015, 19.9165, 50.0165)
        slots = [(_box(r), r.ord % 3 == 0) for r in rows]
        kept, dropped, unmarked = board.replace_outer(slots, outer, 50 / M2, 1 / M2)
        outside = sum(ov.area(ov.difference(p, outer)) > 1 / M2 for p, _ in slots)
        return [(project, len(rows) - dropped, dropped, unmarked, outside)]

    return boards.project(_rows(spark, sf_dir), "project", "ord", run, "project long, kept long, dropped long, unmarked long, outside long")


@query(f"{layers('t')} SELECT ord, CAST(CASE WHEN ord % 2 = 0 THEN 1 ELSE 2 END AS BIGINT) AS kept, {_BIG.format('(maxx - minx) * (maxy - miny) / CASE WHEN ord % 2 = 0 THEN 1 ELSE 2 END')} AS largest FROM t")
def inhabited_parts(spark, sf_dir):
    """Parts of a boundary that hold a territory; without any the largest part stays."""

    def run(r):
        mid = (r.minx + r.maxx) / 2
        far = morph.box(r.maxx + 2, r.miny, r.maxx + 2 + (r.maxx - r.minx) / 3, r.maxy)
        outer = [*_box(r), *far] if r.ord % 2 == 0 else [*morph.box(r.minx, r.miny, mid, r.maxy), *morph.box(mid + 1, r.miny, r.maxx + 1, r.maxy), *far]
        inside = [morph.box(r.minx, r.miny, r.minx + 1e-4, r.miny + 1e-4)] + ([] if r.ord % 2 == 0 else [morph.box(mid + 1, r.miny, mid + 1.0001, r.miny + 1e-4)])
        own = board.keep_inhabited(outer, inside, 1 / M2)
        return [(r.ord, len(own), _unit(board.area(own[0])))]

    return boards.each(synth.territories(spark, sf_dir), run, "ord long, kept long, largest long")


@query(f"{layers('t')} SELECT ord, ord % 2 = 0 AS accepted, CAST(CASE WHEN ord % 2 = 0 THEN 2 END AS BIGINT) AS slots, CASE WHEN ord % 2 = 0 THEN {_BIG.format('(maxx - minx) * (maxy - miny) * 3 / 4')} END AS rest, CASE WHEN ord % 2 = 0 THEN {_BIG.format('(maxx - minx) * (maxy - miny) / 4')} END AS drawn FROM t")
def inner_polygons(spark, sf_dir):
    """A drawn territory is carved out of a placeholder, and refused on top of a deliberate one."""

    def run(r):
        w, h = r.maxx - r.minx, r.maxy - r.miny
        drawn = morph.box(r.minx - w, r.miny - h, r.minx + w / 2, r.miny + h / 2)
        after = board.add_inner([(_box(r), r.ord % 2 == 0)], drawn, _box(r), 1 / M2, 1 / M2)
        if after is None:
            return [(r.ord, False, None, None, None)]
        return [(r.ord, True, len(after), _unit(board.area(after[0][0])), _unit(board.area(after[1][0])))]

    return boards.each(synth.territories(spark, sf_dir), run, "ord long, accepted boolean, slots long, rest long, drawn long")


@query(f"{layers('t')} SELECT ord, {_BIG.format('CASE WHEN ord % 5 = 0 THEN 3e-3 ELSE 3.5e-3 END * (maxy - miny)')} AS size, CAST(1 AS BIGINT) AS parts FROM t")
def orphan_repair(spark, sf_dir):
    """Territories in two pieces: the smaller one joins the neighbour that it touches."""

    def run(project, rows):
        slots = []
        for k, r in enumerate(rows):
            own = morph.box(r.minx, r.miny, r.minx + 3e-3, r.maxy)
            if k + 1 < len(rows):
                x = rows[k + 1].minx + 3e-3
                own += morph.box(x, r.miny, x + 5e-4, r.maxy)
            slots.append(own)
        after = board.connect(slots, 5e-6, 25 / M2, 0.05, 5)
        return [(rows[k].ord, _unit(board.area(p)), len(board.pieces(p))) for k, p in enumerate(after)]

    return boards.project(_rows(spark, sf_dir), "project", "ord", run, "ord long, size long, parts long")


@query(
    f"""{layers('t')}, k AS (SELECT ord, (4e-3) * (4e-3) AS a, ord % 5 AS c FROM t)
    SELECT ord, CASE WHEN c = 1 THEN 6e-5 WHEN c = 2 THEN 4e-5 ELSE 0e0 END >= 2e-6 AS claimed, {_BIG.format('a + CASE WHEN c = 1 THEN 4e-5 * 1e-4 WHEN c = 2 THEN -4e-5 * 1e-4 ELSE 0e0 END')} AS size, CAST(1 AS BIGINT) AS parts FROM k"""
)
def footprint_repair(spark, sf_dir):
    """A footprint across the border of two territories moves to the one that holds most of it."""

    def run(project, rows):
        slots = [_box(r) for r in rows]
        x, y = rows[2].minx, (rows[2].miny + rows[2].maxy) / 2
        roof = morph.box(x - 6e-5, y - 5e-5, x + 4e-5, y + 5e-5)
        claims = {k for k, _, claims in board.shares(slots, roof, 1 / M2, 0.02) if claims}
        after = board.detach(slots, roof, 1 / M2, 0.02)
        return [(r.ord, k in claims, _unit(board.area(after[k])), len(board.pieces(after[k]))) for k, r in enumerate(rows)]

    return boards.project(_rows(spark, sf_dir, 0.004), "project", "ord", run, "ord long, claimed boolean, size long, parts long")


@query(f"{layers('t')} SELECT ord // 5 AS project, CAST(5 AS BIGINT) AS plain, CAST(1 AS BIGINT) AS healed, {_BIG.format('(max(minx) + 3.99e-3 - min(minx)) * 3.99e-3')} AS size FROM t GROUP BY 1")
def healed_union(spark, sf_dir):
    """Territories with hairline seams between them, joined plainly and with the seams closed."""

    def run(project, rows):
        own = [_box(r) for r in rows]
        whole = morph.healed(own, 1e-5)
        return [(project, len(ov.parts(ov.union_all(own))), len(ov.parts(whole)), _unit(ov.area(whole)))]

    return boards.project(_rows(spark, sf_dir, 0.00399), "project", "ord", run, "project long, plain long, healed long, size long")


@query(
    f"""{layers('b', 'f')}, c AS (SELECT id, (maxx - minx) * (maxy - miny) AS a, (maxx - minx) / 2 * ((maxy - miny) / 2) AS big, (maxx - minx) / 16 * ((maxy - miny) / 16) AS small FROM f)
    SELECT id, CAST(2 AS BIGINT) AS holes, TRUE AS holed, CAST(floor((a - big) * 1e14 + 0.5e0) AS BIGINT) AS kept, CAST(floor(a * 1e14 + 0.5e0) AS BIGINT) AS filled, CAST(floor((a - big - small) * 1e14 + 0.5e0) AS BIGINT) AS size, CAST(15 AS BIGINT) AS positions FROM c"""
)
def courtyards(spark, sf_dir):
    """Footprints with a large and a tiny hole: the tiny one goes, and both where courtyards are filled."""

    def run(r):
        w, h = r.maxx - r.minx, r.maxy - r.miny
        rings = [*_box(r), *morph.box(r.minx + w / 8, r.miny + h / 4, r.minx + w * 5 / 8, r.miny + h * 3 / 4), *morph.box(r.minx + w * 3 / 4, r.miny + h / 4, r.minx + w * 13 / 16, r.miny + h * 5 / 16), [(r.minx, r.miny)] * 2]
        rings = [q for q in rings if len(q) > 3]
        shape = ov.union_all([rings])
        inside = morph.holes(shape)
        return [(r.id, len(inside), bool(inside), _unit(ov.area(morph.without_holes(shape, w * h / 16)), 1e14), _unit(ov.area(morph.without_holes(shape)), 1e14), _unit(ov.area(shape), 1e14), sum(map(len, rings)))]

    return boards.each(synth.footprints(spark, sf_dir), run, "id long, holes long, holed boolean, kept long, filled long, size long, positions long")


@query(f"{layers('t')} SELECT ord, TRUE AS inside, CAST(5 AS BIGINT) AS vertices, CAST(5 AS BIGINT) AS simple, {_BIG.format('(maxx - minx) * (maxy - miny)')} AS size, CAST(floor((miny + maxy) / 2 * 1e6 + 0.5e0) AS BIGINT) AS lat, CAST(8 AS BIGINT) AS was FROM t")
def ring_repair(spark, sf_dir):
    """Rings with a zero-width tab and a bend of no size: cleaned, simplified, and a point inside."""

    def run(r):
        mid = (r.minx + r.maxx) / 2
        ring = [(r.minx, r.miny), (mid, r.miny), (mid, r.miny - 1e-3), (mid, r.miny), (r.maxx, r.miny), (r.maxx, r.maxy), (r.minx, r.maxy), (r.minx, r.miny)]
        clean = kernels.despike(ring, 0.01 / M2)
        simple = kernels.simplify_ring(clean, 1e-6)
        x, y = kernels.interior_point(simple)
        best = max((simple, simple[:2] + simple[:1]), key=lambda q: abs(kernels.ring_area(q)))
        return [(r.ord, r.minx < x < r.maxx and r.miny < y < r.maxy, len(best), len(simple), _unit(abs(kernels.ring_area(best))), int(y * 1e6 + 0.5), len(ring))]

    return boards.each(synth.territories(spark, sf_dir), run, "ord long, inside boolean, vertices long, simple long, size long, lat long, was long")


@query(
    f"""{layers('t')}, {_GAPS} SELECT ord, x0 = 19.9e0 OR y0 = 50e0 OR x1 > 19.92e0 OR y1 > 50.02e0 AS touches, {_BIG.format('2.001e-2 * 2.001e-2 - CASE WHEN x0 = 19.9e0 OR y0 = 50e0 OR x1 > 19.92e0 OR y1 > 50.02e0 THEN (x1 - x0) * (y1 - y0) ELSE 0 END')} AS boundary FROM g"""
)
def gap_dissolution(spark, sf_dir):
    """Gaps on the boundary are trimmed off it, others would join a territory."""

    def run(project, rows):
        outer, own = morph.box(19.9, 50.0, 19.92001, 50.02001), [_box(r) for r in rows if r.ord % 7 != 3]
        out = []
        for g in morph.gaps(outer, own, 200 / M2, 2e-5):
            x, y = min(t[2] for t in g), min(t[0] for t in g)
            touches = morph.meets_outline(g, outer, 1e-6)
            left = morph.trim_outer(outer, g, own + [_box(r) for r in rows if r.ord % 7 == 3 and not (r.minx <= x + 1e-9 < r.maxx and r.miny <= y + 1e-9 < r.maxy)], 1e-6) if touches else ov.union_all([outer])
            ord_ = next(r.ord for r in rows if r.ord % 7 == 3 and r.minx - 1e-9 <= x < r.maxx - 1e-4 and r.miny - 1e-9 <= y < r.maxy - 1e-4)
            out.append((ord_, touches, _unit(ov.area(left))))
        return out

    t = synth.territories(spark, sf_dir).withColumn("project", F.lit(1))
    return boards.project(t, "project", "ord", run, "ord long, touches boolean, boundary long")
