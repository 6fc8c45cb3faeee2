"""Planar metric of small areas, as Column expressions (degrees in, metres out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiltwork.config import CONFIG


def lng_scale(lat: Column) -> Column:
    """Metres in a degree of longitude."""
    return F.lit(CONFIG.lng_m) * F.cos(F.radians(lat))


def dist_sq(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared metres, scaled at the pair's mid-latitude."""
    dx, dy = (bx - ax) * lng_scale((ay + by) / 2), (by - ay) * CONFIG.lat_m
    return dx * dx + dy * dy


def dist(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt(dist_sq(ax, ay, bx, by))


def bearing(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees clockwise from north, -180 to 180."""
    return F.degrees(F.atan2((bx - ax) * lng_scale((ay + by) / 2), (by - ay) * CONFIG.lat_m))


def angle_diff(a: Column, b: Column) -> Column:
    """Undirected acute angle, 0 to 90."""
    d = F.abs(a - b) % 180
    return F.when(d > 90, 180 - d).otherwise(d)


def closest_on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """struct(x, y, t, d): projection on a segment, clamped to it; a degenerate segment gives its start."""
    k = lng_scale(py)
    dx, dy = (bx - ax) * k, (by - ay) * CONFIG.lat_m
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * k * dx + (py - ay) * CONFIG.lat_m * dy) / n))).otherwise(0.0)
    x, y = ax + (bx - ax) * t, ay + (by - ay) * t
    ex, ey = (x - px) * k, (y - py) * CONFIG.lat_m
    return F.struct(x.alias("x"), y.alias("y"), t.alias("t"), F.sqrt(ex * ex + ey * ey).alias("d"))


def turn(ax, ay, bx, by, cx, cy) -> Column:
    """Orientation determinant of three points."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def between(ax, ay, bx, by, cx, cy) -> Column:
    """Is a collinear point c inside the box of a and b?"""
    return (F.least(ax, bx) <= cx) & (cx <= F.greatest(ax, bx)) & (F.least(ay, by) <= cy) & (cy <= F.greatest(ay, by))


def segments_meet(p, q, r, s) -> Column:
    """Do the closed segments p-q and r-s meet?  Points are (x, y) pairs of Columns."""
    d1, d2, d3, d4 = turn(*r, *s, *p), turn(*r, *s, *q), turn(*p, *q, *r), turn(*p, *q, *s)
    cross = (F.signum(d1) * F.signum(d2) < 0) & (F.signum(d3) * F.signum(d4) < 0)
    touch = ((d1 == 0) & between(*r, *s, *p)) | ((d2 == 0) & between(*r, *s, *q)) | ((d3 == 0) & between(*p, *q, *r)) | ((d4 == 0) & between(*p, *q, *s))
    return cross | touch


def crossing_point(p, q, r, s) -> Column:
    """Where the closed segments p-q and r-s cross, as a struct of x and y; null if they don't or run side by side."""
    (px, py), (qx, qy), (rx, ry), (sx, sy) = p, q, r, s
    ax, ay, bx, by = qx - px, qy - py, sx - rx, sy - ry
    across = ay * bx - ax * by
    t = ((ry - py) * bx - (rx - px) * by) / across
    u = ((ry - py) * ax - (rx - px) * ay) / across
    return F.when((F.abs(across) >= 1e-14) & t.between(0, 1) & u.between(0, 1), F.struct((px + t * ax).alias("x"), (py + t * ay).alias("y")))


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    f = 10.0**digits
    return F.floor(x * f + 0.5) / f


def boxes_overlap(a: str, b: str) -> Column:
    """Inclusive overlap of two boxes with columns minx..maxy under the given aliases."""
    c = F.col
    return (c(f"{a}.minx") <= c(f"{b}.maxx")) & (c(f"{b}.minx") <= c(f"{a}.maxx")) & (c(f"{a}.miny") <= c(f"{b}.maxy")) & (c(f"{b}.miny") <= c(f"{a}.maxy"))
