"""Small facts about features, views, templates and settings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiltwork.config import CONFIG
from quiltwork.functions import metric


def may_have_outline(kind: Column, osm_id: Column) -> Column:
    """Ways and relations with an id can be looked up."""
    return F.coalesce(kind.isin("way", "relation") & osm_id.isNotNull(), F.lit(False))


def grew_beyond(minx: Column, miny: Column, maxx: Column, maxy: Column, data: tuple[float, float, float, float], slack: float = 1e-6) -> Column:
    """Does a box exceed the downloaded bounds by more than ``slack``?"""
    return (minx < data[0] - slack) | (miny < data[1] - slack) | (maxx > data[2] + slack) | (maxy > data[3] + slack)


def gap_matches(printed_axis: Column, flag_axis: Column) -> Column:
    """A gap is always flagged and never printed."""
    return (printed_axis <= 0) & (flag_axis >= 0)


def pool_key(osm_id: Column, index: Column) -> Column:
    """``osm:<id>``, else ``ix:<index>``."""
    return F.coalesce(F.concat(F.lit("osm:"), osm_id.cast("string")), F.concat(F.lit("ix:"), index.cast("string")))


def is_big(minx: Column, miny: Column, maxx: Column, maxy: Column, cell_m: float) -> Column:
    """Spans more than two cells in one direction."""
    return (((maxx - minx) * metric.lng_scale((miny + maxy) / 2)) > 2 * cell_m) | (((maxy - miny) * CONFIG.lat_m) > 2 * cell_m)


def is_tiny(span_px: Column, least: float = 24.0) -> Column:
    return span_px < least


def claim_floor(area_m2: Column) -> Column:
    """What a territory must hold of a footprint to claim it."""
    return F.greatest(F.lit(CONFIG.slice_m2), area_m2 * CONFIG.slice_share)


def territory_names(number: Column, locality: Column) -> Column:
    """The number, the number with a leading zero below ten, the locality with the number."""
    text = number.cast("string")
    return F.array_compact(F.array(text, F.when(number < 10, F.concat(F.lit("0"), text)), F.concat_ws(" ", locality, F.when(locality.isNotNull(), text))))


def number_text(value: Column, mark: str) -> Column:
    """Whole numbers with a mark between groups of three."""
    return F.regexp_replace(F.format_number(value, 0), ",", mark)


def json_or(text: Column, field: str, fallback: Column) -> Column:
    """A field of a JSON text, else the fallback."""
    return F.coalesce(F.get_json_object(text, f"$.{field}"), fallback)


def store_root(template: Column) -> Column:
    """The folder of a tile store: the digest of its address template."""
    return F.sha1(template)


def in_store(path: Column, root: Column) -> Column:
    return F.get(F.split(path, "/"), 0) == root


def template_id(name: Column, size: Column, mtime: Column, content: Column) -> Column:
    """The first 8 bytes of the content's SHA-256; without content a safe name:size:mtime."""
    safe = F.regexp_replace(F.concat_ws(":", name, size.cast("string"), mtime.cast("string")), "[^A-Za-z0-9:._-]", "_")
    return F.when(content.isNotNull(), F.substring(F.sha2(content, 256), 1, 16)).otherwise(safe)


def layout_is_current(version: Column, manual: Column, now: int) -> Column:
    """Layouts made by hand survive a new version."""
    return F.coalesce(manual, F.lit(False)) | F.coalesce(version == now, F.lit(False))


def snap_radius(pixels: Column, meters_per_pixel: Column) -> Column:
    return F.greatest(F.lit(2.0), F.least(F.lit(40.0), pixels * meters_per_pixel))


def detail(reach: Column, wanted: Column) -> Column:
    """The wanted detail, from 0 to 15 metres below the reach."""
    return F.greatest(F.lit(0.0), F.least(wanted, reach - 15))


def accepts_detour(route_m: Column, direct_m: Column) -> Column:
    """A way is taken if it is at most 1.75 times and 300 m longer than the straight line."""
    return F.coalesce((route_m <= direct_m * CONFIG.detour_ratio) & (route_m - direct_m <= CONFIG.detour_extra_m), F.lit(False))


def bounds_of(own: Column, parsed: Column) -> Column:
    """The geometry's envelope, else the bounds that were given as text: south, north, west, east."""
    value = lambda k: F.expr("NULL").cast("double") if k is None else F.get(parsed, k).try_cast("double")
    given = F.struct(value(2).alias("minx"), value(0).alias("miny"), value(3).alias("maxx"), value(1).alias("maxy"))
    whole = given["minx"].isNotNull() & given["miny"].isNotNull() & given["maxx"].isNotNull() & given["maxy"].isNotNull()
    return F.coalesce(own, F.when(whole, given))


def affine(a: Column, b: Column) -> Column:
    """Product of two 2 x 3 matrices (arrays of six); ``b`` is applied first."""
    m, n = (lambda k: a[k]), (lambda k: b[k])
    return F.array(
        m(0) * n(0) + m(2) * n(1), m(1) * n(0) + m(3) * n(1), m(0) * n(2) + m(2) * n(3), m(1) * n(2) + m(3) * n(3), m(0) * n(4) + m(2) * n(5) + m(4), m(1) * n(4) + m(3) * n(5) + m(5)
    )


def affine_box(m: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Box of a transformed rectangle."""
    corners = [(px, py) for px in (x, x + w) for py in (y, y + h)]
    xs, ys = (F.array(*[m[k] * px + m[k + 2] * py + m[k + 4] for px, py in corners]) for k in (0, 1))
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))


def holds_all(box: Column, points: Column) -> Column:
    return F.forall(points, lambda p: (p["x"] >= box["x"]) & (p["x"] <= box["x"] + box["w"]) & (p["y"] >= box["y"]) & (p["y"] <= box["y"] + box["h"]))


def luma(r: Column, g: Column, b: Column) -> Column:
    """BT.709, rounded."""
    return F.least(F.lit(255), F.floor(r * 0.2126 + g * 0.7152 + b * 0.0722 + 0.5))


def curve(value: Column, table: list[float]) -> Column:
    """Piecewise-linear curve through equally spaced values from 0 to 1, for a byte."""
    at = value / 255.0 * (len(table) - 1)
    k = F.least(F.lit(len(table) - 2), F.floor(at)).cast("int")
    points = F.array(*[F.lit(float(t)) for t in table])
    low, high = F.get(points, k), F.get(points, k + 1)
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((low + (high - low) * (at - k)) * 255 + 0.5)))


def sharpen(center: Column, up: Column, down: Column, left: Column, right: Column, amount: float) -> Column:
    """The middle of a 3 x 3 convolution."""
    v = center * (1 + 4 * amount) - (up + down + left + right) * amount
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v + 0.5)))


def rotated(x: Column, y: Column, degrees: float, lng: float, lat: float) -> tuple[Column, Column]:
    """Local metres, turned, as longitude and latitude with six digits."""
    import math

    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    k = CONFIG.lng_m * math.cos(math.radians(lat))
    r = lambda v: F.floor(v * 1e6 + 0.5) / 1e6
    return r(F.lit(lng) + (x * c - y * s) / k), r(F.lit(lat) + (x * s + y * c) / CONFIG.lat_m)


def notched(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box without its upper right quarter, as a ring."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    return F.array(p(x0, y0), p(x1, y0), p(x1, my), p(mx, my), p(mx, y1), p(x0, y1), p(x0, y0))


def near_ring(ring: Column, x: Column, y: Column, tolerance: float) -> Column:
    """Is a point within ``tolerance`` degrees of some edge of a closed ring?"""
    from quiltwork.functions.ring import edges

    def close(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        n = dx * dx + dy * dy
        t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy) / n))).otherwise(F.lit(0.0))
        return F.hypot(e["a"]["x"] + t * dx - x, e["a"]["y"] + t * dy - y) <= tolerance

    return F.exists(edges(ring), close)


def path_length(line: Column) -> Column:
    """Metres along an array of struct(x, y)."""
    pairs = F.transform(F.slice(line, F.lit(1), F.size(line) - 1), lambda p, i: F.struct(p.alias("a"), F.get(line, i + 1).alias("b")))
    return F.aggregate(pairs, F.lit(0.0), lambda s, e: s + metric.dist(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))


def same_place(ax: Column, ay: Column, bx: Column, by: Column, tolerance: float = 1e-9) -> Column:
    return (F.abs(ax - bx) < tolerance) & (F.abs(ay - by) < tolerance)


def rounded(value: Column, digits: int = 5) -> Column:
    """Half up; 0 digits count as 5."""
    f = float(10 ** (digits or 5))
    return F.floor(value * f + 0.5) / f


def snap_rotation(degrees: Column, step: float = 15.0, reach: float = 3.0) -> Column:
    """Angles within ``reach`` of a multiple of ``step`` are pulled on it."""
    near = F.floor(degrees / step + 0.5) * step
    return F.when(F.abs(degrees - near) <= reach, near).otherwise(degrees)
