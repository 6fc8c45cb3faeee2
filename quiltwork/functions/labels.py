"""Texts of labels, file names, and boxes on a printed page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least side of a box on a page, and how near an edge must be to be pulled on another, in points.
MIN_BOX_PT, SNAP_PT = 10.0, 4.0


def address(street: Column, number: Column, unit: Column) -> Column:
    """Street and number with the unit behind a slash; null without street and number."""
    base = F.nullif(F.concat_ws(" ", street, number), F.lit(""))
    return F.concat(base, F.coalesce(F.concat(F.lit("/"), unit), F.lit("")))


def title(name: Column, where: Column, kind: Column, fallback: str) -> Column:
    """The first known of name, address and kind; a kind of 'yes' says nothing."""
    return F.coalesce(name, where, F.when(kind != "yes", kind), F.lit(fallback))


def speed_text(speed: Column) -> Column:
    """Bare numbers get a unit; all else is shown as tagged."""
    return F.when(speed.rlike("^[0-9]+$"), F.concat(speed, F.lit(" km/h"))).otherwise(speed)


def street_facts(length: Column, lanes: Column, speed: Column) -> Column:
    """Whole metres (if positive), lanes and speed in one line; empty if none is known."""
    metres = F.when(length > 0, F.concat(F.floor(length + 0.5).cast("string"), F.lit(" m")))
    return F.concat_ws(" · ", metres, F.concat(lanes, F.lit(" lanes")), speed_text(speed))


def area_value(m2: Column) -> Column:
    """Whole square metres, or from a square kilometre on two decimals of those; null if not positive."""
    return F.when(m2 >= 1e6, F.floor(m2 / 1e4 + 0.5) / 100).when(m2 > 0, F.floor(m2 + 0.5).cast("double"))


def area_unit(m2: Column) -> Column:
    return F.when(m2 >= 1e6, "km²").when(m2 > 0, "m²")


def round_km2(km2: Column) -> Column:
    """Whole from 100 on, else two decimals."""
    return F.when(km2 >= 100, F.floor(km2 + 0.5).cast("double")).otherwise(F.floor(km2 * 100 + 0.5) / 100)


def meta_line(kind: Column, level: Column, km2: Column) -> Column:
    """Kind, admin level and area, those that are known."""
    return F.concat_ws(" · ", F.replace(kind, F.lit("_"), F.lit(" ")), F.concat(F.lit("level "), level), F.concat(F.regexp_replace(round_km2(km2).cast("string"), r"\.0$", ""), F.lit(" km²")))


def day(stamp: Column) -> Column:
    """The day of an ISO time as yyyy-MM-dd; of other texts the first ten characters."""
    return F.coalesce(F.date_format(F.try_to_timestamp(stamp), "yyyy-MM-dd"), F.substring(stamp, 1, 10))


def file_name(locality: Column, territory: Column, stamp: Column, extension: str) -> Column:
    """A safe lower-case file name; without a territory it ends in the time in seconds."""

    def part(text: Column) -> Column:
        return F.concat(F.lit("-"), F.regexp_replace(F.nullif(text, F.lit("")), r"\s+", "_"))

    name = F.concat(F.lit("territory_map"), F.coalesce(part(locality), F.lit("")), F.coalesce(part(territory), part(stamp.cast("string"))), F.lit(f".{extension}"))
    return F.lower(F.regexp_replace(name, r"[^a-zA-Z0-9_.\-]", "_"))


def language(known: tuple[str, ...], forced: Column, path: Column, preferred: Column, default: str) -> Column:
    """The first supported of an override, the first part of a path, and a list of preferences."""
    first = F.get(F.filter(F.split(path, "/"), lambda p: p != ""), F.lit(0))
    wish = F.get(F.filter(F.transform(preferred, lambda p: F.lower(F.substring(p, 1, 2))), lambda p: p.isin(*known)), F.lit(0))
    return F.coalesce(F.when(forced.isin(*known), forced), F.when(first.isin(*known), first), wish, F.lit(default))


# ---------------------------------------------------------------- page boxes: structs of x, y, width, height


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def to_screen(b: Column, scale: float, page_height: float) -> Column:
    """Points from the lower left to pixels from the upper left."""
    return F.struct((b["x"] * scale).alias("left"), ((page_height - b["y"] - b["height"]) * scale).alias("top"), (b["width"] * scale).alias("width"), (b["height"] * scale).alias("height"))


def to_page(r: Column, scale: float, page_height: float) -> Column:
    return box(r["left"] / scale, page_height - r["top"] / scale - r["height"] / scale, r["width"] / scale, r["height"] / scale)


def clamp_box(b: Column, page_width: float, page_height: float) -> Column:
    """Inside the page, and not smaller than the least side."""

    def side(v: Column, most: float) -> Column:
        return F.greatest(F.lit(MIN_BOX_PT), F.least(v, F.lit(most)))

    w, h = side(b["width"], page_width), side(b["height"], page_height)
    return box(F.greatest(F.lit(0.0), F.least(b["x"], page_width - w)), F.greatest(F.lit(0.0), F.least(b["y"], page_height - h)), w, h)


def snap_box(b: Column, targets: Column) -> Column:
    """Edges within a few points of a target's are pulled on it; targets act one after another."""

    def near(at: Column, to: Column) -> Column:
        return F.abs(at - to) < SNAP_PT

    def pull(held: Column, t: Column) -> Column:
        x = F.when(near(held["x"], t["x"]), t["x"]).otherwise(held["x"])
        y = F.when(near(held["y"], t["y"]), t["y"]).otherwise(held["y"])
        right, top = t["x"] + t["width"], t["y"] + t["height"]
        return box(x, y, F.when(near(x + held["width"], right), right - x).otherwise(held["width"]), F.when(near(y + held["height"], top), top - y).otherwise(held["height"]))

    return F.aggregate(targets, b, pull)
