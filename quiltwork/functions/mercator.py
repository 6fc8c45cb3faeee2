"""Web-Mercator arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EQUATOR_M = 40075016.686


def world(zoom: Column) -> Column:
    return F.lit(256.0) * F.pow(F.lit(2.0), zoom)


def project(lng: Column, lat: Column, zoom: Column) -> tuple[Column, Column]:
    """Pixels at a (fractional) zoom; the sine is held within +-0.9999."""
    s = F.least(F.greatest(F.sin(F.radians(lat)), F.lit(-0.9999)), F.lit(0.9999))
    return (lng / 360 + 0.5) * world(zoom), (0.5 - F.log((1 + s) / (1 - s)) / (4 * F.pi())) * world(zoom)


def unproject(x: Column, y: Column, zoom: Column) -> tuple[Column, Column]:
    n = F.pi() * (1 - 2 * y / world(zoom))
    return (x / world(zoom) - 0.5) * 360, F.degrees(F.atan(F.sinh(n)))


def meters_per_pixel(lat: Column, zoom: Column) -> Column:
    return F.lit(EQUATOR_M) * F.cos(F.radians(lat)) / world(zoom)


def rotate(x: Column, y: Column, cx: Column, cy: Column, degrees: Column) -> tuple[Column, Column]:
    a = F.radians(degrees)
    dx, dy = x - cx, y - cy
    return cx + dx * F.cos(a) - dy * F.sin(a), cy + dx * F.sin(a) + dy * F.cos(a)


def tile_zoom(zoom: Column, offset: Column) -> Column:
    return F.least(F.lit(19), F.greatest(F.lit(3), F.floor(zoom + 0.5) - offset)).cast("int")


def nice_distance(most: Column) -> Column:
    """The largest 1, 2 or 5 times a power of ten that isn't above ``most``."""
    p = F.pow(F.lit(10.0), F.floor(F.log10(most)))
    return F.when(p * 5 <= most, p * 5).when(p * 2 <= most, p * 2).otherwise(p)


def wrap180(deg: Column) -> Column:
    return F.pmod(deg + 180, F.lit(360.0)) - 180


def snap_rotation(deg: Column) -> Column:
    """To the next multiple of 15 degrees if that is within 3."""
    near = F.floor(deg / 15 + 0.5) * 15
    return F.when(F.abs(deg - near) <= 3, near).otherwise(deg)


def fit_zoom(width: Column, height: Column, render: tuple[float, float], padding: float = 0.05, lowest: int = 3, highest: int = 19) -> Column:
    """The largest zoom at which an extent in pixels of zoom 0 fits a picture with padding."""

    def room(px: float, span: Column) -> Column:
        return px * (1 - 2 * padding) / F.greatest(F.lit(1e-9), span)

    return F.greatest(F.lit(float(lowest)), F.least(F.lit(float(highest)), F.log(F.least(room(render[0], width), room(render[1], height))) / F.log(F.lit(2.0))))


def label_points(zoom: Column, tile_zoom: Column, label_px: float, dpi: float) -> Column:
    """Printed height, in points, of labels that are so many pixels high on a tile."""
    return label_px * 72 / dpi * F.pow(F.lit(2.0), zoom - tile_zoom)
