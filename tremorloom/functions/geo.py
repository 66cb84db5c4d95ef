"""Spherical and planar geometry as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Earth radius of the likelihood and that of the distance to traces, in km.
RADIUS_LIKELIHOOD = 6378.1
RADIUS_TRACE = 6371.0088


def wrapped_longitude(x: Column) -> Column:
    return F.pmod(x + 180.0, F.lit(360.0)) - 180.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS_LIKELIHOOD) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))))


def destination(lat: Column, lon: Column, distance: Column, bearing: Column, radius: float = RADIUS_LIKELIHOOD) -> tuple[Column, Column]:
    """Latitude and longitude reached from a point by distance (km) and bearing (radians)."""
    p, r = F.radians(lat), distance / radius
    q = F.asin(F.sin(p) * F.cos(r) + F.cos(p) * F.sin(r) * F.cos(bearing))
    turn = F.atan2(F.sin(bearing) * F.sin(r) * F.cos(p), F.cos(r) - F.sin(p) * F.sin(q))
    return F.degrees(q), wrapped_longitude(lon + F.degrees(turn))


def cell_area_km2(lat_low: Column, size: float, radius: float = RADIUS_TRACE) -> Column:
    return radius**2 * math.radians(size) * (F.sin(F.radians(lat_low + size)) - F.sin(F.radians(lat_low)))


def ulp(k: Column) -> Column:
    """Spacing of doubles just above a positive whole number."""
    return F.pow(F.lit(2.0), F.floor(F.log2(F.abs(k))) - 52)


def right_closed(x: Column) -> Column:
    """Cell of x where a cell holds its upper edge: ceil(nextafter(x, -inf)) - 1, written without nextafter.

    One step above an edge k, the next double down is k itself, so that point still belongs to the cell that ends at k.
    """
    k = F.ceil(x) - 1
    above_zero = F.lit(5e-324)
    step = F.when(k > 0, k + ulp(k.cast("double"))).when(k == 0, above_zero).otherwise(k + ulp(k.cast("double")) / F.when(F.log2(F.abs(k.cast("double"))) == F.floor(F.log2(F.abs(k.cast("double")))), 2.0).otherwise(1.0))
    return F.when(x == step, k - 1).otherwise(k).cast("long")


def left_closed(x: Column, nudge: float = 1e-9) -> Column:
    return F.floor(x + nudge).cast("long")


def clipped(x: Column, low: float, size: float, n: int) -> Column:
    """Cell of x with points outside drawn to the border."""
    return F.least(F.greatest(F.floor((x - low) / size), F.lit(0)), F.lit(n - 1)).cast("long")


def in_polygon(x: Column, y: Column, polygon: Sequence[tuple[float, float]], boundary: bool = True, tolerance: float = 1e-12) -> Column:
    """Even-odd test against a closed ring of (x, y). boundary: points on an edge count as inside."""
    inside, on = F.lit(False), F.lit(False)
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:], strict=False):
        if ay != by:
            crosses = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
            inside = inside != crosses
        if boundary:
            cross = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
            on |= (F.abs(cross) <= tolerance) & x.between(min(ax, bx) - tolerance, max(ax, bx) + tolerance) & y.between(min(ay, by) - tolerance, max(ay, by) + tolerance)
    return inside | on


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Planar distance from a point to a segment."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = F.when(length2 == 0, F.lit(0.0)).otherwise(((px - ax) * dx + (py - ay) * dy) / F.when(length2 == 0, F.lit(1.0)).otherwise(length2))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.sqrt(F.pow(px - ax - t * dx, 2) + F.pow(py - ay - t * dy, 2))


def local_xy(lat: Column, lon: Column, lat0: Column, lon0: Column, radius: float = RADIUS_TRACE) -> tuple[Column, Column]:
    """Equirectangular kilometres around a reference point."""
    return radius * F.radians(wrapped_longitude(lon - lon0)) * F.cos(F.radians(lat0)), radius * F.radians(lat - lat0)
