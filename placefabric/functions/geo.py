"""Geometry on degrees, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
EXTENT = 4096
WEB = 20037508.342789244


def haversine_km(lat1: Column, lng1: Column, lat2, lng2) -> Column:
    lat2, lng2 = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lat2, lng2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def in_box(lat: Column, lng: Column, sw_lat: float, sw_lng: float, ne_lat: float, ne_lng: float) -> Column:
    return lat.between(sw_lat, ne_lat) & lng.between(sw_lng, ne_lng)


def around(lat: float, km: float) -> tuple[float, float]:
    """Half height and width in degrees of a box that holds the circle."""
    d = math.degrees(km / EARTH_KM)
    return d, d / max(0.01, math.cos(math.radians(lat)))


def mercator_x(lng: Column) -> Column:
    return lng * (WEB / 180)


def mercator_y(lat: Column) -> Column:
    lat = F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), lat))
    return F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * (WEB / math.pi)


def tile_x(lng: Column, z: int) -> Column:
    n = 1 << z
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((lng + 180) / 360 * n))).cast("int")


def tile_y(lat: Column, z: int) -> Column:
    n = 1 << z
    y = F.floor((1 - mercator_y(lat) / WEB) / 2 * n)
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), y)).cast("int")


def tile_local(lat: Column, lng: Column, z: int) -> tuple[Column, Column]:
    """Coordinates within a tile, 0..4096, y downwards."""
    n = 1 << z
    x = (lng + 180) / 360 * n
    y = (1 - mercator_y(lat) / WEB) / 2 * n
    return F.round((x - F.floor(x)) * EXTENT).cast("int"), F.round((y - F.floor(y)) * EXTENT).cast("int")


def grid_cell(value: Column, low: float, high: float, side: int) -> Column:
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))
    return F.least(F.lit(side - 1), F.floor(ratio * side)).cast("int")


def grid_side(zoom: int) -> int:
    return 4 if zoom <= 12 else 5 if zoom <= 16 else 6


def zoom_of_span(span: float) -> int:
    """floor(log2(360 / span)), 1 to 22."""
    return max(1, min(22, math.floor(math.log2(360 / span)))) if span > 0 else 22


def zoom_for(span: Column) -> Column:
    """zoom_of_span of a column."""
    return F.when(span > 0, F.greatest(F.lit(1), F.least(F.lit(22), F.floor(F.log2(360 / span))))).otherwise(22).cast("int")


def reach(budget_min: Column, dwell_min: Column, loop: bool, walk_kmh: float = 4.5, detour: float = 1.35, least_min: float = 20) -> Column:
    """reach_km of columns."""
    return F.greatest(F.lit(float(least_min)), budget_min - dwell_min) / 60 * walk_kmh / detour / (2 if loop else 1)


def reach_km(budget_min: float, dwell_min: float, loop: bool, walk_kmh: float = 4.5, detour: float = 1.35, least_min: float = 20) -> float:
    """How far a walk can go in what the stays leave of the time; a loop goes half as far."""
    return max(least_min, budget_min - dwell_min) / 60 * walk_kmh / detour / (2 if loop else 1)
