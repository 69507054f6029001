"""Column expressions on the sphere and on the projected plane."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quakelode.constants import EARTH_KM, EPSG_5070, GRID_STEP


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Haversine distance; rounding cannot push its argument out of [0, 1]."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def valid_place(lat: Column, lon: Column) -> Column:
    """Finite, and within the globe's bounds; false for null."""
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def floor_cell(x: Column, step: float = GRID_STEP) -> Column:
    """Integer index of the half-open cell that holds x, counted from 0 degrees."""
    return F.floor(x / step).cast("long")


def cell_centre(index: Column, step: float = GRID_STEP) -> Column:
    return index * step + step / 2


def clamped_index(x: Column, low: float, high: float, step: float) -> Column:
    """Index from the lower bound; the upper bound itself belongs to the last cell; null outside."""
    last = round((high - low) / step) - 1
    return F.when(x.between(low, high), F.least(F.floor((x - low) / step), F.lit(last)).cast("int"))


def cell_area_km2(south: Column, north: Column, west: Column, east: Column, radius: float) -> Column:
    return radius**2 * F.radians(east - west) * (F.sin(F.radians(north)) - F.sin(F.radians(south)))


def _albers() -> tuple[float, float, float, float, float]:
    e = math.sqrt(EPSG_5070["flattening"] * (2 - EPSG_5070["flattening"]))

    def q(phi: float) -> float:
        s = math.sin(phi)
        return (1 - e * e) * (s / (1 - (e * s) ** 2) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2)

    p0, p1, p2 = (math.radians(EPSG_5070[k]) for k in ("lat0", "lat1", "lat2"))
    n = (m(p1) ** 2 - m(p2) ** 2) / (q(p2) - q(p1))
    c = m(p1) ** 2 + n * q(p1)
    return e, n, c, EPSG_5070["semi_major"] * math.sqrt(c - n * q(p0)) / n, EPSG_5070["semi_major"]


def albers_xy(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Metres in the conic equal-area projection of the contiguous United States."""
    e, n, c, rho0, a = _albers()
    s = F.sin(F.radians(lat))
    q = (1 - e * e) * (s / (1 - F.pow(e * s, F.lit(2.0))) - F.ln((1 - e * s) / (1 + e * s)) / (2 * e))
    rho, theta = a * F.sqrt(c - n * q) / n, n * F.radians(lon - EPSG_5070["lon0"])
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def to_segment_m(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment in the plane; a segment of one point is that point."""
    dx, dy = x2 - x1, y2 - y1
    along = F.when(dx * dx + dy * dy > 0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)).otherwise(0.0)
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), along))
    return F.sqrt(F.pow(x - x1 - t * dx, F.lit(2.0)) + F.pow(y - y1 - t * dy, F.lit(2.0)))
