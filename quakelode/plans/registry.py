"""Registering queries with their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable:
        """Registers a query under its name, with the SQL (DuckDB) that gives its rows."""

        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def rounded_to(x: Column, digits: int) -> Column:
    """x rounded half away from zero in binary arithmetic, as SQL engines round doubles; no negative zero."""
    scale = float(10**digits)
    return F.when(F.isnan(x), x).otherwise(F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale + 0.0)


def km_sql(a: str, b: str, radius: str = "6371.0") -> str:
    """Haversine distance of a.latitude, a.longitude and b's."""
    h = f"pow(sin(radians({b}.latitude - {a}.latitude)/2), 2) + cos(radians({a}.latitude))*cos(radians({b}.latitude))*pow(sin(radians({b}.longitude - {a}.longitude)/2), 2)"
    return f"(2*{radius}::double*asin(sqrt(least(1.0::double, greatest(0.0::double, {h})))))"


def albers_sql(lat: str, lon: str) -> tuple[str, str]:
    """x and y in metres of the conic equal-area projection used by the planar distances, from its defining constants."""
    f = 1 / 298.257222101
    e = math.sqrt(f * (2 - f))

    def q(phi: float) -> float:
        return (1 - e**2) * (math.sin(phi) / (1 - e**2 * math.sin(phi) ** 2) - math.log((1 - e * math.sin(phi)) / (1 + e * math.sin(phi))) / (2 * e))

    def m2(phi: float) -> float:
        return math.cos(phi) ** 2 / (1 - e**2 * math.sin(phi) ** 2)

    p0, p1, p2 = map(math.radians, (23.0, 29.5, 45.5))
    n = (m2(p1) - m2(p2)) / (q(p2) - q(p1))
    c = m2(p1) + n * q(p1)
    s = f"sin(radians({lat}))"
    qs = f"({1 - e * e!r}::double*({s}/(1 - pow({e!r}::double*{s}, 2)) - ln((1 - {e!r}::double*{s})/(1 + {e!r}::double*{s}))/(2*{e!r}::double)))"
    rho = f"(6378137.0::double*sqrt({c!r}::double - {n!r}::double*{qs})/{n!r}::double)"
    rho0 = 6378137.0 * math.sqrt(c - n * q(p0)) / n
    theta = f"({n!r}::double*radians({lon} + 96.0::double))"
    return f"({rho}*sin({theta}))", f"({rho0!r}::double - {rho}*cos({theta}))"
