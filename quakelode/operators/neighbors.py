"""Exact neighbourhood joins in space and time without comparing all pairs."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakelode.constants import DAY, EARTH_KM
from quakelode.functions.geo import great_circle_km
from quakelode.operators.names import fresh

#: How much wider than the radius a bucket is, against rounding.
MARGIN = 1.0005
#: Time buckets in an interval: more of them meet fewer pairs in vain and part a swarm further, for more copies of the left rows.
PERIODS = 4
#: Left rows up to this many (times nine buckets, some 10 MB) are broadcast where a caller asks for it.
BROADCAST_ROWS = 10_000


def _bands(radius_km: float, earth_km: float) -> float:
    """Degrees of latitude in a band: a pair within the radius lies in one band or two adjacent ones."""
    return math.degrees(radius_km / earth_km) * MARGIN


def _columns_in(band: Column, height: float, radius_km: float, earth_km: float) -> Column:
    """Longitude buckets in a band, each wide enough for a pair whose other point lies in this band or a neighbour."""
    top = F.least(F.lit(90.0), (F.greatest(F.abs(band), F.abs(band + 1)) + 1) * height)
    reach = math.sin(min(math.pi / 2, radius_km / earth_km)) / F.greatest(F.cos(F.radians(top)), F.lit(1e-9))
    width = F.degrees(F.asin(F.least(F.lit(1.0), reach))) * MARGIN
    # where the circle may hold a pole, or has fewer than three buckets, the band is one bucket
    return F.when((reach >= 1) | (width > 120), 1).otherwise(F.floor(360 / width)).cast("int")


def unit_vector(lat: Column, lon: Column) -> list[Column]:
    """The place on the unit sphere."""
    return [F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))]


def chord2(km: float, earth_km: float) -> float:
    """Squared straight distance, in radii, of two places so far apart."""
    return 4 * math.sin(min(math.pi / 2, km / (2 * earth_km))) ** 2


def _band_of(x: Column, height: float) -> Column:
    return F.floor(x / height).cast("int")


def _bucket_of(x: Column, n: Column) -> Column:
    return F.least(F.floor((F.pmod(x + 180, F.lit(360.0))) / 360 * n), n - 1).cast("int")


def in_buckets(rows: DataFrame, radius_km: float, earth_km: float = EARTH_KM) -> DataFrame:
    """Adds band and bucket, the row's own place in the cut of space that neighbour_pairs uses."""
    height = _bands(radius_km, earth_km)
    rows = rows.withColumn("band", _band_of(F.col("latitude"), height)).withColumn("buckets", _columns_in(F.col("band"), height, radius_km, earth_km))
    return rows.withColumn("bucket", _bucket_of(F.col("longitude"), F.col("buckets"))).drop("buckets")


def in_near_buckets(rows: DataFrame, radius_km: float, earth_km: float = EARTH_KM) -> DataFrame:
    """Copies each row to the nine buckets at most that can hold what is within the radius of it."""
    height = _bands(radius_km, earth_km)
    rows = rows.withColumn("band", F.explode(F.array(*(_band_of(F.col("latitude"), height) + d for d in (-1, 0, 1)))))
    rows = rows.withColumn("buckets", _columns_in(F.col("band"), height, radius_km, earth_km))
    here = _bucket_of(F.col("longitude"), F.col("buckets"))
    return rows.withColumn("bucket", F.explode(F.array_distinct(F.array(*(F.pmod(here + d, F.col("buckets")).cast("int") for d in (-1, 0, 1)))))).drop("buckets")


def neighbour_pairs(left: DataFrame, right: DataFrame, radius_km: float, days: tuple[float, float] | None = None, earth_km: float = EARTH_KM, lat: str = "latitude", lon: str = "longitude", t: str = "t", strict: bool = False, broadcast_left: bool = False, chord: str | None = None) -> DataFrame:
    """All pairs of rows within the radius, with km; columns of right get the prefix ``r_``.

    days = (low, high): besides, low * 86400 <= left.t - right.t <= high * 86400 (t in epoch seconds); callers add what
    is strict at an end. strict: distance < radius, else <=. Places may lie anywhere on the globe.

    Space is cut into bands of latitude as high as the radius, and each band into buckets at least as wide as the radius
    reaches there; right rows keep their bucket, each left row looks into three buckets of three bands, and with days
    into the time buckets that its interval touches. So the join is an equi-join whose work follows the number of near
    pairs; a swarm is spread over time buckets, and what is still too much in one bucket is split by AQE's skewed join.
    left should be the smaller side; it is dealt to the session's number of tasks before it is copied, since a few bytes
    here make much trigonometry. broadcast_left: if it has BROADCAST_ROWS rows at most, right isn't shuffled at all.
    Places become points of the unit sphere once a row; straight distances, a few products, sort out all but the near
    pairs, for which alone km is computed. chord: the name of a column of
    squared straight distances, in place of km; then pairs beyond the radius by less than rounding may stay.
    """
    height = _bands(radius_km, earth_km)
    band_, col_, when_, n_, c2_, *axes = fresh([*left.columns, *(f"r_{c}" for c in right.columns)], "band", "bucket", "period", "buckets", "chord", "x", "y", "z", "r_x", "r_y", "r_z")
    span = None if days is None else max(1.0, (days[1] - days[0]) * DAY / PERIODS)

    def band(x: Column) -> Column:
        return F.floor(x / height).cast("int")

    def bucket(x: Column, n: Column) -> Column:
        return F.least(F.floor((F.pmod(x + 180, F.lit(360.0))) / 360 * n), n - 1).cast("int")

    r = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)).where(F.col(f"r_{lat}").isNotNull() & F.col(f"r_{lon}").isNotNull())
    r = r.withColumns(dict(zip(axes[3:], unit_vector(F.col(f"r_{lat}"), F.col(f"r_{lon}")), strict=True))).withColumn(band_, band(F.col(f"r_{lat}")))
    r = r.withColumn(col_, bucket(F.col(f"r_{lon}"), _columns_in(F.col(band_), height, radius_km, earth_km)))
    small = broadcast_left and left.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    l = left.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    l = l if small else l.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), *left.columns)
    l = l.withColumns(dict(zip(axes[:3], unit_vector(F.col(lat), F.col(lon)), strict=True)))
    l = l.withColumn(band_, F.explode(F.array(*(band(F.col(lat)) + d for d in (-1, 0, 1)))))
    l = l.withColumn(n_, _columns_in(F.col(band_), height, radius_km, earth_km))
    here = bucket(F.col(lon), F.col(n_))
    l = l.withColumn(col_, F.explode(F.array_distinct(F.array(*(F.pmod(here + d, F.col(n_)).cast("int") for d in (-1, 0, 1)))))).drop(n_)
    on = [band_, col_]
    if span is not None:
        r = r.withColumn(when_, F.floor(F.col(f"r_{t}") / span).cast("long"))
        first, last = (F.floor((F.col(t) - d * DAY) / span).cast("long") for d in (days[1], days[0]))
        l = l.withColumn(when_, F.explode(F.sequence(first, last)))
        on.append(when_)
    km = great_circle_km(F.col(lat), F.col(lon), F.col(f"r_{lat}"), F.col(f"r_{lon}"), earth_km)
    c2 = reduce(Column.__add__, ((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in zip(axes[:3], axes[3:], strict=True)))
    pairs = (r.join(F.broadcast(l), on) if small else l.join(r, on)).where(c2 <= chord2(radius_km, earth_km) * (1 + 1e-9))
    if days is not None:
        age = F.col(t) - F.col(f"r_{t}")
        pairs = pairs.where((age >= days[0] * DAY) & (age <= days[1] * DAY))
    pairs = pairs.withColumn(c2_, c2).drop(*on, *axes)
    if chord:  # callers that rarely need the distance take it from the places
        return pairs.withColumnRenamed(c2_, chord)
    pairs = pairs.drop(c2_).withColumn("km", km)
    return pairs.where(F.col("km") < radius_km if strict else F.col("km") <= radius_km)
