"""Station positions: tables, reports, and what they say of a cell before an issue date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakelode.constants import RADIUS_KM
from quakelode.operators.neighbors import neighbour_pairs

PARTS = ["east_m", "north_m", "up_m"]


def wide(long: DataFrame) -> DataFrame:
    """One row for each (date, station): east, north, up."""
    return long.groupBy("date", "station_id", "latitude", "longitude").pivot("parameter", PARTS).agg(F.first("value", ignorenulls=True))


def summary(long: DataFrame) -> DataFrame:
    """One row: records, stations, first and last date, days, samples a station, and records of each parameter."""
    counts = [F.count_if(F.col("parameter") == p).alias(f"n_{p}") for p in PARTS]
    out = long.agg(F.count("*").alias("records"), F.countDistinct("station_id").alias("stations"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), *counts)
    return out.withColumn("days", F.datediff("last_date", "first_date")).withColumn("samples_per_station", F.try_divide("records", "stations"))


def quality(positions: DataFrame) -> DataFrame:
    """One row: mean days between samples of a station, share missing and spread of each part, busiest and quietest station (ties by name)."""
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy("station_id").orderBy("date")))
    each = positions.withColumn("gap", gap)
    aggs = [F.avg("gap").alias("mean_gap_days")]
    for p in PARTS:
        aggs += [F.avg(F.when(F.col(p).isNull(), 100.0).otherwise(0.0)).alias(f"{p}_missing_pct"), F.avg(p).alias(f"{p}_mean"), F.stddev_samp(p).alias(f"{p}_std"), F.min(p).alias(f"{p}_min"), F.max(p).alias(f"{p}_max")]
    n = positions.groupBy("station_id").agg(F.count("*").alias("n"))
    ends = n.agg(F.min(F.struct(-F.col("n"), "station_id"))["station_id"].alias("most_active"), F.min(F.struct("n", "station_id"))["station_id"].alias("least_active"))
    return each.agg(*aggs).crossJoin(F.broadcast(ends))


def intervals(positions: DataFrame) -> DataFrame:
    """(station_id, samples, mean_gap_days)."""
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy("station_id").orderBy("date")))
    return positions.withColumn("gap", gap).groupBy("station_id").agg(F.count("*").alias("samples"), F.avg("gap").alias("mean_gap_days"))


def station_cells(cells: DataFrame, positions: DataFrame, km: float = RADIUS_KM) -> DataFrame:
    """(row, col, station_id): stations within the radius of a cell's centre."""
    stations = positions.select("station_id", "latitude", "longitude").distinct()
    return neighbour_pairs(cells.select("row", "col", "latitude", "longitude"), stations, km, broadcast_left=True).select("row", "col", F.col("r_station_id").alias("station_id")).distinct()


def last_before(positions: DataFrame, queries: DataFrame, shift_days: int, prefix: str) -> DataFrame:
    """queries (station_id, issue_date) with the station's last position strictly before issue_date - shift_days.

    One ordered pass over samples and queries of a station together; nulls where there is none.
    """
    none = [F.lit(None).cast("double").alias(p) for p in PARTS]
    asked = queries.select("station_id", F.date_sub("issue_date", shift_days).alias("date"), "issue_date", F.lit(0).alias("kind"), *none)
    have = positions.select("station_id", "date", F.lit(None).cast("date").alias("issue_date"), F.lit(1).alias("kind"), *PARTS)
    w = Window.partitionBy("station_id").orderBy("date", "kind").rowsBetween(Window.unboundedPreceding, -1)
    # a sample's parts go together: its own nulls must not be filled from an older one
    sample = F.last(F.when(F.col("kind") == 1, F.struct(*PARTS)), ignorenulls=True).over(w)
    both = asked.unionByName(have).withColumn("s", sample).where("kind = 0")
    return both.select("station_id", "issue_date", *(F.col(f"s.{p}").alias(f"{prefix}{p}") for p in PARTS))


def baseline(positions: DataFrame, queries: DataFrame, first: int = 395, last: int = 30) -> DataFrame:
    """queries with the station's mean position over [issue_date - first, issue_date - last] days, both ends included.

    From running sums by day: two as-of reads a query, whatever the length of the interval.
    """
    w = Window.partitionBy("station_id").orderBy("date", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    have = positions.select("station_id", "date", F.lit(None).cast("date").alias("issue_date"), F.lit(1).alias("kind"), *PARTS)
    none = [F.lit(None).cast("double").alias(p) for p in PARTS]
    ends = queries.select("station_id", F.date_sub("issue_date", last).alias("date"), "issue_date", F.lit(2).alias("kind"), *none).unionByName(queries.select("station_id", F.date_sub("issue_date", first).alias("date"), "issue_date", F.lit(0).alias("kind"), *none))
    rows = have.unionByName(ends)
    sums = {f"s_{p}": F.coalesce(F.sum(p).over(w), F.lit(0.0)) for p in PARTS} | {f"n_{p}": F.count(p).over(w) for p in PARTS}
    rows = rows.withColumns(sums).where("kind <> 1")
    sign = F.when(F.col("kind") == 2, 1).otherwise(-1)
    means: list[Column] = [F.try_divide(F.sum(sign * F.col(f"s_{p}")), F.sum(sign * F.col(f"n_{p}"))).alias(f"base_{p}") for p in PARTS]
    return rows.groupBy("station_id", "issue_date").agg(*means)


def cell_features(cells: DataFrame, issues: DataFrame, positions: DataFrame) -> DataFrame:
    """(row, col, issue_date, six columns): mean over near stations of the last position less its baseline and less that a year before.

    Stations without a position before the date are left out, missing parts are ignored, and what is missing at all is 0.
    """
    near = station_cells(cells, positions)
    asked = near.select("station_id").distinct().crossJoin(F.broadcast(issues.select("issue_date")))
    now = last_before(positions, asked, 0, "now_")
    all_ = now.join(last_before(positions, asked, 365, "year_"), ["station_id", "issue_date"]).join(baseline(positions, asked), ["station_id", "issue_date"])
    names = {"east_m": "east", "north_m": "north", "up_m": "up"}
    each = all_.select("station_id", "issue_date", *((F.col(f"now_{p}") - F.col(f"base_{p}")).alias(f"{n}_anomaly") for p, n in names.items()), *((F.col(f"now_{p}") - F.col(f"year_{p}")).alias(f"{n}_year") for p, n in names.items()))
    cols = [f"{n}_{k}" for k in ("anomaly", "year") for n in names.values()]
    found = near.join(each, "station_id").groupBy("row", "col", "issue_date").agg(*(F.avg(c).alias(c) for c in cols))
    return cells.select("row", "col").crossJoin(F.broadcast(issues.select("issue_date"))).join(found, ["row", "col", "issue_date"], "left").fillna(0.0, cols)
