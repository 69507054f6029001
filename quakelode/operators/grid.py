"""Cells, issue dates and what is fixed for a cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakelode.constants import EARTH_MEAN_KM, FAULT_BUFFER_KM, GRID_STEP, LAT_MAX, LAT_MIN, LON_MAX, LON_MIN, RADIUS_KM
from quakelode.functions.geo import cell_area_km2, cell_centre, clamped_index, floor_cell
from quakelode.functions.times import date_seconds, month_index
from quakelode.operators.lines import nearest_line_km
from quakelode.operators.neighbors import neighbour_pairs


def grid(spark: SparkSession, step: float = GRID_STEP, bounds: tuple[float, float, float, float] = (LAT_MIN, LAT_MAX, LON_MIN, LON_MAX)) -> DataFrame:
    """(row, col, cell, bounds, centres, area_km2) of the regional grid."""
    south, north, west, east = bounds
    rows, cols = round((north - south) / step), round((east - west) / step)
    ids = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"), F.col("id").alias("cell"))
    out = ids.withColumns({"lat_min": south + F.col("row") * step, "lon_min": west + F.col("col") * step})
    out = out.withColumns({"lat_max": F.col("lat_min") + step, "lon_max": F.col("lon_min") + step})
    out = out.withColumns({"lat_center": (F.col("lat_min") + F.col("lat_max")) / 2, "lon_center": (F.col("lon_min") + F.col("lon_max")) / 2})
    return out.withColumn("area_km2", cell_area_km2(F.col("lat_min"), F.col("lat_max"), F.col("lon_min"), F.col("lon_max"), EARTH_MEAN_KM))


def cell_lookup(points: DataFrame, step: float = GRID_STEP, fail: bool = False) -> DataFrame:
    """Adds row and col of the regional grid; points outside have none, or raise."""
    row, col = clamped_index(F.col("latitude"), LAT_MIN, LAT_MAX, step), clamped_index(F.col("longitude"), LON_MIN, LON_MAX, step)
    if fail:
        outside = F.raise_error(F.concat_ws(" ", F.lit("outside the grid:"), "latitude", "longitude")).cast("int")
        row, col = F.coalesce(row, outside), F.coalesce(col, outside)
    return points.withColumns({"row": row, "col": col})


def active_cells(events: DataFrame, step: float = GRID_STEP) -> DataFrame:
    """(row, col, latitude, longitude): the cells, counted from 0 degrees, that ever hosted an event, with their centres."""
    cells = events.select(floor_cell(F.col("latitude"), step).alias("row"), floor_cell(F.col("longitude"), step).alias("col")).distinct()
    return cells.withColumns({"latitude": cell_centre(F.col("row"), step), "longitude": cell_centre(F.col("col"), step)})


def issue_calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(issue_date, issue_t, month): month starts from start to end."""
    first = F.trunc(F.date_add(F.lit(start).cast("date"), -1), "month")
    months = F.sequence(F.add_months(first, 1), F.lit(end).cast("date"), F.expr("interval 1 month"))
    dates = spark.range(1).select(F.explode(months).alias("issue_date"))
    return dates.select("issue_date", date_seconds(F.col("issue_date")).alias("issue_t"), month_index(F.col("issue_date")).alias("month"))


def scored_cells(spark: SparkSession, events: DataFrame, radius_km: float = RADIUS_KM) -> DataFrame:
    """(row, col, latitude, longitude) of regional cells whose centre has an event within the radius."""
    centres = grid(spark).select("row", "col", F.col("lat_center").alias("latitude"), F.col("lon_center").alias("longitude"))
    places = events.select("latitude", "longitude").distinct()
    return neighbour_pairs(centres, places, radius_km, broadcast_left=True).select(*centres.columns).distinct()


def with_statics(cells: DataFrame, coast: DataFrame, fault: DataFrame) -> DataFrame:
    """Adds coast_km and fault_km to cells keyed by (row, col)."""
    out = nearest_line_km(cells, coast, ["row", "col"], "coast_km")
    return nearest_line_km(out, fault, ["row", "col"], "fault_km", FAULT_BUFFER_KM)
