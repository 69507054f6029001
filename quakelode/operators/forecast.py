"""Forecast tables (cell_lat, cell_lon, issue_date, probability) and what is read from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakelode.constants import CLIP_GRID
from quakelode.operators.metrics import clipped

HOT = 0.2  #: forecasts above this stand out


def forecast_table(scored: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """One row for each cell and issue date, probabilities clipped; keys come with the rows, never by position."""
    return scored.select(F.col(lat).alias("cell_lat"), F.col(lon).alias("cell_lon"), "issue_date", clipped(F.col("p"), CLIP_GRID).alias("probability"))


def by_date(forecast: DataFrame, cells: Sequence[tuple[float, float]]) -> DataFrame:
    """A row a date and a column for each of the given cells: mean over duplicates, coordinates rounded to six places."""
    name = F.concat_ws("_", F.format_string("%.6f", F.round("cell_lat", 6)), F.format_string("%.6f", F.round("cell_lon", 6)))
    names = [f"{a:.6f}_{b:.6f}" for a, b in cells]
    return forecast.withColumn("cell", name).groupBy("issue_date").pivot("cell", names).agg(F.avg("probability"))


def long_matrix(forecast: DataFrame) -> DataFrame:
    """The same for any number of cells, a row for each date and cell."""
    return forecast.groupBy("issue_date", F.round("cell_lat", 6).alias("cell_lat"), F.round("cell_lon", 6).alias("cell_lon")).agg(F.avg("probability").alias("probability"))


def summary(forecast: DataFrame) -> DataFrame:
    """(issue_date, cells, missing, min, max and mean probability); missing ones take no part in these."""
    p = F.when(~F.isnan("probability"), F.col("probability"))
    return forecast.groupBy("issue_date").agg(F.count("*").alias("cells"), F.count_if(p.isNull()).alias("missing"), F.min(p).alias("min_p"), F.max(p).alias("max_p"), F.avg(p).alias("mean_p"))


def spacing(forecast: DataFrame, column: str) -> DataFrame:
    """One row: the median step between distinct coordinates."""
    step = F.col(column) - F.lag(column).over(Window.orderBy(column))
    return forecast.select(column).distinct().withColumn("step", step).agg(F.percentile("step", F.lit(0.5)).alias("spacing"))


def tile_edges(forecast: DataFrame, column: str) -> DataFrame:
    """(coordinate, low, high): edges half way to the neighbours, the outer ones as far as the inner."""
    w = Window.orderBy(column)
    d = forecast.select(column).distinct().withColumns({"before": F.lag(column).over(w), "after": F.lead(column).over(w)})
    low = F.coalesce((F.col(column) + F.col("before")) / 2, F.col(column) - (F.col("after") - F.col(column)) / 2)
    high = F.coalesce((F.col(column) + F.col("after")) / 2, F.col(column) + (F.col(column) - F.col("before")) / 2)
    return d.select(F.col(column).alias("coordinate"), low.alias("low"), high.alias("high"))


def hot_zones(forecast: DataFrame, above: float = HOT) -> DataFrame:
    """Cells and dates above the level, with their share of the largest probability of all."""
    top = forecast.agg(F.max("probability").alias("top"))
    return forecast.where(F.col("probability") > above).crossJoin(F.broadcast(top)).withColumn("heat", F.col("probability") / F.col("top")).drop("top")
