"""Reading, checking, merging and publishing catalogues."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakelode.constants import COMPLETENESS, DAY
from quakelode.functions.geo import valid_place
from quakelode.functions.times import epoch_seconds, utc
from quakelode.operators.names import fresh
from quakelode.sources.paths import shared_dir

OBSERVATIONS = T.StructType([T.StructField(n, T.StringType() if n in ("source", "station_id", "parameter") else T.TimestampType() if n == "time" else T.DoubleType()) for n in ("source", "time", "latitude", "longitude", "depth_km", "magnitude", "station_id", "parameter", "value")])
REQUIRED = ("source", "time", "latitude", "longitude", "magnitude")


def read_observations(spark: SparkSession, path: str, split: str) -> DataFrame:
    """The long table of one split, from Parquet or (by its ending) CSV, with a split column."""
    if path.endswith((".csv", ".csv.gz")):
        raw = spark.read.csv(path, header=True)
        check_header(raw.columns, OBSERVATIONS.names)
        text = {"time": utc(F.col("time"))}
        typed = [text.get(f.name, F.col(f.name).try_cast(f.dataType) if f.dataType != T.StringType() else F.col(f.name)).alias(f.name) for f in OBSERVATIONS]
        return raw.select(*typed, F.lit(split).alias("split"))
    return spark.read.schema(OBSERVATIONS).parquet(path).withColumn("split", F.lit(split))


def check_header(columns: Sequence[str], expected: Sequence[str] | None = None, required: Sequence[str] = REQUIRED) -> None:
    """Unique names, the required ones among them, and as a set the expected ones; order is free."""
    names = [c.lstrip("﻿") for c in columns]
    if len(set(names)) != len(names) or not all(names):
        raise ValueError(f"missing or duplicate column names: {names}")
    if missing := set(required) - set(names):
        raise ValueError(f"missing columns: {sorted(missing)}")
    if expected is not None and set(names) != set(expected):
        raise ValueError(f"columns differ: {sorted(set(names) ^ set(expected))}")


def seismic(observations: DataFrame) -> DataFrame:
    return observations.where(F.lower(F.trim("source")) == "seismic")


def complete(events: DataFrame, least: float = COMPLETENESS) -> DataFrame:
    return events.where(F.col("magnitude") >= least)


def row_reason(time: Column, latitude: Column, longitude: Column, magnitude: Column) -> Column:
    """Why a row of text fields is no event: the first of time, place, magnitude that is none; null for an event."""
    number = lambda c: c.try_cast("double")
    finite = lambda c: F.coalesce(~F.isnan(number(c)) & (F.abs(number(c)) != float("inf")), F.lit(False))
    place = finite(latitude) & finite(longitude) & valid_place(number(latitude), number(longitude))
    return F.when(utc(time).isNull(), "time").when(~place, "place").when(~finite(magnitude), "magnitude")


def validated(raw: DataFrame, mode: str = "skip") -> DataFrame:
    """Events of a table of text fields: ``fail`` raises at the first bad row, ``skip`` drops it, ``flag`` keeps it with its reason."""
    reason = row_reason(*(F.col(c) for c in ("time", "latitude", "longitude", "magnitude")))
    out = raw.withColumn("reason", reason)
    if mode == "fail":
        checked = F.when(F.col("reason").isNotNull(), F.raise_error(F.concat(F.lit("invalid "), "reason"))).otherwise(F.lit(True))
        out = out.where(checked.cast("boolean"))
    elif mode == "skip":
        out = out.where(F.col("reason").isNull())
    typed = {"time": utc(F.col("time"))} | {c: F.col(c).try_cast("double") for c in ("latitude", "longitude", "magnitude")}
    out = out.withColumns(typed)
    return out if mode == "flag" else out.drop("reason")


def combine(tables: Sequence[DataFrame], keep_duplicates: bool = False, time: str = "time") -> DataFrame:
    """All records in time order with their first place, exact whole records once: (columns of the first, file_no, row_no).

    Records are compared as text. The place is (table, its own row id), so that the first of equal records is the
    one that stays, and equal times stay in the order of the inputs.
    """
    names = tables[0].columns
    check_header(names, required=("source", time))
    parts = []
    for k, t in enumerate(tables):
        check_header(t.columns, names, required=("source", time))
        parts.append(t.select(*(F.col(c).cast("string").alias(c) for c in names)).withColumn("file_no", F.lit(k)).withColumn("row_no", F.monotonically_increasing_id()))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    if not keep_duplicates:
        first = F.min(F.struct("file_no", "row_no")).alias("first")
        rows = rows.groupBy(*names).agg(first).select(*names, "first.file_no", "first.row_no")
    return rows.orderBy(utc(F.col(time)), "file_no", "row_no")


def combine_stats(tables: Sequence[DataFrame]) -> DataFrame:
    """(input_rows, output_rows, duplicates_removed)."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    each = rows.groupBy(*tables[0].columns).agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("input_rows"), F.count("*").alias("output_rows")).withColumn("duplicates_removed", F.col("input_rows") - F.col("output_rows"))


def publish(observations: DataFrame, features: DataFrame, key: str = "event_id") -> DataFrame:
    """All rows and columns of observations, features in place of columns of their names, null for rows without any."""
    names = [c for c in features.columns if c != key]
    return observations.drop(*names).join(features, key, "left")


def in_study(events: DataFrame, start: int, end: int, bounds: tuple[float, float, float, float], days: float, least: float) -> DataFrame:
    """Possible parents (after start - days, before end, above least) with is_target: from start on and in the rectangle."""
    south, north, west, east = bounds
    t = epoch_seconds(F.col("time")) if "t" not in events.columns else F.col("t")
    parents = events.where((F.col("magnitude") > least) & (t > start - days * 86400) & (t < end))
    return parents.withColumn("is_target", (t >= start) & F.col("latitude").between(south, north) & F.col("longitude").between(west, east))


def duplicate_events(events: DataFrame) -> DataFrame:
    """Times, places and magnitudes that occur more than once, and how often; a fit refuses a table that has any."""
    return events.groupBy("time", "latitude", "longitude", "magnitude").agg(F.count("*").alias("n")).where("n > 1")


def without_repeats(events: DataFrame) -> DataFrame:
    """(event_id, t, latitude, longitude, magnitude), events of one time, place and magnitude once, with the smallest of their ids."""
    return events.groupBy("t", "latitude", "longitude", "magnitude").agg(F.min("event_id").alias("event_id"))


def chronological(events: DataFrame, keys: Sequence[str] = ("split",)) -> DataFrame:
    """Adds ordinal: the place of each event in its split by time, then id.

    Events are counted by day first and ordered within a day, so a split is not sorted in one task.
    """
    day, before = fresh(events.columns, "day", "before")
    rows = events.withColumn(day, F.floor(F.col("t") / DAY))
    upto = F.sum(before).over(Window.partitionBy(*keys).orderBy(day)) - F.col(before)
    counts = rows.groupBy(*keys, day).agg(F.count("*").alias(before)).select(*keys, day, upto.alias(before))
    own = F.row_number().over(Window.partitionBy(*keys, day).orderBy("t", "event_id"))
    return rows.join(counts, [*keys, day]).withColumn("ordinal", F.col(before) + own).drop(day, before)


def history(events: DataFrame, split: str) -> DataFrame:
    """Events that features of a split may use: its own and all earlier splits'."""
    order = ["train", "test", "judge"]
    return events.where(F.col("split").isin(order[: order.index(split) + 1]))


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet in one committed job: readers see the old table or the new one."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: what several jobs read is computed once, and no executor's loss undoes it."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """One row of nested fields as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)
