"""Streaming catalogue jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quakelode.functions.geo import floor_cell, valid_place

KEYS = ["time", "latitude", "longitude", "depth_km", "magnitude"]


def ingest(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Valid events of a stream, exact records once within the watermark; state is dropped as the watermark moves on.

    Records at or before the watermark, which follows the latest valid event by ``late``, are dropped; a batch is held
    against the watermark that stood when the batch before it began, as Spark does for all stateful operators. events: time and the
    columns of KEYS. What came in and what was no event is counted on the way (see account()).
    """
    valid = F.col("time").isNotNull() & valid_place(F.col("latitude"), F.col("longitude")) & F.col("magnitude").isNotNull() & ~F.isnan("magnitude")
    valid = F.coalesce(valid, F.lit(False))
    seen = events.observe("ingest", F.count("*").alias("rows"), F.count_if(~valid).alias("invalid"))
    return seen.where(valid).withWatermark("time", late).dropDuplicatesWithinWatermark(KEYS)


def account(query: StreamingQuery) -> dict[str, int]:
    """What an ingest did with its rows: read, invalid, late (dropped at the watermark), repeated and kept.

    From the progress of the batches that the session still holds (spark.sql.streaming.numRecentProgressUpdates of them).
    """
    out = dict.fromkeys(("rows", "invalid", "late", "kept"), 0)
    for p in query.recentProgress:
        seen = p.observedMetrics.get("ingest")
        if seen is not None and p.numInputRows:
            out["rows"] += seen["rows"]
            out["invalid"] += seen["invalid"]
        for s in p.stateOperators:
            out["late"] += s.numRowsDroppedByWatermark
            out["kept"] += s.numRowsUpdated
    return out | {"repeated": out["rows"] - out["invalid"] - out["late"] - out["kept"]}


def rolling_counts(events: DataFrame, late: str = "2 days", length: str = "30 days") -> DataFrame:
    """(window_start, window_end, row, col, n): events of each half-degree cell in windows that begin every day, in epoch seconds.

    Events are counted by cell and day first; each count, and not each event, goes to the windows that hold its day.
    """
    daily = events.withWatermark("time", late).groupBy(F.window("time", "1 day").alias("d"), floor_cell(F.col("latitude")).alias("row"), floor_cell(F.col("longitude")).alias("col")).agg(F.count("*").alias("n"))
    at = daily.select(F.window_time("d").alias("at"), "row", "col", "n")
    cells = at.groupBy(F.window("at", length, "1 day").alias("w"), "row", "col").agg(F.sum("n").alias("n"))
    return cells.select(F.unix_timestamp(F.col("w.start")).alias("window_start"), F.unix_timestamp(F.col("w.end")).alias("window_end"), "row", "col", "n")


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All input that is there now, into Parquet; a rerun goes on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
