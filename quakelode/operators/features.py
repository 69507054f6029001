"""What was known of a cell before an issue date, and what came after it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakelode.constants import BAND_DAYS, COUNT_DAYS, DAY, DIST_MAX, EARTH_MEAN_KM, MAGNITUDE_DAYS, NO_EVENT_DAYS, RADIUS_KM, TARGET_MAGNITUDE, TIDE_SCALE_KM, WINDOW_DAYS
from quakelode.functions.geo import valid_place
from quakelode.functions.times import date_seconds, day_of, month_index
from quakelode.operators.bands import band_names, band_sums
from quakelode.operators.neighbors import neighbour_pairs

CELL, PLACE = ["row", "col"], ["latitude", "longitude"]


def near_events(cells: DataFrame, events: DataFrame, radius_km: float = RADIUS_KM) -> DataFrame:
    """(row, col, t, magnitude, km, and other columns of events): each event near each cell, whatever the issue dates."""
    pairs = neighbour_pairs(cells.select(*CELL, "latitude", "longitude"), events, radius_km, broadcast_left=True)
    own = [c for c in events.columns if c not in ("latitude", "longitude")]
    return pairs.select(*CELL, *(F.col(f"r_{c}").alias(c) for c in own), "km")


def spine(cells: DataFrame, issues: DataFrame) -> DataFrame:
    """Every cell at every issue date; the calendar is a few hundred rows for a lifetime of months."""
    return cells.crossJoin(F.broadcast(issues))


def _at_issues(near: DataFrame, issues: DataFrame, first: int, last: int) -> DataFrame:
    """near with the issue dates whose month is from first to last months after the event's."""
    month = month_index(day_of(F.col("t")))
    dated = near.withColumn("month", F.explode(F.sequence(month + first, month + last)))
    return dated.join(F.broadcast(issues), "month")


def _within(days: float) -> Column:
    return F.col("issue_t") - F.col("t") <= days * DAY


def _known_at_issues(events: DataFrame, issues: DataFrame) -> DataFrame:
    return _at_issues(events, issues, 0, 13).where("t < issue_t").where(_within(max(COUNT_DAYS)))


def _windowed(found: DataFrame, cells: DataFrame, issues: DataFrame) -> DataFrame:
    zero = {f"count_{d}d": 0 for d in COUNT_DAYS} | {f"max_mag_{d}d": 0.0 for d in MAGNITUDE_DAYS}
    return spine(cells.select(*CELL), issues).join(found, [*CELL, "issue_date"], "left").fillna(zero)


def window_features(near: DataFrame, cells: DataFrame, issues: DataFrame, fault_col: str | None = None) -> DataFrame:
    """Counts and largest magnitudes of near events before each issue date, for every cell and date (0 without any).

    An event counts from strictly before the issue date back to and with its exact age. It touches the 14 months at most
    after its own, so one expansion and one aggregation serve all dates and windows. fault_col: near has the fault
    distance of each event; then mean distances too, null without events.
    """
    aggs = [F.count_if(_within(d)).alias(f"count_{d}d") for d in COUNT_DAYS] + [F.max(F.when(_within(d), F.col("magnitude"))).alias(f"max_mag_{d}d") for d in MAGNITUDE_DAYS]
    if fault_col:
        aggs += [F.avg(F.when(_within(d), F.col(fault_col))).alias(f"fault_mean_{d}d") for d in MAGNITUDE_DAYS]
    return _windowed(_known_at_issues(near, issues).groupBy(*CELL, "issue_date").agg(*aggs), cells, issues)


def near_places(cells: DataFrame, events: DataFrame, radius_km: float = RADIUS_KM) -> DataFrame:
    """(row, col, latitude, longitude): each distinct place of events near each cell, written once.

    A catalogue has far fewer places than events; so what events give is summed by place first, and only places meet cells.
    """
    from quakelode.sources.catalog import written

    places = events.select(*PLACE).distinct()
    pairs = neighbour_pairs(cells.select(*CELL, *PLACE), places, radius_km, broadcast_left=True)
    return written(pairs.select(*CELL, *(F.col(f"r_{c}").alias(c) for c in PLACE)), "near-places")


def place_windows(places: DataFrame, events: DataFrame, cells: DataFrame, issues: DataFrame, fault_col: str | None = None) -> DataFrame:
    """The rows of window_features() from near_places: windows are summed by place and issue date, then by cell.

    fault_col: places have the fault distance.
    """
    rows = events.select(*PLACE, "t", "magnitude")
    aggs = [F.count_if(_within(d)).alias(f"count_{d}d") for d in COUNT_DAYS] + [F.max(F.when(_within(d), F.col("magnitude"))).alias(f"max_mag_{d}d") for d in MAGNITUDE_DAYS]
    # dealt by place before the expansion to dates, which then needs no shuffle of its own
    dealt = rows.join(F.broadcast(_span(issues)), (F.col("t") < F.col("__until")) & (F.col("t") >= F.col("__since"))).select(rows.columns).repartition(_tasks(events), *PLACE)
    parts = _known_at_issues(dealt, issues).groupBy(*PLACE, "issue_date").agg(*aggs).join(places, PLACE)
    merged = [F.sum(f"count_{d}d").alias(f"count_{d}d") for d in COUNT_DAYS] + [F.max(f"max_mag_{d}d").alias(f"max_mag_{d}d") for d in MAGNITUDE_DAYS]
    if fault_col:
        for d in MAGNITUDE_DAYS:
            n = F.when(F.col(fault_col).isNotNull(), F.col(f"count_{d}d"))
            merged.append(F.try_divide(F.sum(n * F.col(fault_col)), F.sum(n)).alias(f"fault_mean_{d}d"))
    return _windowed(parts.groupBy(*CELL, "issue_date").agg(*merged), cells, issues)


def _tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _span(issues: DataFrame) -> DataFrame:
    """One row: events from __since to __until (exclusive) can be in a window of an issue date."""
    return issues.agg((F.min("issue_t") - int(max(COUNT_DAYS)) * DAY).alias("__since"), F.max("issue_t").alias("__until"))


def recency(near: DataFrame, cells: DataFrame, issues: DataFrame) -> DataFrame:
    """Adds log_recency: log1p of the days since the last near event before the issue date, however old, NO_EVENT_DAYS without.

    Events are first reduced to the last of each cell and day, so a busy cell has a row a day in its window.
    """
    last = near.groupBy(*CELL, F.floor(F.col("t") / DAY).alias("day")).agg(F.max("t").alias("t"))
    rows = spine(cells.select(*CELL), issues).select(*CELL, "issue_date", "issue_t", F.lit(None).cast("long").alias("t"), (F.col("issue_t") / DAY).cast("long").alias("day"), F.lit(0).alias("kind"))
    rows = rows.unionByName(last.select(*CELL, F.lit(None).cast("date").alias("issue_date"), F.lit(None).cast("long").alias("issue_t"), "t", "day", F.lit(1).alias("kind")))
    w = Window.partitionBy(*CELL).orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, -1)
    days = (F.col("issue_t") - F.max("t").over(w)) / DAY
    return rows.withColumn("log_recency", F.log1p(F.coalesce(days, F.lit(NO_EVENT_DAYS)))).where("kind = 0").select(*CELL, "issue_date", "log_recency")


def place_recency(places: DataFrame, events: DataFrame, cells: DataFrame, issues: DataFrame) -> DataFrame:
    """The rows of recency() from near_places: of a place only the last event before each issue date since the one before it."""
    day = F.floor(F.col("t") / DAY)
    own = issues.select((F.col("issue_t") / DAY).cast("long").alias("until")).distinct()
    turns = own.withColumn("since", F.coalesce(F.lag("until").over(Window.orderBy("until")), F.col("until") - 1))
    # each day of the calendar with the first issue date after it; days before the calendar count as its first
    turns = turns.select(F.explode(F.sequence("since", F.col("until") - 1)).alias("turn"), "until")
    first = own.agg(F.min("until").alias("__first"))
    rows = events.select(*PLACE, "t").crossJoin(F.broadcast(first)).withColumn("turn", F.greatest(day, F.col("__first") - 1))
    last = rows.join(F.broadcast(turns), "turn").groupBy(*PLACE, "until").agg(F.max("t").alias("t"))
    near = last.join(places, PLACE).groupBy(*CELL, "until").agg(F.max("t").alias("t"))
    return recency(near, cells, issues)


def forward_labels(near: DataFrame, cells: DataFrame, issues: DataFrame, magnitude: float = TARGET_MAGNITUDE, strict: bool = False, days: int = WINDOW_DAYS) -> DataFrame:
    """Adds label: 1 if a near event of at least (strict: above) the magnitude comes after the issue date and within the days."""
    hit = _ahead(near, issues, magnitude, strict, days).select(*CELL, "issue_date").distinct()
    return _labelled(hit, cells, issues)


def _ahead(events: DataFrame, issues: DataFrame, magnitude: float, strict: bool, days: int) -> DataFrame:
    big = events.where(F.col("magnitude") > magnitude if strict else F.col("magnitude") >= magnitude)
    return _at_issues(big, issues, -(days // 28 + 1), 0).where("issue_t < t").where(F.col("t") - F.col("issue_t") <= days * DAY)


def _labelled(hit: DataFrame, cells: DataFrame, issues: DataFrame) -> DataFrame:
    return spine(cells.select(*CELL), issues).join(hit.withColumn("label", F.lit(1)), [*CELL, "issue_date"], "left").fillna({"label": 0})


def place_labels(places: DataFrame, events: DataFrame, cells: DataFrame, issues: DataFrame, magnitude: float = TARGET_MAGNITUDE, strict: bool = False, days: int = WINDOW_DAYS) -> DataFrame:
    """The rows of forward_labels() from near_places."""
    hit = _ahead(events.select(*PLACE, "t", "magnitude"), issues, magnitude, strict, days).select(*PLACE, "issue_date").distinct()
    return _labelled(hit.join(places, PLACE).select(*CELL, "issue_date").distinct(), cells, issues)


def examples(cells: DataFrame, issues: DataFrame, history: DataFrame, own: DataFrame) -> DataFrame:
    """The feature table of a split: counts, magnitudes, recency from history, labels from the split's own events.

    own is a part of history, so one table of near places serves both.
    """
    places = near_places(cells, history)
    out = place_windows(places, history, cells, issues).join(place_recency(places, history, cells, issues), [*CELL, "issue_date"])
    return out.join(place_labels(places, own, cells, issues).select(*CELL, "issue_date", "label"), [*CELL, "issue_date"])


def _followed_in_cell(events: DataFrame, big: DataFrame, radius_km: float, days: int) -> DataFrame:
    """Adds followed: one of big comes later and within the days in the event's own cell, in which no two places are farther
    apart than the radius.

    Time is cut into periods of so many days. A later event of the same period is near enough, and of the next period the
    first one tells; so big is reduced to a row a cell and period.
    """
    height = math.degrees(math.sqrt(2) * math.sin(min(math.pi / 2, radius_km / (2 * EARTH_MEAN_KM)))) * (1 - 1e-6)
    row = F.floor(F.col("latitude") / height)
    inner = F.least(F.abs(row), F.abs(row + 1)) * height
    col = F.floor(F.pmod(F.col("longitude") + 180, F.lit(360.0)) * F.cos(F.radians(inner)) / height)
    here = valid_place(F.col("latitude"), F.col("longitude"))
    place = {"__row": F.when(here, row), "__col": F.when(here, col), "__period": F.floor(F.col("t") / (days * DAY))}
    key = list(place)
    spans = big.withColumns(place).dropna(subset=key).groupBy(*key).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    ahead = spans.select(*key, F.lit(None).cast("long").alias("__next"), F.col("last").alias("__last"))
    ahead = ahead.unionByName(spans.select("__row", "__col", (F.col("__period") - 1).alias("__period"), F.col("first").alias("__next"), F.lit(None).cast("long").alias("__last")))
    ahead = ahead.groupBy(*key).agg(F.min("__next").alias("__next"), F.max("__last").alias("__last"))
    found = (F.col("__last") > F.col("t")) | (F.col("__next") <= F.col("t") + days * DAY)
    return events.withColumns(place).join(ahead, key, "left").select(*events.columns, F.coalesce(found, F.lit(False)).alias("followed"))


def event_labels(events: DataFrame, catalogue: DataFrame, radius_km: float = RADIUS_KM, days: int = WINDOW_DAYS, magnitude: float = TARGET_MAGNITUDE, at_least: bool = False) -> DataFrame:
    """Adds label to events: an event above (at_least: of) the magnitude follows within the days and the radius; and uncensored:
    the catalogue reaches to the end of the days.

    Events followed in their own small cell need no pairs; only the others are compared. In a dense catalogue these are few,
    so pairs don't grow with its square.
    """
    big = catalogue.where(F.col("magnitude") >= magnitude if at_least else F.col("magnitude") > magnitude).select("t", "latitude", "longitude")
    side = _followed_in_cell(events.select("event_id", "t", "latitude", "longitude"), big, radius_km, days)
    pairs = neighbour_pairs(side.where("not followed").drop("followed"), big, radius_km, (-float(days), 0.0), EARTH_MEAN_KM)
    hit = side.where("followed").select("event_id").unionByName(pairs.where("r_t > t").select("event_id")).distinct().withColumn("label", F.lit(1))
    end = catalogue.agg(F.max("t").alias("last_t"))
    out = events.join(hit, "event_id", "left").fillna({"label": 0}).crossJoin(F.broadcast(end))
    return out.withColumn("uncensored", F.col("t") + days * DAY <= F.col("last_t")).drop("last_t")


def with_coverage(targets: DataFrame, history: DataFrame, columns: list[str], days: float | None = BAND_DAYS, warmup: float = 0.0, start: int | None = None, before: int | None = None) -> DataFrame:
    """Adds full_window (the history reaches days back, or warmup for all history) and empties columns within the warm-up.

    The history begins at start, else with its first event; before: the history was frozen then.
    """
    first = history.agg(F.lit(start).cast("long").alias("__first") if start is not None else F.min("t").alias("__first"))
    out = targets.crossJoin(F.broadcast(first))
    need = (warmup if days is None else days) * DAY
    out = out.withColumn("full_window", F.coalesce((F.col("t") - need >= F.col("__first")).cast("int"), F.lit(0)))
    if warmup > 0:
        until = F.col("t") if before is None else F.least(F.col("t"), F.lit(before))
        ready = F.coalesce(until >= F.col("__first") + warmup * DAY, F.lit(False))
        out = out.withColumns({c: F.when(ready, F.col(c)) for c in columns})
    return out.drop("__first")


def bounded_history(events: DataFrame, start: int | None = None, before: int | None = None) -> DataFrame:
    """History from start on (inclusive) and before a freeze (exclusive)."""
    out = events if start is None else events.where(F.col("t") >= start)
    return out if before is None else out.where(F.col("t") < before)


def tide_at_issues(cells: DataFrame, issues: DataFrame, drivers: DataFrame) -> DataFrame:
    """Adds tide: the issue date's tidal potential (0 without one), fading with the cell's coast_km."""
    daily = drivers.where("parameter = 'tidal_potential'").groupBy("date").agg(F.min_by("value", "value").alias("tide"))
    rows = spine(cells, issues).join(F.broadcast(daily.withColumnRenamed("date", "issue_date")), "issue_date", "left")
    return rows.withColumn("tide", F.coalesce("tide", F.lit(0.0)) * F.exp(-F.col("coast_km") / TIDE_SCALE_KM))


def near_points(points: DataFrame, history: DataFrame, radius_km: float = DIST_MAX, days: float = 180.0) -> DataFrame:
    """Events before each query point (point_id, t, latitude, longitude) within radius and days, both strict."""
    pairs = neighbour_pairs(points, history, radius_km, (0.0, days), EARTH_MEAN_KM, strict=True)
    return pairs.where(F.col("r_t") < F.col("t")).where(F.col("t") - F.col("r_t") < days * DAY)


def issue_frame(dates: DataFrame) -> DataFrame:
    """The calendar columns for any dates."""
    return dates.select("issue_date", date_seconds(F.col("issue_date")).alias("issue_t"), month_index(F.col("issue_date")).alias("month"))
