"""Queries over cells and issue dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakelode.functions.geo import cell_centre, floor_cell
from quakelode.operators import etas, features, gps, grid, learn, tables
from quakelode.plans.catalog import r6
from quakelode.plans.registry import Registry, albers_sql, km_sql, rounded_to
from quakelode.sources import catalog, derived, polylines

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: Month starts of each split's forecasts.
ISSUES = {"train": ("1996-01-01", "1998-11-01"), "test": ("1999-01-01", "2000-05-01"), "judge": ("2000-07-01", "2001-06-01")}
WITH = f"with {derived.SEISMIC} "
CELLS = ", cells as (select distinct floor(latitude/0.5::double)::bigint as row, floor(longitude/0.5::double)::bigint as col, floor(latitude/0.5::double)*0.5::double + 0.25::double as latitude, floor(longitude/0.5::double)*0.5::double + 0.25::double as longitude from seismic where split = 'train')"
PAIRS = ", cut as (select * from seismic where magnitude >= 1.75::double), pairs as (select c.row, c.col, e.event_id, e.t, e.magnitude, e.split, e.latitude, e.longitude from cells c join cut e on abs(c.latitude - e.latitude) < 0.95 and " + km_sql("c", "e") + " <= 100)"


def issues_sql(split: str) -> str:
    a, b = ISSUES[split]
    return f", issues as (select d::date as issue_date, epoch(d)::bigint as issue_t from generate_series(timestamp '{a}', timestamp '{b}', interval 1 month) g(d))"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.active_cells(derived.seismic(spark, sf_dir).where("split = 'train'"))


def _near(spark: SparkSession, sf_dir: str, splits: str = "test") -> DataFrame:
    """Complete events known to a split, near each active cell."""
    s = catalog.complete(catalog.history(derived.seismic(spark, sf_dir), splits))
    return features.near_events(_cells(spark, sf_dir), s)


def _known(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(near places, complete events known to the test split, cells, issue dates)."""
    s, cells = catalog.complete(catalog.history(derived.seismic(spark, sf_dir), "test")), _cells(spark, sf_dir)
    return features.near_places(cells, s), s, cells, _issues(spark, "test")


def _issues(spark: SparkSession, split: str) -> DataFrame:
    return grid.issue_calendar(spark, *ISSUES[split])


def _keyed(df: DataFrame, *names: str) -> DataFrame:
    return df.select("row", "col", F.datediff("issue_date", F.lit("1970-01-01").cast("date")).alias("issue_day"), *names)


DAY_SQL = "row, col, (issue_date - date '1970-01-01')::int as issue_day"
HISTORY_TEST = ", known as (select p.row, p.col, i.issue_date, i.issue_t - p.t as age, p.t, p.magnitude, p.event_id from pairs p join issues i on p.t < i.issue_t where p.split in ('train','test'))"
SPINE = ", spine as (select c.row, c.col, i.issue_date, i.issue_t from cells c, issues i)"


@query(WITH + ", q as (select event_id, latitude, longitude, row_number() over (order by event_id) as k from seismic) select event_id, floor(latitude/0.5::double)::bigint as row, round(floor(longitude/0.5::double)*0.5::double + 0.25::double, 6) as centre from q")
def p8_cell_by_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.seismic(spark, sf_dir).select("event_id", floor_cell(F.col("latitude")).alias("row"), rounded_to(cell_centre(floor_cell(F.col("longitude"))), 6).alias("centre"))


@query(WITH + ", q as (select event_id, case when event_id % 11 = 0 then 50.0::double when event_id % 13 = 0 then 50.01::double else latitude end as latitude, case when event_id % 7 = 0 then -65.0::double else longitude end as longitude from seismic) select event_id, case when latitude between 25 and 50 then least(floor((latitude - 25.0::double)/0.5::double), 49)::int end as row, case when longitude between -90 and -65 then least(floor((longitude + 90.0::double)/0.5::double), 49)::int end as col from q")
def p9_cell_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    s = derived.seismic(spark, sf_dir).withColumns({"latitude": F.when(k % 11 == 0, 50.0).when(k % 13 == 0, 50.01).otherwise(F.col("latitude")), "longitude": F.when(k % 7 == 0, -65.0).otherwise(F.col("longitude"))})
    return grid.cell_lookup(s).select("event_id", "row", "col")


@query(WITH + ", g as (select r.range::int as row, c.range::int as col, 25.0::double + r.range*0.5::double as lat_min, -90.0::double + c.range*0.5::double as lon_min from range(50) r, range(50) c), n as (select least(floor((latitude - 25.0::double)/0.5::double), 49)::int as row, least(floor((longitude + 90.0::double)/0.5::double), 49)::int as col, count(*) as events from seismic group by all) select row, col, lat_min, lon_min, lat_min + 0.25::double as lat_center, lon_min + 0.25::double as lon_center, round(pow(6371.0088::double, 2)*radians(0.5::double)*(sin(radians(lat_min + 0.5::double)) - sin(radians(lat_min))), 6) as area_km2, coalesce(events, 0) as events from g left join n using (row, col)")
def p10_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = grid.cell_lookup(derived.seismic(spark, sf_dir)).groupBy("row", "col").agg(F.count("*").alias("events"))
    g = grid.grid(spark).join(n, ["row", "col"], "left").fillna({"events": 0})
    return g.select("row", "col", "lat_min", "lon_min", "lat_center", "lon_center", r6("area_km2"), "events")


@query(WITH + CELLS + " select * from cells")
def p11_active_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


@query(WITH + issues_sql("train") + " select (issue_date - date '1970-01-01')::int as issue_day, issue_t, (select count(*) from seismic where t < issue_t) as before from issues")
def p12_issue_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = derived.seismic(spark, sf_dir).groupBy(F.floor(F.col("t") / 86400).alias("day")).agg(F.count("*").alias("n"))
    i = _issues(spark, "train")
    # dates against dates: a few dozen by a few thousand rows, whatever the catalogue
    out = i.join(F.broadcast(i.select("issue_t").crossJoin(months).where("day * 86400 < issue_t").groupBy("issue_t").agg(F.sum("n").alias("before"))), "issue_t", "left")
    return out.select(F.datediff("issue_date", F.lit("1970-01-01").cast("date")).alias("issue_day"), "issue_t", F.coalesce("before", F.lit(0)).alias("before"))


@query(WITH + CELLS + PAIRS + " select row, col, event_id, t from pairs")
def j1_cell_event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, "judge").select("row", "col", "event_id", "t")


_WINDOW_AGGS = ", ".join(f"count(*) filter (age <= {d}*86400) as count_{d}d" for d in (7, 30, 90, 365)) + ", " + ", ".join(f"max(magnitude) filter (age <= {d}*86400) as max_mag_{d}d" for d in (30, 90, 365))
_WINDOWS = WITH + CELLS + PAIRS + issues_sql("test") + HISTORY_TEST + SPINE + f", w as (select row, col, issue_date, {_WINDOW_AGGS} from known group by all)"


@query(_WINDOWS + f" select {DAY_SQL}, " + ", ".join(f"coalesce(count_{d}d, 0) as count_{d}d" for d in (7, 30, 90, 365)) + " from spine left join w using (row, col, issue_date)")
def a1_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = features.place_windows(*_known(spark, sf_dir))
    return _keyed(w, *(f"count_{d}d" for d in (7, 30, 90, 365)))


@query(WITH + CELLS + PAIRS + issues_sql("test") + HISTORY_TEST + SPINE + f", w as (select row, col, issue_date, min(age) as age from known group by all) select {DAY_SQL}, round(ln(1 + coalesce(age/86400.0::double, 999.0::double)), 6) as log_recency from spine left join w using (row, col, issue_date)")
def a2_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(features.place_recency(*_known(spark, sf_dir)).withColumn("log_recency", rounded_to(F.col("log_recency"), 6)), "log_recency")


@query(_WINDOWS + f" select {DAY_SQL}, " + ", ".join(f"coalesce(max_mag_{d}d, 0.0::double) as max_mag_{d}d" for d in (30, 90, 365)) + " from spine left join w using (row, col, issue_date)")
def a3_largest_magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = features.place_windows(*_known(spark, sf_dir))
    return _keyed(w, *(f"max_mag_{d}d" for d in (30, 90, 365)))


_LABELS = WITH + CELLS + PAIRS + issues_sql("test") + SPINE + ", hit as (select distinct p.row, p.col, i.issue_date from pairs p join issues i on p.t > i.issue_t and p.t <= i.issue_t + 30*86400 where p.split = 'test' and p.magnitude >= 2.0::double), labels as (select row, col, issue_date, (h.issue_date is not null)::int as label from spine left join (select row, col, issue_date from hit) h using (row, col, issue_date))"
_LABELS = _LABELS.replace("(h.issue_date is not null)::int as label from spine left join (select row, col, issue_date from hit) h using", "coalesce(one, 0) as label from spine left join (select row, col, issue_date, 1 as one from hit) h using")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, cells = catalog.complete(derived.seismic(spark, sf_dir).where("split = 'test'")), _cells(spark, sf_dir)
    return features.place_labels(features.near_places(cells, s), s, cells, _issues(spark, "test"))


@query(_LABELS + f" select {DAY_SQL}, label from labels")
def j3_forward_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(_labels(spark, sf_dir), "label")


@query(_LABELS + " select (issue_date - date '1970-01-01')::int as issue_day, count(*) as n, sum(label)::bigint as positives, round(avg(label), 6) as rate from labels group by all")
def a11_label_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = learn.label_balance(_labels(spark, sf_dir), by=["issue_date"])
    return b.select(F.datediff("issue_date", F.lit("1970-01-01").cast("date")).alias("issue_day"), "n", "positives", r6("rate"))


@query(WITH + ", g as (select r.range::int as row, c.range::int as col, 25.25::double + r.range*0.5::double as latitude, -89.75::double + c.range*0.5::double as longitude from range(50) r, range(50) c) select row, col, latitude, longitude from g where exists (select 1 from seismic e where e.split <> 'judge' and abs(e.latitude - g.latitude) < 0.95 and " + km_sql("g", "e") + " <= 100)")
def j14_scored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.scored_cells(spark, catalog.history(derived.seismic(spark, sf_dir), "test"))


def segments_sql(name: str) -> str:
    x, y = albers_sql("latitude", "longitude")
    return f", {name}_v as (select line_id, seq, {x} as x, {y} as y, lead({x}) over w as x2, lead({y}) over w as y2, count(*) over (partition by line_id) as n from {name} window w as (partition by line_id order by seq)), {name}_s as (select line_id, seq, x as x1, y as y1, coalesce(x2, x) as x2, coalesce(y2, y) as y2 from {name}_v where x2 is not null or n = 1)"


def to_lines_sql(points: str, key: str, lines: str, buffer: float) -> str:
    x, y = albers_sql("p.latitude", "p.longitude")
    along = "case when pow(x2-x1,2) + pow(y2-y1,2) > 0 then least(1.0::double, greatest(0.0::double, ((px-x1)*(x2-x1) + (py-y1)*(y2-y1))/(pow(x2-x1,2) + pow(y2-y1,2)))) else 0.0::double end"
    return f"select {key}, greatest(0.0::double, min(sqrt(pow(px-x1-u*(x2-x1),2) + pow(py-y1-u*(y2-y1),2)))/1000 - {buffer}) as km from (select {key}, px, py, x1, y1, x2, y2, {along} as u from (select {key}, {x} as px, {y} as py from {points} p), {lines}_s) group by {key}"


_LINES = f"with {derived.SEISMIC}, {derived.LINES}" + segments_sql("coastline") + segments_sql("faults")


@query(_LINES + " select line_id, seq, round(x1, 3) as x1, round(y1, 3) as y1, round(x2, 3) as x2, round(y2, 3) as y2 from faults_s")
def s9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = polylines.segments(derived.faults(spark, sf_dir))
    return s.select("line_id", "seq", *(rounded_to(F.col(c), 3).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query(_LINES + CELLS + f", k as ({to_lines_sql('cells', 'row, col', 'coastline', 0)}) select row, col, round(km, 6) as coast_km from k")
def j7_coast_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.nearest_line_km(_cells(spark, sf_dir), polylines.segments(derived.coastline(spark, sf_dir)), ["row", "col"], "coast_km")
    return out.select("row", "col", r6("coast_km"))


@query(_LINES + CELLS + f", k as ({to_lines_sql('cells', 'row, col', 'faults', 5)}) select row, col, round(km, 6) as fault_km from k")
def j8_fault_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.nearest_line_km(_cells(spark, sf_dir), polylines.segments(derived.faults(spark, sf_dir)), ["row", "col"], "fault_km", 5.0)
    return out.select("row", "col", r6("fault_km"))


@query(_LINES + f", k as ({to_lines_sql('seismic', 'event_id', 'faults', 5)}) select event_id, round(km, 3) as fault_km from k")
def j9_event_fault_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.nearest_line_km(derived.seismic(spark, sf_dir), polylines.segments(derived.faults(spark, sf_dir)), ["event_id"], "fault_km", 5.0, digits=3)
    return out.select("event_id", "fault_km")


def _elevations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid.grid(spark).select("row", "col", "cell")
    return polylines.with_elevation(g, derived.elevation(spark, sf_dir), "cell")


@query(f"with {derived.ELEVATION}, g as (select range as cell from range(2500)), j as (select cell, elevation from g left join elevation using (cell)) select cell, round(coalesce(elevation, (select quantile_cont(elevation, 0.5) from j)), 6) as elevation from j")
def s10_elevation_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elevations(spark, sf_dir).select("cell", r6("elevation"))


_STATICS = _LINES + CELLS + f", co as ({to_lines_sql('cells', 'row, col', 'coastline', 0)}), fa as ({to_lines_sql('cells', 'row, col', 'faults', 5)})"


@query(_STATICS + " select row, col, round(co.km, 6) as coast_km, round(fa.km, 6) as fault_km from cells join co using (row, col) join fa using (row, col)")
def j15_static_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.with_statics(_cells(spark, sf_dir), polylines.segments(derived.coastline(spark, sf_dir)), polylines.segments(derived.faults(spark, sf_dir)))
    return out.select("row", "col", r6("coast_km"), r6("fault_km"))


@query(f"with {derived.ELEVATION}, {derived.LINES}" + segments_sql("coastline") + ", g as (select range as cell, 25.25::double + (range//50)*0.5::double as latitude, -89.75::double + (range%50)*0.5::double as longitude from range(2500)), j as (select cell, elevation from g left join elevation using (cell)), k as (" + to_lines_sql("g", "cell", "coastline", 0) + ") select round(corr(km, coalesce(elevation, (select quantile_cont(elevation, 0.5) from j))), 6) as r from k join j using (cell)")
def a20_coast_elevation_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid.grid(spark).select("row", "col", "cell", F.col("lat_center").alias("latitude"), F.col("lon_center").alias("longitude"))
    c = grid.nearest_line_km(g, polylines.segments(derived.coastline(spark, sf_dir)), ["cell"], "coast_km")
    both = c.join(_elevations(spark, sf_dir).select("cell", "elevation"), "cell")
    return learn.correlations(both, ["coast_km", "elevation"]).select(r6("r"))


@query(_LINES.replace("with ", "with ", 1) + CELLS + PAIRS + issues_sql("test") + HISTORY_TEST + SPINE + f", fe as ({to_lines_sql('seismic', 'event_id', 'faults', 5)}), fc as ({to_lines_sql('cells', 'row, col', 'faults', 5)}), w as (select row, col, issue_date, " + ", ".join(f"avg(km) filter (age <= {d}*86400) as f{d}" for d in (30, 90, 365)) + f" from known join fe using (event_id) group by all) select {DAY_SQL}, " + ", ".join(f"round(coalesce(f{d}, km), 6) as fault_mean_{d}d" for d in (30, 90, 365)) + " from spine left join w using (row, col, issue_date) join fc using (row, col)")
def a4_dynamic_fault_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = polylines.segments(derived.faults(spark, sf_dir))
    places, s, cells, issues = _known(spark, sf_dir)
    lines = grid.nearest_line_km(places.select(*features.PLACE).distinct(), seg, features.PLACE, "fault_km", 5.0)
    w = features.place_windows(places.join(lines, features.PLACE), s, cells, issues, "fault_km")
    out = w.join(grid.nearest_line_km(cells, seg, ["row", "col"], "static", 5.0).select("row", "col", "static"), ["row", "col"])
    return _keyed(out.withColumns({f"fault_mean_{d}d": rounded_to(F.coalesce(F.col(f"fault_mean_{d}d"), F.col("static")), 6) for d in (30, 90, 365)}), *(f"fault_mean_{d}d" for d in (30, 90, 365)))


_TIDE = _LINES + f", {derived.DRIVERS}" + CELLS + issues_sql("test") + SPINE + f", co as ({to_lines_sql('cells', 'row, col', 'coastline', 0)}), d as (select date, min(value) as v from drivers where parameter = 'tidal_potential' group by date)"


@query(_TIDE + f" select {DAY_SQL}, round(coalesce(v, 0.0::double)*exp(-km/50.0::double), 6) as tide from spine join co using (row, col) left join d on date = issue_date")
def j13_tide_at_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid.nearest_line_km(_cells(spark, sf_dir), polylines.segments(derived.coastline(spark, sf_dir)), ["row", "col"], "coast_km")
    return _keyed(features.tide_at_issues(cells, _issues(spark, "test"), derived.drivers(spark, sf_dir)).withColumn("tide", rounded_to(F.col("tide"), 6)), "tide")


_GPS = f"with {derived.SEISMIC}, {derived.GPS}" + CELLS
_PARTS = ("east_m", "north_m", "up_m")


@query(_GPS + ", st as (select distinct station_id, latitude, longitude from gps) select row, col, station_id from cells c join st on " + km_sql("c", "st") + " <= 100")
def j10_station_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gps.station_cells(_cells(spark, sf_dir), derived.gps_wide(spark, sf_dir))


_ASKED = issues_sql("test") + ", asked as (select station_id, issue_date from (select distinct station_id from gps), issues)"


def _asked(spark: SparkSession, positions: DataFrame) -> DataFrame:
    return positions.select("station_id").distinct().crossJoin(F.broadcast(_issues(spark, "test").select("issue_date")))


def _station_day(df: DataFrame, *names: str) -> DataFrame:
    return df.select("station_id", F.datediff("issue_date", F.lit("1970-01-01").cast("date")).alias("issue_day"), *((_untied(n) if n.startswith("base_") else rounded_to(F.col(n), 6)).alias(n) for n in names))


def _untied(name: str):
    """Six decimals of a mean of short decimals, which may lie on a tie where summation order decides: moved off it."""
    return rounded_to(F.col(name) + 1e-9, 6)


@query(_GPS + _ASKED + " select a.station_id, (a.issue_date - date '1970-01-01')::int as issue_day, " + ", ".join(f"round(n.{p}, 6) as now_{p}" for p in _PARTS) + ", " + ", ".join(f"round(y.{p}, 6) as year_{p}" for p in _PARTS) + " from asked a asof left join gps n on a.station_id = n.station_id and a.issue_date > n.date asof left join gps y on a.station_id = y.station_id and a.issue_date - 365 > y.date")
def j11_position_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.gps_wide(spark, sf_dir)
    both = gps.last_before(g, _asked(spark, g), 0, "now_").join(gps.last_before(g, _asked(spark, g), 365, "year_"), ["station_id", "issue_date"])
    return _station_day(both, *(f"{k}_{p}" for k in ("now", "year") for p in _PARTS))


@query(_GPS + _ASKED + " select a.station_id, (a.issue_date - date '1970-01-01')::int as issue_day, " + ", ".join(f"round(avg(g.{p}) + 1e-9::double, 6) as base_{p}" for p in _PARTS) + " from asked a left join gps g on a.station_id = g.station_id and g.date between a.issue_date - 395 and a.issue_date - 30 group by 1, 2")
def j12_position_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.gps_wide(spark, sf_dir)
    return _station_day(gps.baseline(g, _asked(spark, g)), *(f"base_{p}" for p in _PARTS))


@query(_GPS + " select (date - date '1970-01-01')::int as day, station_id, " + ", ".join(f"round({p}, 6) as {p}" for p in _PARTS) + " from gps")
def a12_gps_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = gps.wide(derived.gps_long(spark, sf_dir))
    return w.select(F.datediff("date", F.lit("1970-01-01").cast("date")).alias("day"), "station_id", *(rounded_to(F.col(p), 6).alias(p) for p in _PARTS))


@query(_GPS + " select 3*count(*) as records, count(distinct station_id) as stations, (min(date) - date '1970-01-01')::int as first_day, (max(date) - min(date))::int as days, count(*) as n_east_m, count(*) as n_north_m, count(*) as n_up_m, round(3.0::double*count(*)/count(distinct station_id), 6) as samples_per_station from gps")
def a13_gps_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = gps.summary(derived.gps_long(spark, sf_dir))
    return s.select("records", "stations", F.datediff("first_date", F.lit("1970-01-01").cast("date")).alias("first_day"), "days", "n_east_m", "n_north_m", "n_up_m", r6("samples_per_station"))


@query(_GPS + ", g as (select *, date - lag(date) over (partition by station_id order by date) as gap from gps), n as (select station_id, count(*) as n from gps group by 1) select round(avg(gap), 6) as mean_gap_days, " + ", ".join(f"round(100.0::double*count(*) filter ({p} is null)/count(*), 6) as {p}_missing_pct, round(avg({p}), 6) as {p}_mean, round(stddev_samp({p}), 6) as {p}_std, round(min({p}), 6) as {p}_min, round(max({p}), 6) as {p}_max" for p in _PARTS) + ", (select station_id from n order by n desc, station_id limit 1) as most_active, (select station_id from n order by n, station_id limit 1) as least_active from g")
def a14_gps_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = gps.quality(derived.gps_wide(spark, sf_dir))
    return q.select(*(rounded_to(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in q.dtypes))


_STATION = _GPS + issues_sql("test") + """, st as (select distinct station_id, latitude, longitude from gps), near as (select row, col, station_id from cells c join st on """ + km_sql("c", "st") + """ <= 100),
 a as (select station_id, issue_date from (select distinct station_id from near), issues),
 b as (select a.station_id, a.issue_date, """ + ", ".join(f"avg(g.{p}) as b_{p}" for p in _PARTS) + """ from a left join gps g on a.station_id = g.station_id and g.date between a.issue_date - 395 and a.issue_date - 30 group by 1, 2),
 s as (select a.station_id, a.issue_date, """ + ", ".join(f"n.{p} as n_{p}, y.{p} as y_{p}" for p in _PARTS) + """ from a asof left join gps n on a.station_id = n.station_id and a.issue_date > n.date asof left join gps y on a.station_id = y.station_id and a.issue_date - 365 > y.date),
 f as (select row, col, issue_date, """ + ", ".join(f"avg(n_{p} - b_{p}) as {p[:-2]}_anomaly, avg(n_{p} - y_{p}) as {p[:-2]}_year" for p in _PARTS) + """ from near join s using (station_id) join b using (station_id, issue_date) group by all)"""


@query(_STATION + SPINE + f" select {DAY_SQL}, " + ", ".join(f"round(coalesce({n}_{k}, 0.0::double) + 1e-9::double, 6) + 0.0 as {n}_{k}" for k in ("anomaly", "year") for n in ("east", "north", "up")) + " from spine left join f using (row, col, issue_date)")
def a15_gps_cell_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gps.cell_features(_cells(spark, sf_dir), _issues(spark, "test"), derived.gps_wide(spark, sf_dir))
    names = [f"{n}_{k}" for k in ("anomaly", "year") for n in ("east", "north", "up")]
    return _keyed(out.withColumns({n: _untied(n) for n in names}), *names)


@query(_GPS + ", g as (select station_id, date - lag(date) over (partition by station_id order by date) as gap from gps) select station_id, count(*) as samples, round(avg(gap), 6) as mean_gap_days from g group by 1")
def w4_station_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gps.intervals(derived.gps_wide(spark, sf_dir)).select("station_id", "samples", r6("mean_gap_days"))


@query(WITH + CELLS + issues_sql("judge") + ", cut as (select * from seismic where magnitude >= 1.75::double), near as (select c.row, c.col, e.t, e.magnitude, pow((c.latitude - e.latitude)*111.0::double, 2) + pow((c.longitude - e.longitude)*111.0::double*cos(radians(c.latitude)), 2) as r2 from cells c join cut e on abs(c.latitude - e.latitude) < 1.9 where sqrt(r2) <= 200), s as (select row, col, issue_date, sum(0.146::double*exp(0.406::double*(magnitude - 1.75::double))/pow(r2 + 60.5::double, 0.76::double)/pow((issue_t - t)/86400.0::double + 0.566::double, 1.22::double)) as x from near join issues on t < issue_t and issue_t - t <= 3650*86400 group by all)" + SPINE + f" select {DAY_SQL}, round(coalesce(x, 0.0::double) + 0.134e-9::double*(0.5::double*111.0::double)*(0.5::double*111.0::double*cos(radians(latitude))), 6) as intensity from spine join cells using (row, col) left join s using (row, col, issue_date)")
def a7_planar_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = catalog.complete(derived.seismic(spark, sf_dir))
    return _keyed(etas.planar_intensity(_cells(spark, sf_dir), _issues(spark, "judge"), s).withColumn("intensity", rounded_to(F.col("intensity"), 6)), "intensity")


_KEYED = "row, col, issue_day"
_M7 = ["a1_window_counts", "a2_recency", "a3_largest_magnitudes", "a4_dynamic_fault_distance", "a15_gps_cell_features", "j13_tide_at_issue"]
_M7_COLUMNS = [f"count_{d}d" for d in (7, 30, 90, 365)] + ["log_recency"] + [f"{k}_{d}d" for k in ("max_mag", "fault_mean") for d in (30, 90, 365)] + [f"{n}_{k}" for k in ("anomaly", "year") for n in ("east", "north", "up")] + ["tide"]


@query(f"select {_KEYED}, " + ", ".join([*_M7_COLUMNS, "coast_km", "fault_km"]) + f" from ({SQL[_M7[0]]})" + "".join(f" join ({SQL[n]}) using ({_KEYED})" for n in _M7[1:]) + f" join ({SQL['j15_static_features']}) using (row, col)")
def m7_wide_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).withColumn("cell", (F.col("row") - 50) * 50 + F.col("col") + 180)
    history = catalog.complete(catalog.history(derived.seismic(spark, sf_dir), "test"))
    lines = (polylines.segments(f(spark, sf_dir)) for f in (derived.coastline, derived.faults))
    wide = tables.wide_features(cells, _issues(spark, "test"), history, *lines, derived.elevation(spark, sf_dir), derived.drivers(spark, sf_dir), derived.gps_wide(spark, sf_dir))
    whole = {f"count_{d}d" for d in (7, 30, 90, 365)} | {f"max_mag_{d}d" for d in (30, 90, 365)}
    names = [*_M7_COLUMNS, "coast_km", "fault_km"]
    return _keyed(wide, *names).select("row", "col", "issue_day", *(F.col(n) if n in whole else _untied(n).alias(n) if n.endswith(("_anomaly", "_year")) else r6(n) for n in names))
