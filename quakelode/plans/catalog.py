"""Queries over catalogues: sources, cleaning, merging, publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakelode.constants import DAY, EARTH_KM
from quakelode.functions import times
from quakelode.functions.etas import time_integral
from quakelode.functions.geo import albers_xy, great_circle_km
from quakelode.operators import features, learn
from quakelode.plans.registry import Registry, albers_sql, km_sql, rounded_to
from quakelode.sources import catalog, derived

query = Registry()
QUERIES, SQL = query.queries, query.sql
WITH = f"with {derived.SEISMIC} "


def r6(name: str):
    """Six decimals, and no negative zero."""
    return rounded_to(F.col(name), 6).alias(name)


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long observation table of all three sources that the views give."""
    s = derived.seismic(spark, sf_dir).select(F.lit("seismic").alias("source"), F.floor(F.col("t") / DAY).alias("day"), "latitude", "longitude", "magnitude", F.lit(None).cast("string").alias("station_id"), F.lit(None).cast("string").alias("parameter"), F.lit(None).cast("double").alias("value"), "split", "event_id")
    d = derived.drivers(spark, sf_dir).select(F.when(F.col("parameter").isin("ap", "kp"), "geomagnetic").when(F.col("parameter") == "f107_observed", "solar").otherwise("tidal_ephemeris").alias("source"), F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long").alias("day"), F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"), F.lit(None).cast("double").alias("magnitude"), F.lit(None).cast("string").alias("station_id"), "parameter", "value")
    g = derived.gps_long(spark, sf_dir).select(F.lit("gps").alias("source"), F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long").alias("day"), "latitude", "longitude", F.lit(None).cast("double").alias("magnitude"), "station_id", "parameter", "value")
    split = F.when(F.col("day") < 10592, "train").when(F.col("day") < 11139, "test").otherwise("judge")
    rest = d.unionByName(g).withColumns({"split": split, "event_id": F.lit(None).cast("long")})
    return s.unionByName(rest)


_LONG = f"""with {derived.SEISMIC}, {derived.DRIVERS}, {derived.GPS}, gl as (select date, station_id, unnest(['east_m','north_m','up_m']) as parameter from gps),
long as (select 'seismic' as source, split from seismic union all
 select case when parameter in ('ap','kp') then 'geomagnetic' when parameter = 'f107_observed' then 'solar' else 'tidal_ephemeris' end, case when date < date '1999-01-01' then 'train' when date < date '2000-07-01' then 'test' else 'judge' end from drivers union all
 select 'gps', case when date < date '1999-01-01' then 'train' when date < date '2000-07-01' then 'test' else 'judge' end from gl)"""


@query(_LONG + " select coalesce(split, 'all') as split, coalesce(source, 'all') as source, count(*) as n from long group by rollup(split, source)")
def a10_rows_by_split_and_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _long(spark, sf_dir).rollup("split", "source").agg(F.count("*").alias("n"))
    return out.select(F.coalesce("split", F.lit("all")).alias("split"), F.coalesce("source", F.lit("all")).alias("source"), "n")


@query(WITH + "select event_id, t, round(latitude, 6) as latitude, round(longitude, 6) as longitude, magnitude, depth_km, split from seismic")
def s1_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.seismic(spark, sf_dir).select("event_id", "t", r6("latitude"), r6("longitude"), "magnitude", "depth_km", "split")


def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as text, some of them spoilt by rule: blank magnitudes, impossible places, times that are none."""
    s = derived.seismic(spark, sf_dir)
    iso = F.date_format(F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, t)"), "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id")
    return s.select("event_id", F.when(k % 31 == 0, "yesterday").when(k % 3 == 0, F.concat(iso, F.lit("Z"))).when(k % 3 == 1, F.concat(iso, F.lit("+05:00"))).otherwise(iso).alias("time"), F.when(k % 37 == 0, "95.5").otherwise(F.col("latitude").cast("string")).alias("latitude"), F.when(k % 41 == 0, "NaN").otherwise(F.col("longitude").cast("string")).alias("longitude"), F.when(k % 43 == 0, "").otherwise(F.col("magnitude").cast("string")).alias("magnitude"))


_REASON = "case when event_id % 31 = 0 then 'time' when event_id % 37 = 0 or event_id % 41 = 0 then 'place' when event_id % 43 = 0 then 'magnitude' end"


@query(WITH + f"select {_REASON} as reason, count(*) as n from seismic group by 1")
def s3_reasons_of_invalid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.validated(_text(spark, sf_dir), "flag").groupBy("reason").agg(F.count("*").alias("n"))


@query(WITH + f"select event_id, t - case when event_id % 3 = 1 then 18000 else 0 end as t, magnitude from seismic where {_REASON} is null")
def s3_valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.validated(_text(spark, sf_dir), "skip").select("event_id", times.epoch_seconds(F.col("time")).alias("t"), "magnitude")


def _parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three overlapping catalogues of text, the second with its columns in another order."""
    rows = derived.seismic(spark, sf_dir).select(F.lit("seismic").alias("source"), F.date_format(F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, t)"), "yyyy-MM-dd'T'HH:mm:ss").alias("time"), F.col("magnitude").cast("string").alias("magnitude"), F.col("event_id").cast("string").alias("ref"), F.col("event_id").alias("k"))
    second = rows.where("k % 3 <> 0").select("ref", "magnitude", "time", "source")
    return [rows.where("k % 2 = 0").drop("k"), second, rows.where("k % 5 = 0").drop("k")]


_PARTS = WITH + ", parts as (select event_id, 0 as f from seismic where event_id % 2 = 0 union all select event_id, 1 from seismic where event_id % 3 <> 0 union all select event_id, 2 from seismic where event_id % 5 = 0) "


@query(_PARTS + "select event_id::varchar as ref, t, min(f) as file_no from parts join seismic using (event_id) group by event_id, t")
def s4_combined_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.combine(_parts(spark, sf_dir)).select("ref", times.epoch_seconds(times.utc(F.col("time"))).alias("t"), "file_no")


@query(_PARTS + "select count(*) as input_rows, count(distinct event_id) as output_rows, count(*) - count(distinct event_id) as duplicates_removed from parts")
def s4_combine_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.combine_stats(_parts(spark, sf_dir))


@query(WITH + f"""select source, coalesce(event_id, -1) as event_id, etas from (select 'seismic' as source, s.event_id, round(s.magnitude*2, 6) as etas from seismic s
 union all select case when parameter in ('ap','kp') then 'geomagnetic' when parameter = 'f107_observed' then 'solar' else 'tidal_ephemeris' end, null, null from ({derived.DRIVERS.removeprefix('drivers as (').removesuffix(')')}) )""")
def s5_published_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _long(spark, sf_dir).where("source <> 'gps'").withColumn("etas", F.lit(-1.0))
    made = derived.seismic(spark, sf_dir).select("event_id", rounded_to(F.col("magnitude") * 2, 6).alias("etas"))
    return catalog.publish(rows, made).select("source", F.coalesce("event_id", F.lit(-1)).alias("event_id"), "etas")


@query(WITH + "select split, magnitude >= 1.75::double as complete, count(*) as n, count(distinct event_id) as ids from seismic group by all")
def p1_p5_seismic_and_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = _long(spark, sf_dir).withColumn("source", F.when(F.col("event_id") % 2 == 0, " Seismic ").otherwise(F.col("source")))
    s = catalog.seismic(mixed)
    done = catalog.complete(s).withColumn("complete", F.lit(True)).unionByName(s.where("magnitude < 1.75").withColumn("complete", F.lit(False)))
    return done.groupBy("split", "complete").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query(WITH + "select event_id, t as seconds, round(t/86400.0::double, 6) as days, extract('year' from make_timestamp(t*1000000)) as year from seismic")
def p2_utc_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived.seismic(spark, sf_dir)
    return s.select("event_id", times.epoch_seconds(F.col("time")).alias("seconds"), rounded_to(times.epoch_days(F.col("time")), 6).alias("days"), F.year(times.day_of(F.col("t"))).cast("long").alias("year"))


@query(WITH + f"select count(*) as n, count(latitude) as latitudes, round(sum(m), 4) as total from (select event_id, case when event_id % 37 <> 0 then latitude end as latitude, magnitude as m from seismic where event_id % 43 <> 0 and event_id % 37 <> 0 and event_id % 41 <> 0)")
def p3_p4_coerced_and_complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["latitude", "longitude", "magnitude"]
    num = _text(spark, sf_dir).withColumns({c: F.col(c).try_cast("double") for c in cols}).dropna(subset=cols)
    from quakelode.functions.geo import valid_place

    good = num.where(valid_place(F.col("latitude"), F.col("longitude")))
    return good.agg(F.count("*").alias("n"), F.count("latitude").alias("latitudes"), rounded_to(F.sum("magnitude"), 4).alias("total"))


@query(WITH + "select event_id, (t >= 852076800 and latitude between 30 and 45 and longitude between -85 and -70)::int as is_target from seismic where magnitude > 1.75::double and t > 852076800 - 180*86400 and t < 883612800")
def p6_study_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = catalog.in_study(derived.seismic(spark, sf_dir), 852076800, 883612800, (30.0, 45.0, -85.0, -70.0), 180.0, 1.75)
    return s.select("event_id", F.col("is_target").cast("int").alias("is_target"))


@query(WITH + ", home as (select 38.0::double as latitude, -77.5::double as longitude) select event_id, round(" + km_sql("home", "seismic") + ", 6) as km from seismic, home")
def p7_great_circle_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived.seismic(spark, sf_dir)
    return s.select("event_id", rounded_to(great_circle_km(F.lit(38.0), F.lit(-77.5), F.col("latitude"), F.col("longitude"), EARTH_KM), 6).alias("km"))


_TAU = "2*pi()*"


@query(WITH + f", d as (select event_id, t, date '1970-01-01' + (t//86400)::int as day, (t % 86400)//3600 as hour from seismic), e as (select event_id, t//86400 as unix_days, hour, isodow(day) - 1 as weekday, dayofyear(day) as day_of_year, month(day) as month from d) select event_id, unix_days, hour::int as hour, weekday::int as weekday, day_of_year::int as day_of_year, month::int as month, " + ", ".join(f"round({f}({_TAU}{c}/{p}::double), 6) + 0.0 as {c}_{f}" for c, p in (("hour", 24.0), ("weekday", 7.0), ("day_of_year", 365.25), ("month", 12.0)) for f in ("sin", "cos")) + " from e")
def p13_calendar_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = times.cycles(F.col("t"))
    out = derived.seismic(spark, sf_dir).select("event_id", *(v.alias(k) for k, v in c.items()))
    return out.select("event_id", "unix_days", "hour", "weekday", "day_of_year", "month", *(r6(k) for k in c if k.endswith(("_sin", "_cos"))))


@query(WITH + "select event_id, round((magnitude - min(magnitude) over ())/(max(magnitude) over () - min(magnitude) over ()), 6) as magnitude, round((depth_km - min(depth_km) over ())/(max(depth_km) over () - min(depth_km) over ()), 6) as depth_km from seismic")
def p14_min_max_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = learn.min_max(derived.seismic(spark, sf_dir), ["magnitude", "depth_km"])
    return s.select("event_id", r6("magnitude"), r6("depth_km"))


@query(WITH + ", k as (select avg(magnitude) as m, stddev_pop(magnitude) as s from seismic where split = 'train') select event_id, round(pi()*least(1.0::double, greatest(-1.0::double, (magnitude - m)/s)), 6) + 0.0 as magnitude from seismic, k")
def p15_standardised_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived.seismic(spark, sf_dir)
    return learn.angles(s, s.where("split = 'train'"), ["magnitude"]).select("event_id", r6("magnitude"))


@query(WITH + "select event_id, round(pow(depth_km + 0.566::double, -0.22::double)*(exp(-0.22::double*ln(1 + 30.0::double/(depth_km + 0.566::double))) - 1)/(-0.22::double), 6) as general, round(ln(1 + 30.0::double/(depth_km + 0.566::double)), 6) as at_one from seismic")
def p16_time_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived.seismic(spark, sf_dir)
    return s.select("event_id", rounded_to(time_integral(F.col("depth_km"), 30.0, 0.566, 1.22), 6).alias("general"), rounded_to(time_integral(F.col("depth_km"), 30.0, 0.566, 1.0), 6).alias("at_one"))


@query(WITH + "select event_id, round({}, 3) as x, round({}, 3) as y from seismic".format(*albers_sql("latitude", "longitude")))
def p18_projected_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = albers_xy(F.col("latitude"), F.col("longitude"))
    return derived.seismic(spark, sf_dir).select("event_id", rounded_to(x, 3).alias("x"), rounded_to(y, 3).alias("y"))


@query(WITH + "select event_id, split, row_number() over (partition by split order by t, event_id) as ordinal from seismic")
def w1_chronological_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.chronological(derived.seismic(spark, sf_dir)).select("event_id", "split", F.col("ordinal").cast("long").alias("ordinal"))


@query(WITH + "select t//2592000 as period, floor(latitude)::bigint as place, count(*) as n from seismic group by all having count(*) > 1")
def w3_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived.seismic(spark, sf_dir).select(F.floor(F.col("t") / 2592000).alias("time"), F.floor("latitude").alias("latitude"), F.lit(0).alias("longitude"), F.lit(0).alias("magnitude"))
    return catalog.duplicate_events(s).select(F.col("time").alias("period"), F.col("latitude").alias("place"), "n")


@query(WITH + ", twice as (select t, latitude, longitude, magnitude from seismic union all select t, latitude, longitude, magnitude from seismic where event_id % 50 = 0) select t, round(latitude, 6) as latitude, round(longitude, 6) as longitude, magnitude, count(*) as n from twice group by t, twice.latitude, twice.longitude, magnitude having count(*) > 1")
def w3_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived.seismic(spark, sf_dir)
    return catalog.duplicate_events(s.unionByName(s.where("event_id % 50 = 0")).withColumn("time", F.col("t"))).select(F.col("time").alias("t"), r6("latitude"), r6("longitude"), "magnitude", "n")


@query(WITH + ", roles as (select unnest(['train','test','judge']) as role, unnest([1,2,3]) as k) select role, count(*) as history, count(*) filter (split = role) as own from roles, seismic where k >= case split when 'train' then 1 when 'test' then 2 else 3 end group by role")
def j16_history_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived.seismic(spark, sf_dir)
    parts = [catalog.history(s, role).withColumn("role", F.lit(role)) for role in ("train", "test", "judge")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("role").agg(F.count("*").alias("history"), F.count_if(F.col("split") == F.col("role")).alias("own"))


@query(WITH + ", h as (select * from seismic where t >= 820454400 and t < 915148800) select count(*) as n, min(t) as first_t, max(t) as last_t from h")
def a9_bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.bounded_history(derived.seismic(spark, sf_dir), 820454400, 915148800).agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
