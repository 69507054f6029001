"""The task's tables, derived from the driver's business tables by plain arithmetic, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {})"


def _tie_free(x: Column, digits: int) -> Column:
    """Rounded in binary arithmetic, as SQL engines do, so that both sides agree on ties."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seismic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, t, time, latitude, longitude, magnitude, depth_km, split); t is in epoch seconds."""
    start = EPOCH.format("cast(o_orderdate as timestamp_ntz)")
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as event_id",
        f"cast({start} + (o_orderkey * 7919) % 86400 as bigint) as t",
        f"timestamp_seconds({start} + (o_orderkey * 7919) % 86400) as time",
        "25.25d + (((o_custkey % 97) * 37) % 97) * 0.25d + ((o_orderkey * 31) % 41 - 20) * 0.01d as latitude",
        "-89.75d + (((o_custkey % 89) * 53) % 89) * 0.25d + ((o_orderkey * 17) % 41 - 20) * 0.01d as longitude",
        "floor((1.0d + 3.5d * pow(((o_orderkey * 7877) % 1000) / 1000.0d, 3)) * 100 + 0.5d) / 100.0d as magnitude",
        "floor(o_totalprice / 20000.0d * 1000 + 0.5d) / 1000.0d as depth_km",
        "case when cast(o_orderdate as date) < date'1999-01-01' then 'train' when cast(o_orderdate as date) < date'2000-07-01' then 'test' else 'judge' end as split",
    )


SEISMIC = """seismic as (select o_orderkey as event_id, cast(epoch(cast(o_orderdate as timestamp)) as bigint) + (o_orderkey*7919) % 86400 as t,
 25.25::double + (((o_custkey%97)*37) % 97)*0.25::double + ((o_orderkey*31) % 41 - 20)*0.01::double as latitude,
 -89.75::double + (((o_custkey%89)*53) % 89)*0.25::double + ((o_orderkey*17) % 41 - 20)*0.01::double as longitude,
 floor((1.0::double + 3.5::double*pow(((o_orderkey*7877) % 1000)/1000.0::double, 3))*100 + 0.5::double)/100.0::double as magnitude,
 floor(o_totalprice/20000.0::double*1000 + 0.5::double)/1000.0::double as depth_km,
 case when cast(o_orderdate as date) < date '1999-01-01' then 'train' when cast(o_orderdate as date) < date '2000-07-01' then 'test' else 'judge' end as split from orders)"""

DRIVER_NAMES = ("ap", "kp", "f107_observed", "tidal_potential", "lunar_phase")


def drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, parameter, value): daily series."""
    rank = "element_at(array('ap','kp','f107_observed','tidal_potential','lunar_phase'), cast(substr(o_orderpriority, 1, 1) as int))"
    orders = table(spark, sf_dir, "orders").selectExpr("cast(o_orderdate as date) as date", f"{rank} as parameter", "o_totalprice")
    return orders.groupBy("date", "parameter").agg(_tie_free(F.avg("o_totalprice") / 10000, 6).alias("value"))


DRIVERS = """drivers as (select cast(o_orderdate as date) as date, ['ap','kp','f107_observed','tidal_potential','lunar_phase'][cast(substr(o_orderpriority,1,1) as int)] as parameter,
 floor(avg(o_totalprice)/10000*1000000.0::double + 0.5::double)/1000000.0::double as value from orders group by all)"""


def gps_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, station_id, latitude, longitude, east_m, north_m, up_m)."""
    items = table(spark, sf_dir, "lineitem").selectExpr("cast(l_shipdate as date) as date", "l_suppkey % 18 as k", "l_quantity", "l_extendedprice", "l_discount")
    means = items.groupBy("date", "k").agg(_tie_free(F.avg("l_quantity") / 1000, 9).alias("east_m"), _tie_free(F.avg("l_extendedprice") / 1e6, 9).alias("north_m"), _tie_free(F.avg("l_discount"), 9).alias("up_m"))
    return means.selectExpr("date", "concat('st', k) as station_id", "26d + (k * 5 % 18) * 1.25d as latitude", "-89d + (k * 7 % 18) * 1.25d as longitude", "east_m", "north_m", "up_m")


def gps_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gps_wide(spark, sf_dir).selectExpr("date", "station_id", "latitude", "longitude", "stack(3, 'east_m', east_m, 'north_m', north_m, 'up_m', up_m) as (parameter, value)")


GPS = """gps as (select cast(l_shipdate as date) as date, 'st' || (l_suppkey % 18) as station_id, 26::double + (l_suppkey % 18 * 5 % 18) * 1.25::double as latitude,
 -89::double + (l_suppkey % 18 * 7 % 18) * 1.25::double as longitude, floor(avg(l_quantity)/1000*1000000000.0::double + 0.5::double)/1000000000.0::double as east_m, floor(avg(l_extendedprice)/1e6::double*1000000000.0::double + 0.5::double)/1000000000.0::double as north_m, floor(avg(l_discount)*1000000000.0::double + 0.5::double)/1000000000.0::double as up_m
 from lineitem group by all)"""


def coastline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr("0 as line_id", "n_nationkey as seq", "25d + n_nationkey as latitude", "-80d + (n_nationkey * 7 % 5) as longitude")


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr("n_regionkey as line_id", "n_nationkey as seq", "26d + (n_nationkey * 11 % 23) as latitude", "-88d + (n_nationkey * 3 % 20) as longitude")


LINES = """coastline as (select 0 as line_id, n_nationkey as seq, 25::double + n_nationkey as latitude, -80::double + (n_nationkey*7 % 5) as longitude from nation),
faults as (select n_regionkey as line_id, n_nationkey as seq, 26::double + (n_nationkey*11 % 23) as latitude, -88::double + (n_nationkey*3 % 20) as longitude from nation)"""


def elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, elevation) by cell number in the regional grid of half degrees."""
    return table(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) as cell", "case when p_partkey % 7 <> 0 then cast(p_retailprice as double) end as elevation").where("cell < 2500")


ELEVATION = "elevation as (select cast(p_partkey as bigint) as cell, case when p_partkey % 7 <> 0 then cast(p_retailprice as double) end as elevation from part where p_partkey < 2500)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, split, y, p), with ties among the scores."""
    p = "0.6d * ((o_orderkey * 7877) % 1000) / 1000.0d + 0.4d * ((o_orderkey * 104729) % 1000) / 1000.0d as p"
    base = seismic(spark, sf_dir).select("event_id", "split", F.when(F.col("magnitude") >= 2.0, 1).otherwise(0).alias("y"))
    scores = table(spark, sf_dir, "orders").selectExpr("o_orderkey as event_id", "o_orderpriority as model", p)
    return base.join(scores, "event_id").select("event_id", "model", "split", "y", "p")


PREDICTIONS = SEISMIC + """, predictions as (select event_id, o_orderpriority as model, split, case when magnitude >= 2.0::double then 1 else 0 end as y,
 0.6::double*((o_orderkey*7877) % 1000)/1000.0::double + 0.4::double*((o_orderkey*104729) % 1000)/1000.0::double as p from seismic join orders on event_id = o_orderkey)"""


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, basis, bitstring, n): counts of two-bit outcomes; qubit 0 is the rightmost."""
    bits = "element_at(array('00','01','10','11'), cast((event_id * 31 % 7) % 4 + 1 as int))"
    e = table(spark, sf_dir, "events").selectExpr("cast(user_id as bigint) as run_id", "case when user_id % 2 = 0 then 'Z' else 'X' end as basis", f"{bits} as bitstring")
    return e.groupBy("run_id", "basis", "bitstring").agg(F.count("*").alias("n"))


SHOTS = """shots as (select cast(user_id as bigint) as run_id, case when user_id % 2 = 0 then 'Z' else 'X' end as basis, ['00','01','10','11'][(event_id*31 % 7) % 4 + 1] as bitstring, count(*) as n from events group by all)"""
