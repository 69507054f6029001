"""Queries over measurement counts, and over streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakelode.operators import shots
from quakelode.plans.catalog import r6
from quakelode.plans.registry import Registry
from quakelode.sources import derived
from quakelode.sources.paths import shared_dir
from quakelode.streaming import catalog as streams

query = Registry()
QUERIES, SQL = query.queries, query.sql
WITH = f"with {derived.SHOTS} "


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.shots(spark, sf_dir)


@query(WITH + "select run_id, bitstring, n, round(n/(sum(n) over (partition by run_id))::double, 6) as p from shots")
def c1_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shots.probabilities(_shots(spark, sf_dir)).select("run_id", "bitstring", "n", r6("p"))


@query(WITH + "select run_id, round(coalesce(sum(n) filter (bitstring = '11'), 0)/sum(n)::double, 6) as p from shots group by run_id")
def c1_outcome_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shots.outcome_probability(_shots(spark, sf_dir), "11").select("run_id", r6("p"))


@query(WITH + "select run_id, bitstring, n from (select *, row_number() over (partition by run_id order by n desc, bitstring) as k from shots) where k = 1")
def c2_most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shots.most_common(_shots(spark, sf_dir))


@query(WITH + "select run_id, round(sum(n*case when bitstring[2] = '1' then -1 else 1 end)/sum(n)::double, 6) + 0.0 as z0, round(sum(n*case when bitstring[1] = '1' then -1 else 1 end)/sum(n)::double, 6) + 0.0 as z1, round(sum(n*case when bitstring in ('01','10') then -1 else 1 end)/sum(n)::double, 6) + 0.0 as zz from shots group by run_id")
def c3_parities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shots.parities(_shots(spark, sf_dir)).select("run_id", r6("z0"), r6("z1"), r6("zz"))


@query(WITH + "select run_id, round(coalesce(sum(n) filter (bitstring in ('01','10')), 0)/sum(n)::double, 6) as impossible from shots group by run_id")
def c4_impossible_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shots.impossible_share(_shots(spark, sf_dir)).select("run_id", r6("impossible"))


@query(WITH + ", p as (select run_id, bitstring, n/(sum(n) over (partition by run_id))::double as p from shots), r as (select distinct run_id from shots) select a.run_id, b.run_id as other_id, round(coalesce((select pow(sum(sqrt(x.p*y.p)), 2) from p x join p y using (bitstring) where x.run_id = a.run_id and y.run_id = b.run_id), 0.0::double), 6) as fidelity from r a join r b on b.run_id = a.run_id + 1 where a.run_id % 2 = 0")
def c5_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _shots(spark, sf_dir).withColumn("pair_id", F.floor(F.col("run_id") / 2))
    return shots.fidelity(s.where("run_id % 2 = 0"), s.where("run_id % 2 = 1")).select("run_id", "other_id", r6("fidelity"))


_CAL = WITH + ", cal as (select ['00','01','10','11'][run_id % 4 + 1] as prepared, bitstring, n from shots)"
_READ = ", ".join(f"round(coalesce(sum(n) filter (bitstring = '{b}'), 0)/sum(n)::double, 6) as p_{b}" for b in shots.TWO_BITS)


def _calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shots(spark, sf_dir).selectExpr("element_at(array('00','01','10','11'), cast(run_id % 4 + 1 as int)) as prepared", "bitstring", "n")


@query(_CAL + f" select prepared, {_READ} from cal group by prepared")
def c6_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shots.confusion_matrix(_calibration(spark, sf_dir)).select("prepared", *(r6(f"p_{b}") for b in shots.TWO_BITS))


@query()
def c7_mitigated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    boosted = _calibration(spark, sf_dir).withColumn("n", F.when(F.col("prepared") == F.col("bitstring"), F.col("n") * 20).otherwise(F.col("n")))
    return shots.mitigated(_shots(spark, sf_dir), shots.confusion_matrix(boosted))


_SCALES = WITH + ", m as (select run_id, (case bitstring when '00' then 1 when '01' then 3 when '10' then 5 else 7 end)::double as scale, n::double as value from shots), f as (select run_id from m group by 1 having count(*) = 4)"


@query(_SCALES + """, s as (select run_id, regr_intercept(value, scale) as linear, count(*)::double as n, sum(scale) as x1, sum(scale**2) as x2, sum(scale**3) as x3, sum(scale**4) as x4, sum(value) as y0, sum(scale*value) as y1, sum(scale**2*value) as y2 from m where run_id in (select run_id from f) group by 1)
 select run_id, round(linear, 6) + 0.0 as linear, round((y0*(x2*x4 - x3*x3) - x1*(y1*x4 - x3*y2) + x2*(y1*x3 - x2*y2))/(n*(x2*x4 - x3*x3) - x1*(x1*x4 - x3*x2) + x2*(x1*x3 - x2*x2)), 6) + 0.0 as quadratic from s""")
def c8_extrapolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _shots(spark, sf_dir).selectExpr("run_id", "cast(case bitstring when '00' then 1 when '01' then 3 when '10' then 5 else 7 end as double) as scale", "cast(n as double) as value")
    full = m.groupBy("run_id").count().where("count = 4").select("run_id")
    return shots.extrapolated(m.join(full, "run_id")).select("run_id", r6("linear"), r6("quadratic"))


@query(WITH + ", z as (select run_id, sum(n*case when bitstring[2] = '1' then -1 else 1 end)/sum(n)::double as z0, sum(n*case when bitstring in ('01','10') then -1 else 1 end)/sum(n)::double as zz from shots group by run_id) select run_id, round(-0.5::double*z0 + 0.25::double*zz, 6) + 0.0 as energy from z")
def c9_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = shots.parities(_shots(spark, sf_dir)).selectExpr("run_id", "stack(3, 'z0', z0, 'z1', z1, 'zz', zz) as (term, value)")
    terms = spark.createDataFrame([("z0", -0.5), ("zz", 0.25)], "term string, coefficient double")
    return shots.energies(z, terms).select("run_id", r6("energy"))


@query("""with q as (select p_partkey as qubit, p_retailprice/10.0::double as t1, (p_size + p_partkey % 17)::double as t2, (p_partkey*37 % 1000)/10000.0::double as readout_error from part),
 e as (select s_suppkey as a, s_suppkey + 1 as b, case when s_suppkey % 19 = 0 then 1.0::double else ((s_suppkey*71 + 13) % 500 + 1)/10000.0::double end as error from supplier)
 select round(quantile_cont(t1, 0.5), 6) as median_t1, round(quantile_cont(t2, 0.5), 6) as median_t2, round(quantile_cont(readout_error, 0.5), 6) as median_readout, count(*) filter (t1 <= 95) as unusable_qubits,
 (select round(quantile_cont(error, 0.5), 6) from e where error < 1) as median_error, (select count(*) from e where error >= 1) as unusable_edges,
 (select max(c) from (select count(*) as c from (select a as q from e union all select b from e) group by q)) as largest_degree,
 (select a from e order by error, a, b limit 1) as best_a, (select b from e order by error, a, b limit 1) as best_b, (select round(min(error), 6) from e) as best_error from q""")
def c10_calibration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = derived.table(spark, sf_dir, "part").selectExpr("p_partkey as qubit", "p_retailprice / 10.0d as t1", "cast(p_size + p_partkey % 17 as double) as t2", "(p_partkey * 37 % 1000) / 10000.0d as readout_error")
    e = derived.table(spark, sf_dir, "supplier").selectExpr("s_suppkey as a", "s_suppkey + 1 as b", "case when s_suppkey % 19 = 0 then 1.0d else ((s_suppkey * 71 + 13) % 500 + 1) / 10000.0d end as error")
    out = shots.calibration_report(q, e, 95.0)
    return out.select(*(r6(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query(WITH + ", e as (select * from (values (0, 1)) v(a, b)), c as (select run_id, bitstring, n, (bitstring[2] <> bitstring[1])::int as cut from shots), m as (select *, max(cut) over (partition by run_id) as best from c) select run_id, round(sum(cut*n)/sum(n)::double, 6) as mean_cut, max(best)::bigint as best_cut, round(coalesce(sum(n) filter (cut = best), 0)/sum(n)::double, 6) as optimum_share from m group by run_id")
def c11_cut_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.createDataFrame([(0, 1)], "a int, b int")
    return shots.cut_values(_shots(spark, sf_dir), edges).select("run_id", r6("mean_cut"), "best_cut", r6("optimum_share"))


#: Rows in a file of the stream, more or less.
STREAM_ROWS = 500_000


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue as a stream of one batch a year: with some places that are none, some records twice, and in
    each year's batch some of two years before anew, with another depth. All batches are of the same number of files,
    which follows the year with the most rows; where rows are too few for so many, files without any make up for them."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    s = derived.seismic(spark, sf_dir).select("event_id", "time", F.when(F.col("event_id") % 29 == 0, 99.0).otherwise(F.col("latitude")).alias("latitude"), "longitude", "depth_km", "magnitude")
    twice, anew = s.where("event_id % 5 = 0"), s.where("event_id % 7 = 0").withColumn("depth_km", F.col("depth_km") + 1000)
    first, last, most = s.groupBy(F.year("time").alias("y")).agg(F.count("*").alias("n")).agg(F.min("y"), F.max("y"), F.max("n")).first()
    files = -(-most // STREAM_ROWS)
    for year in range(first, last + 1):
        parts = [df.where(F.year("time") == y) for df, y in ((s, year), (twice, year), (anew, year - 2))]
        parts[0].unionByName(parts[1]).unionByName(parts[2]).repartition(files, "event_id").write.mode("append").parquet(path)
        for _ in range(files * (year - first + 1) - len(spark.read.schema(s.schema).parquet(path).inputFiles())):
            s.limit(0).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(s.schema).option("maxFilesPerTrigger", files).parquet(path)


def _drained(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    path = f"{shared_dir(spark)}/drained-{uuid.uuid4().hex}"
    streams.to_table(stream, f"{path}/data", f"{path}/state", mode).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


_INGESTED = f"""with {derived.SEISMIC}, s as (select event_id, t, depth_km, year(make_timestamp(t*1000000)) as y from seismic where event_id % 29 <> 0),
w as (select y, max(t) as latest from s group by y)
select event_id, t, round(depth_km, 3) as depth_km from s
union all select event_id, t, round(depth_km + 1000, 3) from s join w using (y) where event_id % 7 = 0 and t > latest - 2*86400 and y + 2 <= (select max(y) from w)"""


@query(_INGESTED)
def t1_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that come two years late are dropped, but for those of the last two days before their own year's last event:
    a batch is held against the watermark that stood before the batch before it."""
    out = streams.ingest(_stream(spark, sf_dir), "2 days")
    return _drained(spark, out).select("event_id", F.unix_timestamp("time").alias("t"), F.round("depth_km", 3).alias("depth_km"))


@query(f"with {derived.SEISMIC}, w as (select unnest(range(floor(t/86400)::bigint - 29, floor(t/86400)::bigint + 1)) as day, floor(latitude/0.5::double)::bigint as row, floor(longitude/0.5::double)::bigint as col from seismic), c as (select day*86400 as window_start, (day + 30)*86400 as window_end, row, col, count(*) as n from w group by all) select window_start, window_end, row, col, n from c where window_end <= (select max(t) from seismic)")
def t2_rolling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    s = derived.seismic(spark, sf_dir).select("time", "latitude", "longitude")
    s.write.parquet(path)
    counts = streams.rolling_counts(spark.readStream.schema(s.schema).parquet(path), late="0 seconds")
    return _drained(spark, counts)
