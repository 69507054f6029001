"""Queries over predictions, models and forecasts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakelode.operators import features, forecast, grid, learn, metrics
from quakelode.plans.catalog import r6
from quakelode.plans.registry import Registry, rounded_to
from quakelode.sources import catalog, derived

query = Registry()
QUERIES, SQL = query.queries, query.sql
BY = ["model", "split"]
WITH = f"with {derived.PREDICTIONS}, base as (select model, avg(y) as base from predictions where split = 'train' group by model) "


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places. ece, of hundredths of few rows, lies on ties of that; a billionth moves it off them."""
    df = df.withColumn("ece", F.col("ece") + 1e-9) if "ece" in df.columns else df
    return df.select(*(r6(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def clip_sql(x: str, clip: str = "1e-4") -> str:
    return f"least(1 - {clip}::double, greatest({clip}::double, {x}))"


_IG = f"avg(case when y = 1 then log2({clip_sql('p')}) - log2({clip_sql('base')}) else log2(1 - {clip_sql('p')}) - log2(1 - {clip_sql('base')}) end)"


@query(WITH + f"select model, split, round({_IG}, 6) + 0.0 as ig_bits from predictions join base using (model) group by all")
def m9_information_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived.predictions(spark, sf_dir)
    base = p.where("split = 'train'").groupBy("model").agg(F.avg("y").alias("base"))
    return rounded(metrics.information_gain(p.join(base, "model"), F.col("base"), BY))


_EDGES = [i * 0.1 for i in range(10)] + [1.0]
_BIN = "case " + " ".join(f"when p >= {a!r}::double and p < {b!r}::double then {k}" for k, (a, b) in enumerate(zip(_EDGES[:-1], _EDGES[1:], strict=True)))


def ece_sql(closed: bool) -> str:
    return f"select model, split, round(sum(case when bin is null then 0 else n*abs(rate - mean)/total end) + 1e-9::double, 6) as ece from (select *, sum(n) over (partition by model, split) as total from (select model, split, bin, count(*) as n, avg(y) as rate, avg(p) as mean from (select *, {_BIN}{' when p = 1 then 9' if closed else ''} end as bin from predictions) group by model, split, bin)) group by model, split"


@query(WITH + ece_sql(False))
def m10_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.calibration_error(derived.predictions(spark, sf_dir), BY))


@query(WITH + ", spoilt as (select model, split, y, case when event_id % 50 = 0 then 1.0::double else p end as p from predictions) " + ece_sql(True).replace("from predictions", "from spoilt"))
def m10_calibration_error_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived.predictions(spark, sf_dir).withColumn("p", F.when(F.col("event_id") % 50 == 0, 1.0).otherwise(F.col("p")))
    return rounded(metrics.calibration_error(p, BY, closed=True))


_PROPER = f"count(*) as n, sum(y)::bigint as positives, round(avg(y), 6) as base_rate, round(avg(pow(p - y, 2)), 6) as brier, round(avg(case when y = 1 then -ln({clip_sql('p')}) else -ln(1 - {clip_sql('p')}) end), 6) as log_loss"


@query(WITH + f"select model, split, {_PROPER} from predictions group by all")
def m11_proper_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.proper_scores(derived.predictions(spark, sf_dir), BY))


_CURVE = ", s as (select model, split, p, sum(y)::bigint as pos, sum(1 - y)::bigint as neg from predictions group by all), c as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by model, split) as positives, sum(neg) over (partition by model, split) as negatives from s window w as (partition by model, split order by p desc))"
_AUC = "sum(neg*(tp - pos + pos/2.0::double))/(any_value(positives)*any_value(negatives))::double"
_AP = "sum(pos*tp/(tp + fp)::double)/any_value(positives)::double"


@query(WITH + _CURVE + f" select model, split, round({_AUC}, 6) as auc from c group by all")
def m12_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.roc_auc(derived.predictions(spark, sf_dir), BY))


@query(WITH + _CURVE + f" select model, split, round({_AP}, 6) as pr_auc from c group by all")
def m13_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.average_precision(derived.predictions(spark, sf_dir), BY))


@query(WITH + _CURVE + " select model, split, round(p, 6) as p, tp::bigint as tp, fp::bigint as fp from c")
def w6_score_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.curve(derived.predictions(spark, sf_dir), BY).select(*BY, r6("p"), "tp", "fp")


@query(WITH + _CURVE + " select model, split, round(p, 6) as p, round(tp/positives::double, 6) as tpr, round(fp/negatives::double, 6) as fpr, round(tp/(tp + fp)::double, 6) as precision, round(tp/positives::double, 6) as recall from c")
def m15_curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.curve_points(derived.predictions(spark, sf_dir), BY))


def confusion_sql(threshold: float) -> str:
    return f"select *, round((tp + tn)/(tp + tn + fp + fn)::double, 6) as accuracy, round(coalesce(tp/nullif(tp + fp, 0)::double, 0), 6) as precision, round(coalesce(tp/nullif(tp + fn, 0)::double, 0), 6) as recall, round(coalesce(2*tp/nullif(2*tp + fp + fn, 0)::double, 0), 6) as f1 from (select model, split, count(*) filter (p < {threshold}::double and y = 0) as tn, count(*) filter (p >= {threshold}::double and y = 0) as fp, count(*) filter (p < {threshold}::double and y = 1) as fn, count(*) filter (p >= {threshold}::double and y = 1) as tp from predictions group by all)"


@query(WITH + confusion_sql(0.65))
def m14_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.confusion(derived.predictions(spark, sf_dir), BY, 0.65))


@query(WITH + ", e as (select model, split, quantile_cont(p, [" + ", ".join(str(k / 10) for k in range(1, 10)) + "]) as edges from predictions group by all) select model, split, len(list_filter(edges, lambda x: x < p))::int as bin, count(*) as n, round(avg(p), 6) as mean, round(avg(y), 6) as rate from predictions join e using (model, split) group by all")
def m16_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.reliability(derived.predictions(spark, sf_dir), BY))


@query(WITH + _CURVE + f", a as (select model, split, {_PROPER} from predictions group by all), b as (select model, split, round({_IG}, 6) + 0.0 as ig_bits from predictions join base using (model) group by all), d as ({ece_sql(False)}), e as (select model, split, round({_AUC}, 6) as auc, round({_AP}, 6) as pr_auc from c group by all), f as ({confusion_sql(0.5)}) select * from a join b using (model, split) join d using (model, split) join e using (model, split) join f using (model, split)")
def m17_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.scorecard(derived.predictions(spark, sf_dir)))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.seismic(spark, sf_dir).withColumn("depth_km", F.when(F.col("event_id") % 7 != 0, F.col("depth_km")))


@query(f"with {derived.SEISMIC}, g as (select event_id, split, case when event_id % 7 <> 0 then depth_km end as d from seismic) select event_id, round(coalesce(d, (select quantile_cont(d, 0.5) from g where split = 'train')), 6) as depth_km from g")
def m4_median_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _gaps(spark, sf_dir)
    return learn.imputed(s, s.where("split = 'train'"), ["depth_km"]).select("event_id", r6("depth_km"))


@query(f"with {derived.SEISMIC}, k as (select avg(magnitude) as m, stddev_pop(magnitude) as s, avg(depth_km) as dm, stddev_pop(depth_km) as ds from seismic where split = 'train') select event_id, round((magnitude - m)/s, 6) + 0.0 as magnitude, round((depth_km - dm)/ds, 6) + 0.0 as depth_km from seismic, k")
def m5_standardisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived.seismic(spark, sf_dir)
    return rounded(learn.standardised(s, s.where("split = 'train'"), ["magnitude", "depth_km"]).select("event_id", "magnitude", "depth_km"))


@query(f"with {derived.SEISMIC} select 'latitude' as a, 'longitude' as b, round(corr(latitude, longitude), 6) as r from seismic union all select 'latitude', 'magnitude', round(corr(latitude, magnitude), 6) from seismic union all select 'longitude', 'magnitude', round(corr(longitude, magnitude), 6) from seismic")
def a20_correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(learn.correlations(derived.seismic(spark, sf_dir), ["latitude", "longitude", "magnitude"]))


#: A forecast by rule, for the queries that read forecasts: every active cell at every test issue date.
def _forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quakelode.plans.cells import _cells, _issues

    f = features.spine(_cells(spark, sf_dir), _issues(spark, "test"))
    rule = F.pmod(F.col("row") * 31 + F.col("col") * 17 + F.col("month") * 7, F.lit(101)) / 100.0
    return forecast.forecast_table(f.withColumn("p", rule))


def _forecast_sql() -> str:
    from quakelode.plans.cells import CELLS, issues_sql

    return f"with {derived.SEISMIC}" + CELLS + issues_sql("test") + ", forecast as (select latitude as cell_lat, longitude as cell_lon, issue_date, least(0.9999::double, greatest(0.0001::double, (((row*31 + col*17 + (year(issue_date)*12 + month(issue_date) - 1)*7) % 101 + 101) % 101)/100.0::double)) as probability from cells, issues)"


_DAY = "(issue_date - date '1970-01-01')::int as issue_day"


def _day(df: DataFrame) -> DataFrame:
    return df.select(F.datediff("issue_date", F.lit("1970-01-01").cast("date")).alias("issue_day"), *(c for c in df.columns if c != "issue_date"))


@query(_forecast_sql() + f" select {_DAY}, cell_lat, cell_lon, round(probability, 6) as probability from forecast")
def s7_forecast_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quakelode.sources.paths import shared_dir

    path = f"{shared_dir(spark)}/forecast-{uuid.uuid4().hex}"
    catalog.write_table(_forecast(spark, sf_dir), path, by="issue_date")
    return _day(rounded(spark.read.schema("cell_lat double, cell_lon double, probability double, issue_date date").parquet(path)))


@query(_forecast_sql() + f" select {_DAY}, round(cell_lat, 6) as cell_lat, round(cell_lon, 6) as cell_lon, round(avg(probability), 6) as probability from forecast group by all")
def a16_forecast_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(rounded(forecast.long_matrix(_forecast(spark, sf_dir))))


@query(_forecast_sql() + f" select {_DAY}, count(*) as cells, 0::bigint as missing, round(min(probability), 6) as min_p, round(max(probability), 6) as max_p, round(avg(probability), 6) as mean_p from forecast group by all")
def a17_forecast_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(rounded(forecast.summary(_forecast(spark, sf_dir))))


@query(_forecast_sql() + ", d as (select distinct cell_lat from forecast), s as (select cell_lat - lag(cell_lat) over (order by cell_lat) as step from d) select round(quantile_cont(step, 0.5), 6) as spacing from s")
def a18_grid_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(forecast.spacing(_forecast(spark, sf_dir), "cell_lat"))


@query(_forecast_sql() + f" select {_DAY}, cell_lat, cell_lon, round(probability, 6) as probability, round(probability/(select max(probability) from forecast), 6) as heat from forecast where probability > 0.2::double")
def a19_hot_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(rounded(forecast.hot_zones(_forecast(spark, sf_dir))))


@query(f"with {derived.SEISMIC}, k as (select o_orderpriority as model, split, count(*) as n, round(avg(magnitude), 6) as mean from seismic join orders on o_orderkey = event_id group by all) select * from k order by mean desc, model, split limit 5")
def w7_top_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = derived.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("model"))
    k = derived.seismic(spark, sf_dir).join(o, "event_id").groupBy(*BY).agg(F.count("*").alias("n"), rounded_to(F.avg("magnitude"), 6).alias("mean"))
    return k.orderBy(F.desc("mean"), *BY).limit(5)


def _examples(spark: SparkSession, sf_dir: str, split: str, known: DataFrame) -> DataFrame:
    from quakelode.plans.cells import _cells, _issues

    own = known.where(F.col("split") == split)
    cells = _cells(spark, sf_dir)
    out = features.examples(cells, _issues(spark, split), catalog.history(known, split), own)
    return out.join(cells, ["row", "col"]).withColumn("split", F.lit(split))


def grid_forecast(spark: SparkSession, sf_dir: str, rounds: int = 400) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored test rows, calibrated judge rows, scored grid of the judge's dates): the flagship run, model and all."""
    from quakelode.plans.cells import _issues

    known = catalog.written(catalog.complete(derived.seismic(spark, sf_dir)), "complete")
    columns = learn.FEATURE_SETS["baseline"]
    train, test, judge = (catalog.written(_examples(spark, sf_dir, s, known), f"examples-{s}") for s in ("train", "test", "judge"))
    model = learn.boosted(train, columns, rounds=rounds)
    raw = learn.scored(model, test, columns)
    calibrated = learn.calibrated(raw, learn.scored(model, judge, columns))
    cells = grid.scored_cells(spark, catalog.history(derived.seismic(spark, sf_dir), "test"))
    dates = _issues(spark, "judge")
    places = features.near_places(cells, known)
    table = features.place_windows(places, known, cells, dates).join(features.place_recency(places, known, cells, dates), ["row", "col", "issue_date"]).join(cells, ["row", "col"])
    return raw, calibrated, learn.calibrated(raw, learn.scored(model, table, columns))


@query()
def m1_m3_m18_grid_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.forecast_table(grid_forecast(spark, sf_dir)[2])


@query()
def m1_m17_model_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, judged, _ = grid_forecast(spark, sf_dir)
    rows = raw.select("split", "label", "p").unionByName(judged.select("split", "label", "p")).selectExpr("'boosted' as model", "split", "label as y", "p")
    base = rows.where("split = 'test'").groupBy("model").agg(F.avg("y").alias("base"))
    return metrics.scorecard(rows, base)


@query()
def m2_logistic_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived.seismic(spark, sf_dir)
    columns = ["latitude", "longitude", "depth_km", "magnitude"]
    rows = catalog.written(features.event_labels(s, s).select("event_id", "split", "label", *columns), "labelled")
    ready = learn.standardised(rows, rows.where("split = 'train'"), columns)
    return learn.scored(learn.logistic(ready.where("split = 'train'"), columns), ready, columns).select("event_id", "label", "p")


@query()
def m6_principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["latitude", "longitude", "depth_km", "magnitude"]
    return learn.components(derived.seismic(spark, sf_dir), columns, 2).select("event_id", "pc_1", "pc_2")


def settings_of_the_sweep() -> list[dict]:
    return [{"rounds": n, "depth": d, "rate": r, "l2": x} for n in (200, 400, 800) for d in (3, 4, 6) for r in (0.01, 0.05, 0.1) for x in (0.1, 1.0, 5.0)]


@query()
def m8_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived.seismic(spark, sf_dir)
    rows = features.event_labels(s, s).select("event_id", "split", "label", "latitude", "longitude", "depth_km", "magnitude")
    rows = catalog.written(rows.where("split in ('train', 'test')"), "sweep")
    return learn.sweep(rows.where("split = 'train'"), rows.where("split = 'test'"), ["latitude", "longitude", "depth_km", "magnitude"], settings_of_the_sweep())


@query()
def w7_best_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five settings of the sweep with the greatest gain; ties go to fewer rounds, then smaller values."""
    return m8_sweep(spark, sf_dir).orderBy(F.desc("ig_bits"), "rounds", "depth", "rate", "l2").limit(5)
