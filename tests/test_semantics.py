"""Edges of windows, radii and bins; values worked out by hand or by brute force."""

import json
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quakelode.constants import BAND_EDGES_KM, DAY, EARTH_KM, EARTH_MEAN_KM, PAPER
from quakelode.functions import etas as formulas
from quakelode.functions import times
from quakelode.functions.geo import great_circle_km
from quakelode.operators import etas, features, forecast, gps, grid, learn, metrics, shots
from quakelode.operators.neighbors import neighbour_pairs
from quakelode.sources import catalog, polylines

T0 = 10957 * DAY  # 2000-01-01
EVENTS = "event_id long, t long, latitude double, longitude double, magnitude double, split string"


def hav(a, b, radius=EARTH_KM):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * radius * math.asin(math.sqrt(min(1, max(0, h))))


@pytest.fixture(scope="module")
def cell(spark):
    return spark.createDataFrame([(80, -160, 40.25, -79.75), (81, -160, 44.0, -79.75)], "row long, col long, latitude double, longitude double")


@pytest.fixture(scope="module")
def issue(spark):
    return grid.issue_calendar(spark, "2000-01-01", "2000-01-01")


def event(k, t, m=2.5, lat=40.25, lon=-79.75):
    return (k, t, lat, lon, m, "train")


def test_windows_are_strict_at_the_issue_and_inclusive_at_their_age(spark, cell, issue):
    rows = [event(0, T0), *(event(10 + d, T0 - d * DAY, 2.0 + d / 1000) for d in (7, 30, 90, 365)), *(event(1000 + d, T0 - d * DAY - 1) for d in (7, 30, 90, 365))]
    near = features.near_events(cell, spark.createDataFrame(rows, EVENTS))
    got = {r.row: r for r in features.window_features(near, cell, issue).collect()}
    assert [got[80][f"count_{d}d"] for d in (7, 30, 90, 365)] == [1, 3, 5, 7]
    assert got[80].max_mag_30d == 2.5 and [got[81][f"count_{d}d"] for d in (7, 30, 90, 365)] == [0] * 4 and got[81].max_mag_365d == 0.0


def test_recency(spark, cell, issue):
    near = features.near_events(cell, spark.createDataFrame([event(1, T0 - 5000 * DAY), event(2, T0)], EVENTS))
    got = {r.row: r.log_recency for r in features.recency(near, cell, issue).collect()}
    assert got[80] == pytest.approx(math.log1p(5000)) and got[81] == pytest.approx(math.log1p(999))


@pytest.mark.parametrize(("t", "m", "strict", "label"), [(T0, 2.5, False, 0), (T0 + 1, 2.0, False, 1), (T0 + 1, 2.0, True, 0), (T0 + 30 * DAY, 2.0, False, 1), (T0 + 30 * DAY + 1, 5.0, False, 0), (T0 + 1, 1.99, False, 0)])
def test_forward_labels(spark, cell, issue, t, m, strict, label):
    near = features.near_events(cell, spark.createDataFrame([event(1, t, m)], EVENTS))
    assert {r.row: r.label for r in features.forward_labels(near, cell, issue, strict=strict).collect()} == {80: label, 81: 0}


def test_event_labels_exclude_themselves_and_simultaneous_ones(spark):
    s = spark.createDataFrame([event(1, T0, 3.0), event(2, T0, 3.0), event(3, T0 + 30 * DAY, 2.0), event(4, T0 + 40 * DAY, 2.01)], EVENTS)
    got = {r.event_id: (r.label, r.uncensored) for r in features.event_labels(s, s).collect()}
    assert got == {1: (0, True), 2: (0, True), 3: (1, False), 4: (0, False)}
    assert {r.event_id: r.label for r in features.event_labels(s, s, at_least=True).collect()}[1] == 1


def test_future_events_change_no_feature(spark, cell, issue):
    rng = np.random.default_rng(2)
    rows = [event(i, T0 + int(x), 2.0, 40.25 + rng.normal(scale=0.4), -79.75 + rng.normal(scale=0.4)) for i, x in enumerate(rng.integers(-400 * DAY, 400 * DAY, 300))]
    known = [r for r in rows if r[1] < T0]
    a, b = (sorted(map(tuple, features.window_features(features.near_events(cell, spark.createDataFrame(x, EVENTS)), cell, issue).collect())) for x in (rows, known))
    assert a == b


@pytest.mark.parametrize("radius", [100.0, 200.0, 1500.0])
def test_neighbours_over_the_whole_globe(spark, radius):
    rng = np.random.default_rng(int(radius))
    place = lambda n: [(i, float(np.degrees(np.arcsin(z))), float(lon)) for i, (z, lon) in enumerate(zip(rng.uniform(-1, 1, n), rng.uniform(-180, 180, n)))]
    left = place(200) + [(900, 90.0, 0.0), (901, -90.0, 10.0), (902, 0.0, 180.0), (903, 49.99, -180.0), (904, None, 1.0)]
    right = [(i + 5000, lat + float(rng.normal(scale=radius / 150)), lon + float(rng.normal(scale=radius / 80))) for i, lat, lon in left if lat is not None] + place(1500)
    right = [(k, max(-90.0, min(90.0, lat)), (lon + 180) % 360 - 180) for k, (_, lat, lon) in enumerate(right)]
    a, b = (spark.createDataFrame(x, "id long, latitude double, longitude double") for x in (left, right))
    got = sorted((r.id, r.r_id) for r in neighbour_pairs(a, b, radius).collect())
    want = sorted((i, j) for i, lat, lon in left if lat is not None for j, la, lo in right if hav((lat, lon), (la, lo)) <= radius)
    assert got == want and len(want) > 100


def test_neighbour_joins_have_no_cartesian_product(spark, sf):
    from quakelode.sources import derived

    s = derived.seismic(spark, sf)
    for df in (etas.parents_of(s, s), features.band_sums(s, s), features.near_events(grid.active_cells(s), s)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_what_is_asked(spark, sf):
    from quakelode.sources import derived

    plan = derived.seismic(spark, sf).select("event_id", "t")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan


def test_bands(spark):
    target = spark.createDataFrame([event(1, T0, 1.0)], EVENTS)
    step = math.degrees(1 / EARTH_MEAN_KM)
    at = lambda k, km, m, t=T0 - DAY: (k, t, 40.25 + km * step, -79.75, m, "train")
    past = [at(2, 0.0, 1.0), at(3, 25.0, 2.0), at(4, 24.999, 4.0), at(5, 200.0, 8.0), at(6, 200.001, 16.0), at(7, 10.0, 32.0, T0), at(8, 10.0, 64.0, T0 - 1825 * DAY), at(9, 10.0, 128.0, T0 - 1825 * DAY + 1)]
    r = features.band_sums(target, spark.createDataFrame(past, EVENTS)).first()
    assert [r[n] for n in features.band_names(BAND_EDGES_KM)] == [133.0, 2.0, 0.0, 8.0]
    every = features.band_sums(target, spark.createDataFrame(past, EVENTS), days=None).first()
    assert every.band_0_25_km == 197.0


def test_intensity_and_cell_forecast_against_numpy(spark):
    rng = np.random.default_rng(6)
    rows = [event(i, T0 - int(rng.integers(-50, 250) * DAY) - int(rng.integers(0, DAY)), float(rng.uniform(1.0, 5.0)), 40.25 + rng.normal(), -79.75 + rng.normal()) for i in range(200)]
    target = spark.createDataFrame([event(999, T0, 1.0)], EVENTS)
    history = spark.createDataFrame(rows, EVENTS)
    k, rate, n, counts = PAPER, 0.0, 0, 0.0
    x, w = np.polynomial.legendre.leggauss(200)
    lo, hi = math.sin(math.radians(40.0)), math.sin(math.radians(40.5))
    phi = np.degrees(np.arcsin((lo + hi) / 2 + (hi - lo) / 2 * x))
    lam = -79.75 + 0.25 * x
    for _, t, la, lo_, m, _ in rows:
        age, km = (T0 - t) / DAY, hav((la, lo_), (40.25, -79.75), EARTH_MEAN_KM)
        if 0 < age < 180 and km < 200 and m > 1.75:
            scale, n = math.exp(-k["a"] * (m - 5)), n + 1
            rate += k["K"] * (age + k["c"]) ** -k["p"] * (km**2 * scale + k["d"]) ** -k["q"]
            kernel = np.array([[(hav((la, lo_), (p, q), EARTH_MEAN_KM) ** 2 * scale + k["d"]) ** -k["q"] for q in lam[::1]] for p in phi[::1]]) if n <= 3 else None
            if kernel is not None:
                space = EARTH_MEAN_KM**2 * (hi - lo) * math.radians(0.5) / 4 * (np.outer(w, w) * kernel).sum()
                got = etas.cell_integrals(np.array([la]), np.array([lo_]), np.array([m]), np.array([30]), np.array([20]), k, 0.5, 5.0, 1e-6, 128)[0][0]
                assert got == pytest.approx(space, rel=1e-5)
    r = etas.intensity(target, history).first()
    assert r.parents == n and r.intensity == pytest.approx(rate + k["mu"], rel=1e-9)
    c = etas.cell_forecast(target, history).first()
    assert c.parents == n and c.total_lambda > c.background_lambda > 0 and c.probability == pytest.approx(1 - math.exp(-c.total_lambda))
    with pytest.raises(PySparkException):
        etas.cell_forecast(spark.createDataFrame([event(1, T0, 1.0, 60.0)], EVENTS), history).collect()


def test_time_integral_near_one(spark):
    df = spark.createDataFrame([(3.0,)], "a double")
    one, near = df.select(formulas.time_integral(F.col("a"), 30.0, 0.5, 1.0).alias("x"), formulas.time_integral(F.col("a"), 30.0, 0.5, 1 + 1e-9).alias("y")).first()
    assert one == pytest.approx(math.log(33.5 / 3.5)) and near == pytest.approx(one, rel=1e-7)


def test_parameters_are_checked():
    assert formulas.parameters(True)["K"] != PAPER["K"] and formulas.parameters(overrides={"K": 1.0})["K"] == 1.0
    for bad in ({"x": 1.0}, {"c": 0.0}, {"mu": -1.0}, {"q": float("nan")}):
        with pytest.raises(ValueError):
            formulas.parameters(overrides=bad)
    with pytest.raises(ValueError):
        formulas.parameters(True, {"K": 1.0})
    assert formulas.featured_name("a.csv", True) == "a_feature_fitted.csv" and formulas.featured_name("t", False) == "t_featured"


def test_fit_recovers_known_amplitudes(spark):
    rng = np.random.default_rng(8)
    h = rng.exponential(2e-6, 4000)
    area_days, exposure = 5e8, 3000.0
    z = area_days * h / exposure
    got = etas.fit_amplitudes(spark.createDataFrame([(float(x),) for x in h], "h double"), area_days, exposure)
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if ((z - 1) / (1 - mid + mid * z)).sum() > 0 else (lo, mid)
    share = 0.0 if (z - 1).sum() <= 0 else lo
    assert got["share_triggered"] == pytest.approx(share, abs=1e-9)
    assert got["mu"] * area_days + got["K"] * exposure == pytest.approx(len(h))
    none = etas.fit_amplitudes(spark.createDataFrame([(0.0,)] * 5, "h double"), 10.0, 1.0)
    assert none["K"] == 0 and none["mu"] == 0.5
    with pytest.raises(ArithmeticError):
        etas.fit_amplitudes(spark.createDataFrame([(1.0,)], "h double"), 10.0, 0.0)


def test_amplitudes_at_the_corners(spark):
    fit = lambda h, background, exposure: etas.fit_amplitudes(spark.createDataFrame([(float(x),) for x in h], "h double"), background, exposure)
    weak = fit([0.0, 0.1, 0.2], 10.0, 5.0)
    assert weak["K"] == 0 and weak["mu"] == pytest.approx(0.3) and weak["separable"]
    strong = fit([5.0, 6.0, 7.0], 10.0, 5.0)
    assert strong["mu"] == 0 and strong["K"] == pytest.approx(0.6) and strong["share_triggered"] == pytest.approx(1.0)
    same = fit([0.5] * 4, 10.0, 5.0)
    assert not same["separable"] and same["K"] == 0
    with pytest.raises(ValueError):
        fit([1.0], 0.0, 1.0)


def test_space_mass_against_a_fine_grid():
    bounds = (25, 50, -90, -65)
    places = [(38.0, -78.0, 3.0), (25.0, -78.0, 3.0), (25.3, -89.5, 5.5), (49.99, -65.5, 2.0), (24.0, -70.0, 6.0), (40.0, -64.0, 4.0), (20.0, -70.0, 4.0)]
    got, error = etas.space_masses(*np.array(places).T, bounds, PAPER, 200.0, 5.0)
    r = np.linspace(0, 200, 20001)
    r, dr = (r[1:] + r[:-1]) / 2, r[1] - r[0]
    beta = (np.arange(1440) + 0.5) / 1440 * 2 * np.pi
    for (lat, lon, m), mass in zip(places, got):
        p, q, angle = np.radians(lat), np.radians(lon), (r / EARTH_MEAN_KM)[:, None]
        phi = np.degrees(np.arcsin(np.sin(p) * np.cos(angle) + np.cos(p) * np.sin(angle) * np.cos(beta)))
        lam = np.degrees(q + np.arctan2(np.sin(beta) * np.sin(angle) * np.cos(p), np.cos(angle) - np.sin(p) * np.sin(np.radians(phi))))
        share = ((phi >= 25) & (phi <= 50) & (lam >= -90) & (lam <= -65)).mean(1)
        kernel = (r**2 * math.exp(-PAPER["a"] * (m - 5.0)) + PAPER["d"]) ** -PAPER["q"]
        fine = (kernel * 2 * np.pi * share * EARTH_MEAN_KM * np.sin(r / EARTH_MEAN_KM) * dr).sum()
        assert mass == pytest.approx(fine, rel=3e-3, abs=1e-12)
    assert (error <= 1e-4 * got + 1e-12).all() and got[1] == pytest.approx(got[0] / 2, rel=2e-2) and got[-1] == 0


def test_texts_become_events(spark):
    rows = [("2000-01-01T00:00:00", "40", "-79", "2"), ("2000-01-01T00:00:00Z", "40", "-79", "2"), ("2000-01-01T05:00:00+05:00", "40", "-79", "2"), ("2000-01-01", "40", "-79", "2"), ("1999-12-31T23:59:59.750Z", "40", "-79", "2"), ("never", "40", "-79", "2"), ("2000-01-01", "91", "-79", "2"), ("2000-01-01", "40", "NaN", "2"), ("2000-01-01", "40", "-79", ""), (None, None, None, None)]
    raw = spark.createDataFrame(rows, "time string, latitude string, longitude string, magnitude string")
    seconds = [r[0] for r in catalog.validated(raw).select(times.epoch_seconds(F.col("time"))).collect()]
    assert seconds == [T0, T0, T0, T0, T0 - 1]
    assert [r.reason for r in catalog.validated(raw, "flag").collect()] == [None] * 5 + ["time", "place", "place", "magnitude", "time"]
    with pytest.raises(PySparkException):
        catalog.validated(raw, "fail").collect()
    for bad in (["a", "a"], ["source"], ["source", "time", "latitude", "longitude", ""]):
        with pytest.raises(ValueError):
            catalog.check_header(bad)
    catalog.check_header(["﻿time", "magnitude", "longitude", "latitude", "source"])


def test_merge_keeps_the_first_of_equal_records(spark):
    a = spark.createDataFrame([("seismic", "2000-01-02", "x"), ("seismic", "2000-01-01T00:00:00Z", "y"), ("seismic", "2000-01-02", "x")], "source string, time string, note string")
    b = spark.createDataFrame([("z", "2000-01-01T01:00:00+01:00", "seismic"), ("x", "2000-01-02", "seismic")], "note string, time string, source string")
    got = catalog.combine([a, b]).collect()
    assert [r.note for r in got] == ["y", "z", "x"] and [r.file_no for r in got] == [0, 1, 0]
    assert catalog.combine([a, b], keep_duplicates=True).count() == 5
    assert tuple(catalog.combine_stats([a, b]).first()) == (5, 3, 2)
    again = catalog.combine([catalog.combine([a, b]).select("source", "time", "note")])
    assert again.count() == 3
    with pytest.raises(ValueError):
        catalog.combine([a, b.drop("note")])


def test_cells_and_lines(spark, tmp_path):
    p = spark.createDataFrame([(50.0, -65.0), (25.0, -90.0), (24.99, -80.0), (49.99, -65.01)], "latitude double, longitude double")
    assert [(r.row, r.col) for r in grid.cell_lookup(p).collect()] == [(49, 49), (0, 0), (None, 30 - 10), (49, 49)]
    shape = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "LineString", "coordinates": [[-80, 30], [-80, 40]]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "MultiLineString", "coordinates": [[[-70, 30], [-70, 31], [-70, 32]], [[-60, 30]]]}}]}
    (tmp_path / "lines.json").write_text(json.dumps(shape))
    v = polylines.read_geojson_lines(spark, str(tmp_path / "lines.json"))
    s = polylines.segments(v)
    assert v.count() == 6 and s.count() == 4
    near = spark.createDataFrame([(1, 35.0, -80.0), (2, 35.0, -79.0)], "event_id int, latitude double, longitude double")
    got = {r.event_id: r.km for r in grid.nearest_line_km(near, s, ["event_id"], "km", 5.0).collect()}
    assert got[1] == 0.0 and got[2] == pytest.approx(hav((35, -79), (35, -80), EARTH_MEAN_KM) - 5, rel=0.02)
    rng = np.random.default_rng(3)
    many = spark.createDataFrame([(k, 0, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(26, 49, 80), rng.uniform(-89, -66, 80)))], "line_id int, seq int, latitude double, longitude double").withColumn("line_id", F.floor(F.col("line_id") / 2)).withColumn("seq", F.monotonically_increasing_id())
    wide = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(25, 50, 150), rng.uniform(-90, -65, 150)))], "event_id int, latitude double, longitude double")
    lines = polylines.segments(many)
    one = {r.event_id: r.km for r in grid.nearest_line_km(wide, lines, ["event_id"], "km").collect()}
    assert len(one) == 150 and None not in one.values()
    e = spark.createDataFrame([(1, None), (2, 4.0), (3, 8.0)], "cell int, elevation double")
    cells = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "cell int")
    assert sorted((r.cell, r.elevation) for r in polylines.with_elevation(cells, e, "cell").collect()) == [(1, 6.0), (2, 4.0), (3, 8.0), (4, 6.0)]
    assert {r.elevation for r in polylines.with_elevation(cells, e.where("elevation is null"), "cell").collect()} == {None}


PRED = "model string, split string, y int, p double"


@pytest.mark.parametrize(("counts", "want"), [(((529, 64), (526, 908)), (0.7089, 0.9342, 0.6332, 0.7548)), (((195, 86), (72, 387)), (0.7865, 0.8182, 0.8431, 0.8305))])
def test_confusion_of_recorded_runs(spark, counts, want):
    (tn, fp), (fn, tp) = counts
    rows = [("m", "s", 0, 0.1)] * tn + [("m", "s", 0, 0.9)] * fp + [("m", "s", 1, 0.1)] * fn + [("m", "s", 1, 0.5)] * tp
    r = metrics.confusion(spark.createDataFrame(rows, PRED), ["model"]).first()
    assert tuple(round(r[c], 4) for c in ("accuracy", "precision", "recall", "f1")) == want


def test_metric_edges(spark):
    f = lambda rows: spark.createDataFrame([("m", "s", y, p) for y, p in rows], PRED)
    tied = f([(0, 0.5), (1, 0.5), (1, 0.5)])
    assert metrics.roc_auc(tied, ["model"]).first().auc == 0.5 and metrics.average_precision(tied, ["model"]).first().pr_auc == pytest.approx(2 / 3)
    one = f([(1, 0.2), (1, 0.3)])
    assert math.isnan(metrics.roc_auc(one, ["model"]).first().auc) and metrics.confusion(one, ["model"]).first().f1 == 0
    edge = f([(1, 1.0), (0, 0.0), (1, 0.30000000000000004), (0, 0.3)])
    assert metrics.calibration_error(edge, ["model"]).first().ece == pytest.approx((0 + 0.7 + 0.3) / 4)
    bins = [r[0] for r in edge.select(metrics.bin_of(F.col("p"), True)).collect()]
    assert bins == [9, 0, 3, 2] and [r[0] for r in edge.select(metrics.bin_of(F.col("p"), False)).collect()] == [None, 0, 3, 2]
    base = metrics.information_gain(f([(1, 0.25), (0, 0.25)]), F.lit(0.25), ["model"]).first().ig_bits
    assert base == 0 and metrics.information_gain(f([(1, 0.0)]), F.lit(0.5), ["model"]).first().ig_bits == pytest.approx(math.log2(1e-4) + 1)


def test_preparation(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "a"), (None, "a"), (5.0, "a"), (9.0, "b")], "x double, split string")
    train = df.where("split = 'a'")
    assert [r.x for r in learn.imputed(df, train, ["x"]).collect()] == [1.0, 3.0, 3.0, 5.0, 9.0]
    flat = spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double")
    assert [r.x for r in learn.min_max(flat, ["x"]).collect()] == [0.0, 0.0, None]
    assert [r.x for r in learn.standardised(flat, flat, ["x"]).collect()] == [0.0, 0.0, None]
    assert max(r.x for r in learn.angles(df.where("x > 0 and not isnan(x)"), train.where("not isnan(x)"), ["x"]).collect()) == math.pi


def test_calibration_is_monotone_and_clipped(spark):
    rng = np.random.default_rng(1)
    rows = [(float(p), int(rng.random() < p**2)) for p in rng.random(500)]
    df = spark.createDataFrame(rows, "p double, label int")
    out = learn.calibrated(df, spark.createDataFrame([(k / 50 - 0.2, k) for k in range(70)], "p double, k int")).orderBy("k").collect()
    p = [r.p for r in out]
    assert p == sorted(p) and min(p) >= 1e-4 and max(p) <= 1 - 1e-4


def test_grid_model_end_to_end(spark, sf):
    from quakelode.plans.learning import grid_forecast

    raw, judged, table = grid_forecast(spark, sf, rounds=3)
    cells = table.select("row", "col").distinct().count()
    out = forecast.forecast_table(table)
    assert out.count() == cells * 12 == out.select("cell_lat", "cell_lon", "issue_date").distinct().count()
    assert out.where("probability < 1e-4 or probability > 1 - 1e-4").count() == 0
    assert 0 <= metrics.roc_auc(raw.select(F.lit("m").alias("model"), F.col("label").alias("y"), "p"), ["model"]).first().auc <= 1


def test_positions_as_of(spark):
    g = spark.createDataFrame([("s", "1999-12-31", 1.0, 2.0, None), ("s", "2000-01-01", 9.0, 9.0, 9.0), ("s", "1998-12-31", 5.0, 6.0, 7.0)], "station_id string, date string, east_m double, north_m double, up_m double").withColumn("date", F.to_date("date"))
    q = spark.createDataFrame([("s", "2000-01-01"), ("t", "2000-01-01")], "station_id string, issue_date string").withColumn("issue_date", F.to_date("issue_date"))
    got = {r.station_id: tuple(r)[2:] for r in gps.last_before(g, q, 0, "").collect()}
    assert got == {"s": (1.0, 2.0, None), "t": (None, None, None)}
    assert {r.station_id: r.base_east_m for r in gps.baseline(g, q).collect()} == {"s": 5.0, "t": None}


def test_tiles_and_hot_zones(spark):
    f = spark.createDataFrame([(1.0, 0.1), (2.0, 0.2), (4.0, 0.8)], "cell_lat double, probability double")
    assert [tuple(r)[1:] for r in forecast.tile_edges(f, "cell_lat").orderBy("coordinate").collect()] == [(0.5, 1.5), (1.5, 3.0), (3.0, 5.0)]
    assert forecast.spacing(f, "cell_lat").first().spacing == 1.5
    assert [r.heat for r in forecast.hot_zones(f).collect()] == [1.0]


def test_recorded_measurements(spark):
    run = lambda k, c: [(k, 0, b, n) for b, n in zip(shots.TWO_BITS, c)]
    df = spark.createDataFrame(run(1, (506, 0, 0, 494)) + run(2, (504, 13, 17, 466)) + run(3, (512, 6, 4, 478)), "run_id long, pair_id long, bitstring string, n long").where("n > 0")
    impossible = {r.run_id: r.impossible for r in shots.impossible_share(df).collect()}
    assert impossible == {1: 0.0, 2: pytest.approx(0.03), 3: pytest.approx(0.01)}
    fidelity = {r.other_id: r.fidelity for r in shots.fidelity(df.where("run_id = 1"), df.where("run_id > 1")).collect()}
    assert fidelity == {2: pytest.approx(0.970, abs=5e-4), 3: pytest.approx(0.990, abs=5e-4)}
    scales = spark.createDataFrame([(1, 1.0, 0.9677), (1, 3.0, 0.9100), (1, 5.0, 0.8603)], "run_id long, scale double, value double")
    r = shots.extrapolated(scales).first()
    assert r.linear == pytest.approx(0.99322, abs=1e-4) and r.quadratic == pytest.approx(0.99955, abs=1e-4)
    exact = spark.createDataFrame([(b, *(0.9 if b == c else 0.1 / 3 for c in shots.TWO_BITS)) for b in shots.TWO_BITS], "prepared string, p_00 double, p_01 double, p_10 double, p_11 double")
    p = {(r.run_id, r.bitstring): r.p for r in shots.mitigated(df, exact).collect()}
    assert p[1, "01"] == 0 and sum(v for (k, _), v in p.items() if k == 2) == pytest.approx(1)
    square = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 0)], "a int, b int")
    cut = shots.cut_values(spark.createDataFrame([(1, "0101", 3), (1, "0011", 1)], "run_id long, bitstring string, n long"), square).first()
    assert tuple(cut) == (1, 3.5, 4, 0.75)


def test_driver_entry(spark, monkeypatch):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_corpus_operators(monkeypatch):
    import importlib.util

    import __spark_entry__ as entry

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("quakelode.llm", "corpus_pipeline") else real(name, *a))
    assert not any(n.startswith("op") for n in entry.queries()) and "pipeline" not in entry.queries()


def test_registered_models_have_all_rounds(spark, sf, monkeypatch):
    from quakelode.plans import learning

    class Stop(Exception):
        pass

    asked = []

    def stop(*_, **options):
        asked.append(options)
        raise Stop

    monkeypatch.setattr(learning.learn, "boosted", stop)
    for query in (learning.m1_m3_m18_grid_forecast, learning.m1_m17_model_scorecard):
        with pytest.raises(Stop):
            query(spark, sf)
    assert [o.get("rounds", 400) for o in asked] == [400, 400]
    monkeypatch.setattr(learning.learn, "sweep", lambda train, test, columns, grid: asked.append(grid) or [])
    learning.m8_sweep(spark, sf)
    assert len(asked[-1]) == 81 and {(o["rounds"], o["depth"], o["rate"], o["l2"]) for o in asked[-1]} == {(n, d, r, x) for n in (200, 400, 800) for d in (3, 4, 6) for r in (0.01, 0.05, 0.1) for x in (0.1, 1.0, 5.0)}


def test_models_learn_what_there_is(spark):
    """Held-out rows of labels that hang on two columns; the given tables' labels are near chance at the smallest size."""
    rng = np.random.default_rng(3)
    x = rng.random((3000, 3))
    y = (rng.random(3000) < np.where((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3), 0.9, 0.1)).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(v), k) for k, (r, v) in enumerate(zip(x, y))], "a double, b double, c double, label int, k int")
    train, test = df.where("k < 2000"), df.where("k >= 2000")
    auc = lambda p: metrics.roc_auc(p.select(F.lit("m").alias("model"), F.col("label").alias("y"), "p"), ["model"]).first().auc
    assert auc(learn.scored(learn.boosted(train, ["a", "b", "c"], rounds=5), test, ["a", "b", "c"])) > 0.85
    got = learn.sweep(train, test, ["a", "b", "c"], [{"rounds": n, "depth": d, "rate": 0.1, "l2": 1.0} for n in (5, 60) for d in (1, 3)]).toPandas().set_index(["rounds", "depth"])
    assert len(got) == 4 and got.loc[(60, 3), "auc"] > 0.85 > got.loc[(60, 1), "auc"] and got.loc[(60, 3), "ig_bits"] > got.loc[(5, 3), "ig_bits"] > 0


def test_a_stump_is_the_best_one():
    from quakelode.operators import boosting

    rng = np.random.default_rng(4)
    x, y = rng.random((400, 3)), rng.integers(0, 2, 400).astype(float)
    edges = boosting.quantile_edges(x)
    codes = boosting.binned(x, edges)
    trees = boosting.grow(codes, y, 3, 0.3, 1, 2.0)
    p = y.mean()
    g, h = p - y, np.full(400, p * (1 - p))
    gains = {}
    for c in range(3):
        for k in range(boosting.BINS - 1):
            left = codes[:, c] <= k
            if boosting.LEAF <= left.sum() <= 400 - boosting.LEAF:
                gains[c, k] = sum(g[s].sum() ** 2 / (h[s].sum() + 2.0) for s in (left, ~left))
    best = max(gains, key=gains.get)
    assert (trees.column[0, 0], trees.cut[0, 0]) == best
    left = codes[:, best[0]] <= best[1]
    assert np.allclose(trees.value[0], [-0.3 * g[s].sum() / (h[s].sum() + 2.0) for s in (left, ~left)], rtol=1e-5)
    one = next(boosting.probabilities(boosting.grow(codes, y, 1, 0.3, 1, 2.0), codes, [1]))
    assert np.allclose(next(boosting.probabilities(trees, codes, [1, 3])), one)


def test_registered_fit_meets_the_tolerance(spark, sf):
    from quakelode.plans.events import e5_amplitude_fit

    got = e5_amplitude_fit(spark, sf).first().integration
    assert 0 < got.exposure and got.error <= 0.002 * got.exposure


def test_resampled_catalogues_come_from_the_events(spark):
    events = spark.createDataFrame([(7, T0 - DAY, 40.2, -70.2, 5.0, "train"), (8, T0 + DAY, 40.2, -70.2, 5.0, "train")], EVENTS)
    got = etas.resampled(events, 400, (40.25, -70.25), T0).collect()
    rate = sorted(-math.log1p(-r.probability) for r in got)
    one = min(x - rate[0] for x in rate if x > rate[0] * 1.000001)
    times = [round((x - rate[0]) / one) for x in rate]
    assert len(got) == 400 and np.allclose(rate, [rate[0] + one * k for k in times])
    assert abs(np.mean(times) - 1) < 0.2 and abs(times.count(0) / 400 - math.exp(-1)) < 0.1
    assert len({r.probability for r in etas.resampled(events.where("event_id = 8"), 5, (40.25, -70.25), T0).collect()}) == 1
