"""Catalogues so dense that work by pairs would grow with their square, against brute force."""

import numpy as np

from quakelode.constants import DAY, EARTH_MEAN_KM, PAPER
from quakelode.operators import etas, features

EVENTS = "event_id long, t long, latitude double, longitude double, magnitude double"


def kilometres(a, b):
    p, q = np.radians(a), np.radians(b)
    h = np.sin((q[0] - p[0]) / 2) ** 2 + np.cos(p[0]) * np.cos(q[0]) * np.sin((q[1] - p[1]) / 2) ** 2
    return 2 * EARTH_MEAN_KM * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def dense(spark, n, seed, days=400):
    rng = np.random.default_rng(seed)
    centres = [(40.0, -80.0), (40.4, 179.95), (89.6, 10.0), (-0.1, 0.0)]
    rows = [(k, int(rng.integers(0, days * DAY)), *map(float, rng.normal(centres[k % 4], (0.5, 0.6))), float(rng.integers(100, 400)) / 100) for k in range(n)]
    rows = [(k, t, min(90.0, a), (o + 180) % 360 - 180, m) for k, t, a, o, m in rows]
    return rows, spark.createDataFrame(rows, EVENTS)


def test_labels_of_a_dense_catalogue_need_few_pairs(spark, monkeypatch):
    rows, df = dense(spark, 1500, 1)
    t, la, lo, m = (np.array([r[k] for r in rows]) for k in (1, 2, 3, 4))
    compared = []
    real = features.neighbour_pairs
    monkeypatch.setattr(features, "neighbour_pairs", lambda left, *a, **k: compared.append(left) or real(left, *a, **k))
    got = {r.event_id: r.label for r in features.event_labels(df, df).collect()}
    for k in range(len(rows)):
        near = (t > t[k]) & (t <= t[k] + 30 * DAY) & (m > 2.0) & (kilometres((la, lo), (np.full(len(la), la[k]), np.full(len(la), lo[k]))) <= 100)
        assert got[k] == int(near.any()), k
    assert compared[0].count() < len(rows) / 3


def test_sums_over_parents_make_no_row_of_a_pair(spark, monkeypatch):
    monkeypatch.setattr(etas, "HELD", 40)
    monkeypatch.setattr(etas, "PAIRS", 50)
    rows, df = dense(spark, 600, 2)
    t, la, lo, m = (np.array([r[k] for r in rows]) for k in (1, 2, 3, 4))
    out = etas.intensity(df, df)
    got = {r.event_id: r for r in out.collect()}
    for k in range(len(rows)):
        km, age = kilometres((la, lo), (np.full(len(la), la[k]), np.full(len(la), lo[k]))), (t[k] - t) / DAY
        at = (age > 0) & (age < 180) & (km < 200) & (m > 1.75)
        each = (age[at] + PAPER["c"]) ** -PAPER["p"] * (km[at] ** 2 * np.exp(-PAPER["a"] * (m[at] - 5)) + PAPER["d"]) ** -PAPER["q"]
        assert got[k].parents == at.sum()
        assert abs(got[k].intensity - PAPER["mu"] - PAPER["K"] * each.sum()) <= 1e-11 * max(1e-3, each.sum()), k
    assert "r_magnitude" not in out._jdf.queryExecution().toString()


def test_cell_forecasts_make_no_row_of_a_pair(spark, monkeypatch):
    monkeypatch.setattr(etas, "CELL_HELD", 60)
    monkeypatch.setattr(etas, "NODES", 600)
    rng, k = np.random.default_rng(4), PAPER
    rows = [(n, int(rng.integers(0, 300 * DAY)), *map(float, rng.normal((40.0, -80.0), (0.8, 1.0)).round(1)), float(rng.integers(3, 9)) / 2) for n in range(400)]
    asked = [(n, int(rng.integers(150 * DAY, 300 * DAY)), *map(float, rng.uniform((39.2, -81.0), (40.8, -79.0))), 0.0) for n in range(40)] + [(99, 200 * DAY, 26.0, -66.0, 0.0)]
    out = etas.cell_forecast(spark.createDataFrame(asked, EVENTS), spark.createDataFrame([*rows, *rows[:50], (500, None, 40.0, -80.0, 3.0)], EVENTS))
    assert "r_event_id" not in out._jdf.queryExecution().toString()
    got = {r.event_id: r for r in out.collect()}
    t, la, lo, m = (np.array([r[c] for r in [*rows, *rows[:50]]]) for c in (1, 2, 3, 4))
    for n, when, x, y, _ in asked:
        at = np.flatnonzero((t < when) & (when - t < 180 * DAY) & (m > 1.75) & (kilometres((la, lo), (np.full(len(la), x), np.full(len(la), y))) < 200))
        cell = [np.full(len(at), int(np.floor((v - low) / 0.5))) for v, low in ((x, 25.0), (y, -90.0))]
        space, gap = etas.cell_integrals(la[at], lo[at], m[at], *cell, k, 0.5, 5.0, 1e-6, 128)
        age = (when - t[at]) / DAY + k["c"]
        each = k["K"] * ((age + 30) ** (1 - k["p"]) - age ** (1 - k["p"])) / (1 - k["p"])
        r = got[n]
        assert r.parents == len(at) and abs(r.event_lambda - (each * space).sum()) <= 1e-9 * (each * space).sum()
        assert abs(r.error_estimate - (each * gap).sum()) <= 1e-6 * (each * gap).sum() + 1e-14
    assert len(got) == 41 and got[99].parents == 0 and max(r.parents for r in got.values()) > 50


def test_the_baseline_joins_its_labels_once(spark, sf):
    from quakelode.plans.learning import m2_logistic_baseline

    assert "orders.parquet" not in m2_logistic_baseline(spark, sf)._jdf.queryExecution().toString()


def test_parents_as_rows_have_few_copies_and_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(etas, "HELD", 40)
    monkeypatch.setattr(etas, "OUT_ROWS", 50)
    rows, df = dense(spark, 400, 3)
    out = etas.parents_of(df, df)
    t, la, lo, m = (np.array([r[k] for r in rows]) for k in (1, 2, 3, 4))
    want = set()
    for k in range(len(rows)):
        age, km = (t[k] - t) / DAY, kilometres((la, lo), (np.full(len(la), la[k]), np.full(len(la), lo[k])))
        want |= {(k, int(j)) for j in np.flatnonzero((age > 0) & (age < 180) & (km < 200) & (m > 1.75))}
    got = out.collect()
    assert len(got) == len(want) > 1000 and {(r.event_id, r.r_event_id) for r in got} == want
    assert all(r.age == (r.t - r.r_t) / DAY and r.r_magnitude == rows[r.r_event_id][4] for r in got)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and "MapInArrow" in plan  # no side meets the other by 45 copies of each target


def test_features_by_place_equal_those_by_event(spark):
    from quakelode.operators import grid

    rng = np.random.default_rng(6)
    spots = [(float(a), float(o)) for a, o in rng.normal((40.0, -80.0), (1.0, 1.3), (60, 2)).round(2)]
    rows = [(k, int(rng.integers(9000 * DAY, 10100 * DAY)), *spots[int(rng.integers(0, 60))], float(rng.integers(100, 400)) / 100) for k in range(1500)]
    rows += [(2000 + k, int(k * DAY), *spots[k], 2.5) for k in range(5)] + [(3000, 9862 * DAY, *spots[0], 3.0), (3001, 9861 * DAY, *spots[1], 3.9), (3002, None, 40.0, -80.0, 2.0), (3003, 9861 * DAY, None, -80.0, 2.0)]
    df = spark.createDataFrame(rows, EVENTS)
    line = spark.createDataFrame([(s[0], s[1], float(k)) for k, s in enumerate(spots)], "latitude double, longitude double, far double")
    cells, issues = grid.active_cells(df.where("latitude is not null")), grid.issue_calendar(spark, "1996-01-01", "1997-03-01")
    near, places = features.near_events(cells, df.join(line, ["latitude", "longitude"], "left")), features.near_places(cells, df)
    assert places.count() < near.count() / 10
    key = ["row", "col", "issue_date"]
    pairs = [
        (features.window_features(near, cells, issues, "far"), features.place_windows(places.join(line, ["latitude", "longitude"], "left"), df, cells, issues, "far")),
        (features.recency(near, cells, issues), features.place_recency(places, df, cells, issues)),
        (features.forward_labels(near, cells, issues), features.place_labels(places, df, cells, issues)),
    ]
    for old, new in pairs:
        a, b = (x.toPandas().sort_values(key).reset_index(drop=True) for x in (old, new))
        assert list(a.columns) == list(b.columns) and len(a) == len(b) > 100
        for c in a.columns:
            assert np.allclose(a[c], b[c], rtol=1e-12, equal_nan=True) if c.startswith("fault") else (a[c] == b[c]).all(), c


def test_wide_features_join_places_and_not_events(spark, sf, monkeypatch):
    from quakelode.plans import cells, learning

    def refuse(*_, **__):
        raise AssertionError("events met cells one by one")

    monkeypatch.setattr(features, "near_events", refuse)
    assert cells.m7_wide_features(spark, sf).columns
    assert learning._examples(spark, sf, "test", learning.derived.seismic(spark, sf)).columns


def crowded(n, places, days, seed):
    """Targets and parents of some places each, so that places hold many: arrays on the unit sphere, parents in the order of time."""
    rng = np.random.default_rng(seed)

    def rows(many, spread):
        lat, lon = (np.radians(c + rng.normal(0, spread, places))[rng.integers(0, places, many)] for c in (40.0, -80.0))
        t = np.sort(rng.integers(0, days * DAY, many)).astype(float)
        return {"t": t, "x": np.cos(lat) * np.cos(lon), "y": np.cos(lat) * np.sin(lon), "z": np.sin(lat), "magnitude": rng.integers(176, 450, many) / 100, "lat": np.degrees(lat), "lon": np.degrees(lon)}

    return rows(n, 0.1), rows(20 * n, 1.2)


def test_sums_by_panels_of_time_equal_those_by_pairs(monkeypatch):
    compared = []
    real = etas.near_blocks
    monkeypatch.setattr(etas, "near_blocks", lambda *a: compared.append(1) or real(*a))
    for seed, (n, places, days) in enumerate([(300, 3, 700), (200, 8, 200), (80, 40, 900)]):
        targets, parents = crowded(n, places, days, seed)
        targets["t"][:40] = parents["t"][:40]  # simultaneous ones, and ages of just the days
        targets["t"][-20:] = parents["t"][-40:-20] + 180 * DAY
        for kept in (512, 2):
            monkeypatch.setattr(etas, "PLACES_HELD", kept)
            monkeypatch.setattr(etas, "_panel_width", lambda *_: 9.7 * DAY)
            total, count = etas.kernel_sums(targets, parents, PAPER, 5.0, 180.0, 200.0)
            assert not compared
            for i in range(0, n, 7):
                age = (targets["t"][i] - parents["t"]) / DAY
                km = kilometres((parents["lat"], parents["lon"]), (np.full(len(age), targets["lat"][i]), np.full(len(age), targets["lon"][i])))
                at = (age > 0) & (age < 180) & (km < 200)
                each = (age[at] + PAPER["c"]) ** -PAPER["p"] * (km[at] ** 2 * np.exp(-PAPER["a"] * (parents["magnitude"][at] - 5)) + PAPER["d"]) ** -PAPER["q"]
                assert count[i] == at.sum() and abs(total[i] - each.sum()) <= 1e-12 * each.sum(), (seed, i)


def test_crowded_places_meet_each_parent_once_a_place(monkeypatch):
    targets, parents = crowded(4000, 20, 900, 3)
    pairs = []
    real = etas.near_blocks
    monkeypatch.setattr(etas, "near_blocks", lambda some, *a: pairs.append(len(some["t"])) or real(some, *a))
    _, count = etas.kernel_sums(targets, parents, PAPER, 5.0, 180.0, 200.0)
    assert sum(pairs) < 100 and count.sum() > 1e7  # all but a few targets are summed by panels
    assert etas._panel_width(30, 30, 3000, 900.0 * DAY, 180.0 * DAY) is None  # where places hold one target, pairs take less


def test_sums_over_parents_shuffle_few_bytes_an_event(spark, monkeypatch):
    monkeypatch.setattr(etas, "SUMMED", 50)
    rows, df = dense(spark, 500, 7)
    out = etas.intensity(df.select("event_id", "t", "latitude", "longitude"), df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join Inner" not in plan  # parents aren't copied as rows, nor sums joined to targets
    got = {r.event_id: r.parents for r in out.collect()}
    t, la, lo, m = (np.array([r[k] for r in rows]) for k in (1, 2, 3, 4))
    for k in range(0, 500, 9):
        at = (t < t[k]) & (t[k] - t < 180 * DAY) & (m > 1.75) & (kilometres((la, lo), (np.full(len(la), la[k]), np.full(len(la), lo[k]))) < 200)
        assert got[k] == at.sum()


def test_parents_shuffle_few_bytes_an_event(spark):
    """Targets and copies of parents were rows, which took 278 bytes an event in the shuffle."""
    sc, n, rng = spark.sparkContext, 40_000, np.random.default_rng(8)

    def shuffled():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    columns = np.arange(n), rng.integers(0, 2000 * DAY, n), rng.uniform(25, 50, n), rng.uniform(-90, -65, n), rng.integers(176, 400, n) / 100
    df = spark.createDataFrame([(int(a), int(b), float(c), float(d), float(e)) for a, b, c, d, e in zip(*columns, strict=True)], EVENTS)
    before = shuffled()
    assert etas.parents_of(df, df).selectExpr("count(*)").first()[0] > n
    assert 0 < shuffled() - before < 180 * n
