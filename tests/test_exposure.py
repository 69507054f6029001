"""The triggering model's exposure on the larger given events, against dense sums."""

import math

import numpy as np
import pytest

from quakelode.constants import EARTH_MEAN_KM, PAPER
from quakelode.operators import etas
from quakelode.plans import queries
from quakelode.sources import derived

LARGER = "/root/testdata/sf0.01"
BOUNDS = (30.0, 45.0, -85.0, -70.0)


def dense(place, bounds, km=200.0, n=200_000):
    """The mass by a plain sum over rings, finer near the parent."""
    lat, lon, m = place
    s = (np.arange(n) + 0.5) / n
    r, dr = km * s**2, km * 2 * s / n
    kernel = (r**2 * math.exp(-PAPER["a"] * (m - 5.0)) + PAPER["d"]) ** -PAPER["q"]
    part = etas.bearings_inside(np.full(n, np.radians(lat)), np.full(n, np.radians(lon)), r / EARTH_MEAN_KM, bounds)
    return (kernel * EARTH_MEAN_KM * np.sin(r / EARTH_MEAN_KM) * dr * part).sum()


@pytest.fixture(scope="module")
def parents(spark):
    s = derived.seismic(spark, LARGER).where("magnitude > 1.75").select("latitude", "longitude", "magnitude").toPandas()
    return s.to_numpy().T


@pytest.mark.parametrize("bounds", [BOUNDS, (25.0, 50.0, -90.0, -65.0)])
def test_masses_of_all_events_settle(parents, bounds):
    mass, error = etas.space_masses(*parents, bounds, PAPER, 200.0, 5.0)
    assert (error <= np.maximum(1e-4 * mass, 1e-9)).all()
    exact, _ = etas.space_masses(*parents[:, ::7], bounds, PAPER, 200.0, 5.0, 1e-12, (80, 160))
    assert np.allclose(mass[::7], exact, rtol=1e-5, atol=1e-12)
    few, _ = etas.space_masses(*parents, bounds, PAPER, 200.0, 5.0, 1e-4, (8, 16))  # 13 panels of 16 nodes at most
    assert np.allclose(few, mass, rtol=1e-4, atol=1e-12)
    for k in range(0, len(mass), 400):
        assert mass[k] == pytest.approx(dense(parents[:, k], bounds), rel=1e-4, abs=1e-9)


def test_parents_at_edges_and_corners():
    edge = math.degrees(200.0 / EARTH_MEAN_KM)
    places = [(45.0 + edge - 1e-4, -78.0, 3.0), (45.0 + edge + 1e-4, -78.0, 3.0), (45.0, -70.0, 4.0), (45.0, -78.0, 4.0), (30.0 - 1e-9, -85.0, 6.0), (46.75, -84.13, 3.57), (46.2, -68.4, 5.0), (38.0, -78.0, 0.0)]
    mass, error = etas.space_masses(*np.array(places).T, BOUNDS, PAPER, 200.0, 5.0)
    for place, got in zip(places, mass, strict=True):
        assert got == pytest.approx(dense(place, BOUNDS, n=1_000_000), rel=1e-3, abs=1e-12)
    assert mass[0] > 0 and mass[1] == 0 and (error <= np.maximum(1e-4 * mass, 1e-9)).all()
    assert mass[2] == pytest.approx(mass[3] / 2, rel=2e-2)


def test_breaks_are_where_rings_meet_the_rectangle():
    lat, lon = np.radians([46.0]), np.radians([-84.0])
    breaks = etas.ring_breaks(lat, lon, BOUNDS, np.array([1e-3]), 0.1)[0]
    assert (np.diff(breaks) >= 0).all() and breaks[0] == 0 and breaks[-1] == 0.1
    touched = [a for a in breaks if 0 < a < 0.1]
    assert any(a == pytest.approx(math.radians(1.0)) for a in touched)  # the northern parallel
    assert any(a == pytest.approx(math.asin(math.cos(lat[0]) * math.sin(math.radians(1.0)))) for a in touched)  # the western meridian


def test_fit_queries_run_on_the_larger_tables(spark):
    rows = queries.queries()["e3_space_exposure"](spark, LARGER).toPandas()
    assert len(rows) and (rows["mass"] >= 0).all() and (rows["mass_error"] <= np.maximum(1e-4 * rows["mass"], 1e-9)).all()
    fit = queries.queries()["e5_amplitude_fit"](spark, LARGER).first()
    assert fit.integration.error <= 0.002 * fit.integration.exposure and fit.fit.log_likelihood >= fit.fit.original_log_likelihood
    report = queries.queries()["s8_fit_report"](spark, LARGER).first()
    assert report.exposure == pytest.approx(fit.integration.exposure) and report.parent_count == fit.training.parent_count


def test_the_registered_fit_resolves_repeated_events(spark, sf, tmp_path):
    """Keys 17 712 000 apart give the same second, place and magnitude, so that tables of some ten million orders hold repeats."""
    from pyspark.sql import functions as F

    from quakelode.plans.events import e5_amplitude_fit
    from quakelode.sources import catalog, derived

    orders = spark.read.parquet(f"{sf}/orders.parquet")
    orders.unionByName(orders.where("o_orderkey % 5 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 17_712_000)).write.parquet(f"{tmp_path}/orders.parquet")
    assert catalog.duplicate_events(derived.seismic(spark, str(tmp_path))).count() > 100
    got, want = (e5_amplitude_fit(spark, d).first() for d in (str(tmp_path), sf))
    assert got.training == want.training and abs(got.fit.log_likelihood / want.fit.log_likelihood - 1) < 1e-9 and abs(got.fit.mu / want.fit.mu - 1) < 1e-6
