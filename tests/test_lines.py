"""Nearest lines against brute force, and the plan of the search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakelode.functions.geo import albers_xy
from quakelode.operators import lines

POINTS = "event_id long, latitude double, longitude double"
SEGMENTS = "x1 double, y1 double, x2 double, y2 double"


def brute(p, s):
    """Kilometres from each projected point to its nearest segment."""
    out = np.empty(len(p))
    d = s[:, 2:] - s[:, :2]
    size = (d**2).sum(1)
    for k, q in enumerate(p):
        t = np.where(size > 0, ((q - s[:, :2]) * d).sum(1) / np.where(size > 0, size, 1), 0).clip(0, 1)
        out[k] = np.sqrt(((s[:, :2] + t[:, None] * d - q) ** 2).sum(1)).min() / 1000
    return out


def places(spark, n, seed):
    rng = np.random.default_rng(seed)
    lat, lon = rng.uniform(25, 50, n), rng.uniform(-90, -65, n)
    points = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(lat, lon))], POINTS)
    xy = points.select("event_id", *(c.alias(n) for c, n in zip(albers_xy(F.col("latitude"), F.col("longitude")), "xy"))).orderBy("event_id").toPandas()
    return points, xy[["x", "y"]].to_numpy()


def check(spark, segments, points, xy):
    df = spark.createDataFrame(segments.tolist(), SEGMENTS)
    got = lines.nearest_line_km(points, df, ["event_id"], "km").orderBy("event_id").toPandas()["km"].to_numpy()
    assert np.allclose(got, brute(xy, segments), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("shape", ["cloud", "coast", "far", "long", "one", "upright"])
def test_nearest_segment_equals_brute_force(spark, shape):
    rng = np.random.default_rng(1)
    points, xy = places(spark, 300, 2)
    at = rng.uniform([-1e6, 3e5], [2e6, 2.9e6], (400, 2))
    if shape == "cloud":
        s = np.concatenate((at, at + rng.normal(0, 3e4, at.shape)), 1)
    elif shape == "coast":  # one line with many short pieces
        line = np.cumsum(rng.normal([1500, 1000], 4000, (2000, 2)), 0) + [-5e5, 5e5]
        s = np.concatenate((line[:-1], line[1:]), 1)
    elif shape == "far":  # all on one small spot, far from all points
        s = np.concatenate((at[:50] * 1e-3 + [9e6, -5e6], at[50:100] * 1e-3 + [9e6, -5e6]), 1)
    elif shape == "long":
        s = np.concatenate((at[:60], at[60:120]), 1)
    elif shape == "one":
        s = np.array([[1.2e6, 1.5e6, 1.2e6, 1.5e6]])
    else:  # along the axes and on the squares' own borders
        grid = np.arange(-4, 12) * float(1 << 17)
        s = np.array([[g, 0.0, g, 2.5e6] for g in grid] + [[-8e5, g, 1.9e6, g] for g in grid])
    check(spark, s, points, xy)


def test_many_segments(spark):
    rng = np.random.default_rng(4)
    points, xy = places(spark, 200, 5)
    angle = np.linspace(0, 40 * np.pi, 100_001)
    line = np.stack((5e5 + angle * 8e3 * np.cos(angle), 1.6e6 + angle * 8e3 * np.sin(angle)), 1) + rng.normal(0, 300, (100_001, 2))
    s = np.concatenate((line[:-1], line[1:]), 1)
    check(spark, s, points, xy)


def test_no_segments_and_no_places(spark):
    points = spark.createDataFrame([(1, 40.0, -80.0), (2, None, -80.0), (3, float("nan"), 1.0)], POINTS)
    none = spark.createDataFrame([], SEGMENTS)
    assert [r.km for r in lines.nearest_line_km(points, none, ["event_id"], "km").collect()] == [None] * 3
    one = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (None, 0.0, 1.0, 1.0)], SEGMENTS)
    got = {r.event_id: r.km for r in lines.nearest_line_km(points, one, ["event_id"], "km").collect()}
    assert got[1] > 0 and got[2] is None and got[3] is None


def test_squares_cover_segments(spark):
    rng = np.random.default_rng(7)
    s = rng.uniform(-3e5, 3e5, (40, 4))
    held = {}
    for r in lines.segment_squares(spark.createDataFrame(s.tolist(), SEGMENTS), 16).collect():
        held.setdefault((r.x1, r.y1, r.x2, r.y2), set()).add((r.bx, r.by))
    for x1, y1, x2, y2 in s.tolist():
        t = np.linspace(0, 1, 500)
        need = {(int((x1 + u * (x2 - x1) + lines.SHIFT_M) // 2**16), int((y1 + u * (y2 - y1) + lines.SHIFT_M) // 2**16)) for u in t}
        assert need <= held[x1, y1, x2, y2] and len(held[x1, y1, x2, y2]) <= 2 * len(need) + 4


def test_plan_has_no_cross_join(spark, capsys):
    points, _ = places(spark, 50, 2)
    s = spark.createDataFrame(np.random.default_rng(1).uniform(-1e6, 1e6, (60, 4)).tolist(), SEGMENTS)
    lines.nearest_line_km(points, s, ["event_id"], "km").explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
