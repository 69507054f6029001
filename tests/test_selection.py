"""Exact percentiles against Spark's own, and their plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakelode.operators.selection import percentiles

POINTS = [0.0, 0.1, 0.25, 0.5, 0.73, 1.0]


@pytest.mark.parametrize("groups", [1, 7])
def test_percentiles_equal_the_buffered_ones(spark, groups):
    rng = np.random.default_rng(groups)
    rows = [(int(rng.integers(groups)) if k % 50 else None, float(rng.integers(0, 40)) / 8 if k % 3 else None, float(rng.normal())) for k in range(3000)]
    df = spark.createDataFrame(rows, "g int, value double, b double").withColumn("b", F.when(F.col("g") == 0, None).otherwise(F.col("b"))).repartition(6)
    got = {r.g: (r.which, r.b) for r in percentiles(df, ["g"], {"which": F.col("value"), "b": F.col("b")}, POINTS).collect()}
    want = {r.g: (r.which, r.b) for r in df.groupBy("g").agg(*(F.percentile(c, F.array(*map(F.lit, POINTS))).alias(n) for c, n in (("value", "which"), ("b", "b")))).collect()}
    assert got == want and None in got


def test_one_group_of_all_rows_spreads_over_ranges(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011 / 10).alias("x"))
    got = percentiles(df, [], {"x": F.col("x")}, POINTS).first().x
    assert got == df.agg(F.percentile("x", F.array(*map(F.lit, POINTS)))).first()[0]


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert percentiles(df, [], {"x": F.col("x")}, [0.5]).first().x is None
    assert percentiles(df.limit(0), [], {"x": F.col("x")}, [0.5]).first().x is None
