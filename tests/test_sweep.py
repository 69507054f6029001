"""The sweep of settings: fitted and scored on all rows, which are counted by the bins they fall into."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakelode.operators import boosting, learn, metrics

GRID = [{"rounds": n, "depth": d, "rate": 0.3, "l2": 1.0} for n in (1, 4) for d in (2, 3)]


def test_a_sweep_fits_on_all_train_rows(spark):
    # more rows than the 50 000 that were once fitted, and columns with many equal values
    rows = spark.range(90_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(97)) / 7.0).alias("a"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) ** 2).cast("double").alias("b"))
    rows = rows.withColumn("label", (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100)) < F.col("a") * 5 + F.when(F.col("b") > 3e5, 20).otherwise(0)).cast("int"))
    train, test = rows.where("id < 80000"), rows.where("id >= 80000")
    got = {(r.rounds, r.depth): r for r in learn.sweep(train, test, ["a", "b"], GRID).collect()}
    assert len(got) == 4
    old, new = train.toPandas(), test.toPandas()
    edges = boosting.quantile_edges(old[["a", "b"]].to_numpy())
    codes = [boosting.binned(x[["a", "b"]].to_numpy(), edges) for x in (old, new)]
    for depth in (2, 3):
        trees = boosting.grow(codes[0], old["label"].to_numpy(float), 4, 0.3, depth, 1.0)
        for n, p in zip((1, 4), boosting.probabilities(trees, codes[1], [1, 4]), strict=True):
            bits, auc = metrics.scores_of_counts(p, new["label"].to_numpy(), 1 - new["label"].to_numpy(), old["label"].mean())
            assert got[n, depth].ig_bits == pytest.approx(bits, abs=1e-12) and got[n, depth].auc == pytest.approx(auc, abs=1e-12)


def test_counted_rows_give_the_trees_and_scores_of_single_ones(spark):
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 5, (900, 3)).astype(np.uint8)
    y = (rng.random(900) < 0.2 + 0.1 * codes[:, 1]).astype(float)
    cells, nth = np.unique(codes, axis=0, return_inverse=True)
    n, ones = np.bincount(nth), np.bincount(nth, y)
    one, all_ = boosting.grow(cells, ones, 6, 0.2, 3, 1.0, n), boosting.grow(codes, y, 6, 0.2, 3, 1.0)
    assert (one.column == all_.column).all() and (one.cut == all_.cut).all() and np.allclose(one.value, all_.value, atol=1e-6)
    p = next(boosting.probabilities(one, cells, [6])).round(2)
    table = spark.createDataFrame([("m", int(v), float(q)) for v, q in zip(y, p[nth])], "model string, y int, p double")
    want = metrics.information_gain(table, F.lit(0.4), ["model"]).first().ig_bits, metrics.roc_auc(table, ["model"]).first().auc
    assert np.allclose(metrics.scores_of_counts(p, ones, n - ones, 0.4), want, rtol=1e-12)


def test_one_class_and_missing_values(spark):
    same = boosting.grow(np.arange(60).reshape(-1, 1).astype(np.uint8), np.ones(60), 3, 0.1, 2, 0.1, np.full(60, 7))
    assert (same.cut == boosting.BINS - 1).all() and same.value.shape == (3, 4)
    rows = spark.createDataFrame([(k, float(k % 50) if k % 9 else None, int(k % 4 == 0)) for k in range(400)], "k int, a double, label int")
    got = learn.sweep(rows.where("k < 300"), rows.where("k >= 300"), ["a"], GRID[:1]).collect()
    assert len(got) == 1 and 0 < got[0].auc < 1
    assert np.isnan(metrics.scores_of_counts(np.array([0.5]), np.array([3]), np.array([0]), 0.5)[1])
