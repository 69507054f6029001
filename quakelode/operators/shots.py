"""Analyses of measurement counts: (run_id, bitstring, n); the rightmost character of a bitstring is qubit 0."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from quakelode.operators.selection import percentiles

TWO_BITS = ("00", "01", "10", "11")
#: Edges of a graph that one row holds, and up to how many edges (2 MB) these rows are broadcast to all colourings.
EDGES_IN_A_ROW, BROADCAST_EDGES = 1000, 100_000


def probabilities(shots: DataFrame) -> DataFrame:
    return shots.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("run_id")))


def outcome_probability(shots: DataFrame, bitstring: str) -> DataFrame:
    """(run_id, p) of one outcome, 0 where it never came."""
    return shots.groupBy("run_id").agg((F.sum(F.when(F.col("bitstring") == bitstring, F.col("n")).otherwise(0)) / F.sum("n")).alias("p"))


def most_common(shots: DataFrame) -> DataFrame:
    """(run_id, bitstring, n): the largest count; of equal ones the smallest bitstring."""
    best = shots.groupBy("run_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "bitstring")).alias("b"))
    return best.select("run_id", "b.bitstring", (-F.col("b.m")).alias("n"))


def _sign(qubits: tuple[int, ...]) -> Column:
    ones = sum((F.substring("bitstring", -q - 1, 1).cast("int") for q in qubits[1:]), F.substring("bitstring", -qubits[0] - 1, 1).cast("int"))
    return F.when(ones % 2 == 0, 1).otherwise(-1)


def parities(shots: DataFrame, terms: dict[str, tuple[int, ...]] | None = None) -> DataFrame:
    """(run_id, one column a term): mean parity of the named qubits."""
    terms = terms or {"z0": (0,), "z1": (1,), "zz": (0, 1)}
    return shots.groupBy("run_id").agg(*((F.sum(F.col("n") * _sign(q)) / F.sum("n")).alias(k) for k, q in terms.items()))


def impossible_share(shots: DataFrame, allowed: tuple[str, ...] = ("00", "11")) -> DataFrame:
    return shots.groupBy("run_id").agg((F.sum(F.when(F.col("bitstring").isin(*allowed), 0).otherwise(F.col("n"))) / F.sum("n")).alias("impossible"))


def fidelity(a: DataFrame, b: DataFrame) -> DataFrame:
    """(run_id, other_id, fidelity) of run pairs matched by pair_id: the squared sum of sqrt(p q); 0 without a common outcome."""
    side = lambda d, r: d.select("pair_id", F.col("run_id").alias(r), "bitstring", (F.col("n") / F.sum("n").over(Window.partitionBy("pair_id", "run_id"))).alias(f"p_{r}"))
    left, right = side(a, "run_id"), side(b, "other_id")
    pairs = left.select("pair_id", "run_id").distinct().join(right.select("pair_id", "other_id").distinct(), "pair_id")
    both = left.join(right, ["pair_id", "bitstring"]).groupBy("run_id", "other_id").agg(F.pow(F.sum(F.sqrt(F.col("p_run_id") * F.col("p_other_id"))), F.lit(2.0)).alias("fidelity"))
    return pairs.select("run_id", "other_id").join(both, ["run_id", "other_id"], "left").fillna({"fidelity": 0.0})


def confusion_matrix(calibration: DataFrame) -> DataFrame:
    """(prepared, p_00 .. p_11): how often each outcome was read for each prepared state, from (prepared, bitstring, n)."""
    total = F.sum("n")
    return calibration.groupBy("prepared").agg(*((F.sum(F.when(F.col("bitstring") == b, F.col("n")).otherwise(0)) / total).alias(f"p_{b}") for b in TWO_BITS))


def mitigated(shots: DataFrame, matrix: DataFrame) -> DataFrame:
    """(run_id, bitstring, p): counts solved for what was there, negative shares cut to 0, then brought to sum 1.

    matrix has four rows; many runs are solved at once in each batch of a partition.
    """
    rows = {r["prepared"]: [r[f"p_{b}"] for b in TWO_BITS] for r in matrix.limit(len(TWO_BITS) + 1).collect()}
    if missing := sorted(set(TWO_BITS) - set(rows)):
        raise ValueError(f"no calibration for the prepared states {missing}")
    m = np.array([rows[b] for b in TWO_BITS]).T
    if abs(np.linalg.det(m)) < 1e-12:
        raise ValueError("the calibration doesn't tell the prepared states apart")
    counts = shots.groupBy("run_id").agg(*(F.sum(F.when(F.col("bitstring") == b, F.col("n")).otherwise(0)).cast("double").alias(f"c{i}") for i, b in enumerate(TWO_BITS)))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = b[["c0", "c1", "c2", "c3"]].to_numpy()
            p = np.linalg.solve(m, (c / c.sum(1, keepdims=True)).T).T.clip(0)
            p /= p.sum(1, keepdims=True)
            yield pd.DataFrame({"run_id": np.repeat(b["run_id"].to_numpy(), 4), "bitstring": list(TWO_BITS) * len(b), "p": p.ravel()})

    return counts.mapInPandas(solve, "run_id long, bitstring string, p double")


def extrapolated(measured: DataFrame) -> DataFrame:
    """(run_id, linear, quadratic): the values at scale 0 of fits through (scale, value)."""
    x, y = F.col("scale").cast("double"), F.col("value")
    s = measured.groupBy("run_id").agg(F.regr_intercept("value", "scale").alias("linear"), F.count("*").cast("double").alias("n"), *(F.sum(F.pow(x, F.lit(float(k)))).alias(f"x{k}") for k in (1, 2, 3, 4)), F.sum(y).alias("y0"), F.sum(x * y).alias("y1"), F.sum(x * x * y).alias("y2"))
    det = lambda a, b, c, d, e, f, g, h, i: a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    n, x1, x2, x3, x4, y0, y1, y2 = (F.col(c) for c in ("n", "x1", "x2", "x3", "x4", "y0", "y1", "y2"))
    return s.select("run_id", "linear", F.try_divide(det(y0, x1, x2, y1, x2, x3, y2, x3, x4), det(n, x1, x2, x1, x2, x3, x2, x3, x4)).alias("quadratic"))


def energies(expectations: DataFrame, coefficients: DataFrame) -> DataFrame:
    """(run_id, energy): (run_id, term, value) weighted by (term, coefficient); terms without a value count 0."""
    return expectations.join(coefficients, "term").groupBy("run_id").agg(F.sum(F.col("value") * F.col("coefficient")).alias("energy"))


def calibration_report(qubits: DataFrame, edges: DataFrame, least_t1: float = 0.0) -> DataFrame:
    """One row: medians over (qubit, t1, t2, readout_error) and (a, b, error), unusable edges (error >= 1), largest degree, best pair."""
    names = {"median_t1": "t1", "median_t2": "t2", "median_readout": "readout_error"}
    middle = percentiles(qubits, [], {name: F.col(c) for name, c in names.items()}, [0.5]).select(*(F.col(name)[0].alias(name) for name in names))
    between = percentiles(edges, [], {"median_error": F.when(F.col("error") < 1, F.col("error"))}, [0.5]).select(F.col("median_error")[0].alias("median_error"))
    q = middle.crossJoin(qubits.agg(F.count_if(F.col("t1") <= least_t1).alias("unusable_qubits")))
    e = edges.agg(F.count_if(F.col("error") >= 1).alias("unusable_edges"), F.min(F.struct("error", "a", "b")).alias("best"))
    d = edges.select(F.explode(F.array("a", "b")).alias("qubit")).groupBy("qubit").count().agg(F.max("count").alias("largest_degree"))
    return q.crossJoin(between).crossJoin(e).crossJoin(d).select("*", F.col("best.a").alias("best_a"), F.col("best.b").alias("best_b"), F.col("best.error").alias("best_error")).drop("best")


def cut_values(shots: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, mean_cut, best_cut, optimum_share): edges (a, b) cut by each sampled colouring, and how often the best of the run came.

    Each colouring meets the edges some at a time and leaves one number for each lot, not a row for each edge.
    """
    many = edges.count()
    parts = edges.groupBy(F.pmod(F.xxhash64("a", "b"), F.lit(max(1, -(-many // EDGES_IN_A_ROW)))).alias("part")).agg(F.collect_list(F.struct("a", "b")).alias("edges"))
    other = lambda e: F.substr("bitstring", -e["a"] - 1, F.lit(1)) != F.substr("bitstring", -e["b"] - 1, F.lit(1))
    met = shots.crossJoin(F.broadcast(parts) if many <= BROADCAST_EDGES else parts)
    cuts = met.withColumn("cut", F.size(F.filter("edges", other)).cast("long")).groupBy("run_id", "bitstring", "n").agg(F.sum("cut").alias("cut"))
    cuts = cuts.withColumn("best", F.max("cut").over(Window.partitionBy("run_id")))
    return cuts.groupBy("run_id").agg((F.sum(F.col("cut") * F.col("n")) / F.sum("n")).alias("mean_cut"), F.first("best").alias("best_cut"), (F.sum(F.when(F.col("cut") == F.col("best"), F.col("n")).otherwise(0)) / F.sum("n")).alias("optimum_share"))
