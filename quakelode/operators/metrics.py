"""Forecast scores by group, from a long table of predictions (group columns, y 0/1, p)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakelode.constants import CLIP_GRID
from quakelode.operators.selection import percentiles

BINS = 10


def clipped(p: Column, clip: float) -> Column:
    return F.least(F.lit(1 - clip), F.greatest(F.lit(clip), p))


def information_gain(predictions: DataFrame, base: Column, by: Sequence[str], clip: float = CLIP_GRID) -> DataFrame:
    """ig_bits: mean log2 likelihood over that of the base rate (a column or literal, clipped alike)."""
    p, b = clipped(F.col("p"), clip), clipped(base, clip)
    bits = F.when(F.col("y") == 1, F.log2(p) - F.log2(b)).otherwise(F.log2(1 - p) - F.log2(1 - b))
    return predictions.groupBy(*by).agg(F.avg(bits).alias("ig_bits"))


def scores_of_counts(p: np.ndarray, positives: np.ndarray, negatives: np.ndarray, base: float, clip: float = CLIP_GRID) -> tuple[float, float]:
    """ig_bits and auc, as information_gain() and roc_auc() give them, of scores with their numbers of rows of each label."""
    inside, b = np.clip(p, clip, 1 - clip), min(1 - clip, max(clip, base))
    bits = positives * (np.log2(inside) - np.log2(b)) + negatives * (np.log2(1 - inside) - np.log2(1 - b))
    # rising distinct scores: a pair of both labels counts if the positive's is higher, and half if they are tied
    nth = np.unique(p, return_inverse=True)[1]
    pos, neg = np.bincount(nth, positives), np.bincount(nth, negatives)
    n, pairs = pos.sum() + neg.sum(), pos.sum() * neg.sum()
    won = (pos * (neg.cumsum() - neg / 2)).sum()
    return float(bits.sum() / n) if n else math.nan, float(won / pairs) if pairs else math.nan


def bin_of(p: Column, closed: bool) -> Column:
    """Number of the decile bin, edges at i * 0.1 in doubles; p = 1 is in the last bin if closed, else in none."""
    edges = [i * 0.1 for i in range(BINS)] + [1.0]
    found = F.when(p < edges[1], 0)
    for k in range(1, BINS):
        found = found.when((p >= edges[k]) & (p < edges[k + 1]), k)
    return F.when(p >= 0, found.when(F.lit(closed) & (p == 1.0), BINS - 1))


def calibration_error(predictions: DataFrame, by: Sequence[str], closed: bool = False) -> DataFrame:
    """ece: mean distance of rate and mean forecast over bins, by their share of all rows."""
    w = Window.partitionBy(*by)
    bins = predictions.withColumn("bin", bin_of(F.col("p"), closed)).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("y").alias("rate"), F.avg("p").alias("mean"))
    bins = bins.withColumn("all", F.sum("n").over(w))
    return bins.groupBy(*by).agg(F.sum(F.when(F.col("bin").isNotNull(), F.col("n") / F.col("all") * F.abs(F.col("rate") - F.col("mean"))).otherwise(0.0)).alias("ece"))


def proper_scores(predictions: DataFrame, by: Sequence[str], clip: float = CLIP_GRID) -> DataFrame:
    """n, positives, base_rate, brier, log_loss (natural, clipped)."""
    p = clipped(F.col("p"), clip)
    loss = -F.when(F.col("y") == 1, F.ln(p)).otherwise(F.ln(1 - p))
    return predictions.groupBy(*by).agg(F.count("*").alias("n"), F.sum("y").alias("positives"), F.avg("y").alias("base_rate"), F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2.0))).alias("brier"), F.avg(loss).alias("log_loss"))


def curve(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, p, tp, fp, positives, negatives): one row for each distinct score, falling, with cumulative counts.

    Rows are first reduced to distinct scores. Scores are then summed in a thousand ranges and within each, so a group
    of very many scores is not ordered in one task.
    """
    each = predictions.groupBy(*by, "p").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg")).withColumn("range", -F.floor(F.col("p") * 1000).cast("long"))
    total = each.groupBy(*by, "range").agg(F.sum("pos").alias("rpos"), F.sum("neg").alias("rneg"))
    upto, all_ = Window.partitionBy(*by).orderBy("range"), Window.partitionBy(*by)
    total = total.select(*by, "range", (F.sum("rpos").over(upto) - F.col("rpos")).alias("pos0"), (F.sum("rneg").over(upto) - F.col("rneg")).alias("neg0"), F.sum("rpos").over(all_).alias("positives"), F.sum("rneg").over(all_).alias("negatives"))
    inner = Window.partitionBy(*by, "range").orderBy(F.col("p").desc())
    joined = each.join(total, [*by, "range"])
    return joined.select(*by, "p", (F.col("pos0") + F.sum("pos").over(inner)).alias("tp"), (F.col("neg0") + F.sum("neg").over(inner)).alias("fp"), "positives", "negatives", F.col("pos").alias("pos"), F.col("neg").alias("neg"))


def roc_auc(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    """auc: ties count one half; NaN if there is one class only."""
    c = curve(predictions, by)
    over = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2))
    pairs = (F.first("positives") * F.first("negatives")).cast("double")
    return c.groupBy(*by).agg(F.when(pairs == 0, F.lit(float("nan"))).otherwise(F.try_divide(over, pairs)).alias("auc"))


def average_precision(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    """pr_auc: sum of recall steps times precision; NaN without positives."""
    c = curve(predictions, by)
    steps = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return c.groupBy(*by).agg(F.when(F.first("positives") == 0, F.lit(float("nan"))).otherwise(F.try_divide(steps, F.first("positives").cast("double"))).alias("pr_auc"))


def curve_points(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, p, tpr, fpr, precision, recall) at each distinct score."""
    return curve(predictions, by).select(*by, "p", F.try_divide("tp", "positives").alias("tpr"), F.try_divide("fp", "negatives").alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "positives").alias("recall"))


def confusion(predictions: DataFrame, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """tn, fp, fn, tp at p >= threshold, and accuracy, precision, recall, f1 (0 where they divide by 0)."""
    hit, yes = F.col("p") >= threshold, F.col("y") == 1
    c = predictions.groupBy(*by).agg(F.count_if(~hit & ~yes).alias("tn"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(hit & yes).alias("tp"))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = c.withColumns({"accuracy": safe(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), "precision": safe(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe(F.col("tp"), F.col("tp") + F.col("fn"))})
    return c.withColumn("f1", safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def reliability(predictions: DataFrame, by: Sequence[str], bins: int = BINS) -> DataFrame:
    """(by, bin, n, mean, rate) over bins between exact quantiles of p (the upper edge belongs to a bin); empty bins are absent."""
    edges = percentiles(predictions, by, {"edges": F.col("p")}, [k / bins for k in range(1, bins)])
    binned = predictions.join(edges, [*by]).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("p"))))
    return binned.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean"), F.avg("y").alias("rate"))


def scorecard(predictions: DataFrame, base: DataFrame | None = None, threshold: float = 0.5, clip: float = CLIP_GRID, closed: bool = False) -> DataFrame:
    """All scores of each (model, split); base: (model, base), by default the rate of the model's train split."""
    by = ["model", "split"]
    base = base if base is not None else predictions.where("split = 'train'").groupBy("model").agg(F.avg("y").alias("base"))
    out = proper_scores(predictions, by, clip)
    parts = [information_gain(predictions.join(base, "model"), F.col("base"), by, clip), calibration_error(predictions, by, closed), roc_auc(predictions, by), average_precision(predictions, by), confusion(predictions, by, threshold)]
    for part in parts:
        out = out.join(part, by, "left")
    return out
