"""Preparation, models and calibration on feature tables."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import PCA, Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakelode.constants import CLIP_GRID
from quakelode.operators import boosting, metrics
from quakelode.operators.selection import percentiles

#: Cells of a sweep that are packed together.
CELLS = 500_000
COUNTS = ["count_7d", "count_30d", "count_90d", "count_365d", "log_recency"]
#: Columns of one wide feature table that each experiment uses.
FEATURE_SETS = {
    "baseline": ["latitude", "longitude", *COUNTS],
    "max_magnitude": ["latitude", "longitude", *COUNTS, "max_mag_30d", "max_mag_90d", "max_mag_365d"],
    "coast_elevation": ["latitude", "longitude", *COUNTS, "coast_km", "elevation"],
    "fault": ["latitude", "longitude", *COUNTS, "fault_km"],
    "dynamic_fault": ["latitude", "longitude", *COUNTS, "fault_mean_30d", "fault_mean_90d", "fault_mean_365d"],
    "coast": ["latitude", "longitude", *COUNTS, "coast_km"],
    "coast_tide": ["latitude", "longitude", *COUNTS, "coast_km", "tide"],
    "elevation": ["latitude", "longitude", *COUNTS, "elevation"],
    "gps": ["latitude", "longitude", *COUNTS, "east_anomaly", "north_anomaly", "up_anomaly", "east_year", "north_year", "up_year"],
    "etas": ["latitude", "longitude", *COUNTS, "intensity"],
    "event_4": ["coast_km", "fault_km", "etas", "magnitude"],
    "event_14": ["latitude", "longitude", "depth_km", "magnitude", "coast_km", "fault_km", *(f"{c}_{k}" for c in ("hour", "weekday", "day_of_year", "month") for k in ("sin", "cos"))],
}


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column on [0, 1] by its own extremes; a constant column is 0."""
    ends = df.agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    scaled = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"__lo_{c}"), F.col(f"__hi_{c}") - F.col(f"__lo_{c}")), F.when(F.col(c).isNotNull(), 0.0)) for c in columns}
    return df.crossJoin(F.broadcast(ends)).withColumns(scaled).select(*df.columns)


def standardised(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less the train mean, over the train's population deviation (a constant column is only centred)."""
    stats = train.agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(out).select(*df.columns)


def angles(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standardised columns, clipped to [-1, 1] and times pi."""
    return standardised(df, train, columns).withColumns({c: math.pi * F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col(c))) for c in columns})


def imputed(df: DataFrame, train: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Missing values (null or NaN) replaced by the train median: exact, or by approximate quantiles."""
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in columns}
    if not exact:
        model = Imputer(strategy="median", inputCols=list(columns), outputCols=list(columns), relativeError=1e-4).fit(train)
        return model.transform(df)
    middle = percentiles(train, [], {f"__{c}": v for c, v in clean.items()}, [0.5]).select(*(F.col(f"__{c}")[0].alias(f"__{c}") for c in columns))
    return df.withColumns(clean).crossJoin(F.broadcast(middle)).withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).select(*df.columns)


def assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="error").transform(df)


def components(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """Adds pc_1 to pc_k, from centred columns."""
    ready = assembled(standardised(df, df, columns), columns)
    out = PCA(k=k, inputCol="features", outputCol="pcs").fit(ready).transform(ready)
    return out.withColumns({f"pc_{i + 1}": vector_to_array("pcs")[i] for i in range(k)}).drop("features", "pcs")


def boosted(train: DataFrame, columns: Sequence[str], rounds: int = 400, rate: float = 0.05, depth: int = 5, rows: float = 0.8, cols: str = "0.8", seed: int = 42) -> Model:
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, stepSize=rate, maxDepth=depth, subsamplingRate=rows, featureSubsetStrategy=cols, seed=seed, checkpointInterval=20)
    ready = assembled(train, columns).select("features", "label").cache()
    try:
        return model.fit(ready)
    finally:
        ready.unpersist()


def logistic(train: DataFrame, columns: Sequence[str]) -> Model:
    return LogisticRegression(featuresCol="features", labelCol="label", maxIter=100).fit(assembled(train, columns).select("features", "label"))


def scored(model: Model | PipelineModel, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds p, the model's probability of label 1; keys stay on their rows."""
    out = model.transform(assembled(df, columns))
    return out.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def calibrated(fit_on: DataFrame, df: DataFrame, clip: float = CLIP_GRID) -> DataFrame:
    """p of df through the isotonic fit of label on p over fit_on: interpolated, constant beyond its ends, clipped."""
    model = IsotonicRegression(featuresCol="p", labelCol="label").fit(fit_on.select("p", F.col("label").cast("double").alias("label")))
    out = model.transform(df)
    return out.withColumn("p", metrics.clipped(F.col("prediction"), clip)).drop("prediction")


def sweep(train: DataFrame, test: DataFrame, columns: Sequence[str], grid: Sequence[dict]) -> DataFrame:
    """(rounds, depth, rate, l2, ig_bits, auc) of each setting, fitted on all train rows and scored on all test rows.

    Columns are cut at exact quantiles of all train rows. Rows that fall into the same bins are one cell with its numbers of
    rows and of labels 1, from which trees and scores come out as from the single rows; so what a task holds follows the
    number of cells, which columns of BINS bins bound. Settings are fitted and scored side by side, one a task; settings that
    differ in rounds alone are one fit. Missing values are in the last bin.
    """
    from quakelode.sources.catalog import written

    spark, f = train.sparkSession, len(columns)
    share, n = train.agg(F.avg("label"), F.count("label")).first()
    if not n:
        raise ValueError("there must be train rows")
    points = [k / boosting.BINS for k in range(1, boosting.BINS)]
    cuts = percentiles(train, [], {f"c{k}": F.col(c) for k, c in enumerate(columns)}, points).first() or [None] * f
    edges = [np.unique(c if c is not None else np.zeros(0)) for c in cuts]
    codes = [f"c{k}" for k in range(f)]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.asarray(b.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False)) for k in range(f)]
            found = [pa.array(np.searchsorted(e, v, "left").astype(np.int8)) for e, v in zip(edges, x, strict=True)]
            yield pa.RecordBatch.from_arrays([*found, b.column(f)], names=[*codes, "label"])

    def cells(rows: DataFrame) -> DataFrame:
        typed = rows.where("label is not null").select(*(F.col(c).cast("double").alias(c) for c in columns), F.col("label").cast("int").alias("label"))
        held = typed.mapInArrow(binned, ", ".join(f"{c} byte" for c in codes) + ", label int")
        return held.groupBy(*codes).agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("y")).mapInArrow(_packed_cells, "data binary")

    both = cells(train).withColumn("split", F.lit(0)).unionByName(cells(test).withColumn("split", F.lit(1)))
    packed = written(both, "sweep-cells")
    # deep trees first, as they take longest
    fits = sorted({(g["depth"], g["rate"], g["l2"]) for g in grid}, key=lambda x: (-x[0], *x[1:]))
    after = {x: sorted({g["rounds"] for g in grid if (g["depth"], g["rate"], g["l2"]) == x}) for x in fits}

    def counted(table: pa.Table) -> list[np.ndarray]:
        # counts are small numbers mostly, and are held as such
        cell, *counts = np.stack([table.column(c).to_numpy().astype(np.uint8) for c in codes], 1), *(table.column(c).to_numpy() for c in ("y", "n"))
        return [cell, *(v.astype(np.min_scalar_type(int(v.max(initial=0)))) for v in counts)]

    def joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        return [np.concatenate([empty, *(p.pop(0) for p in parts)]) for empty in (np.zeros((0, f), np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint8))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for b in batches:
            for k, split, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                with pa.ipc.open_stream(data.as_buffer()) as stream:
                    held.setdefault(k, ([], []))[split].append(counted(stream.read_all()))
        for k in sorted(held):
            depth, rate, l2 = fits[k]
            old, new = (joined(parts) for parts in held.pop(k))
            trees = boosting.grow(*old[:2], max(after[fits[k]]), rate, depth, l2, old[2])
            scores = [metrics.scores_of_counts(p, new[1].astype(float), new[2] - new[1].astype(float), share) for p in boosting.probabilities(trees, new[0], after[fits[k]])]
            bits, auc = ([float(x) for x in v] for v in zip(*scores, strict=True))
            many = len(scores)
            yield pa.RecordBatch.from_arrays([pa.array(after[fits[k]], pa.int32()), pa.array([depth] * many, pa.int32()), *(pa.array([v] * many, pa.float64()) for v in (rate, l2)), pa.array(bits, pa.float64()), pa.array(auc, pa.float64())], names=["rounds", "depth", "rate", "l2", "ig_bits", "auc"])

    table = spark.createDataFrame([(k,) for k in range(len(fits))], "k int")
    # every fit needs all cells
    dealt = packed.crossJoin(F.broadcast(table)).select("k", "split", "data").repartitionByRange(len(fits), "k")
    return dealt.mapInArrow(run, "rounds int, depth int, rate double, l2 double, ig_bits double, auc double")


def _packed_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(data): cells, a part's in the order of their bins, in compressed Arrow batches of CELLS or so."""
    held, n = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            n += batch.num_rows
        if n and (batch is None or n >= CELLS):
            table, sink = pa.Table.from_batches(held), pa.BufferOutputStream()
            table = table.sort_by([(c, "ascending") for c in table.column_names])
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["data"])
            held, n = [], 0


def label_balance(df: DataFrame, label: str = "label", by: Sequence[str] = ("split",)) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("positives"), F.avg(label).alias("rate"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for all pairs of columns, each pair once, from one aggregation; null where a column is constant."""
    pairs: list[Column] = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    return df.agg(F.array(*pairs).alias("x")).select(F.explode("x").alias("x")).select("x.*")
