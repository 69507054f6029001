"""Approximate nearest neighbours: inverted lists scanned with adaptive dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakelode.llm.shared import materialize
from quakelode.llm.vectors import lengths, matrix, stacked, usable

SAMPLE, SAMPLE_BYTES = 65_536, 1 << 25  #: vectors, those with the smallest hashes, on which the index is fitted, and doubles of them
TRIALS = 256  #: of them, those whose neighbours in the sample show how many lists to probe
RECALL = 0.97  #: share of their neighbours that the probed lists must hold
MEMBERS = 16  #: vectors of the sample to a list, at least
PART = 4096  #: vectors of a list, and queries, that one task compares at a time
COLUMNS = 16  #: columns added between two tests
EPSILON = 2.1  #: of the test that gives a candidate up: wrong for about one in 10^4 at each look


def fit(sample: np.ndarray, count: int, neighbours: int, seed: int = 5) -> tuple[np.ndarray, int]:
    """Centres by k-means on the sample, and the lists to probe for RECALL of the sample's own nearest neighbours."""
    draw = np.random.default_rng(seed)
    k = int(np.clip(np.sqrt(count) / 4, 1, max(1, len(sample) // MEMBERS)))
    centres = sample[draw.choice(len(sample), k, replace=False)]
    for _ in range(10):
        near = _nearest(sample, centres)
        for c in range(k):
            mine = sample[near == c]
            centres[c] = mine.mean(0) if len(mine) else sample[draw.integers(len(sample))]
    near = _nearest(sample, centres)
    trial = sample[draw.choice(len(sample), min(TRIALS, len(sample)), replace=False)]
    needed = []
    for q in trial:
        closest = np.argsort(((sample - q) ** 2).sum(1), kind="stable")[1 : neighbours + 1]
        rank = np.argsort(np.argsort(((centres - q) ** 2).sum(1)))
        needed.extend(rank[near[closest]] + 1)
    return centres, int(np.quantile(needed, RECALL, method="higher")) if needed else 1


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[a : a + 4096] @ centres.T - half, 1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def rotation(length: int, seed: int = 3) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(length, length)))[0]


def adaptive_scan(q: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Indices of rows of x that may be among the k nearest of q, all vectors rotated.

    After each block of columns a row's partial distance d' over d of D columns is tested: if d' * D / d exceeds the
    k-th smallest full distance so far by the factor (1 + EPSILON / sqrt(d))^2, it is given up. Rows as near as the
    k-th always stay.
    """
    d, lead = x.shape[1], max(4 * k, 64)
    full = ((x[:lead] - q) ** 2).sum(1)
    keep = [np.arange(len(full))]
    bound = np.partition(full, k - 1)[k - 1] if len(full) >= k else np.inf
    for a in range(lead, len(x), 1024):
        at, part = np.arange(a, min(a + 1024, len(x))), np.zeros(min(1024, len(x) - a))
        for c in range(0, d, COLUMNS):
            part = part + ((x[at, c : c + COLUMNS] - q[c : c + COLUMNS]) ** 2).sum(1)
            seen = min(d, c + COLUMNS)
            limit = bound * seen / d * (1 + EPSILON / np.sqrt(seen)) ** 2 if seen < d else bound * (1 + 1e-9) + 1e-12
            on = part <= limit
            at, part = at[on], part[on]
        keep.append(at)
        full = np.concatenate((full, part))
        bound = np.partition(full, k - 1)[k - 1] if len(full) >= k else np.inf
    return np.concatenate(keep)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest rows of vectors found, except that of its own id.

    score is the Euclidean distance of the given vectors in double precision; ties go to the smaller id. Vectors that
    are null, empty, zero or hold null or non-finite components take
    no part, as queries or candidates, nor do null ids; a query's candidates are those of its length. Rows that repeat an id count once, by their nearest vector. With
    k candidates or fewer all are returned. Other columns play no part.

    Each length has its index, which is fitted on SAMPLE rows at most and covers every row: each goes to the list of its
    nearest centre, and each query probes as many lists as RECALL of neighbours in the sample needed. Lists become more
    with the square root of the rows, up to one for MEMBERS vectors of the sample (4096); beyond that they grow, and long
    ones are split: a task gets a part of a list with the queries that probe it, in groups of PART.
    """
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for length in lengths(queries, vector_col):
        found = found.unionByName(_nearest_of_length(vectors, queries, length, k, id_col, vector_col))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))  # an id may have vectors of several lengths
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest_of_length(vectors: DataFrame, queries: DataFrame, length: int, k: int, id_col: str, vector_col: str) -> DataFrame:
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        return df.where(usable(vector_col) & (F.size(vector_col) == length)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null")

    rows, asked = clean(vectors), clean(queries)
    count = rows.count()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # rows whose hash is small first, so that a task sends a share of the sample and not a sample of its own
    most, place = max(MEMBERS, min(SAMPLE, SAMPLE_BYTES // length // 8)), F.pmod(F.xxhash64("id", "v"), F.lit(1 << 32))
    few = rows.where(place <= (1 << 32) * 2.0 * most / count).orderBy(place, "id").limit(most).select("v").toArrow()
    few = few if len(few) else rows.limit(most).select("v").toArrow()  # all rows are one row
    centres, probes = fit(matrix(few["v"], length), count, k)
    turn = rotation(length)
    kind = dict(rows.dtypes)["v"]

    def lists(many: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            half = (centres**2).sum(1) / 2
            for batch in batches:
                x = matrix(batch.column(1), length)
                order = np.argsort(half - x @ centres.T, 1)[:, :many] if many > 1 else _nearest(x, centres)[:, None]
                at = np.repeat(np.arange(len(x)), order.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(order.ravel().astype(np.int32))], names=["id", "v", "list"])

        return run

    schema = f"id long, v {kind}, list int"
    listed = materialize(rows.mapInArrow(lists(1), schema), "neighbours-lists")
    probed = materialize(asked.mapInArrow(lists(probes), schema), "neighbours-probes")
    parts = [{r["list"]: -(-r["count"] // PART) for r in df.groupBy("list").count().collect()} for df in (listed, probed)]
    cut = [(c, parts[0][c], parts[1][c]) for c in range(len(centres)) if c in parts[0] and c in parts[1]]
    table, other = (spark.createDataFrame(cut, "list int, p long, r long") for _ in range(2))
    left = listed.join(F.broadcast(table), "list").withColumn("part", F.pmod(F.xxhash64("id"), "p")).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("r") - 1))).drop("p", "r")
    right = probed.join(F.broadcast(other), "list").withColumn("group", F.pmod(F.xxhash64("id"), "r")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") - 1))).drop("p", "r")

    def scan(have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        if not len(have) or not len(want):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        have = have.sort_values("id", kind="stable")
        x0, ids = stacked(have["v"], length), have["id"].to_numpy()
        x, out = x0 @ turn, []
        for q0, me in zip(stacked(want["v"], length), want["id"].to_numpy(), strict=True):
            at = adaptive_scan(q0 @ turn, x, 2 * k + 2)
            at = at[ids[at] != me]
            score = np.sqrt(((x0[at] - q0) ** 2).sum(1))
            best = pd.DataFrame({"vec_id": ids[at], "score": score}).sort_values(["score", "vec_id"]).drop_duplicates("vec_id")[:k]
            out.append(best.assign(query_id=me))
        return pd.concat(out)[["query_id", "vec_id", "score"]]

    on = ["list", "part", "group"]
    found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(scan, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
