"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quakelode.llm.shared import discard, materialize, text_chunks, word_hashes, words_of

SAMPLE = 2000  #: labelled documents of each class, those with the smallest hashes, on which the field is fitted
LINES = 300_000  #: lines of all of them together (some 130 MB of features): documents count whole, in the order of the hashes
ROUNDS = 150  #: steps of the fit
FEATURES = 12


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its bytes, each row's first line and the end): an empty row is one empty line."""
    breaks = np.flatnonzero(data == 10)
    # a line break before a row's start ends in the row before: it comes first
    begins, ends = np.concatenate((breaks + 1, offsets[:-1])), np.concatenate((offsets[1:], breaks))
    order = np.argsort(begins, kind="stable")
    starts, ends = begins[order], np.sort(ends, kind="stable")
    first = np.append(np.flatnonzero(order >= len(breaks)), len(starts))
    size = (ends - starts).astype(np.float64)

    def held(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (sums[ends] - sums[starts]).astype(np.float64)

    upper, lower = held((data >= 65) & (data <= 90)), held((data >= 97) & (data <= 122))
    wide, digits, marks = held(data >= 128), held((data >= 48) & (data <= 57)), held(data == 33)
    signs, bars = held(((data >= 35) & (data <= 38)) | (data == 42) | (data == 64) | (data == 94) | (data == 126)), held(data == 124)
    w0, w1, _ = words_of(data, offsets)
    hashes, line = word_hashes(data, w0, w1), np.searchsorted(starts, w0, "right") - 1
    words = np.bincount(line, minlength=len(starts)).astype(np.float64)
    again = np.zeros(len(w0), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    again = np.bincount(line[again], minlength=len(starts))
    whole = word_hashes(data, starts, ends)
    same = np.zeros(len(starts))
    same[1:] = (whole[1:] == whole[:-1]) & (size[1:] > 0)
    same[first[:-1]] = 0
    some, letters = np.maximum(words, 1), np.maximum(upper + lower + wide, 1)
    rest = size - upper - lower - wide - digits - (words - 1).clip(0)
    out = np.stack([upper / letters, marks / some, signs / some, bars / some, digits / np.maximum(size, 1), again / some, (size / some) / 10, np.log1p(size) / 8, rest / np.maximum(size, 1), size == 0, same, np.ones_like(size)], 1)
    return np.minimum(out, 3).astype(np.float32), size, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the lines before and after it in its row (zeros at the ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate((x, before, after), 1)


class Field(NamedTuple):
    weights: np.ndarray  # of a line's features, for good against bad
    moves: np.ndarray  # 2 x 2: from the state before (0 bad, 1 good) to this one
    slope: float  # score = sigmoid(slope * logit(share of good bytes) + shift)
    shift: float


def _chain(e: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds of good against bad for each line, all rows at once, longest first."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    heads, tails, n = first[:-1][order], first[1:][order] - 1, n[order]
    active = np.searchsorted(-n, -np.arange(n.max() if len(n) else 0), "left")  # rows with more lines than t
    (t00, t01), (t10, t11) = moves
    forward, backward = e.copy(), np.zeros_like(e)
    for t in range(1, len(active)):
        at = heads[: active[t]] + t
        x = forward[at - 1]
        forward[at] += np.logaddexp(t01, x + t11) - np.logaddexp(t00, x + t10)
        at = tails[: active[t]] - t
        x = e[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(t10, x + t11) - np.logaddexp(t00, x + t01)
    return forward, backward


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit(x: np.ndarray, first: np.ndarray, size: np.ndarray, good: np.ndarray, prior: float) -> Field:
    """The field that makes the rows' labels, taken by all their lines, likeliest (each row weighing alike), by Adam.

    Then slope and shift for rows are fitted by Newton steps; prior is the log-odds of good over all labelled rows.
    """
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    y, share = good[row].astype(np.float64), (1 / n)[row]
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    to = np.flatnonzero(inner)
    theta, m, v = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    for step in range(1, ROUNDS + 1):
        moves = theta[-4:].reshape(2, 2)
        e = x @ theta[:-4]
        a, b = _chain(e, first, moves)
        gap = (y - _sigmoid(a + b)) * share
        grad = np.concatenate((x.T @ gap, np.zeros(4)))
        joint = np.stack([i * a[to - 1] + moves[i, j] + j * (e + b)[to] for i in (0, 1) for j in (0, 1)])
        joint = np.exp(joint - joint.max(0))
        joint /= joint.sum(0)
        for k in range(4):
            grad[-4 + k] = ((((y[to - 1] == k // 2) & (y[to] == k % 2)) - joint[k]) * share[to]).sum()
        grad = grad / len(n) - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    got = Field(theta[:-4], theta[-4:].reshape(2, 2), 1.0, 0.0)
    z, k = _logit(_shares(x, first, size, got)), np.zeros(2)
    design = np.stack([z, np.ones_like(z)], 1)
    for _ in range(25):
        p = _sigmoid(design @ k)
        h = design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        k = k + np.linalg.solve(h, design.T @ (good - p) - 1e-2 * k)
    balance = np.log(max(good.sum(), 1) / max((1 - good).sum(), 1))
    return Field(got.weights, got.moves, float(k[0]), float(k[1] + prior - balance))


def _shares(x: np.ndarray, first: np.ndarray, size: np.ndarray, field: Field) -> np.ndarray:
    """Of each row, the share of its bytes in good lines: marginals weighted by length (an empty line counts as one byte)."""
    a, b = _chain(x @ field.weights, first, field.moves)
    w = size + 1
    return np.add.reduceat(w * _sigmoid(a + b), first[:-1]) / np.add.reduceat(w, first[:-1])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """The field fitted on at most SAMPLE labelled documents of each class, with all their lines.

    The bound is on rows: of a class, documents are taken by hash of their ids, and one whose lines would bring the class
    above half of LINES is passed over. Labels other than 0 and 1 and null ids are left out; an id with both labels counts
    as bad. Of rows that repeat an id one is learned from, that of the smallest text hash. If a class has no document,
    every line is judged alike and scores are the share of good labels (a half without any).
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("good"))
    counts = {r.good: r["count"] for r in known.groupBy("good").count().collect()}
    prior = float(np.log(max(counts.get(1, 0), 0.5) / max(counts.get(0, 0), 0.5)))
    # ids whose hash is small first, so that a task sends a share of the sample and not a sample of its own
    small = lambda g: F.pmod(F.xxhash64("id"), F.lit(1 << 32)) <= (1 << 32) * 2.0 * SAMPLE / max(counts.get(g, 0), 1)
    order = [F.pmod(F.xxhash64("id"), F.lit(1 << 32)), F.col("id")]
    chosen = [known.where(F.col("good") == g).where(small(g)).orderBy(*order).limit(SAMPLE) for g in (0, 1)]

    def run(batches):
        for batch in batches:
            for at, data, offsets in text_chunks(batch.column(2)):
                x, size, first = line_features(data, offsets)
                x = with_neighbours(x, first)
                parts = [slice(a, b) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(parts)), pa.array([x[p].astype(np.float32).tobytes() for p in parts], pa.binary()), pa.array([size[p].tobytes() for p in parts], pa.binary())], names=["good", "x", "size"])

    src = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    held = src.join(F.broadcast(chosen[0].union(chosen[1])), "id").groupBy("id", "good").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    held = materialize(held.select("id", "good", F.col("t.text").alias("text"), (F.length("t.text") - F.length(F.replace("t.text", F.lit("\n"), F.lit(""))) + 1).alias("lines"), order[0].alias("place")), "quality-sample")
    ids, room = [], {0: LINES // 2, 1: LINES // 2}
    for r in sorted(held.select("place", "id", "good", "lines").collect()):
        if r.lines <= room[r.good]:
            room[r.good] -= r.lines
            ids.append(r.id)
    sample = held.where(F.col("id").isin(ids)).select("id", "good", "text").mapInArrow(run, "good int, x binary, size binary").collect()
    discard(held)
    good = np.array([r.good for r in sample], np.float64)
    if not 0 < good.sum() < len(good):
        return Field(np.zeros(3 * FEATURES), np.zeros((2, 2)), 0.0, prior if counts else 0.0)
    x = [np.frombuffer(r.x, np.float32).reshape(-1, 3 * FEATURES) for r in sample]
    first = np.concatenate(([0], np.cumsum([len(p) for p in x])))
    return fit(np.concatenate(x).astype(np.float64), first, np.concatenate([np.frombuffer(r["size"], np.float64) for r in sample]), good, prior)


def score(field: Field, text: Column) -> Column:
    """Probability that a text is good, from all its lines; null and empty texts are one empty line."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for _, data, offsets in text_chunks(texts):
            x, size, first = line_features(data, offsets)
            out.append(_sigmoid(field.slope * _logit(_shares(with_neighbours(x, first), first, size, field)) + field.shift))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return F.arrow_udf(run, DoubleType())(text.cast("string"))
