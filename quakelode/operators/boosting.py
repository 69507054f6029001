"""Boosted trees on binned rows, equal ones counted, so that a task fits one setting of a sweep."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np

BINS = 64  #: values of a column after cutting it at quantiles
LEAF = 20  #: rows that each side of a split must have
BLOCK = 1 << 14  #: rows that are summed at a time


class Trees(NamedTuple):
    start: float  # log-odds before the first tree
    column: np.ndarray  # of each tree's inner nodes, level by level
    cut: np.ndarray  # greatest bin that goes left; the last bin where a node isn't split
    value: np.ndarray  # of each tree's leaves


def quantile_edges(x: np.ndarray) -> list[np.ndarray]:
    """For each column the values at which it is cut into BINS bins at most."""
    return [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)


def _histograms(codes: np.ndarray, node: np.ndarray, width: int, weights: Sequence[np.ndarray]) -> np.ndarray:
    """(weights, nodes, columns, bins): sums of each weight, by blocks that stay in a processor's cache."""
    f = codes.shape[1]
    out = np.zeros((len(weights), f, width * BINS))
    for a in range(0, len(codes), BLOCK):
        first = node[a : a + BLOCK] * BINS
        for c in range(f):
            at = first + codes[a : a + BLOCK, c]
            for w, weight in enumerate(weights):
                out[w, c] += np.bincount(at, weight[a : a + BLOCK], width * BINS)
    return out.reshape(len(weights), f, width, BINS).transpose(0, 2, 1, 3)


def _split(codes: np.ndarray, node: np.ndarray, width: int, g: np.ndarray, h: np.ndarray, n: np.ndarray, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """The best column and cut of each of ``width`` nodes."""
    left = _histograms(codes, node, width, (g, h, n)).cumsum(3)
    both = left[..., -1:]
    right = both - left
    score = lambda s: s[0] ** 2 / (s[1] + l2)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((left[2] >= LEAF) & (right[2] >= LEAF), score(left) + score(right) - score(both), 0.0).reshape(width, -1)
    best = gain.argmax(1)
    return best // BINS, np.where(gain[np.arange(width), best] > 1e-12, best % BINS, BINS - 1)


def grow(codes: np.ndarray, y: np.ndarray, rounds: int, rate: float, depth: int, l2: float, n: np.ndarray | None = None) -> Trees:
    """Trees for the log loss of y (0 or 1), each with leaves by one Newton step. A prefix of them is what fewer rounds give.

    With n, a row of codes stands for so many rows that have them, and y is how many of these are 1: they always meet in a
    leaf, so the trees are those of the single rows.
    """
    n = np.ones(len(y)) if n is None else n
    if y.sum() in (0, n.sum()):  # rows of one class are never split
        codes, y, n = codes[:1], y.sum(keepdims=True), n.sum(keepdims=True)
    n, y = n.astype(float), y.astype(float)
    share = float(np.clip(y.sum() / n.sum(), 1e-6, 1 - 1e-6))
    start = float(np.log(share / (1 - share)))
    raw = np.full(len(y), start)
    column, cut, value = np.zeros((rounds, (1 << depth) - 1), np.uint8), np.zeros((rounds, (1 << depth) - 1), np.uint8), np.zeros((rounds, 1 << depth), np.float32)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h, node = n * p - y, n * p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            c, k = _split(codes, node, width, g, h, n, l2)
            column[t, first : first + width], cut[t, first : first + width] = c, k
            node = _below(codes, node, c, k.astype(np.uint8))
        value[t] = -rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + l2)
        raw += value[t][node]
    return Trees(start, column, cut, value)


def _below(codes: np.ndarray, node: np.ndarray, column: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The nodes of the next level that rows go to; column and cut of each node of this one."""
    out, f = np.empty_like(node), codes.shape[1]
    begins = np.arange(0, BLOCK * f, f)
    for a in range(0, len(node), BLOCK):
        at = node[a : a + BLOCK]
        nth = column.take(at)
        nth += begins[: len(at)]
        np.add(at, at, out=out[a : a + BLOCK])
        out[a : a + BLOCK] += codes[a : a + BLOCK].ravel().take(nth) > cut.take(at)
    return out


def probabilities(trees: Trees, codes: np.ndarray, after: list[int]) -> Iterator[np.ndarray]:
    """p of label 1 after so many trees, for each of the rising numbers."""
    raw, depth = np.full(len(codes), trees.start), trees.value.shape[1].bit_length() - 1
    for t in range(max(after)):
        if (trees.cut[t] == BINS - 1).all():  # a tree of one leaf
            raw += trees.value[t, 0]
        else:
            node = np.zeros(len(codes), np.int64)
            for level in range(depth):
                nodes = slice((1 << level) - 1, (2 << level) - 1)
                node = _below(codes, node, trees.column[t, nodes].astype(np.int64), trees.cut[t, nodes])
            raw += trees.value[t][node]
        if t + 1 in after:
            yield 1 / (1 + np.exp(-raw))
