"""Toxic documents from a support vector machine over a gapped subsequence kernel with Nyström landmarks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quakelode.llm.shared import discard, materialize, text_chunks

SAMPLE = 2000  #: labelled documents of each class, those with the smallest hashes, from which the model is fitted
SAMPLE_BYTES = 8_000_000  #: of texts of a class in the sample: documents count whole, in the order of the hashes
LANDMARKS, LONGEST = 24, 11  #: landmark strings, and characters of one
MORE = 4.0  #: how many times as often as by chance toxic documents must have a landmark
LEAST = 0.003  #: share of toxic sentences that must have it beyond that
ORDERS = (3, 4)  #: lengths of the subsequences that count
DECAY = 0.6  #: what each character that a subsequence spans is worth
USUAL = 9  #: characters of a string beyond which its length counts against it
WINDOW = 48  #: a longer unit is read in windows of so many characters, each half in the next
GROWN, CLEAN = 0.5, 60.0  #: what copies with a letter put in, and clean units, weigh in the fit beside toxic units
CACHE_BYTES = 48_000_000  #: of units whose scores a Python worker keeps

_SPACED = re.compile(r"(?<!\S)\w[^\w\s]?(?:[^\S\n]\w[^\w\s]?){2,}(?!\S)")
_SIGNS = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words(text: str) -> list[str]:
    """Lower-cased words of a text, repeats and all, and letters that stand apart put together."""
    text = text.lower()
    found = text.split()
    if _SPACED.search(text):
        found += ["".join(re.findall(r"\w", m)) for m in _SPACED.findall(text)]
    return found


def units(word: str) -> list[str]:
    """What the kernel compares: a word without its signs, after ^ and before $, or windows of WINDOW characters that overlap by half."""
    word = f"^{word if word.isalnum() else _SIGNS.sub('', word)}$"
    if len(word) <= WINDOW:
        return [word] if len(word) > 2 else []
    return [word[a : a + WINDOW] for a in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def subsequence_kernel(left: list[str], right: list[str], decay: float = DECAY, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """For each pair of strings the weight of subsequences that both have: decay to the power of what each spans, in both.

    Summed over the orders (lengths of subsequences), scaled so that one without gaps counts 1, and divided by the root of
    how much longer than USUAL each string is. Strings of left are read character by character, many at a time; for every
    place of right the weights of all shorter common subsequences up to it are carried along.
    """
    width = max(map(len, right))
    alphabet = {c: k + 1 for k, c in enumerate(sorted(set("".join(right))))}
    same = np.zeros((len(alphabet) + 1, len(right) * width), np.float32)
    for j, z in enumerate(right):
        for k, c in enumerate(z):
            same[alphabet[c], j * width + k] = 1
    gap = np.arange(width)[None, :] - np.arange(width)[:, None] - 1
    carry = np.where(gap >= 0, decay ** (2.0 + np.maximum(gap, 0)), 0).astype(np.float32)
    out = np.zeros((len(left), len(right)), np.float32)
    by_length = np.argsort([len(s) for s in left], kind="stable")
    step = max(1, 60_000 // same.shape[1])
    for a in range(0, len(left), step):
        at = by_length[a : a + step]
        length = max(len(left[i]) for i in at)
        codes = np.array([[alphabet.get(c, 0) for c in left[i]] + [0] * (length - len(left[i])) for i in at], np.int32).reshape(len(at), length)
        before = [None] + [np.zeros((len(at), same.shape[1]), np.float32) for _ in range(max(orders) - 1)]
        total = np.zeros((len(at), same.shape[1]), np.float32)
        for i in range(length):
            hit = same[codes[:, i]]
            for p in range(max(orders), 0, -1):
                got = hit if p == 1 else hit * before[p - 1]
                if p in orders:
                    total += got * np.float32(decay ** (2 - 2 * p))
                if p < max(orders):
                    before[p] *= np.float32(decay)
                    before[p] += (got.reshape(-1, width) @ carry).reshape(got.shape)
        out[at] = total.reshape(len(at), len(right), width).sum(2)
    size = [np.array([min(1.0, USUAL / max(1, len(s))) ** 0.5 for s in strings], np.float32) for strings in (left, right)]
    return out * size[0][:, None] * size[1]


class Model(NamedTuple):
    landmarks: list[str]
    weights: np.ndarray  # of the kernel with each landmark
    bias: float
    document: np.ndarray  # weights of what _inputs() gives, and a constant: the log-odds of a text


def margins(model: Model, strings: list[str]) -> np.ndarray:
    if not model.landmarks or not strings:
        return np.full(len(strings), model.bias)
    return subsequence_kernel(strings, model.landmarks).astype(np.float64) @ model.weights + model.bias


def _inputs(best: np.ndarray, hits: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Of texts: the greatest margin of their words, and the log of the share of words beyond the boundary."""
    return np.stack([np.minimum(best, 3), np.log((hits + 0.02) / (many + 5)), np.ones_like(best)], 1)


def _hit(margin: np.ndarray) -> np.ndarray:
    """How far a word's margin lies beyond the boundary: 0 from half a margin before it, 1 from half a margin after it."""
    return np.clip(margin + 0.5, 0, 1)


def _pieces(unit: str, sizes: Iterable[int]) -> set[str]:
    return {unit[a : a + n] for n in sizes for a in range(len(unit) - n + 1)}


def choose_landmarks(toxic: Counter, clean: Counter, total: tuple[float, float]) -> list[str]:
    """Pieces of units that toxic documents have and clean ones hardly, one after the other.

    toxic and clean: how much the sentences with each unit weigh; total: what all sentences of a label do. A piece is worth
    what its units weigh in toxic documents, less MORE times as much as clean ones let expect. Each time the best one is
    taken, or the longest around it that is worth nearly as much, and the units that hold it are set aside.
    """
    expect, least = MORE * total[0] / max(total[1], 1e-9), max(3.0, LEAST * total[0])
    worth: Counter = Counter()
    common: set[str] = set()
    for n in range(4, 8):
        level: Counter = Counter()
        for unit, weight in toxic.items():
            for g in _pieces(unit, (n,)):
                if n == 4 or g[:-1] in common:  # a piece isn't more common than its beginning
                    level[g] += weight
        level = Counter({g: w for g, w in level.items() if w >= least})
        common = set(level)
        for unit, weight in clean.items():
            for g in level.keys() & _pieces(unit, (n,)):
                level[g] -= expect * weight
        worth.update({g: w for g, w in level.items() if w >= least})
    holds = {u: p for u in toxic if (p := worth.keys() & _pieces(u, range(4, 8)))}
    longer = {u: _pieces(u, range(8, LONGEST + 1)) for u in holds}
    for part, sign in ((toxic, 1.0), (clean, -expect)):
        for unit, weight in part.items():
            if unit in holds or part is clean and not worth.keys().isdisjoint(_pieces(unit, (4, 5, 6, 7))):
                for g in longer.get(unit) or _pieces(unit, range(8, LONGEST + 1)):
                    worth[g] += sign * weight
    holds = {u: {g for g in p | longer[u] if worth[g] >= least} for u, p in holds.items()}
    chosen: list[str] = []
    while len(chosen) < LANDMARKS:
        best = max((g for g in worth if worth[g] >= least), key=lambda g: (worth[g], g), default=None)
        if best is None:
            break
        best = max((g for g in worth if best in g and worth[g] >= 0.8 * worth[best]), key=lambda g: (len(g), worth[g], g))
        chosen.append(best)
        for unit in [u for u in holds if best in u]:
            for g in holds.pop(unit):
                worth[g] -= toxic[unit]
    return chosen


def _grown(strings: list[str]) -> list[str]:
    """Each with one letter of the others put in, at each place between the second letter and the last but one in turn."""
    letters, out = sorted(set("".join(strings)) - {"^", "$"}), []
    for k, s in enumerate(strings):
        at = 3 + k % max(1, len(s) - 5)
        out.append(s[:at] + letters[(7 * k) % len(letters)] + s[at:])
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the bias) of the squared-hinge machine, by Newton steps over the rows within the margin."""
    x = np.concatenate((x, np.ones((len(x), 1))), 1)
    w, ridge = np.zeros(x.shape[1]), np.diag([penalty] * (x.shape[1] - 1) + [1e-9])
    for _ in range(rounds):
        near = y * (x @ w) < 1
        part = x[near] * weight[near, None]
        new = np.linalg.solve(part.T @ x[near] + ridge, part.T @ y[near])
        if np.allclose(new, w, rtol=1e-6, atol=1e-9):
            break
        w = new
    return w


def fit(texts: list[str], toxic: np.ndarray, prior: float) -> Model:
    """The machine fitted on the sentences of labelled texts, and what its margins say of a whole text.

    All sentences of clean texts are clean. Of a toxic text, one sentence at least is toxic, by one unit at least: that of
    the greatest margin, chosen anew before each of three fits; the landmarks, and copies of these units with one letter put in, are toxic too.
    The kernel with the landmarks, whitened by the kernel among them (Nyström), gives the machine's inputs. In the choice of
    landmarks a sentence counts once however often it is repeated, and a document as ten sentences at most.
    """
    split = [[t for t in _SENTENCE.split(text) if t] for text in texts]
    one: dict[str, str] = {}  # each unit once in memory, however often it comes
    sentences = [[[one.setdefault(u, u) for w in words(t) for u in units(w)] for t in ts] for ts in split]
    weighed, total, met = (Counter(), Counter()), [0.0, 0.0], set()
    for ts, bag, y in zip(split, sentences, toxic, strict=True):
        weight = min(1.0, 10 / max(1, len(ts)))
        for t, s in zip(ts, bag, strict=True):
            if t not in met:
                met.add(t)
                total[1 - y] += weight
                for u in set(s):
                    weighed[1 - y][u] += weight
    landmarks = choose_landmarks(*weighed, tuple(total))
    if not landmarks:
        return Model([], np.zeros(0), 0.0, np.array([0.0, 0.0, prior]))
    among = subsequence_kernel(landmarks, landmarks).astype(np.float64)
    scale = 1 / np.sqrt(np.diag(among))
    values, axes = np.linalg.eigh(among * scale[:, None] * scale)
    white = scale[:, None] * (axes / np.sqrt(np.maximum(values, 1e-3))) @ axes.T
    every = sorted(weighed[0].keys() | weighed[1].keys())
    place = {u: k for k, u in enumerate(every)}
    kernel = subsequence_kernel(every, landmarks).astype(np.float64)
    x = kernel @ white
    rows = [[np.fromiter((place[u] for u in s), int, len(s)) for s in bag if s] for bag in sentences]
    clean = np.unique(np.concatenate([s for bag, y in zip(rows, toxic, strict=True) if not y for s in bag] or [np.zeros(0, int)]))
    margin = (kernel * scale**2).max(1)
    for _ in range(3):
        witness = np.array([max((s[np.argmax(margin[s])] for s in bag), key=lambda k: margin[k]) for bag, y in zip(rows, toxic, strict=True) if y and bag], int)
        grown = _grown([every[k] for k in witness])
        inputs = np.concatenate((x[witness], among @ white, subsequence_kernel(grown, landmarks).astype(np.float64) @ white, x[clean]))
        sizes = len(witness), len(landmarks), len(grown), len(clean)
        weights = [share / max(n, 1) for n, share in zip(sizes, (1, 1, GROWN, CLEAN), strict=True)]
        w = _svm(inputs, np.repeat([1.0, 1.0, 1.0, -1.0], sizes), np.repeat(weights, sizes))
        margin = x @ w[:-1] + w[-1]
    machine = Model(landmarks, white @ w[:-1], float(w[-1]), np.zeros(3))
    del sentences, one, rows, kernel, x
    k = _calibrated(np.concatenate([_inputs(*evidence(machine, texts[a : a + 100])) for a in range(0, len(texts), 100)]), toxic.astype(np.float64))
    _cache.clear()
    k[2] += prior - np.log(max(toxic.sum(), 1) / max((1 - toxic).sum(), 1))
    return machine._replace(document=k)


def _calibrated(inputs: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the logistic curve over inputs, by Newton steps with a slight pull to 0."""
    k, pull = np.zeros(inputs.shape[1]), 1e-1
    for _ in range(30):
        p = 0.5 * (1 + np.tanh(inputs @ k / 2))
        h = inputs.T @ (inputs * (p * (1 - p))[:, None]) + pull * np.eye(len(k))
        k = k + np.linalg.solve(h, inputs.T @ (y - p) - pull * k)
    return k


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model fitted on at most SAMPLE labelled documents of each class and SAMPLE_BYTES of their texts.

    Of a class, documents are taken by hash of their ids, and one whose text would bring the class above the bytes is
    passed over. Labels other than 0 and 1 and null ids are left out; an id with both labels counts as toxic. Of rows that
    repeat an id one is learned from, that of the smallest text hash. If a class has no document, or toxic documents share
    nothing that clean ones lack, the score is the share of toxic labels (a half without any).
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    prior = float(np.log(max(counts.get(1, 0), 0.5) / max(counts.get(0, 0), 0.5)))
    mark = F.pmod(F.xxhash64("id"), F.lit(1 << 32))
    # ids whose hash is small first, so that a task sends a share of the sample and not a sample of its own
    some = [known.where(F.col("toxic") == g).where(mark <= (1 << 32) * 2.0 * SAMPLE / max(counts.get(g, 0), 1)).orderBy(mark, "id").limit(SAMPLE) for g in (0, 1)]
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    held = rows.join(F.broadcast(some[0].union(some[1])), "id").groupBy("id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    held = materialize(held.select("id", "toxic", F.col("t.text").alias("text"), F.octet_length("t.text").alias("bytes"), mark.alias("mark")), "toxicity-sample")
    ids, room = [], {0: SAMPLE_BYTES, 1: SAMPLE_BYTES}
    for r in sorted(held.select("mark", "id", "toxic", "bytes").collect()):
        if r.bytes <= room[r.toxic]:
            room[r.toxic] -= r.bytes
            ids.append(r.id)
    sample = sorted((r.id, r.toxic, r.text) for r in held.where(F.col("id").isin(ids)).select("id", "toxic", "text").collect())
    discard(held)
    toxic = np.array([r[1] for r in sample], int)
    if not 0 < toxic.sum() < len(toxic):
        return Model([], np.zeros(0), 0.0, np.array([0.0, 0.0, prior if counts else 0.0]))
    return fit([r[2] for r in sample], toxic, prior)


_cache: dict[tuple, dict[str, float]] = {}
_held = [0]


def evidence(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: the greatest margin among its words' units, how many words lie beyond the boundary, and how many there are.

    Margins of words met before are kept, up to CACHE_BYTES.
    """
    key = (*model.landmarks, model.weights.tobytes(), model.bias)
    if key not in _cache or _held[0] > CACHE_BYTES:
        _cache.clear()
        _cache[key], _held[0] = {}, 0
    seen = _cache[key]
    bags = [words(t) for t in texts]
    new = {w: units(w) for w in set().union(*bags) - seen.keys()}
    strings = list({u for us in new.values() for u in us})
    margin = dict(zip(strings, margins(model, strings).tolist(), strict=True))
    _held[0] += sum(map(len, new)) + 150 * len(new)
    seen.update((w, max(map(margin.__getitem__, us), default=model.bias)) for w, us in new.items())
    got = [np.fromiter(map(seen.__getitem__, bag), np.float64, len(bag)) for bag in bags]
    return np.array([max(g.max(initial=model.bias), model.bias) for g in got]), np.array([_hit(g).sum() for g in got]), np.array([float(len(g)) for g in got])


def _texts(column: pa.Array) -> Iterator[list[str]]:
    for _, data, offsets in text_chunks(column):
        data = data.tobytes()
        yield [data[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def score(model: Model, text: Column) -> Column:
    """Probability that a text is toxic, from all its words; null and empty texts have none."""
    def run(column: pa.Array) -> pa.Array:
        out = [_inputs(*evidence(model, texts)) @ model.document for texts in _texts(column)]
        return pa.array(0.5 * (1 + np.tanh(np.concatenate(out) / 2)) if out else [], pa.float64())

    return F.arrow_udf(run, DoubleType())(text.cast("string"))
