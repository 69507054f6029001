"""Drawing documents like a target: importance weights by hashed words, and an exact draw of the highest noisy scores."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakelode.llm.shared import discard, fresh, materialize, ordered, running_total, text_chunks

#: Pivots of a round of the selection; a round leaves about this part of the candidates.
PIVOTS = 48
RESULTS = ("n_features", "weight", "score", "rank")

_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_buckets(text: bytes, buckets: int) -> np.ndarray:
    """The bucket of each word [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text whose A-Z are lower-cased, repeats and all."""
    words = text.translate(_WORD).split()
    return np.fromiter(map(crc32, words), np.int64, len(words)) % buckets


def _runs(texts: pa.Array) -> Iterator[list[bytes]]:
    for _, data, offsets in text_chunks(texts):
        data = data.tobytes()
        yield [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def bucket_counts(documents: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """Words of all texts in each bucket: a task sums its rows in an array, of which the buckets it met go on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for run in _runs(batch.column(0)):
                sums += np.bincount(np.concatenate([word_buckets(t, buckets) for t in run]), minlength=buckets)
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(sums[met])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    rows = documents.select(F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    for r in rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Of each bucket, how much likelier its words are in the target: 1000 natural logs, each count plus one, rounded down."""
    all_source, all_target = float(source.sum()) + len(source), float(target.sum()) + len(target)
    ratios = ((float(t) + 1) * all_source / ((float(s) + 1) * all_target) for t, s in zip(target, source, strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def _weights(gain: np.ndarray, text: Column) -> Column:
    """(n, weight) of a text: how many words it has, and the sum of their buckets' gains."""

    def run(texts: pa.Array) -> pa.Array:
        many, total = [], []
        for some in _runs(texts):
            for t in some:
                at = word_buckets(t, len(gain))
                many.append(len(at))
                total.append(int(gain[at].sum()))
        return pa.StructArray.from_arrays([pa.array(many, pa.int64()), pa.array(total, pa.int64())], ["n", "weight"])

    return F.arrow_udf(run, "struct<n: bigint, weight: bigint>")(text.cast("string"))


def _noise(id_: Column, seed: int) -> Column:
    """1000 times a Gumbel variate that the id decides, rounded down; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _scored(documents: DataFrame, gain: np.ndarray, names: list[str], id_col: str, text_col: str, seed: int) -> DataFrame:
    """documents and, under names: words, weight, score, and what orders rows of equal score (no id, id, a hash of the text)."""
    n, weight, score, no_id, id_, tie = names
    (both,) = fresh([*documents.columns, *names], "both")
    rows = documents.withColumn(both, _weights(gain, F.col(f"`{text_col}`")))
    rows = rows.withColumns({n: F.col(both)["n"], weight: F.col(both)["weight"], no_id: F.col(f"`{id_col}`").isNull(), id_: F.col(f"`{id_col}`"), tie: F.xxhash64(f"`{text_col}`")})
    return rows.withColumn(score, F.col(weight) + _noise(F.col(id_), seed)).drop(both)


def _place(names: list[str]) -> Column:
    """The struct by which rows are ordered, best first."""
    _, _, score, *rest = names
    return F.struct((-F.col(score)).alias("p0"), *(F.col(c).alias(f"p{k}") for k, c in enumerate(rest, 1)))


def _fixed(rows: DataFrame, names: list[str], values: tuple) -> Column:
    """A place as a constant."""
    types = dict(rows.dtypes)
    return F.struct(*(F.lit(v).cast(types[c]).alias(f"p{k}") for k, (c, v) in enumerate(zip(names[2:], values, strict=True))))


def kth_place(rows: DataFrame, names: list[str], k: int, seed: int = 0) -> tuple | None:
    """The place of the k-th row (from 1) in the order of _place(); None for k = 0. rows: a written table of k rows or more.

    Each round draws pivots from the candidates at random and counts exactly how many lie before, at and after each.
    That tells the pivot at which the k-th row lies, or leaves the rows between two pivots, which are written as the
    next round's candidates. Any number of rows may share a place.
    """
    place, candidates, draw = _place(names), rows, random.Random(seed)
    while k:
        drawn = candidates.select(place.alias("p")).orderBy(F.xxhash64(F.lit(draw.getrandbits(60)), "p")).limit(PIVOTS)
        pivots = [tuple(p) for p in drawn.agg(F.sort_array(F.collect_set("p"))).first()[0]]
        fixed = F.array(*(_fixed(rows, names, p) for p in pivots))
        before, at = F.size(F.filter(fixed, lambda p: p < place)), F.array_contains(fixed, place)
        for i, on, n in sorted(tuple(r) for r in candidates.groupBy(before.alias("i"), at.alias("on")).count().collect()):
            if k <= n:
                break
            k -= n
        used = candidates
        candidates = candidates if on else materialize(candidates.where((before == i) & (at == F.lit(on))), "resampling-candidates")
        if used is not rows:
            discard(used)
        if on:
            return pivots[i]
    return None


def _draw(documents: DataFrame, target: DataFrame, names: list[str], id_col: str, text_col: str, target_col: str, buckets: int, least_words: int, percent: int, seed: int) -> tuple[np.ndarray, DataFrame, tuple | None, int]:
    """(gains, every document's id and columns names in the shared folder, the last place drawn, how many are drawn)."""
    gain = gains(bucket_counts(target, target_col, buckets), bucket_counts(documents, text_col, buckets))
    slim = materialize(_scored(documents.select(f"`{id_col}`", f"`{text_col}`"), gain, names, id_col, text_col, seed).select(*names), "resampling-scores")
    able = F.col(names[0]) >= least_words
    size = percent * slim.where(able).count() // 100
    written = slim if least_words <= 0 else slim.where(able)
    return gain, slim, kth_place(written, names, size), size


def _ranked(rows: DataFrame, names: list[str], rank: str, size: int) -> DataFrame:
    """rows, which are those up to the last place drawn, with their rank; of rows that share the last place, as many as belong to the draw."""
    part, nth, one, all_, row = fresh([*rows.columns, rank], "part", "nth", "one", "all", "row")
    # equal rows are told apart by where they stand, so that ranges of the order part them too
    rows = ordered(rows.withColumn(row, F.monotonically_increasing_id()), [_place(names), F.col(row)], part, nth, "resampling-winners")
    rows = rows.withColumns({one: F.lit(1).cast("long"), all_: F.lit(0)})
    out = running_total(rows, [all_], F.col(part), [F.col(nth)], one, rank).withColumn(rank, F.col(rank) + 1)
    return out.withColumn(rank, F.when(F.col(rank) <= size, F.col(rank))).drop(part, nth, one, all_, row)


def resample(documents: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of documents: how it fares in a draw of ``percent`` that favours texts like the target's.

    Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of lower-cased texts are counted in hashed buckets, over all documents and all
    target texts; weight sums a text's gains (see gains()), score adds noise that the id and the seed decide, and of the
    N rows with at least ``least_words`` the floor(percent * N / 100) of highest score are drawn: ranks 1, 2, 3 ..., ties
    to smaller ids, then ids before none, then by a hash of the text. Other rows have rank null. Null and empty texts have
    no words and weight 0; a null id draws its noise as an empty one. Repeated rows each count; of equal ones at the end
    of the draw, as many as belong to it. No documents give no rows; without target texts every word's gain is small or
    negative, and the draw goes on. Other columns don't matter.

    Texts are read twice and never moved. The selection counts over the written scores; only drawn rows are sorted.
    """
    names = fresh([id_col], *RESULTS[:3], "no_id", "id_", "tie")
    _, slim, last, size = _draw(documents, target, names, id_col, text_col, target_col, buckets, least_words, percent, seed)
    (rank,) = fresh([id_col, *names], "rank")
    inside = F.lit(False) if last is None else (F.col(names[0]) >= least_words) & (_place(names) <= _fixed(slim, names, last))
    out = slim.where(~inside).withColumn(rank, F.lit(None).cast("long"))
    if last is not None:
        out = out.unionByName(_ranked(slim.where(inside), names, rank, size))
    return out.select(F.col(names[4]).alias(id_col), *(F.col(a).alias(b) for a, b in zip((*names[:3], rank), RESULTS, strict=True)))


def drawn(documents: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """The rows of documents that resample() draws, with all their columns, and n_features, weight, score and rank (which
    take the place of columns so named). The place of the last one decides, so texts are scored again and not joined."""
    documents = documents.drop(*(c for c in documents.columns if c.lower() in RESULTS and c not in (id_col, text_col)))
    names = fresh(documents.columns, *RESULTS[:3], "no_id", "id_", "tie")
    gain, slim, last, size = _draw(documents, target, names, id_col, text_col, target_col, buckets, least_words, percent, seed)
    (rank,) = fresh([*documents.columns, *names], "rank")
    rows = _scored(documents, gain, names, id_col, text_col, seed)
    inside = F.lit(False) if last is None else (F.col(names[0]) >= least_words) & (_place(names) <= _fixed(slim, names, last))
    return _ranked(rows.where(inside), names, rank, size).where(F.col(rank).isNotNull()).drop(*names[3:])
