"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakelode.llm.shared import fresh, plain_columns, running_total

#: Source parts at least, and rows of a part beyond that; the matrix of parts and shards has CELLS fields at most (32 MB).
PARTS, PART_ROWS, CELLS = 256, 1_000_000, 1 << 22
#: Blocks of a part or shard that are permuted by themselves: at least so many, and rows of a block beyond that.
BLOCKS, BLOCK_ROWS = 64, 50_000


def communication_matrix(counts: dict[int, int], sizes: list[int], seed: int) -> np.ndarray:
    """How many rows of each part (rows) go to each shard (columns): one draw of a uniform shuffle's counts.

    Row by row: a part's counts are multivariate hypergeometric in what the shards have left.
    """
    draw, left, out = np.random.default_rng(seed), [int(s) for s in sizes], np.zeros((len(counts), len(sizes)), np.int64)
    for k, part in enumerate(sorted(counts)):
        want, pool = counts[part], sum(left)
        for s in range(len(sizes)):
            pool -= left[s]
            got = hypergeometric(draw.random(), left[s], pool, want)
            out[k, s] = got
            left[s] -= got
            want -= got
    return out


def hypergeometric(u: float, good: int, bad: int, n: int) -> int:
    """How many of n drawn are good, at the quantile u, for populations of any size.

    Weights go out from the mode by the law's own ratios of neighbours, twelve deviations and sixty values to each side;
    what lies beyond is less than a double can add to their sum.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    all_ = good + bad
    mode = min(high, max(low, (n + 1) * (good + 1) // (all_ + 2)))
    reach = 60 + int(12 * math.sqrt(n * (good / all_) * (bad / all_) * ((all_ - n) / max(1, all_ - 1))))
    x = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    rise = np.log((good - x[:-1]) * (n - x[:-1])) - np.log((x[:-1] + 1) * (bad - n + x[:-1] + 1))
    level = np.concatenate(([0.0], np.cumsum(rise)))
    sums = np.cumsum(np.exp(level - level.max()))
    return int(x[min(len(x) - 1, int(np.searchsorted(sums, u * sums[-1], "right")))])


def shard(documents: DataFrame, shards: int = 16, id_col: str = "doc_id", seed: int = 11) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (gapless from 0 within a shard) to all rows of documents.

    Law ``rows``: shard sizes differ by one at most, and each arrangement is as likely as any other for a random seed.
    Rows are dealt into parts by a hash of all columns, permuted there, sent to shards by the drawn counts, and permuted
    again. Null ids and null or empty columns are hashed like others; equal rows are spread by their place among each
    other, which cannot be told apart in the result; no rows give none. Columns of the input named shard or slot are
    replaced. Both permutations order blocks by hash first, so no part or shard is sorted in one task, and a rerun of
    any task deals its rows alike. Parts and blocks become more with the rows, so that a task's sort doesn't grow.
    """
    src = documents.drop("shard", "slot")
    total = src.count()
    parts = max(PARTS, min(total // PART_ROWS, CELLS // shards))
    mark, part, one, rank, again, deal = fresh([*src.columns, "shard", "slot"], "mark", "part", "one", "rank", "again", "deal")
    plain = plain_columns(src)
    rows = src.withColumn(mark, F.xxhash64(F.lit(seed), *plain)).withColumn(part, F.pmod(mark, F.lit(parts))).withColumn(one, F.lit(1).cast("long"))
    counts = {r[0]: r[1] for r in rows.groupBy(part).agg(F.count("*")).collect()}
    total = sum(counts.values())
    sizes = [total // shards + (k < total % shards) for k in range(shards)]
    ends = communication_matrix(counts, sizes, seed).cumsum(1)
    table = documents.sparkSession.createDataFrame([(int(p), e.tolist()) for p, e in zip(sorted(counts), ends, strict=True)], f"`{part}` long, `{deal}` array<long>")
    in_part, in_shard = (max(BLOCKS, total // many // BLOCK_ROWS) for many in (parts, shards))

    order: list[Column] = [F.xxhash64(mark, F.lit(2)), F.col(mark), *plain]
    local = running_total(rows, [part], F.pmod(F.xxhash64(mark, F.lit(1)), F.lit(in_part)), order, one, rank)
    sent = local.join(F.broadcast(table), part)
    sent = sent.withColumn("shard", F.size(F.filter(deal, lambda e: e <= F.col(rank)))).withColumn(again, F.xxhash64(mark, rank, F.lit(5)))
    # equal rows part here: their ranks differ, and with them the second order
    done = running_total(sent, ["shard"], F.pmod(again, F.lit(in_shard)), [F.xxhash64(again, F.lit(7)), F.col(again), F.col(part), F.col(rank)], one, "slot")
    return done.select(*(F.col(f"`{c}`") for c in src.columns), "shard", "slot")
