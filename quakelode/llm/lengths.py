"""Token counts from one exact histogram of encoded lengths."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakelode.llm.encode import encoded, grouped
from quakelode.llm.shared import materialize, running_total

#: Lengths whose sums are taken together before the blocks are added up.
BLOCK = 1024


def length_histogram(documents: DataFrame, text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """(tokens, documents): how many texts have each encoded length, without special tokens.

    Null, empty and blank texts have 0 tokens and are counted; repeated rows count as often as they come; no rows give
    no lengths. A task sends one row for each length it met, whatever the number of its texts; the histogram is written
    to the shared folder, so that texts are encoded once, however many answers are taken from it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for batch in batches:
            for _, texts in grouped(batch.column(0)):
                seen.update(len(ids) // 4 for ids in encoded(texts, tokenizer_path))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["tokens", "documents"])

    part = documents.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "tokens long, documents long")
    return materialize(part.groupBy("tokens").agg(F.sum("documents").alias("documents")), "lengths-histogram")


def context_totals(histogram: DataFrame) -> DataFrame:
    """Answers for every context limit that is the length of some text, from suffix sums over the histogram.

    For limit ``tokens``: documents (of exactly that length), documents_at_least and tokens_at_least (suffix sums),
    total_tokens, truncated_tokens (what is left if every text is cut at the limit), truncated_documents (longer ones),
    and quantile (share of documents of at most that length).
    """
    rows = histogram.withColumn("held", F.col("tokens") * F.col("documents"))
    down, order = -F.floor(F.col("tokens") / BLOCK), [F.col("tokens").desc()]
    keyed = rows.withColumn("all", F.lit(0))
    longer = running_total(keyed, ["all"], down, order, "documents", "longer")
    longer = running_total(longer, ["all"], down, order, "held", "longer_held").drop("all")
    sums = histogram.agg(F.sum("documents").alias("n"), F.sum(F.col("tokens") * F.col("documents")).alias("t"))
    return longer.crossJoin(F.broadcast(sums)).select(
        "tokens", "documents", (F.col("longer") + F.col("documents")).alias("documents_at_least"), (F.col("longer_held") + F.col("held")).alias("tokens_at_least"), F.col("t").alias("total_tokens"), (F.col("t") - F.col("longer_held") + F.col("longer") * F.col("tokens")).alias("truncated_tokens"), F.col("longer").alias("truncated_documents"), (1 - F.col("longer") / F.col("n")).alias("quantile")
    )


def at_limit(totals: DataFrame, limit: int) -> DataFrame:
    """One row for any limit, present as a length or not: total_tokens, truncated_tokens, truncated_documents."""
    above: Column = F.col("tokens") > limit
    held = F.sum(F.col("tokens") * F.col("documents"))
    return totals.agg(F.coalesce(held, F.lit(0)).alias("total_tokens"), F.coalesce(F.sum(F.least("tokens", F.lit(limit)) * F.col("documents")), F.lit(0)).alias("truncated_tokens"), F.coalesce(F.sum(F.when(above, F.col("documents")).otherwise(0)), F.lit(0)).alias("truncated_documents"))


def length_quantile(totals: DataFrame, share: float) -> DataFrame:
    """One row: the smallest length that at least ``share`` of the documents do not exceed; null without documents."""
    return totals.where(F.col("quantile") >= share).agg(F.min("tokens").alias("tokens"))
