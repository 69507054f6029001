"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakelode.llm.shared import discard, materialize


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _sum(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component): the smallest id that each linked id reaches. edges: two long columns; nulls and self-links fall away.

    Each round rewires links to the smallest known neighbour and is written to the shared folder; only a row count and
    a checksum come to the driver. Minima are pre-aggregated before the shuffle, so a node with very many links is no
    hot group; ids without links are not returned. No link at all gives an empty result.
    """
    u, v = edges.columns
    now = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct()
    now = materialize(_small(now), "components")
    seen = _sum(now)
    for _ in range(rounds):
        after = materialize(_small(_large(now)), "components")
        discard(now)
        now, before, seen = after, seen, _sum(after)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ids = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.union(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
