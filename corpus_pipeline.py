"""From raw documents to packed training sequences, stage by stage; each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakelode.llm import minhash, mixing, packing, quality
from quakelode.llm.queries import quality_held_out
from quakelode.llm.shared import fresh, materialize
from quakelode.shipping import shipped


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-level field, fitted on labelled ones among them, takes for good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality_held_out())
    field = quality.train(docs, labels)
    (score,) = fresh(docs.columns, "score")
    return docs.withColumn(score, quality.score(field, F.col("text"))).where(F.col(score) >= 0.5).drop(score)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: sets of five-word shingles with a Jaccard similarity of 0.8 or more."""
    return minhash.deduplicated(docs, shingle_words=5, percent=80)


def weighted_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix by source weights takes it: not at all, once or twice."""
    return mixing.mixed(docs, weights=(3, 1, 2), share=1.5, most=2)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all pieces, with their places in sequences of 2048."""
    return packing.pack(docs, capacity=2048, end_id=0)


STAGES = [(name, shipped(f)) for name, f in (("quality", good_documents), ("near_dedup", one_of_each), ("mixing", weighted_mix), ("packing", packed))]

#: SQL cannot express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
