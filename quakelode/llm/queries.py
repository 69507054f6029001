"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakelode.llm import audit, cosine, lattice, lengths, licenses, minhash, mixing, neighbours, oracles, packing, quality, resampling, sharding, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), shingle_words=4, percent=80)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.context_totals(lengths.length_histogram(_documents(spark, sf_dir)))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine.near_duplicate_vectors(_embeddings(spark, sf_dir), least=0.95)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_documents(spark, sf_dir), capacity=2048, end_id=0)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir)).drop("blocks")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(_documents(spark, sf_dir), shards=16)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return dealt.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    scored = lattice.likelihoods(_documents(spark, sf_dir).withColumn("learn", F.coalesce(~held_out, F.lit(True))), "learn", rounds=1)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _embeddings(spark, sf_dir)
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(_documents(spark, sf_dir), weights=(3, 1, 2), share=1.5, most=2)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = quality.train(documents, labels.where(~quality_held_out()))
    scored = documents.select("doc_id", F.coalesce(quality_held_out(), F.lit(False)).alias("held_out"), quality.score(field, F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def quality_held_out() -> Column:
    """Rows from whose labels the quality classifier doesn't learn."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resampling.resample(_documents(spark, sf_dir), target, buckets=10_000, least_words=20, percent=10, seed=2024)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.train(documents, labels.where(~held_out))
    scored = documents.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), toxicity.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


#: One query for each operator.
QUERIES = (
    op1_minhash_near_dedup,
    op2_token_counts,
    op3_embedding_near_dedup,
    op4_best_fit_packing,
    op5_license_scan,
    op6_sharding,
    op7_lm_scoring,
    op8_nearest_neighbours,
    op9_source_mixing,
    op10_quality_classifier,
    op11_target_resampling,
    op12_filter_audit,
    op13_toxicity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": oracles.MINHASH, "op3_embedding_near_dedup": oracles.COSINE, "op5_license_scan": oracles.LICENSES, "op11_target_resampling": oracles.RESAMPLING, "op12_filter_audit": oracles.AUDIT}
