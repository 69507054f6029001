import collections

import corpus_pipeline
from pyspark.sql import functions as F

from quakelode.llm import minhash, mixing, quality
from quakelode.llm.queries import quality_held_out


def test_stages_follow_each_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        seen[name] = (before, docs)
    before, after = seen["quality"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    field = quality.train(before, labels.where(~quality_held_out()))
    good = {r.doc_id for r in before.where(quality.score(field, F.col("text")) >= 0.5).select("doc_id").collect()}
    assert {r.doc_id for r in after.select("doc_id").collect()} == good
    marked = {r.doc_id: r.quality for r in labels.collect()}
    wrong = [i for i in marked if (i in good) != (marked[i] == 1)]
    assert len(wrong) <= 0.02 * len(marked)
    before, after = seen["near_dedup"]
    groups = minhash.near_duplicates(before, shingle_words=5).collect()
    assert sorted(r.doc_id for r in after.select("doc_id").collect()) == sorted({r.component_id for r in groups})
    before, after = seen["mixing"]
    taken = {r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies}
    assert collections.Counter(r.doc_id for r in after.select("doc_id").collect()) == taken
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048
    assert collections.Counter(packed[packed["piece"] == 0]["doc_id"]) == taken


def test_stages_of_odd_documents(spark, sf, tmp_path):
    """Nulls, empty and repeated rows, clashing names and empty tables go through all stages."""
    from pyspark.sql import functions as F

    text = "the house by the river was built of stone and wood in a year of good harvests."
    rows = [(1, text), (2, text), (3, None), (4, ""), (None, text + " It stands."), (None, None), (5, "word " * 9000 + "end."), (6, "\n".join([text] * 3))]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for (i, t), s in zip(rows, ["a", "a", None, "b", "b", None, "c", "a"])], "doc_id long, text string, lang string, source string, n_chars long")
    names = ["size", "source_size", "target", "copies", "taken", "copy", "score", "id", "kept", "mark", "block", "n", "salt", "task", "length"]
    wide = docs.withColumns({c: F.lit("7") for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for df in (docs, wide, docs.limit(0), wide.limit(0)):
            out = stage(spark, df, sf)
            assert out.columns == df.columns and (df.isEmpty() or name != "near_dedup" or out.where("doc_id in (1, 2)").count() == 1)
            out.collect()
    packed = corpus_pipeline.STAGES[-1][1](spark, wide, sf)
    assert packed.where("piece = 0").count() == len(rows) and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0
