"""The registered queries that SQL can't express, on the given tables, against plain versions."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakelode.llm import lattice, mixing, queries, sharding


def words(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_sharding(spark, sf, docs):
    got = queries.op6_sharding(spark, sf).toPandas()
    assert sorted(got["doc_id"]) == sorted(docs) and set(got["law"]) == {"rows"} and got["grown_shard"].isna().all()
    for r in got.itertuples():
        text = (docs[r.doc_id].text or "").encode()
        assert r.size == len(text) + 1 and r.text_crc32 == zlib.crc32(text)
    counts = got.groupby("shard")["slot"].agg(["count", "nunique", "max"])
    assert len(counts) == 16 and np.ptp(counts["count"]) <= 1 and (counts["nunique"] == counts["count"]).all() and (counts["max"] == counts["count"] - 1).all()
    assert abs(np.corrcoef(got["doc_id"], got["shard"])[0, 1]) < 0.3


def test_hypergeometric_draws():
    for good, bad, n in ((5, 7, 4), (3, 100, 50), (40, 2, 41), (0, 5, 3), (6, 0, 2), (500, 500, 30)):
        share = np.cumsum([math.comb(good, x) * math.comb(bad, n - x) / math.comb(good + bad, n) for x in range(n + 1)])
        for u in np.linspace(0.001, 0.999, 57):
            assert sharding.hypergeometric(u, good, bad, n) == np.searchsorted(share, u, "right")
    draw = np.random.default_rng(0)
    good, bad, n = 3 * 10**11, 7 * 10**11, 10**10
    x = np.array([sharding.hypergeometric(draw.random(), good, bad, n) for _ in range(400)])
    spread = math.sqrt(n * 0.3 * 0.7 * (1 - n / 10**12))
    assert abs((x - 0.3 * n).mean()) < 4 * spread / 20 and 0.85 < x.std() / spread < 1.15


def test_document_likelihood(spark, sf, docs):
    """Sums over words, by the vocabulary's own scores and after one round of estimation from the rows to learn from."""
    learn = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    train = collections.Counter(w.decode() for i, r in docs.items() if learn(i) for w in words(r.text))
    ends = sum(map(learn, docs))
    own = lattice._pieces(None).first_scores()
    counts = np.append(lattice.expected_pieces(list(train), np.array([*map(float, train.values())]), own), ends)
    prior = np.exp(own)
    prior[-2] *= 256
    counts += prior * max(1.0, 1e-3 * counts.sum())
    new = np.log(counts / counts.sum())
    new[-2] -= math.log(256)
    rows = spark.read.parquet(f"{sf}/documents.parquet").withColumn("learn", F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
    for scores, got in ((own, lattice.likelihoods(rows, "learn")), (new, queries.op7_lm_scoring(spark, sf))):
        each = {}
        got = got.toPandas()
        vocabulary = sorted({w.decode() for i in got["doc_id"] for w in words(docs[i].text)})
        each = dict(zip(vocabulary, lattice.word_scores(vocabulary, scores)))
        for r in got.itertuples():
            want = (sum(each[w.decode()] for w in words(docs[r.doc_id].text)) + scores[-1]) / math.log(10)
            assert r.score == pytest.approx(want, rel=1e-9) and r.n_tokens == len(words(docs[r.doc_id].text)) + 1
    assert (got["held_out"] == [not learn(i) for i in got["doc_id"]]).all() and set(got["train_tokens"]) == {sum(train.values()) + ends}


def queue(rows, weights=(3, 1, 2), share=1.5, most=2):
    """Copies of rows (id, source, size, order) that the queue takes, one finish time after the other."""
    names = sorted({r[1] for r in rows if r[1] is not None}) + [None] * any(r[1] is None for r in rows)
    held = {s: sum(r[2] for r in rows if r[1] == s) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, live = {}, list(names)
    while live:
        rest, w = share * sum(held.values()) - sum(target.values()), sum(weight[s] for s in live)
        over = [s for s in live if rest * weight[s] / w > most * held[s]]
        target |= {s: most * held[s] for s in over} if over else {s: rest * weight[s] / w for s in live}
        live = [s for s in live if s not in target]
    copies = []
    for k, s in enumerate(names):
        before = 0
        for r in sorted((r for r in rows if r[1] == s), key=lambda r: r[3]):
            copies += [((before + r[2] + e * held[s]) / target[s], k, before, e, r) for e in range(most) if r[2]]
            before += r[2]
    taken, used = collections.Counter(), 0
    for *_, r in sorted(copies, key=lambda c: c[:4]):
        used += r[2]
        if used > sum(target.values()):
            break
        taken[r[0]] += r[2]
    return taken, target


@pytest.mark.parametrize("last", [3, 10_000])
def test_mixing_is_the_queue(spark, sf, monkeypatch, last):
    monkeypatch.setattr(mixing, "LAST_COPIES", last)
    d = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 9 != 0, F.col("source")))
    tie = F.xxhash64("text")
    mark = F.xxhash64(F.lit(17), "doc_id", tie)
    rows = [(r.doc_id, r.source, len(words(r.text)), (r.block, r.mark, r.tie, len(words(r.text)))) for r in d.select("doc_id", "source", "text", F.pmod(mark, F.lit(mixing.BLOCKS)).alias("block"), mark.alias("mark"), tie.alias("tie")).collect()]
    taken, target = queue(rows)
    for r in mixing.mix(d).select("doc_id", "source", "target", "taken").collect():
        assert r.taken == taken[r.doc_id] and r.target == pytest.approx(target[r.source])
    again = queries.op9_source_mixing(spark, sf).toPandas()
    assert again.columns.tolist() == ["doc_id", "size", "source_size", "target", "taken"] and (again["taken"] <= 2 * again["size"]).all()


def test_mixing_of_equal_rows(spark):
    """Sources of rows that are equal in all columns, and very many sources held at their cap."""
    rows = [(1, "one two three", "a")] * 40 + [(2, "four five", "b")] * 30 + [(3, "six", None)] * 25
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, part in got.fillna({"source": "-"}).groupby("source"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= part["size"].max()
    assert len(got) == 95 and got["taken"].sum() <= 1.5 * got["size"].sum()
    many = [(k, "word " * (1 + k % 3), f"s{k % 400:03d}") for k in range(1200)]
    got = mixing.mix(spark.createDataFrame(many, "doc_id long, text string, source string"), weights=(1000, 1, 1)).toPandas()
    sums = got.groupby("source").agg({"taken": "sum", "target": "first", "size": "max"})
    assert ((sums["taken"] - sums["target"]).abs() <= sums["size"] + 1e-6).all()


def test_quality(spark, sf, docs, monkeypatch):
    got = queries.op10_quality_classifier(spark, sf).toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(docs) and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.index]).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("y")).toPandas().set_index("doc_id")
    both = got.join(labels, how="inner")
    rank, good = both[both["held_out"]]["score"].rank(), both[both["held_out"]]["y"] == 1
    assert (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum()) > 0.95


def test_recall_of_neighbours(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(v["embedding"].to_numpy()).astype(float), v["vec_id"].to_numpy()
    got = queries.op8_nearest_neighbours(spark, sf).toPandas()
    found = wanted = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        best = [i for _, i in sorted(zip(d[ids != q], ids[ids != q]))[:10]]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, len(best) + 1)) and mine["score"].is_monotonic_increasing
        assert np.allclose(mine["score"], [d[ids == i][0] for i in mine["vec_id"]], rtol=0, atol=1e-12)
        found, wanted = found + len({*best} & {*mine["vec_id"]}), wanted + len(best)
    assert found >= 0.9 * wanted > 0
