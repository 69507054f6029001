"""Resampling, the audit of filters and toxicity: odd input, and plain versions beside them."""

import collections
import hashlib
import itertools
import math
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakelode.llm import audit, queries, resampling, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def corpus(n=120):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 4))) for _ in range(60)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 400))), "en", rnd.choice(["a", "b", None]), 1) for i in range(n)]
    rows += [(1000 + k, t, None, None, None) for k, t in enumerate([None, "", " \n\t", "LOUD TEXT HERE $", "日本語 テスト", "x" * 90_000, "long " * 30_000, "a|b"])]
    rows += [(2000 + k, "the same text " * 30, "en", "hot", 1) for k in range(60)]
    return rows + [rows[3], rows[3], rows[5], (None, "no id at all " * 20, "en", "a", 1), (None, None, None, None, None), (None, "no id at all " * 20, "en", "b", 1)]


def buckets(text):
    return [zlib.crc32(w.encode()) % 50 for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))]


@pytest.mark.parametrize("pivots", [2, 48])
def test_draw_equals_plain_version(spark, monkeypatch, pivots):
    monkeypatch.setattr(resampling, "PIVOTS", pivots)
    rows, target = corpus(), [(0, "aa bé ab"), (1, None), (2, "日本語 the same")]
    documents = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("own")).withColumn("Rank", F.lit(7))
    got = resampling.resample(documents, spark.createDataFrame(target, "item_id long, text string"), buckets=50, least_words=3, percent=30).collect()
    s, t = collections.Counter(b for r in rows for b in buckets(r[1])), collections.Counter(b for r in target for b in buckets(r[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 50) / ((s[b] + 1) * (T + 50)))) for b in range(50)}
    want = []
    for i, text, *_ in rows:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets(text))
        want.append((i, len(buckets(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    assert sorted(map(repr, (tuple(r)[:4] for r in got))) == sorted(map(repr, want))
    able = sorted((-score, i is None, i or 0) for i, n, _, score in want if n >= 3)
    size = 30 * len(able) // 100
    assert [(-r.score, r.doc_id is None, r.doc_id or 0) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == able[:size]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, size + 1))
    texts = resampling.drawn(documents, spark.createDataFrame(target, "item_id long, text string"), buckets=50, least_words=3, percent=30)
    assert set(texts.columns) == {"doc_id", "text", "lang", "source", "n_chars", "n_features", "weight", "score", "rank"}
    assert sorted((r["rank"], r.score) for r in texts.collect()) == sorted((r["rank"], r.score) for r in got if r["rank"])


def test_draw_of_nothing_and_of_equal_rows(spark):
    target = spark.createDataFrame([(0, "a b")], "item_id long, text string")
    nothing = spark.createDataFrame([], DOCS)
    assert resampling.resample(nothing, target).count() == 0 and resampling.drawn(nothing, target).count() == 0
    few = spark.createDataFrame([(i, "a b c", None, None, None) for i in range(9)], DOCS)
    assert [r["rank"] for r in resampling.resample(few, target, least_words=3).collect()] == [None] * 9  # a tenth of nine is none
    assert resampling.drawn(few, target, least_words=3).count() == 0
    same = spark.createDataFrame([(7, "a b c", None, None, None)] * 40, DOCS)
    ranks = [r["rank"] for r in resampling.resample(same, target.limit(0), least_words=3).collect()]
    assert sorted(r for r in ranks if r) == [1, 2, 3, 4] and len(ranks) == 40


def plain_audit(rows, labels):
    smallest = {}
    for i, text, *_ in rows:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    good, toxic = ({r[0] for r in labels if r[k] == 1 and r[0] is not None} for k in (1, 2))
    docs = []
    for i, text, _, source, _ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum(c in string.ascii_uppercase for c in text) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > smallest[text]}
        docs.append((source or "", {c for c in fails if fails[c]}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine, shapley, per = [d for d in docs if d[0] == part], collections.Counter(), {}
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = list(mine)
            for step, c in enumerate(order, 1):
                gone = [d for d in alive if c in d[1]]
                redundant = sum(c in d[1] for d in mine) - len(gone)
                alive = [d for d in alive if c not in d[1]]
                shapley[c] += len(gone)
                per[order, step] = (len(alive), len(gone), redundant, sum(d[1] == {c} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone))
        out.update({(part, o, s): (*v, shapley[o[s - 1]]) for (o, s), v in per.items()})
    return out


def test_audit_equals_plain_version(spark):
    rows = corpus()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 100, 2)] + [(2005, 1, 1), (2005, 0, None), (None, 1, 1), (99999, 1, 1), (1003, None, None)]
    documents = spark.createDataFrame(rows, DOCS).withColumns({"mask": F.lit(1), "key": F.lit("k"), "part": F.lit("p"), "n": F.lit(3)})
    got = {tuple(r)[:3]: tuple(r)[3:] for r in audit.interactions(documents, spark.createDataFrame(labels, LABELS)).collect()}
    assert got == plain_audit(rows, labels)
    assert audit.interactions(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)).count() == 0
    assert audit.interactions(documents, spark.createDataFrame([], LABELS)).agg(F.sum("good_lost"), F.max("toxic_lost")).first() == (0, 0)


def test_packed_sums_do_not_overflow():
    every, lost = audit.packed_outcomes("ABCDE")
    many = 2**62
    total = audit.unpack(sum(m * many for m in every[:1]) + every[3], 1805)
    assert total[0] == many and total[1] == 1 and total[2] == 0  # mask 0 is kept by the first step of ABCDE, mask AB is removed
    assert audit.unpack(lost[1] * many, 600).sum() == 120 * many % 2**64 - (2**64 if 120 * many % 2**64 >= 2**63 else 0)
    assert audit.unpack(lost[31], 600).reshape(120, 5).sum(1).tolist() == [1] * 120


def plain_kernel(s, t, decay, n):
    """Every pair of equal subsequences of n characters, by what they span."""
    def all_of(x):
        out = collections.Counter()
        for at in itertools.combinations(range(len(x)), n):
            out["".join(x[i] for i in at)] += decay ** (at[-1] - at[0] + 1)
        return out
    a, b = all_of(s), all_of(t)
    return sum(a[u] * b[u] for u in a) / decay ** (2 * n)


def test_kernel_equals_enumeration():
    left, right = ["^idiot$", "^i$", "", "^idxiot$", "^clown$", "aaaa", "^strange words$"], ["^idiot$", "aaa", "lown"]
    got = toxicity.subsequence_kernel(left, right)
    size = lambda s: min(1.0, toxicity.USUAL / max(1, len(s))) ** 0.5
    for i, s in enumerate(left):
        for j, t in enumerate(right):
            want = sum(plain_kernel(s, t, toxicity.DECAY, n) for n in toxicity.ORDERS) * size(s) * size(t)
            assert got[i, j] == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_words_and_units():
    assert toxicity.words("You i d i o t, mr s. c. u. m.") == "you i d i o t, mr s. c. u. m. idiot scum".split()
    assert toxicity.units("i-d_i.ot!") == ["^idiot$"] and toxicity.units("--") == []
    parts = toxicity.units("x" * 500 + "idiot" + "y" * 500)
    assert all(len(p) <= toxicity.WINDOW for p in parts) and any("idiot" in p for p in parts)


@pytest.fixture(scope="module")
def model_and_texts():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "an", "re", "ing", "li", "pa", "st", "do"]) for _ in range(rnd.randint(1, 4)))
    texts, toxic = [], []
    for k in range(240):
        text = [word() for _ in range(rnd.randint(5, 60))]
        if k % 3 == 0:
            text[rnd.randrange(len(text))] = rnd.choice(["idiot", "clown", "worthless"]) + rnd.choice(["", ".", ","])
        texts.append(" ".join(text))
        toxic.append(int(k % 3 == 0))
    return toxicity.fit(texts, np.array(toxic), 0.0), texts


@pytest.mark.parametrize("insult", ["idiot", "IDIOT", "you idiot!", "i-d-i-o-t", "i d i o t", "i. d. i. o. t.", "idxiot", "clownn", "wor.thless", "worthxless"])
def test_gapped_and_grown_insults(model_and_texts, insult):
    model, texts = model_and_texts
    clean = [t for k, t in enumerate(texts) if k % 3]
    with_it, without = toxicity._inputs(*toxicity.evidence(model, [f"{clean[0]} {insult} {clean[1]}", f"{clean[0]} {clean[1]}"])) @ model.document
    assert with_it > 0 > without


def test_landmarks_are_pieces_that_tell_labels_apart():
    toxic = collections.Counter({"^idiot$": 30, "^idiots$": 8, "^lowei$": 9, "^loweitra$": 8, "^loweisch$": 9, "^common$": 50})
    clean = collections.Counter({"^common$": 60, "^rare$": 1, "^lowing$": 2})
    assert toxicity.choose_landmarks(toxic, clean, (100.0, 120.0)) == ["^idiot$", "^lowei"] or toxicity.choose_landmarks(toxic, clean, (100.0, 120.0))[:2] == ["^idiot", "^lowei"]


def test_toxicity_of_odd_texts(spark, model_and_texts):
    model, texts = model_and_texts
    odd = [(0, None), (1, ""), (2, " \n"), (3, "idiot"), (4, "日本語" * 5000), (5, "x" * 200_000), (None, "the clown"), (3, "idiot"), (6, "!!! ???"), (7, ("pan " * 50_000) + "idiot")]
    df = spark.createDataFrame(odd, "doc_id long, text string").withColumn("score", F.lit(5))
    got = df.select("doc_id", "text", toxicity.score(model, F.col("text")).alias("p")).collect()
    assert all(0 <= r.p <= 1 for r in got) and len(got) == len(odd)
    assert {r.p >= 0.5 for r in got if r.text and ("idiot" in r.text or "clown" in r.text)} == {True}
    assert not any(r.p >= 0.5 for r in got if not (r.text and ("idiot" in r.text or "clown" in r.text)))
    assert len({r.p for r in got if r.doc_id in (0, 1, 2)}) == 1


def test_toxicity_without_labels(spark):
    documents = spark.createDataFrame([(0, "a"), (1, "b"), (2, None), (None, "c")], "doc_id long, text string")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    for rows, share in (([], 0.5), ([(0, 0), (1, 0), (None, 1)], 0.5 / 2.5), ([(0, None), (1, 7)], 0.5), ([(0, 1), (1, 0), (0, 0)], 0.5)):
        model = toxicity.train(documents, labels(rows))
        assert [r.p for r in documents.select(toxicity.score(model, F.col("text")).alias("p")).collect()] == pytest.approx([share] * 4)
    empty = toxicity.train(documents.limit(0), labels([(0, 1), (1, 0)]))
    assert empty.landmarks == [] and documents.limit(0).select(toxicity.score(empty, F.col("text"))).count() == 0


def test_toxicity_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op13_toxicity(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = got[got["held_out"]]
    a, b = np.sort(held[held["toxic"] == 0]["score"]), held[held["toxic"] == 1]["score"]
    auc = (np.searchsorted(a, b, "left") + np.searchsorted(a, b, "right")).mean() / 2 / len(a)
    assert auc > 0.9, auc
