import collections
import math
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakelode.llm import encode, lattice, lengths, licenses, minhash, mixing, packing, quality, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TR = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def corpus(seed=1, n=60):
    """Texts of all odd kinds, copies and near copies among them."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 120))]
        text = " ".join(words)
        if i % 5 == 1:
            text = rows[rnd.randrange(len(rows))][1]
        if i % 5 == 2 and rows[i - 1][1]:
            near = rows[i - 1][1].split()
            near[rnd.randrange(len(near))] = "changed"
            text = " ".join(near)
        rows.append((i, text, "en", rnd.choice(["a", "b", None, "hot", "hot", "hot"]), len(text or "")))
    odd = [None, "", " \n\t ", "one", "one two", "ONE Two three", "one two THREE", "\x85odd\xa0spaces here now", "é, É! 日本語 テスト 12.5 <|endoftext|> don't", "x" * 3000, "long " * 4000, "ends with a break\n", "\n\n"]
    rows += [(1000 + k, t, None, None, None) for k, t in enumerate(odd)]
    rows += [rows[3], rows[3], (None, "one two three", None, "a", 1), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, size):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_match_brute_force(docs, size):
    rows = [r for r in corpus() if r[0] is not None]
    sets = [(i, shingles(t, size)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in sets:
        for b, u in sets:
            if s and u and 100 * len(s & u) >= 80 * len(s | u) and find(a) != find(b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = minhash.near_duplicates(docs, shingle_words=size).collect()
    assert len(got) == len(corpus())
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == find(r.doc_id) and r.kept == (r.component_id == r.doc_id)
            assert r.n_shingles in {len(s) for i, s in sets if i == r.doc_id}
        else:
            assert not r.kept
    kept = minhash.deduplicated(docs, shingle_words=size).where("doc_id is not null").collect()
    assert sorted(r.doc_id for r in kept) == sorted({find(i) for i, _ in sets})


def test_near_duplicates_of_large_groups(spark):
    base = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(base[: 5 + i % 90] + [f"x{i}"] + base[6 + i % 90 :])) for i in range(700)] + [(1000 + i, " ".join(base)) for i in range(300)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=4).collect()
    assert {r.component_id for r in got} == {0}


def test_estimates_follow_jaccard():
    rng = np.random.default_rng(0)
    for j in (0.3, 0.6, 0.8, 0.95):
        est = []
        for n in (3000, 200):
            for _ in range(30):
                common = rng.integers(0, 2**63, int(n * j), dtype=np.uint64)
                rest = rng.integers(0, 2**63, n - len(common), dtype=np.uint64)
                k = len(rest) // 2
                sets = [np.unique(minhash.mix(np.concatenate((common, part)))) for part in (rest[:k], rest[k:])]
                x, y = minhash.registers(sets)
                est.append(minhash.estimate(np.array([(x == y).sum()]), np.array([len(sets[0])]))[0])
        assert abs(np.mean(est) - j) < 0.03


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert minhash.near_duplicates(empty).count() == 0
    assert lengths.context_totals(lengths.length_histogram(empty)).count() == 0
    assert packing.pack(empty).count() == 0
    assert licenses.scan(empty).count() == 0
    assert sharding.shard(empty).count() == 0
    assert lattice.likelihoods(empty.withColumn("learn", F.lit(True)), "learn").count() == 0
    assert mixing.mix(empty).count() == 0
    assert empty.select(quality.score(quality.train(empty, labels), F.col("text"))).count() == 0


def test_clashing_columns_change_nothing(docs):
    names = ["id", "n", "bands", "row", "block", "mark", "part", "one", "rank", "before", "tie", "w", "size", "shard", "slot", "target", "source_key", "word"]
    wide = docs.withColumns({c: F.lit("7") for c in names})
    assert sorted(map(tuple, minhash.near_duplicates(wide).collect()), key=str) == sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=str)
    dealt = sharding.shard(wide, 4)
    assert {"doc_id", "id", "rank", "one"} <= set(dealt.columns) and dealt.count() == docs.count()
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    a, b = (sorted(map(str, mixing.mix(d).select(*cols).collect())) for d in (wide, docs))
    assert a == b
    assert packing.pack(wide).count() == packing.pack(docs).count()
    assert sorted(map(str, licenses.scan(wide).collect())) == sorted(map(str, licenses.scan(docs).collect()))


def token_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["Hello WORLD <|endoftext|> Again", "HELLO<|endoftext|>Hello, É World! <|StartOfText|> <|> A", "F# x <|> Y |> Map ÀB Ab. AB' i̇ İX", "Hello WORLD Again"])
def test_ids_are_those_of_the_whole_text(text):
    from quakelode.llm.encode import encoded

    assert list(np.frombuffer(encoded([text])[0], "<u4")) == token_ids()(text)


def test_ids_of_random_texts():
    """20 000 texts of parts that tokenizers treat by rules of their own."""
    from quakelode.llm.encode import encoded

    rnd, ids = random.Random(11), token_ids()
    parts = ["Hello", "WORLD", "don't", "I'VE", "a", "B", "xs", "Parser", "12", "3.5", "é", "É", "e\u0301", "E\u0301", "İ", "ß", "ẞ", "日本語", "Ж", "ﬁ", "<|", "|>", "<|>", "<|endoftext|>", "<|startoftext|>", "<|StartOfText|>", "<", "|", ">", "!", "'", '"', "--", "\u200d", "\u0302", "\x85", "\xa0", "\u2003", "\x1c", "\x00", "😀", "_"]
    texts = ["".join(rnd.choice(parts) + rnd.choice(["", "", " ", " ", "\n", "\t", "\x0b"]) for _ in range(rnd.randint(1, 9))) for _ in range(20_000)]
    assert [t for t, got in zip(texts, encoded(texts)) if list(np.frombuffer(got, "<u4")) != ids(t)] == []


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    from quakelode.llm.encode import encoded

    path, texts = public_tokenizers.path("byte_bpe_50k.json"), ["Hello  WORLD\n again", "", None, "日本 <|endoftext|>"]
    want = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [list(np.frombuffer(x, "<u4")) for x in encoded(texts, path)] == want


def test_length_sums(docs):
    ids = token_ids()
    held = np.array([len(ids(r[1])) for r in corpus()])
    totals = lengths.context_totals(lengths.length_histogram(docs))
    for r in totals.collect():
        assert r.documents == (held == r.tokens).sum() and r.documents_at_least == (held >= r.tokens).sum()
        assert r.tokens_at_least == held[held >= r.tokens].sum() and r.total_tokens == held.sum()
        assert r.truncated_tokens == np.minimum(held, r.tokens).sum() and r.truncated_documents == (held > r.tokens).sum()
        assert abs(r["quantile"] - (held <= r.tokens).mean()) < 1e-12
    for limit in (0, 7, 100, 10**6):
        assert lengths.at_limit(totals, limit).first().truncated_tokens == np.minimum(held, limit).sum()
    assert lengths.length_quantile(totals, 0.5).first().tokens == np.sort(held)[math.ceil(len(held) / 2) - 1]


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_round_trip(docs, capacity):
    ids = token_ids()
    packed = packing.pack(docs, capacity=capacity).toPandas()
    want = collections.Counter((r[0], np.array([*ids(r[1]), 0], "<u4").tobytes()) for r in corpus())
    named = packed[packed.doc_id.notna()]
    for doc, part in named.groupby("doc_id"):
        texts = [t for i, t in want if i == doc]
        assert len(part) == sum(want[doc, t] * -(-len(t) // (4 * capacity)) for t in texts)
        if len(texts) == 1 and want[doc, texts[0]] == 1:
            part = part.sort_values("piece")
            assert b"".join(part["ids"]) == texts[0] and list(part["start"]) == list(range(0, len(texts[0]) // 4, capacity))
    for _, s in packed.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert list(s["offset"]) == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= capacity


def test_bin_completion_against_exhaustive_search():
    rnd = random.Random(3)

    def optimum(sizes, capacity):
        best = [len(sizes)]

        def place(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(sizes):
                best[0] = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] + sizes[k] <= capacity and bins[i] not in bins[:i]:
                    bins[i] += sizes[k]
                    place(k + 1, bins)
                    bins[i] -= sizes[k]
            bins.append(sizes[k])
            place(k + 1, bins)
            bins.pop()

        place(0, [])
        return best[0]

    for _ in range(60):
        capacity = rnd.choice([10, 24, 50])
        sizes = sorted((rnd.randint(1, capacity) for _ in range(rnd.randint(1, 9))), reverse=True)
        plan = packing.bin_completion(collections.Counter(sizes), capacity, 2000)
        used = collections.Counter()
        for pattern, times in plan.patterns:
            assert sum(s * k for s, k in pattern) <= capacity
            used.update({s: k * times for s, k in pattern})
        assert used == collections.Counter(sizes) and plan.bound <= optimum(sizes, capacity) == plan.sequences
    assert packing.bin_completion({}, 10) == packing.Plan([], 0, 0)


def test_bin_completion_meets_the_bound_where_best_fit_does_not():
    """400 full sequences of 2048, each cut into three pieces of random lengths."""
    rnd, sizes = random.Random(1), collections.Counter()
    for _ in range(400):
        a, b = sorted(rnd.sample(range(1, 2048), 2))
        sizes.update((a, b - a, 2048 - b))
    assert sum(n for _, n in packing.best_fit(sizes, 2048)) == 401
    plan = packing.bin_completion(sizes, 2048)
    assert plan.sequences == plan.bound == 400 and all(sum(s * k for s, k in pattern) == 2048 for pattern, _ in plan.patterns)


def test_license_phrases_and_templates(spark, docs):
    texts = [
        "Licensed under CC BY-NC 4.0.", "cc\nby and CC-BY again; all Rights\treserved", "GNU GENERAL public license", "plain text by cc",
        "Copyright 2020. Released under the MIT License. More words follow here.", "intro " * 500 + "Licensed under the Apache License, Version 2.0" + " outro" * 500, None, "", "all rights all rights reserved",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(TR))
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(at)) and r.base_labels == ",".join(sorted({x for _, x in at}))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None)) and 0 <= r.score <= 1
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
    assert got[0].labels == "cc-by,cc-by-nc" and got[4].labels == "mit" and got[5].labels == "apache" and got[3].labels == ""


@pytest.mark.parametrize(("text", "labels"), [
    ("Licensed under CC BY 4.0", "cc-by"), ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc"), ("Licensed under CC BY-SA 4.0", "cc-by,cc-by-sa"), ("Licensed under CC BY-ND 4.0.", "cc-by,cc-by-nd"),
    ("under the terms of the GNU General Public License", "gpl"), ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    ("under the terms of the GNU Lesser General Public License", "gpl,lgpl"), ("under the terms of the GNU Affero General Public License", "agpl,gpl"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gpl,lgpl"),
    ("Released under the Apache License", "apache"), ("Licensed under the Apache License, Version 2.0", "apache"), ("Released under the MIT License", "mit"),
    ("The record was released under the name of the band, and the license was never found", ""), ("Released under a license of the state, the film under review was late", ""),
    ("Licensed under state law " + "word " * 40 + "MIT " + "word " * 40 + "the license", ""),
    ("Licensed under CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa"), ("der den mit.\nLicensed under the Apache License, Version 2.0", "apache"), ("nd ontiti nd. Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("Licensed under the MIT License or the Apache License, Version 2.0", "apache,mit"), ("Licensed under the MIT License or licensed under the Apache License, Version 2.0 at your option", "apache,mit"),
    ("Licensed under CC BY-NC 4.0. Figures are licensed under CC BY 4.0", "cc-by,cc-by-nc"), ("Licensed under CC BY-SA 4.0 or licensed under CC BY-ND 4.0", "cc-by,cc-by-nd,cc-by-sa"),
    ("This work is licensed under the GNU General Public License. This work is licensed under the GNU Lesser General Public License", "gpl,lgpl"),
    ("This work is licensed under the GNU Lesser General Public License or under the terms of the GNU Affero General Public License", "agpl,gpl,lgpl"),
    ("Released under the MIT License. Released under the MIT License. Released under the Apache License.", "apache,mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "mit"),
])
def test_licenses_are_told_apart(spark, text, labels):
    """Alone, and in the middle of a long text. (The phrase "general public license" gives gpl in itself.)"""
    rows = [(1, text), (2, "some more " * 90 + text + " and so on" * 90)]
    assert {r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {labels}


def test_license_join_finds_every_block(spark):
    """All blocks with the containment, by brute force over random words."""
    rnd = random.Random(5)
    letters = [f"t{k}" for k in range(12)]
    texts = [rnd.sample(letters, k) for k in (3, 5, 8)] + [[*letters, "u1", "u2", "u3", "u4"]]
    templates = [licenses.Template(" ".join(t), f"l{len(t)}", " ".join(t[: len(t) // 5])) for t in texts]
    rows = [(i, " ".join(rnd.choice([*letters, "x", "y", "u1", "u2"]) for _ in range(rnd.randint(0, 300)))) for i in range(80)]
    got = {r.doc_id: {(b.template, b.first) for b in r.blocks} for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates).collect()}
    for i, t in rows:
        w, want = t.split(), set()
        for k, s in enumerate(texts):
            wide = 24 if len(s) < 15 else 128
            for at in range(0, max(0, len(w) - 1 - wide // 2) + 1, wide // 2):
                block = w[at : at + wide]
                if 10 * len({*block} & {*s}) >= 8 * len(s) and " " + " ".join(s[: len(s) // 5]) in " " + " ".join(block):
                    want.add((k, at))
        assert got[i] == want


def test_shards_are_exact_and_repeat(docs):
    dealt = sharding.shard(docs, 5).toPandas()
    counts = dealt.groupby("shard")["slot"].agg(["count", "min", "max", "nunique"])
    assert counts["count"].max() - counts["count"].min() <= 1 and (counts["min"] == 0).all() and (counts["max"] + 1 == counts["count"]).all() and (counts["nunique"] == counts["count"]).all()
    again = sharding.shard(docs.repartition(7), 5).toPandas()
    key = ["shard", "slot"]
    assert dealt.sort_values(key)["text"].fillna("").tolist() == again.sort_values(key)["text"].fillna("").tolist()
    assert dealt.sort_values(key)["doc_id"].tolist() != sorted(dealt["doc_id"])


def test_shuffle_is_uniform():
    shares = np.zeros((4, 3))
    for seed in range(2000):
        m = sharding.communication_matrix({0: 5, 1: 1, 2: 0, 3: 9}, [5, 5, 5], seed)
        assert (m.sum(0) == 5).all() and (m.sum(1) == [5, 1, 0, 9]).all()
        shares += m
    assert np.allclose(shares / 2000, np.outer([5, 1, 0, 9], [1 / 3] * 3), atol=0.1)


def test_lattice_equals_all_segmentations():
    pieces = lattice._pieces(None)
    scores = pieces.first_scores()

    def total(text):
        if not text:
            return 1.0
        out = math.exp(len(text[0].encode()) * scores[-2]) * total(text[1:])
        for k in range(1, min(len(text), pieces.longest) + 1):
            if text[:k] in pieces.index:
                out += math.exp(scores[pieces.index[text[:k]]]) * total(text[k:])
        return out

    words = ["the", "a", "ingthe", "日本x", "\x00", "é", "zzzzqq"]
    assert np.allclose(lattice.word_scores(words, scores), [math.log(total("▁" + w)) for w in words])
    long = "ab" * 300
    assert np.isclose(lattice.word_scores([long], scores)[0], lattice._long_word(pieces, long, scores))
    assert np.isclose(lattice._long_word(pieces, "ingthe", scores), lattice.word_scores(["ingthe"], scores)[0])
    assert np.isclose(np.exp(scores).sum() + 255 * np.exp(scores[-2]), 1)
    n = lattice.expected_pieces(["the"], np.array([5.0]), scores)
    assert 5 <= n.sum() <= 5 * 4


def test_long_words_teach_pieces(spark, monkeypatch):
    pieces = lattice._pieces(None)
    scores, words, counts = pieces.first_scores(), ["the", "ingthe", "日本x", "\x00é", "z" * 90, "thequickbrownfox" * 11], np.array([3.0, 1.0, 2.0, 4.0, 1.0, 2.0])
    whole = lattice.expected_pieces(words, counts, scores)
    monkeypatch.setattr(lattice, "LONG", 3)
    assert np.allclose(lattice.expected_pieces(words, counts, scores), whole)
    monkeypatch.undo()
    long = "thequickbrownfox" * 50
    n = lattice.expected_pieces([long], np.array([2.0]), scores)
    held = sum(x * len(t) for x, t in zip(n, pieces.text)) + n[-1] / 3  # bytes: only the mark's three, no piece being likelier
    assert 2 * len(long) - 1 < held < 2 * len(long) + 2 + 2 * len(long)
    df = spark.createDataFrame([(1, long, True), (2, long, False)], "doc_id long, text string, learn boolean")
    blank = spark.createDataFrame([(1, "", True), (2, long, False)], "doc_id long, text string, learn boolean")
    taught, untaught = ({r.doc_id: r.score for r in lattice.likelihoods(d, "learn", rounds=1).collect()}[2] for d in (df, blank))
    assert taught > untaught / 2


def test_likelihoods(docs, monkeypatch):
    monkeypatch.setattr(lattice, "HEAD", 40)
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 1, F.lit(True))
    got = lattice.likelihoods(docs.withColumn("learn", learn), "learn").collect()
    train = collections.Counter()
    for i, t, *_ in corpus():
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            train.update([*(t or "").encode().lower().split(), 0])
    n, v = sum(train.values()), len(train)
    base = lambda t: sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*(t or "").encode().lower().split(), 0])
    want = collections.Counter((i, round(base(t), 5)) for i, t, *_ in corpus())
    assert collections.Counter((r.doc_id, round(r.base_score, 5)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 and r.n_known <= r.n_tokens for r in got)
    assert {r.doc_id: r.n_known for r in got}[1001] == 1


def test_mix_meets_targets(docs):
    got = mixing.mix(docs).toPandas()
    rows = corpus()
    sizes = [len((r[1] or "").encode().split()) for r in rows]
    assert sorted(got["size"]) == sorted(sizes)
    names = sorted({r[3] for r in rows if r[3] is not None})
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate([*names, None])}
    held = {s: sum(n for n, r in zip(sizes, rows) if r[3] == s) for s in weights}
    target, live = {}, set(weights)
    while True:
        rest, w = 1.5 * sum(sizes) - sum(target.values()), sum(weights[s] for s in live)
        over = [s for s in live if rest * weights[s] / w > 2 * held[s]]
        if not over:
            target |= {s: rest * weights[s] / w for s in live}
            break
        target |= {s: 2 * held[s] for s in over}
        live -= set(over)
    got["source"] = got["source"].where(got["source"].notna(), None)
    for s in weights:
        part = got[got["source"].isna()] if s is None else got[got["source"] == s]
        assert np.allclose(part["target"], target[s]) and abs(part["taken"].sum() - target[s]) <= part["size"].max()
    assert (got["taken"] <= 2 * got["size"]).all() and got["taken"].sum() <= 1.5 * sum(sizes) + 1e-6
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert sorted(zip(got["doc_id"].fillna(-1), got["size"], got["taken"])) == sorted(zip(again["doc_id"].fillna(-1), again["size"], again["taken"]))
    assert mixing.mixed(docs).count() == got["copies"].sum()


def test_quality_field(spark, docs):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8)))

    def page(good):
        lines = []
        for _ in range(rnd.randint(1, 8)):
            w = [word() for _ in range(rnd.randint(3, 15))]
            lines.append(" ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w))
        return "\n".join(lines)

    rows = [(i, page(i % 3 > 0), int(i % 3 > 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    field = quality.train(df, df.where("doc_id % 2 = 0").select("doc_id", "quality"))
    scored = df.where("doc_id % 2 = 1").select("quality", quality.score(field, F.col("text")).alias("s")).toPandas()
    assert ((scored["s"] >= 0.5) == (scored["quality"] == 1)).mean() > 0.97
    odd = docs.select(quality.score(field, F.col("text")).alias("s")).toPandas()["s"]
    assert odd.between(0, 1).all() and len(odd) == docs.count()
    one = quality.train(df, df.where("quality = 1").select("doc_id", "quality"))
    assert 0 <= docs.select(F.avg(quality.score(one, F.col("text")))).first()[0] <= 1


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    e, moves, first = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([0, 4, 5, 7])
    a, b = quality._chain(e, first, moves)
    for lo, hi in zip(first[:-1], first[1:]):
        weight = {}
        for y in range(2 ** (hi - lo)):
            path = [(y >> k) & 1 for k in range(hi - lo)]
            weight[tuple(path)] = math.exp(sum(e[lo + k] * s for k, s in enumerate(path)) + sum(moves[p, s] for p, s in zip(path, path[1:])))
        for k in range(hi - lo):
            p = sum(w for path, w in weight.items() if path[k]) / sum(weight.values())
            assert np.isclose(quality._sigmoid(np.array(a + b))[lo + k], p)


def test_line_features_of_odd_rows():
    texts = ["", "a\n", "\n\n", "b b b", "same\nsame"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    x, size, first = quality.line_features(data, offsets)
    assert list(np.diff(first)) == [1, 2, 3, 1, 2] and list(size) == [0, 1, 0, 0, 0, 0, 5, 4, 4]
    assert x[6, 5] == pytest.approx(2 / 3) and x[8, 10] == 1 and x[7, 10] == 0


def test_long_chunks_are_not_kept():
    """Text without white space makes chunks of many kB, each met once; their ids don't stay in the worker."""
    rnd = random.Random(2)
    tokenizer, cache, _ = encode._tokenizer(None)
    for _ in range(20):
        encode.encoded(["".join(chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(5000)) + f" word{rnd.random()}" for _ in range(10)])
    assert max(map(len, cache)) <= encode.CACHED_BYTES


def test_long_words_are_counted_in_pieces(spark, monkeypatch):
    """Words of many bytes leave the counting task early and are never among those that all tasks hold."""
    monkeypatch.setattr(lattice, "FLUSH_BYTES", 500)
    rows = [(k, ("y" * 300 + f"{k % 3} ") * 2 + "short", k % 2 == 0) for k in range(12)]
    got = {r.word: (r.c, r.seen) for r in lattice.word_table(spark.createDataFrame(rows, "doc_id long, text string, learn boolean"), "text", "learn").collect()}
    want = collections.Counter(w for _, t, _ in rows for w in t.split())
    assert {w: n for w, (_, n) in got.items() if w} == want and got["short"] == (6, 12) and got[None] == (6, 12)


def test_bounds_of_packing():
    """Three items of just over a third need more room than their sum says, and the search's limit holds for nodes too."""
    assert packing.lower_bound({700: 3000}, 2048) == 1500
    counts = {896: 1007, 601: 3, 814: 10, 1268: 3, 890: 7}
    plan = packing.bin_completion(counts, 2048, 500)
    assert plan.bound <= plan.sequences <= plan.bound + 1 and plan.steps <= 500
