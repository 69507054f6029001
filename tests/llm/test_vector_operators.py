import numpy as np
import pytest

from quakelode.llm import cosine, neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, id string"


def rows(seed=0, n=400, d=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    for i in range(0, n, 4):
        x[i] = x[i // 8] + rng.normal(scale=0.08, size=d)
    for i in range(1, n, 7):
        x[i] = x[5]
    for i in range(3, n, 11):
        x[i] = 2 * x[2]
    out = [(i, [float(v) for v in r], 0, "z") for i, r in enumerate(x)]
    return out + [(900, None, 1, "z"), (901, [], 1, "z"), (902, [0.0] * d, 1, "z"), (903, [float("nan")] + [1.0] * (d - 1), 1, "z"), (904, [float("inf")] * d, 1, "z"), (905, [None] + [1.0] * (d - 1), 1, "z"), (906, [1.0] * (d + 1), 1, "z"), out[10]]


@pytest.mark.parametrize("tile", [50, 4096])
def test_links_and_components_match_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(cosine, "TILE", tile)
    data = rows()
    good = [r for r in data if r[0] < 900]
    x = np.array([r[1] for r in good])
    norm = np.sqrt((x**2).sum(1))
    linked = x @ x.T / np.outer(norm, norm) >= 0.95
    np.fill_diagonal(linked, False)
    ids = np.array([r[0] for r in good])
    label = ids.copy()
    while True:
        new = np.array([min(label[i], label[linked[i]].min() if linked[i].any() else label[i], label[ids == ids[i]].min()) for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    got = cosine.near_duplicate_vectors(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    want = {i: (n, c) for i, n, c in zip(ids, linked.sum(1), label)}
    for r in got:
        n, c = want.get(r.vec_id, (0, r.vec_id))
        assert (r.n_links, r.component_id, r.kept) == (n, c, c == r.vec_id)


def test_neighbours_reach_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 64)
    data = rows(n=900)
    df = spark.createDataFrame(data, SCHEMA)
    got = neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=10).toPandas()
    good = {r[0]: np.array(r[1]) for r in data if r[0] < 900}
    hit = total = 0
    for q in [i for i in good if i % 20 == 0]:
        true = sorted((float(np.sqrt(((good[i] - good[q]) ** 2).sum())), i) for i in good if i != q)[:10]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11))
        assert list(zip(mine["score"], mine["vec_id"])) == sorted(zip(mine["score"], mine["vec_id"]))
        assert np.allclose(mine["score"], [np.sqrt(((good[i] - good[q]) ** 2).sum()) for i in mine["vec_id"]], rtol=0, atol=0)
        hit += len({i for _, i in true} & set(mine["vec_id"]))
        total += 10
    assert hit / total >= 0.9


def test_few_or_no_vectors(spark):
    few = spark.createDataFrame(rows(n=11), SCHEMA)
    got = neighbours.nearest(few, few, k=20).toPandas()
    assert set(got.groupby("query_id").size()) == {10}
    none = spark.createDataFrame([], SCHEMA)
    assert neighbours.nearest(none, none).count() == 0 and cosine.near_duplicate_vectors(none).count() == 0
    bad = spark.createDataFrame([(1, None, 0, ""), (2, [0.0], 0, "")], SCHEMA)
    assert neighbours.nearest(bad, bad).count() == 0
    assert sorted(map(tuple, cosine.near_duplicate_vectors(bad).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5000, 64)) @ neighbours.rotation(64)
    lost = 0
    for q in x[:40]:
        true = np.argsort(((x - q) ** 2).sum(1))[:10]
        lost += len(set(true) - set(neighbours.adaptive_scan(q, x, 10)))
    assert lost <= 2


def test_each_length_has_its_links_and_neighbours(spark):
    data = [(i, [1.0, float(i)], 0, "") for i in range(6)] + [(10 + i, [1.0, 0.01 * i, 0.0], 0, "") for i in range(4)]
    df = spark.createDataFrame(data, SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id) for r in cosine.near_duplicate_vectors(df).collect()}
    assert all(got[10 + i] == (3, 10) for i in range(4)) and got[0] == (0, 0)
    near = neighbours.nearest(df, df, k=2).collect()
    assert {r.vec_id for r in near if r.query_id == 10} == {11, 12} and {r.vec_id for r in near if r.query_id == 0} == {1, 2}
