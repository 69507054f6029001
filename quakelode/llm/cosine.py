"""Near-duplicate vectors: tiles compared along principal components, stopped by suffix norms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakelode.llm.components import components
from quakelode.llm.shared import materialize
from quakelode.llm.vectors import lengths, matrix, stacked, usable

TILE = 4096  #: vectors in a tile: 2 MB at 64 doubles each
RANGES = 1024  #: ranges of the first component at most; what a tile can't hold of one is split by hash
STRIP = 256  #: rows of a tile that are compared with the other tile at a time
PAIRS = 1 << 21  #: doubles of each side (16 MB) that pairs which went on take at a time
STEPS = (0.25, 0.5)  #: shares of the components after which pairs are given up
SLACK = 1e-9  #: what rounding may hide in a partial sum


def principal_axes(vectors: DataFrame, col: str, length: int) -> np.ndarray:
    """Axes of the unit vectors (columns), by falling energy. Only sums of length * length products come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((length, length))
        for batch in batches:
            x = matrix(batch.column(0), length)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length * length)), pa.array(total.ravel())], names=["at", "x"])

    sums = vectors.select(col).mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    gram = np.zeros(length * length)
    for r in sums:
        gram[r["at"]] = r["x"]
    return np.linalg.eigh(gram.reshape(length, length))[1][:, ::-1]


def tile_links(x: np.ndarray, y: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two tiles (of one with itself: i < j) with cosine >= least, by strips of the first.

    x, y: rotated unit vectors. Leading components are summed for all pairs at once; a pair goes on
    only while its sum plus the product of what is left of both norms can still reach the threshold. Pairs that go to
    the end may miss the threshold by rounding: the cosine of the given vectors decides.
    """
    d = x.shape[1]
    cuts = sorted({max(1, int(d * s)) for s in STEPS} | {d})
    tails = [(np.sqrt((x[:, c:] ** 2).sum(1)), np.sqrt((y[:, c:] ** 2).sum(1))) for c in cuts]
    for a in range(0, len(x), STRIP):
        head = x[a : a + STRIP, : cuts[0]] @ y[:, : cuts[0]].T
        i, j = np.nonzero(head + np.outer(tails[0][0][a : a + STRIP], tails[0][1]) >= least - SLACK)
        part = head[i, j]
        i += a
        if same:
            i, j, part = (z[i < j] for z in (i, j, part))
        for k in range(1, len(cuts)):
            part = part + _products(x[:, cuts[k - 1] : cuts[k]], y[:, cuts[k - 1] : cuts[k]], i, j)
            on = part + tails[k][0][i] * tails[k][1][j] >= least - SLACK
            i, j, part = i[on], j[on], part[on]
        yield i, j


def _products(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the rows i of x and j of y, some at a time: where little is given up there are very many."""
    out, step = np.zeros(len(i)), max(1, PAIRS // x.shape[1])
    for a in range(0, len(i), step):
        out[a : a + step] = np.einsum("ij,ij->i", x[i[a : a + step]], y[j[a : a + step]])
    return out


def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    a, b = (np.sqrt(np.einsum("ij,ij->i", z, z)) for z in (x, y))
    return _products(x, y, i, j) / (a[i] * b[j])


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the pairs (i, j) join it to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def _class_links(classes: DataFrame, length: int, least: float) -> DataFrame:
    """(c, links, other) from the comparison of all classes (c, v, n) of one length."""
    axes = principal_axes(classes, "v", length)

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), length)
            first = x @ axes[:, 0] / np.linalg.norm(x, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first)], names=["c", "v", "n", "first"])

    kind = dict(classes.dtypes)["v"]
    placed = materialize(classes.select("c", "v", "n").mapInArrow(rotate, f"c long, v {kind}, n long, first double"), "cosine-rotated")
    count = placed.count()
    wanted = min(RANGES, -(-count // TILE))
    cuts = placed.approxQuantile("first", [k / wanted for k in range(1, wanted)], 0.1 / wanted) if wanted > 1 else []
    edges = F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    ranged = placed.withColumn("range", F.size(F.filter(edges, lambda e: e <= F.col("first"))))
    bounds = ranged.groupBy("range").agg(F.min("first").alias("lo"), F.max("first").alias("hi"), F.ceil(F.count("*") / TILE).alias("parts"))
    bounds = materialize(bounds, "cosine-bounds")
    tile = F.col("range") * F.lit(1 << 32) + F.col("part")
    dealt = ranged.join(F.broadcast(bounds.select("range", "parts")), "range").withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts"))).select("c", "v", "n", tile.alias("tile"))
    # two tiles meet if their ranges are as near as linked unit vectors can be; slots as wide as that make it an equi-join
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6
    tiles = bounds.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(tile.alias("tile"), "lo", "hi")
    slots = lambda low, high: F.explode(F.sequence(F.floor(low / reach), F.floor(high / reach)))
    left = tiles.select(F.col("tile").alias("i"), F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i"), slots(F.col("lo") - reach, F.col("hi") + reach).alias("slot"))
    right = tiles.select(F.col("tile").alias("j"), F.col("lo").alias("lo_j"), F.col("hi").alias("hi_j"), slots(F.col("lo"), F.col("hi")).alias("slot"))
    meets = left.join(right, "slot").where("i <= j").where((F.col("lo_j") - F.col("hi_i") <= reach) & (F.col("lo_i") - F.col("hi_j") <= reach)).select("i", "j").distinct()
    meets = materialize(meets.select(F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"), "i", "j"), "cosine-meets")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = (pdf[pdf["tile"] == k] for k in (pdf["tile"].min(), pdf["tile"].max()))
        same = pdf["tile"].min() == pdf["tile"].max()
        if same and pdf["i"].iloc[0] != pdf["j"].iloc[0]:  # the other tile has no rows
            return pd.DataFrame({"c": [], "links": [], "other": []}).astype("int64")
        x0, y0 = stacked(left["v"], length), stacked(right["v"], length)
        x, y = ((z / np.sqrt((z**2).sum(1, keepdims=True))) @ axes for z in (x0, y0))
        ci, cj, wi, wj = left["c"].to_numpy(), right["c"].to_numpy(), left["n"].to_numpy(), right["n"].to_numpy()
        shift = 0 if same else len(left)
        ids = ci if same else np.concatenate((ci, cj))
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i, j in tile_links(x, y, least, same):
            ok = _exact(x0, y0, i, j) >= least
            i, j = i[ok], j[ok]
            np.add.at(links, i, wj[j])
            np.add.at(links, j + shift, wi[i])
            if len(i):
                root = _forest(len(ids), np.concatenate((i, np.arange(len(ids)))), np.concatenate((j + shift, root)))
        at = np.flatnonzero(links)
        return pd.DataFrame({"c": ids[at], "links": links[at], "other": ids[root[at]]})

    met = dealt.join(meets, "tile")
    return materialize(met.groupBy("i", "j").applyInPandas(compare, "c long, links long, other long"), "cosine-links")


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of vectors.

    Two vectors are linked if their cosine, in double precision, is at least ``least``. n_links counts the other rows
    linked with this one, component_id is the smallest id reached by links. Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing, nor do those of different lengths. Rows that
    repeat an id are one node of the components, and each counts as a link of its equals; a null id takes part in
    n_links, but its component is that of its equals, else null, and it is never kept. Other columns play no part.

    Equal vectors are one class from the start. Classes of one length are laid out in tiles along its first component; two tiles meet
    in one task if their ranges of it are as near as linked unit vectors can be. A task returns counts and a spanning
    forest, never all its pairs.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    # + 0.0 makes -0.0 and 0.0 one value
    rows = rows.withColumn("v", F.when(usable("v"), F.transform("v", lambda x: x + F.lit(0.0).cast("float") * x)))
    classes = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("c", F.monotonically_increasing_id())
    classes = materialize(classes, "cosine-classes")
    found = spark.createDataFrame([], "c long, links long, other long")
    for length in lengths(classes, "v"):
        found = found.unionByName(_class_links(classes.where(F.size("v") == length), length, least))
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    named = materialize(rows.join(classes.select("v", "c"), "v", "left").select("id", "c"), "cosine-rows")
    named = named.join(classes.select("c", F.col("id").alias("rep"), "n"), "c", "left").join(links, "c", "left")
    reps = classes.select("c", "id")
    edges = found.where("c <> other").select("c", "other").distinct().join(reps.withColumnRenamed("id", "a"), "c").join(reps.select(F.col("c").alias("other"), F.col("id").alias("b")), "other").select("a", "b")
    again = named.where("id <> rep").select("id", "rep").join(rows.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id"), "id")
    comp = components(edges.where("a is not null and b is not null").union(again.select("id", "rep")))
    named = named.withColumn("rep", F.coalesce("rep", "id")).join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep")
    return named.select(F.col("id").alias(id_col), (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
