"""Near-duplicate documents: HyperMinHash registers, banding, collision-corrected estimates, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakelode.llm.components import components
from quakelode.llm.shared import discard, materialize, mix, shingle_sets, text_chunks

BUCKETS, MANTISSA, ROWS = 128, 10, 4  #: registers a text, mantissa bits of each, registers in a band
BANDS = BUCKETS // ROWS
EMPTY = np.uint16(0xFFFF)
#: Members of one leader that get its row together, and groups into which all rows of a leader are dealt where none is known.
GROUP, SALTS = 64, 64
#: Members of one leader compared with each other in one task's memory.
TILE = 256
#: Shingles of all members of a tile (8 MB).
TILE_SHINGLES = 1_000_000
#: Ids up to this many (16 MB) are broadcast to find their texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


@lru_cache(1)
def _detours() -> np.ndarray:
    """Where an empty register looks for a value: 256 random tries of each register, the same in every task."""
    return np.random.default_rng(7).integers(0, BUCKETS, (256, BUCKETS))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BUCKETS registers for each sorted set of 64-bit hashes: leading zeros of a bucket's smallest hash, then its mantissa bits.

    The upper bits of a hash name its bucket, so the first of a sorted bucket is its smallest. Registers without a hash
    take that of a randomly chosen other one (optimal densification), so two registers agree with probability J.
    """
    edges = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(57)
    least, found = np.zeros((len(sets), BUCKETS), np.uint64), np.zeros((len(sets), BUCKETS), bool)
    for k, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, edges)
            got = s[np.minimum(at, len(s) - 1)]
            found[k] = (at < len(s)) & (got >> np.uint64(57) == edges >> np.uint64(57))
            least[k] = got
    rest = (least << np.uint64(7)) | np.uint64(1 << 6)
    zeros = (64 - np.frexp(rest.astype(np.float64))[1]).clip(0, 57).astype(np.uint64)
    bits = (rest << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    out = np.where(found, (zeros << np.uint64(MANTISSA)) | bits, np.uint64(EMPTY)).astype(np.uint16)
    open_rows = np.flatnonzero(found.any(1) & ~found.all(1))
    if len(open_rows):
        part, had = out[open_rows], found[open_rows]
        missing = ~had
        for step in _detours():
            take = missing & had[:, step]
            part[take] = out[open_rows][:, step][take]
            missing &= ~take
            if not missing.any():
                break
        else:
            first = out[open_rows, had.argmax(1)]
            part = np.where(missing, first[:, None], part)
        out[open_rows] = part
    return out


@lru_cache(4096)
def _chance(step: int) -> float:
    """How often two registers of different smallest hashes agree, with exp(step / 8) hashes in a bucket."""
    load = np.exp(step / 8)
    edges = np.concatenate([2.0**-z * (1 - np.arange(1 << MANTISSA) / (2 << MANTISSA)) for z in range(40)])
    cells = np.diff(np.exp(-load * np.append(edges, 0)))
    return float((cells**2).sum() / cells.sum() ** 2)


def estimate(same: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Jaccard from the share of equal registers, corrected by the share that agree by chance at n hashes a set."""
    steps = np.round(8 * np.log(np.maximum(n, 1) / BUCKETS)).astype(int)
    chance = np.array([_chance(int(s)) for s in np.unique(steps)])[np.searchsorted(np.unique(steps), steps)] if len(steps) else np.zeros(0)
    return (same / BUCKETS - chance) / (1 - chance)


def sketches(documents: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n, f1, f2, bands): set size, 128-bit sum over the set, and the registers, four to a long, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column(1)):
                sets = list(shingle_sets(data, offsets, size))
                with np.errstate(over="ignore"):
                    sums = [np.array([mix(s, salt).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for salt in (1, 2)]
                bands = registers(sets).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, sums), lists], names=["id", "n", "f1", "f2", "bands"])

    src = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, n long, f1 long, f2 long, bands array<long>")


def _sets(texts: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column(1)):
                sets = [s.view(np.int64) for s in shingle_sets(data, offsets, size)]
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["id", "s"])

    return texts.mapInArrow(run, "id long, s array<long>")


def _of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of ids, which are broadcast if they are few."""
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def _salt(groups: Column) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(11)), groups).alias("salt")


def _beside(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """pairs (leader, id, salt) with the columns of table for both, the leader's under names that begin with ``l_``.

    Members of one leader are dealt into groups by salt, so a leader of very many is no hot key, and its row is sent once
    a group and not once a member.
    """
    members = pairs.join(table, "id")
    heads = pairs.select("leader", "salt").distinct().join(table.select(F.col("id").alias("leader"), *(F.col(c).alias(f"l_{c}") for c in table.columns if c != "id")), "leader")
    return members.join(heads, ["leader", "salt"])


def _spread(rows: DataFrame, leaders: DataFrame) -> DataFrame:
    """rows (leader, id, ...) joined with leaders, which has a row for each leader and is broadcast if it is short."""
    leaders = materialize(leaders, "minhash-leaders")
    if leaders.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(leaders), "leader")
    dealt = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.select("*", _salt(F.lit(SALTS))).join(dealt, ["leader", "salt"]).drop("salt")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, share: int) -> DataFrame:
    """Of pairs (leader, id, salt) those whose whole sets meet the threshold, as (a, b) with a < b."""
    ids = pairs.select(F.explode(F.array("leader", "id")).alias("id")).distinct()
    sets = materialize(_sets(_of(texts, ids), size), "minhash-sets")
    common = F.size(F.array_intersect("s", "l_s")).cast("long")
    linked = _beside(pairs, sets).select("leader", "id", common.alias("x"), (F.size("s") + F.size("l_s")).cast("long").alias("n")).where(f"100 * x >= {share} * (n - x)")
    out = materialize(linked.select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b")), "minhash-links")
    discard(sets)
    return out


def _plausible(share: int) -> float:
    """Estimates below this are no candidates: five standard errors under the threshold."""
    j = share / 100
    return j - 5 * float(np.sqrt(j * (1 - j) / BUCKETS))


def _estimated(pairs: DataFrame, classes: DataFrame, share: int) -> DataFrame:
    least = _plausible(share)

    @F.pandas_udf(T.BooleanType())
    def close(x: pd.Series, y: pd.Series, n: pd.Series) -> pd.Series:
        a, b = (np.stack(z.to_numpy()).astype(np.int64).view(np.uint16).reshape(len(z), BUCKETS) for z in (x, y))
        return pd.Series(estimate((a == b).sum(1), n.to_numpy()) >= least)

    joined = _beside(pairs, classes.select("id", "n", "bands")).where(f"100 * least(n, l_n) >= {share} * greatest(n, l_n)")
    return joined.where(close("bands", "l_bands", F.expr("(n + l_n) / 2"))).select("leader", "id", "salt")


def _within(rows: DataFrame, share: int) -> DataFrame:
    """Links (a, b) that join different components of a leader's members, by exact comparison of whole sets in tiles.

    rows: (leader, id, component, n, s). In a tile only members outside its largest component are compared, each with
    all others at once; of the links between two components one leaves the task.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        tile, ids, comp, n = (pdf[c].to_numpy() for c in ("tile", "id", "component", "n"))
        none = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        names, comp, many = np.unique(comp, return_inverse=True, return_counts=True)
        if len(names) == 1 or (i != j and (tile == tile[0]).all()):
            return none
        values, flat = np.unique(np.concatenate(pdf["s"].to_numpy()), return_inverse=True)
        ends = np.concatenate(([0], np.cumsum(n)))
        mark, root, found = np.zeros(len(values), np.int64), np.arange(len(names)), []
        for k in np.flatnonzero(comp != many.argmax()):
            mark[flat[ends[k] : ends[k + 1]]] = 1
            common = np.add.reduceat(mark[flat], ends[:-1])
            mark[flat[ends[k] : ends[k + 1]]] = 0
            linked = (100 * common >= share * (n + n[k] - common)) & (root[comp] != root[comp[k]])
            for m in np.flatnonzero(linked):
                if root[comp[m]] != root[comp[k]]:
                    found.append((min(ids[k], ids[m]), max(ids[k], ids[m])))
                    root[root == root[comp[m]]] = root[comp[k]]
        return pd.DataFrame(found, columns=["a", "b"]) if found else none

    size = rows.groupBy("leader").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).alias("tiles"))
    tiled = _spread(rows, size).withColumn("tile", F.pmod(F.xxhash64("id", F.lit(3)), F.col("tiles")))
    pairs = tiled.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))
    return pairs.groupBy("leader", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of documents.

    Two documents are linked if their sets of ``shingle_words``-word shingles (A-Z lower-cased, words between ASCII white
    space) have 100 * |common| >= percent * |union|. component_id is the smallest id reachable by links, kept says that
    the row has that id. A text of fewer words is one shingle; null, empty and blank texts have n_shingles 0 and no links.
    Rows that repeat an id are one node, linked by any of their texts. A row with a null id takes part by its text: its
    component is that of its equals, else null, and it is never kept. Other columns play no part.

    Equal sets are one class from the start (128-bit sums), so copies cost one aggregation. Classes that share a band are
    first compared with the band's leader, the one of the smallest hash; near copies share it in most of their bands.
    Leaders whose members are then still in different components are gone through in tiles that hold whole sets, where
    a member of the largest component is compared only with members of others; no pairs leave a tile but one link for
    two components. Every link rests on whole sets.
    """
    sketch = materialize(sketches(documents, id_col, text_col, shingle_words), "minhash-sketch")
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    classes = materialize(sketch.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("id").alias("id"), F.min("bands").alias("bands")), "minhash-classes")
    banded = classes.where("id is not null").select("id", F.posexplode("bands").alias("band", "key"))
    order = F.struct(F.xxhash64("id"), "id")
    shared = banded.groupBy("band", "key").agg(F.count("*").alias("members"), F.min(order).alias("least")).where("members > 1")
    members = banded.join(shared.select("band", "key", "members", F.col("least.id").alias("leader")), ["band", "key"]).select("id", "leader", "members")
    members = materialize(members.groupBy("id", "leader").agg(F.max("members").alias("members")), "minhash-bands")
    # one id may stand for texts of several classes, if ids repeat
    links = None
    twice = sketch.where("id is not null").groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    if not twice.isEmpty():
        again = sketch.where("n > 0").join(twice, "id").join(classes.select("f1", "f2", "n", F.col("id").alias("rep")), ["f1", "f2", "n"])
        links = again.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))

    stars = members.where("id <> leader").select("leader", "id", _salt(F.ceil(F.col("members") / GROUP)))
    pairs = materialize(_estimated(stars, classes, percent), "minhash-pairs")
    confirmed = _confirmed(pairs, texts, shingle_words, percent)
    discard(pairs)
    links = confirmed if links is None else links.union(confirmed)
    comp = materialize(components(links), "minhash-components")
    # what shares a band shares its leader: leaders whose members are in several components are gone through in whole
    rows = members.where("members > 2").select(F.col("leader"), F.explode(F.array("id", "leader")).alias("id")).distinct()
    rows = rows.join(comp.withColumnRenamed("component", "known"), "id", "left").withColumn("component", F.coalesce("known", "id")).drop("known")
    some = rows.groupBy("leader").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("leader")
    rest = materialize(_spread(rows, some), "minhash-open")
    discard(members)
    if not rest.isEmpty():
        sets = _sets(_of(texts, rest.select("id").distinct()), shingle_words).withColumn("n", F.size("s").cast("long"))
        sets = materialize(sets.where("n > 0"), "minhash-sets")
        more = materialize(_within(rest.join(sets, "id"), percent), "minhash-links")
        discard(sets)
        comp = materialize(components(links.union(more)), "minhash-components")
    discard(rest)
    rep = sketch.join(classes.select("f1", "f2", "n", F.col("id").alias("rep")), ["f1", "f2", "n"], "left").withColumn("rep", F.coalesce("rep", "id"))
    found = rep.join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(False)).alias("kept"))


def deduplicated(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of documents, with all their columns, that near_duplicates() keeps: one of each group.

    Of rows that repeat a kept id one stays. Rows with a null id all stay, for nothing can name them.
    """
    found = near_duplicates(documents, id_col, text_col, shingle_words, percent)
    found = materialize(found.select(F.col(id_col).alias("id"), "kept"), "minhash-kept")
    gone = found.where("not kept and id is not null").select(F.col("id").alias(id_col)).distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    left = documents.join(gone, id_col, "left_anti")
    twice = found.where("kept").groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("id").alias(id_col))
    if twice.isEmpty():
        return left
    once = left.join(twice, id_col, "left_semi").dropDuplicates([id_col])
    return left.join(twice, id_col, "left_anti").unionByName(once)
