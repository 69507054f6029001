"""What several operators of this subpackage use: the shared folder, word hashing over Arrow buffers, prefix sums."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Text bytes that a Python worker expands to NumPy arrays at a time; one longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; on one machine, where none is set, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and survives the loss of any executor."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that materialize() made and nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """names, each with underscores in front until it clashes with no column (Spark resolves names without case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def plain_columns(df: DataFrame) -> list[Column]:
    """The columns of df in a form that can be hashed and sorted: what holds a map becomes JSON."""
    return [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t else F.col(f"`{c}`") for c, t in df.dtypes]


def ordered(df: DataFrame, order: list[Column], part: str, nth: str, label: str) -> DataFrame:
    """df in the shared folder with two columns that give its rows' order: part (ranges of it, one a task) and, through all, nth."""
    return materialize(df.orderBy(*order).withColumn(part, F.spark_partition_id()).withColumn(nth, F.monotonically_increasing_id()), label)


def running_total(df: DataFrame, keys: list[str], block: Column, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one within ``keys``, in the order of (block, order).

    Two levels, so that no key is sorted in one task: totals by block are summed first, then each block by itself.
    Keys, block and value must not be null, and the order must leave ties only between equal rows.
    """
    b, before, total = fresh([*df.columns, out], "block", "before", "total")
    rows = df.withColumn(b, block)
    totals = rows.groupBy(*keys, b).agg(F.sum(value).alias(total))
    totals = totals.select(*keys, b, (F.sum(total).over(Window.partitionBy(*keys).orderBy(b)) - F.col(total)).alias(before))
    inner = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(totals, [*keys, b]).withColumn(out, F.col(before) + F.sum(value).over(inner) - F.col(value)).drop(b, before)


# ---- words ----------------------------------------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        grown = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        grown[0] = 1
        with np.errstate(over="ignore"):
            got = np.multiply.accumulate(grown)
        if n > 4 * CHUNK_BYTES:
            return got  # not kept: one very long text
        _powers[name] = got
    return _powers[name]


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of its rows and the end) for runs of rows of about CHUNK_BYTES; null texts are empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        last = min(last, n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, other bytes as they are."""
    return data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in data, and for each row the number of words before it (and the end)."""
    n = len(data)
    inside = np.ones(n + 1, bool)
    inside[:n] = (data != 32) & ((data < 9) | (data > 13))
    inside[n] = False
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (edge | ~before))
    ends = np.flatnonzero(before & (edge | ~inside))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words: differences of one running polynomial, shifted to position 0, then mixed."""
    n = len(data)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n + 1, "up")[:n], out=total[1:])
        return mix((total[ends] - total[starts]) * _power(_INVERSE, n + 1, "down")[starts])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles of ``size`` words; a shorter row is one shingle, an empty one none."""
    data = lowered(data)
    starts, ends, first = words_of(data, offsets)
    w = word_hashes(data, starts, ends)
    with np.errstate(over="ignore"):
        rolled = w[: max(0, len(w) - size + 1)].copy()
        for k in range(1, size):
            rolled = mix(rolled * np.uint64(0xC2B2AE3D27D4EB4F) + w[k : k + len(rolled)])
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            s = np.sort(rolled[a : b - size + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            one = w[a : a + 1].copy()
            for k in range(a + 1, b):
                one = mix(one + w[k : k + 1], int(b - a))
            yield mix(one, int(b - a))
        else:
            yield np.zeros(0, np.uint64)


@F.arrow_udf(LongType())
def word_count(texts: pa.Array) -> pa.Array:
    """Words [^\\x20\\x09-\\x0D]+ of each text; 0 for null."""
    counts = [np.diff(words_of(data, offsets)[2]) for _, data, offsets in text_chunks(texts)]
    return pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())
