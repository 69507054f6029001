"""How filters act together: what every order of them keeps and removes at every step, from sums of wide packed counters."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a packed field: a sum of documents, of which there are fewer than 2 ** 63, never reaches the next field.
BITS = 64
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_filters(text: Column) -> dict[str, Column]:
    """Conditions on which a text fails (null: as an empty one): A few words, B few distinct words, C many capitals, D signs."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    many, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return {"A": many < 200, "B": 100 * distinct < 50 * many, "C": 100 * capitals > 2 * F.length(text).cast("long"), "D": text.rlike("[#$%&*|]")}


def orders(letters: str) -> list[str]:
    return ["".join(p) for p in permutations(letters)]


def packed_outcomes(letters: str) -> tuple[list[int], list[int]]:
    """For each mask of failed filters (bit k: letters[k]) two big integers of fields of BITS bits, for one document of that mask.

    The first has kept, removed and redundant of each step of each order, three fields a step, and at its end for each
    filter whether it alone fails; the second has removed alone, one field a step.
    """
    bit = {c: 1 << k for k, c in enumerate(letters)}
    every, lost = [], []
    for mask in range(1 << len(letters)):
        fields, removed = [], []
        for order in orders(letters):
            gone = False
            for c in order:
                fails = bool(mask & bit[c])
                fields += [not (gone or fails), fails and not gone, fails and gone]
                removed.append(fails and not gone)
                gone |= fails
        fields += [mask == bit[c] for c in letters]
        every.append(_pack(fields))
        lost.append(_pack(removed))
    return every, lost


def _pack(fields: list[int]) -> int:
    return int.from_bytes(np.array(fields, f"<u{BITS // 8}").tobytes(), "little")


def unpack(total: int, fields: int) -> np.ndarray:
    return np.frombuffer(total.to_bytes(fields * BITS // 8, "little"), f"<u{BITS // 8}").astype(np.int64)


def masks(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", filters=text_filters, copies: str = "E") -> DataFrame:
    """(part, mask, good, toxic, n): how many documents fail just these filters; the last bit is that of ``copies``.

    Equal texts are found by their SHA-256. Rows that agree in id, text and part become one row with a count before they
    are joined, so neither copies nor repeated or missing ids gather in a task.
    """
    conditions = filters(F.col(f"`{text_col}`"))
    bits = reduce(Column.__add__, (F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions.values())), F.lit(0))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = documents.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"), bits.alias("mask"))
    rows = rows.groupBy("key", "id", "part", "mask").agg(F.count("*").alias("n"))
    first = rows.where("id is not null").groupBy("key").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    rows = rows.join(first, ["key", "id"], "left").withColumn("mask", F.col("mask") + F.when(copy, 1 << len(conditions)).otherwise(0))
    rows = rows.groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(b) for c, b in (("quality", "good"), ("toxic", "toxic"))))
    return rows.join(known, "id", "left").groupBy("part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))).agg(F.sum("n").alias("n"))


def interactions(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", filters=text_filters, copies: str = "E") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), zeros included.

    For each part, each order in which the filters may be applied and each step of it: documents kept after the step,
    removed by it, and redundant (failing its filter, but removed before); those that fail its filter alone; removed ones
    labelled good or toxic; and what its filter removes in all orders together. Filters are those of ``filters`` and, last,
    ``copies``: a document whose text equals that of any smaller id, removed or not.

    Every mask of failed filters stands for a big integer whose fields are all those outcomes; a part's integers are
    summed, each as often as documents have it, and the sums unpacked. A part has at most four rows a mask here.

    Null texts are empty; a null part is the empty string. A null id has no label and no smaller id. Rows that repeat the
    smallest id of a text aren't copies. Of repeated labels any that says good (toxic) counts; labels that are null or of
    no document count for nothing. No documents give no rows. Other columns don't matter.
    """
    letters = "".join(filters(F.lit(""))) + copies
    every, lost = packed_outcomes(letters)
    names = orders(letters)
    steps = len(names) * len(letters)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        total = good = toxic = 0
        for mask, is_good, is_toxic, n in zip(part["mask"].tolist(), part["good"].tolist(), part["toxic"].tolist(), part["n"].tolist(), strict=True):
            total += n * every[mask]
            good += n * lost[mask] * is_good
            toxic += n * lost[mask] * is_toxic
        fields = unpack(total, 3 * steps + len(letters))
        out = pd.DataFrame(fields[: 3 * steps].reshape(steps, 3), columns=list(COUNTS[:3]))
        which = np.array([letters.index(c) for order in names for c in order])
        out["unique_fails"] = fields[3 * steps :][which]
        out["good_lost"], out["toxic_lost"] = unpack(good, steps), unpack(toxic, steps)
        out["shapley"] = np.array([out["removed"].to_numpy()[which == k].sum() for k in range(len(letters))])[which]
        out.insert(0, "part", part["part"].iloc[0])
        out.insert(1, "filter_order", np.repeat(names, len(letters)))
        out.insert(2, "step", np.tile(np.arange(1, len(letters) + 1, dtype=np.int32), len(names)))
        return out

    counted = masks(documents, labels, id_col, text_col, part_col, filters, copies)
    return counted.groupBy("part").applyInPandas(run, f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in COUNTS)}")
