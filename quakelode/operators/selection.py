"""Exact percentiles of groups of any size: ranks over ranges of values, so that no group is held or sorted in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakelode.operators.names import fresh


def percentiles(df: DataFrame, by: Sequence[str], columns: dict[str, Column], points: Sequence[float]) -> DataFrame:
    """(by, and for each name of columns an array of its exact percentiles at the points), as ``percentile`` gives them.

    Between two values the percentile is interpolated; nulls don't count, and a group without values has null. All columns
    are ranked at once: equal values are counted, dealt to ranges of (group, column, value) that are written, summed by
    range, and only then counted up within each range. A group spreads over as many ranges as its distinct values ask.
    """
    from quakelode.sources.catalog import written

    taken = [*by, *columns]
    which, value, n, part, before, total, upto = fresh(taken, "which", "value", "n", "part", "before", "total", "upto")
    keys = [*by, which]
    pairs = F.array(*(F.struct(F.lit(k).alias(which), c.cast("double").alias(value)) for k, c in enumerate(columns.values())))
    counted = df.select(*by, F.inline(pairs)).where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias(n))
    ranged = written(counted.repartitionByRange(*keys, value).withColumn(part, F.spark_partition_id()), "percentiles")
    # a row a group and range: where a group's values begin in each range, and how many it has in all
    w = Window.partitionBy(*keys)
    sums = ranged.groupBy(*keys, part).agg(F.sum(n).alias(total))
    sums = sums.select(*keys, part, (F.sum(total).over(w.orderBy(part)) - F.col(total)).alias(before), F.sum(total).over(w).alias(total))
    same = reduce(Column.__and__, (F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in (*keys, part)))
    rows = ranged.alias("a").join(sums.alias("b"), same).select(*(F.col(f"a.`{c}`") for c in (*keys, part, value, n)), before, total)
    rows = rows.withColumn(upto, F.col(before) + F.sum(n).over(Window.partitionBy(*keys, part).orderBy(value)))
    at = lambda rank: F.max(F.when((F.col(upto) - F.col(n) <= rank) & (rank < F.col(upto)), F.col(value)))
    ends, out = [], []
    for k, p in enumerate(points):
        place = F.lit(float(p)) * (F.col(total) - 1)
        ends += [at(F.floor(place)).alias(f"lo{k}"), at(F.ceil(place)).alias(f"hi{k}"), F.max(place).alias(f"place{k}")]
        lo, hi, place = F.col(f"lo{k}"), F.col(f"hi{k}"), F.col(f"place{k}")
        out.append(F.when(lo == hi, lo).otherwise((F.ceil(place) - place) * lo + (place - F.floor(place)) * hi))
    found = rows.groupBy(*keys).agg(*ends).select(*keys, F.array(*out).alias(value))
    return found.groupBy(*by).agg(*(F.max(F.when(F.col(which) == k, F.col(value))).alias(name) for k, name in enumerate(columns)))
