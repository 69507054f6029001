"""Distance to the nearest of many line segments, by squares of the plane that grow finer."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakelode.functions.geo import albers_xy, to_segment_m
from quakelode.operators.names import fresh

#: Squares have sides of 2 ** bits metres: one that holds the whole projected Earth, then about thousand kilometres.
WHOLE, COARSE = 26, 20
#: Bits by which squares shrink from one level to the next below that, and those of the finest that may be.
STEP, FINEST = 2, 8
#: Segments that a square may well hold: fewer of them aren't worth another level.
IN_SQUARE = 16
#: Rows (square of points, segment) that are broadcast, some 5 MB.
BROADCAST_ROWS = 100_000
#: Added to projected metres, so that numbers of squares begin at 0.
SHIFT_M = float(1 << (WHOLE - 1))


def _levels(segments: DataFrame) -> list[int]:
    """Bits of the sides of the squares, from the whole plane to the finest: many segments in little space need fine ones."""
    n, *ends = segments.agg(F.count("*"), *(g(c) for c in ("x1", "y1", "x2", "y2") for g in (F.min, F.max))).first()
    if not n:
        return []
    wide = max(max(ends[1], ends[5]) - min(ends[0], ends[4]), max(ends[3], ends[7]) - min(ends[2], ends[6]), 1.0)
    leaf = max(FINEST, min(COARSE, round(math.log2(wide / max(1.0, n / IN_SQUARE) ** 0.7))))
    return sorted({WHOLE, *range(COARSE, leaf, -STEP), leaf}, reverse=True)


def _square(metres: Column, bits: int) -> Column:
    return F.floor((metres + SHIFT_M) / float(1 << bits)).cast("long")


def segment_squares(segments: DataFrame, bits: int) -> DataFrame:
    """segments with bx and by: a row for each square that a segment passes through, column by column along it."""
    side = float(1 << bits)
    left, right = F.least("x1", "x2"), F.greatest("x1", "x2")
    out = segments.withColumn("bx", F.explode(F.sequence(_square(left, bits), _square(right, bits))))
    slope = F.when(F.col("x1") == F.col("x2"), F.lit(0.0)).otherwise((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")))
    # where the segment enters and leaves the column; of an upright one, its ends
    edges = [F.least(right, F.greatest(left, (F.col("bx") + d) * side - SHIFT_M)) for d in (0, 1)]
    at = [F.when(F.col("x1") == F.col("x2"), own).otherwise(F.col("y1") + (edge - F.col("x1")) * slope) for edge, own in zip(edges, (F.col("y1"), F.col("y2")), strict=True)]
    return out.withColumn("by", F.explode(F.sequence(_square(F.least(*at), bits), _square(F.greatest(*at), bits))))


def near_squares(points: DataFrame, segments: DataFrame, levels: list[int]) -> DataFrame:
    """(ax, ay, bx, by): for each square (ax, ay) of points the squares of segments that may hold its points' nearest one.

    Both are numbered at the last level. From the whole plane down, the pairs of one level are joined with the squares that
    lie within them at the next. A square of points is no farther from some segment than the distance of middles and a
    diagonal together, and from those of another square no nearer than that distance without the diagonal; so pairs stay
    whose middles are at most two diagonals farther apart than the nearest pair's.
    """
    leaf, before, pairs = levels[-1], levels[0], None
    points, segments = points.select("ax", "ay").distinct(), segments.select("bx", "by").distinct()
    for bits in levels:
        a, b = (df.select(*(F.shiftright(c, bits - leaf).alias(c) for c in df.columns)) for df in (points, segments))
        a, b = (a.distinct(), b.distinct()) if bits > leaf else (a, b)
        if pairs is None:  # one square each, that of the whole plane
            pairs = a.join(b, (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by")))
        else:
            inner = [x.select(*(F.shiftright(c, before - bits).alias(f"{c}_") for c in own), *own) for x, own in ((a, ("ax", "ay")), (b, ("bx", "by")))]
            outer = pairs.select(*(F.col(c).alias(f"{c}_") for c in ("ax", "ay", "bx", "by")))
            pairs = outer.join(inner[0], ["ax_", "ay_"]).join(inner[1], ["bx_", "by_"]).select("ax", "ay", "bx", "by")
            apart = F.hypot((F.col("ax") - F.col("bx")).cast("double"), (F.col("ay") - F.col("by")).cast("double"))
            least = F.min("apart").over(Window.partitionBy("ax", "ay"))
            pairs = pairs.withColumn("apart", apart).withColumn("least", least).where(F.col("apart") <= F.col("least") + 2 * math.sqrt(2) + 1e-6).drop("apart", "least")
        before = bits
    return pairs


def nearest_line_km(points: DataFrame, segments: DataFrame, key: list[str], name: str, buffer_km: float = 0.0, digits: int | None = None) -> DataFrame:
    """Adds the planar distance to the nearest segment (x1, y1, x2, y2 in projected metres), less the buffer and at least 0.

    Points meet only segments in squares that may hold their nearest one (near_squares), whatever the number of either;
    which squares of points meet which segments is written down first, and broadcast if it has BROADCAST_ROWS rows at most.
    Points without a place, and all points where there is no segment, get null.
    """
    from quakelode.sources.catalog import written

    ends = ["x1", "y1", "x2", "y2"]
    lines = segments.select(*ends).where(reduce(Column.__and__, (F.col(c).isNotNull() & ~F.isnan(c) for c in ends)))
    levels = _levels(lines)
    if not levels:
        return points.withColumn(name, F.lit(None).cast("double"))
    x, y = albers_xy(F.col("latitude"), F.col("longitude"))
    own = fresh(ends + ["ax", "ay", "bx", "by", "km"], *(f"key{k}" for k in range(len(key))))
    placed = points.where(reduce(Column.__and__, (F.col(c).isNotNull() & ~F.isnan(c) for c in ("latitude", "longitude"))))
    placed = placed.select(*(F.col(c).alias(o) for c, o in zip(key, own, strict=True)), x.alias("px"), y.alias("py"))
    # never null, so that no test for null, with the whole projection in it, is pushed down to each scan
    placed = placed.withColumns({a: F.coalesce(_square(F.col(p), levels[-1]), F.lit(0)) for a, p in (("ax", "px"), ("ay", "py"))})
    held = segment_squares(lines, levels[-1])
    near = written(near_squares(placed, held, levels).join(held, ["bx", "by"]).drop("bx", "by").distinct(), "near-lines")
    met = placed.join(F.broadcast(near) if near.count() <= BROADCAST_ROWS else near, ["ax", "ay"])
    least = F.min(to_segment_m(F.col("px"), F.col("py"), *(F.col(c) for c in ends))) / 1000 - buffer_km
    near = met.groupBy(*own).agg(F.greatest(F.lit(0.0), least).alias("km"))
    if digits is not None:
        near = near.withColumn("km", F.round("km", digits))
    near = near.select(*(F.col(o).alias(c) for c, o in zip(key, own, strict=True)), F.col("km").alias(name))
    return points.join(near, key, "left")
