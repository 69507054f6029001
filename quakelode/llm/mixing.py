"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakelode.llm.shared import discard, fresh, materialize, ordered, plain_columns, running_total, word_count

#: Blocks of a source that are summed by themselves: at least so many, and rows of a block beyond that.
BLOCKS, BLOCK_ROWS = 256, 100_000
#: Bins of a histogram in the search for the last finish time, and copies that come to the driver at its end.
STEPS, LAST_COPIES = 1024, 10_000
#: Source tables up to this many rows and bytes of names are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16_000_000

RESULTS = ("size", "source_size", "target", "copies", "taken")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, k, source_size, target) from (source, source_size): ``share`` of all sizes by weight, none above ``most`` times its size.

    Sources take the weights in turn, by code point, null last. What a stopped source leaves is reshared by weight: all
    others get one level times their weight, the largest level that stopping the sources in order of cap / weight gives.
    Places and sums along both orders are taken in ranges, so any number of sources may come.
    """
    part, nth = F.col("part"), F.col("nth")
    ranked = ordered(sizes, [F.col("source").asc_nulls_last()], "part", "nth", "mixing-names").withColumns({"all": F.lit(0), "one": F.lit(1).cast("long")})
    ranked = running_total(ranked, ["all"], part, [nth], "one", "k").drop("part", "nth", "one")
    ranked = ranked.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("k") % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    filled = ordered(ranked, [F.col("cap") / F.col("w"), F.col("k")], "part", "nth", "mixing-caps")
    stopped = running_total(filled, ["all"], part, [nth], "cap", "stopped")
    stopped = running_total(stopped, ["all"], -part, [-nth], "w", "after")
    total = sizes.agg(F.coalesce(F.sum("source_size") * F.lit(float(share)), F.lit(0.0)).alias("budget"))
    level = stopped.crossJoin(F.broadcast(total)).agg(F.max((F.col("budget") - F.col("stopped")) / (F.col("after") + F.col("w"))).alias("level"))
    return filled.crossJoin(F.broadcast(level)).select("source", "k", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def _mix(documents: DataFrame, names: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """documents and, under names, what mix() adds."""
    size, source_size, target, copies, taken = names
    key, k, mark, tie, block, side_k = fresh([*documents.columns, *names], "source_key", "source_nth", "mark", "tie", "block", "side_nth")
    cuts = fresh([*documents.columns, *names, key, k, mark, tie, block, side_k], *(f"cut_{e}" for e in range(most)))
    # the order within a source: by a hash of id and text, so that neither equal ids nor null ones come together
    rows = documents.withColumn(size, word_count(F.col(f"`{text_col}`").cast("string"))).withColumn(tie, F.xxhash64(f"`{text_col}`"))
    rows = rows.withColumn(mark, F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), tie))
    slim = rows.groupBy(F.col(f"`{source_col}`").alias("source"), F.col(size).alias("size"), F.col(mark).alias("mark"), F.col(tie).alias("tie")).agg(F.count("*").alias("n"))
    slim = materialize(slim, "mixing-sizes")
    blocks = max(BLOCKS, slim.count() // BLOCK_ROWS)
    slim = slim.withColumn("block", F.pmod("mark", F.lit(blocks))).withColumn("held", F.col("size") * F.col("n"))
    sources = materialize(source_targets(slim.groupBy("source").agg(F.sum("held").alias("source_size")), weights, share, most), "mixing-sources")
    many, held = sources.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col("source").cast("string"))), F.lit(0))).first()
    small = F.broadcast if many <= BROADCAST_ROWS and held <= BROADCAST_BYTES else (lambda df: df)

    named = sources.withColumnRenamed("source", "name")
    placed = slim.join(small(named), slim["source"].eqNullSafe(named["name"])).where("size > 0 and target > 0")
    placed = materialize(running_total(placed.drop("source", "name"), ["k"], F.col("block"), [F.col("mark"), F.col("tie"), F.col("size")], "held", "before"), "mixing-places")
    each = placed.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("e", F.explode(F.array(*map(F.lit, range(most))))).withColumn("b", F.col("before") + F.col("i") * F.col("size"))
    each = each.withColumn("f", (F.col("b") + F.col("size") + F.col("e") * F.col("source_size")) / F.col("target"))
    last = _last(each.select("size", "f", "k", "b", "e"), sources.agg(F.sum("target")).first()[0] or 0.0)
    # a source's copies of an epoch are taken up to one place of its order, so its rows need no order any more
    order = ("block", "mark", "tie", "size")
    fields = ", ".join(f"{c}: long" for c in (*order, "i", "n"))
    if last is None:
        cut = sources.select("k", *(F.lit(None).cast(f"struct<{fields}>").alias(c) for c in cuts))
    else:
        until = each.where(F.struct("f", "k", "b", "e") <= last).withColumn("at", F.struct(*(F.col(c).cast("long").alias(c) for c in (*order, "i", "n"))))
        cut = until.groupBy("k").agg(*(F.max(F.when(F.col("e") == e, F.col("at"))).alias(c) for e, c in enumerate(cuts)))
    cut = materialize(cut, "mixing-cuts")
    discard(placed)
    side = sources.join(cut.withColumnRenamed("k", side_k), F.col("k") == F.col(side_k), "left").select(F.col("source").alias(key), F.col("k").alias(k), F.col("source_size").alias(source_size), F.col("target").alias(target), *cuts)
    rows = rows.withColumn(block, F.pmod(F.col(mark), F.lit(blocks))).join(small(side), F.col(f"`{source_col}`").eqNullSafe(F.col(key)))

    here = F.struct(*(F.col(c).cast("long").alias(o) for c, o in zip((block, mark, tie, size), order, strict=True)))
    ends = [F.struct(*(F.col(c)[o].alias(o) for o in order)) for c in cuts]
    wanted = (F.col(size) > 0) & (F.col(target) > 0)
    up_to = [wanted & F.coalesce((here < end) | (here == end) & (F.col(c)["i"] + 1 == F.col(c)["n"]), F.lit(False)) for c, end in zip(cuts, ends, strict=True)]
    count = lambda conditions: reduce(Column.__add__, (F.when(x, 1).otherwise(0) for x in conditions))
    split = reduce(Column.__or__, (F.coalesce(F.col(c)["i"] + 1 < F.col(c)["n"], F.lit(False)) for c in cuts))
    if cut.where(split).isEmpty():
        out = rows.withColumn(copies, count(up_to))
    else:  # of rows with one id and text some are taken and some are not, by a hash of all columns; of equal rows, whichever
        at = wanted & reduce(Column.__or__, (F.coalesce((here == end) & (F.col(c)["i"] + 1 < F.col(c)["n"]), F.lit(False)) for c, end in zip(cuts, ends, strict=True)))
        nth, one, rank, whole = fresh(rows.columns, "nth", "one", "rank", "whole")
        equal = materialize(rows.where(at).withColumn(whole, F.xxhash64(*plain_columns(documents))).withColumn(nth, F.monotonically_increasing_id()).withColumn(one, F.lit(1).cast("long")), "mixing-equal")
        equal = running_total(equal, [k, mark, tie, size], F.struct(whole, F.pmod(nth, F.lit(BLOCKS))), [F.col(nth)], one, rank)
        some = [x | wanted & F.coalesce((here == end) & (F.col(rank) <= F.col(c)["i"]), F.lit(False)) for x, c, end in zip(up_to, cuts, ends, strict=True)]
        out = rows.where(~at).withColumn(copies, count(up_to)).unionByName(equal.withColumn(copies, count(some)).drop(nth, one, rank, whole))
    return out.withColumn(copies, F.col(copies).cast("int")).withColumn(taken, F.col(copies) * F.col(size)).select(*(F.col(f"`{c}`") for c in documents.columns), *names)


def mix(documents: DataFrame, **options) -> DataFrame:
    """Adds size, source_size, target, copies and taken (copies * size) to all rows of documents.

    Options: id_col, text_col, source_col, weights, share, most, seed. size is the number of words between ASCII white
    space (null: 0). Within its source each document comes once in each of ``most`` epochs, in the order of a hash; a
    copy's virtual finish time is the words of its source up to and with it, divided by the source's target. In the
    order of finish times over all sources, copies are taken while the words fit the budget, the sum of targets; so each
    source comes within about one document of its target. Documents without words, and those of sources without any,
    have copies 0. Null ids, null sources (one source of their own), ties and repeated ids are ordered by a hash of id and
    text; of rows that have both alike, so many are taken as their places say, by a hash of all columns. No rows give none. Input columns
    named like the results are replaced.

    Texts are read twice and never moved: the first time for sizes and hashes, from which each source's last place of
    every epoch is found, the second time to compare each row's place with these.
    """
    return _mix(documents.drop(*RESULTS), RESULTS, **options)


def _last(copies: DataFrame, budget: float) -> Column | None:
    """The place (f, k, b, e) of the last copy, in that order, up to which the words fit the budget; None if none does.

    Histograms narrow the place down, by finish time, then by source and place in it where times are equal, until
    LAST_COPIES are left, which come to the driver.
    """
    place = F.struct("f", "k", "b", "e")
    rest, used = copies, 0
    while True:
        r = rest.agg(F.count("*").alias("many"), F.coalesce(F.sum("size"), F.lit(0)).alias("held"), F.max(place).alias("end"), *(g(c).alias(f"{n}_{c}") for c in "fkb" for n, g in (("lo", F.min), ("hi", F.max)))).first()
        if used + r.held <= budget:
            found = r.end
            break
        if r.many <= LAST_COPIES:
            found = None
            for *at, n in sorted(tuple(x) for x in rest.select("f", "k", "b", "e", "size").collect()):
                used += n
                if used > budget:
                    break
                found = at
            break
        c = next(c for c in "fkb" if r[f"lo_{c}"] < r[f"hi_{c}"])
        step = (r[f"hi_{c}"] - r[f"lo_{c}"]) / STEPS
        binned = F.least(F.floor((F.col(c) - F.lit(r[f"lo_{c}"])) / F.lit(step)), F.lit(STEPS - 1))
        for bin_, n in sorted(tuple(x) for x in rest.groupBy(binned).agg(F.sum("size")).collect()):
            if used + n > budget:
                rest = rest.where(binned == bin_)
                break
            used += n
    if found is None and rest is not copies:  # none of these fits: the last one before them
        first = rest.agg(F.min(place).alias("p")).first().p
        found = copies.where(place < _place(copies, first)).agg(F.max(place).alias("p")).first().p
    return None if found is None else _place(copies, found)


def _place(copies: DataFrame, values) -> Column:
    types = dict(copies.dtypes)
    return F.struct(*(F.lit(v).cast(types[c]).alias(c) for c, v in zip("fkbe", values, strict=True)))


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of documents as often as mix() takes it, with the columns of documents alone, all of them."""
    names = tuple(fresh(documents.columns, *RESULTS))
    (copy,) = fresh([*documents.columns, *names], "copy")
    out = _mix(documents, names, **options).where(F.col(names[3]) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(names[3]))))
    return out.select(*(F.col(f"`{c}`") for c in documents.columns))
