"""Packing documents into sequences of fixed length by bin completion over the histogram of piece lengths."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quakelode.llm.encode import encoded, grouped
from quakelode.llm.shared import materialize

Pattern = tuple[tuple[int, int], ...]  # (length, how many of it) in one sequence, longest first
#: Fillings and nodes that the branch and bound looks at; beyond them the best solution so far stands.
STEPS = 20_000
#: Fractions of a sequence to which the lower bound rounds lengths down.
ROUNDED = 24
#: Offsets of (task, length) up to this many rows (20 MB) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000


class Plan(NamedTuple):
    patterns: list[tuple[Pattern, int]]  # and how many sequences are filled by each
    sequences: int
    bound: int  # no plan has fewer
    steps: int = 0  # fillings that the search looked at


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs.

    For each k, items over capacity - k take one each and waste what fits nothing of k or more. And for each k up to ROUNDED,
    an item of more than a (k+1)-th of the capacity counts as a whole number of k-ths of a sequence, rounded down (exact
    multiples count as they are): the items of one sequence then never count as more than one.
    """
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[int(s)] for s in sizes], object)
    held = [int(x) for x in np.concatenate(([0], np.cumsum(sizes * n)))]
    many = [int(x) for x in np.concatenate(([0], np.cumsum(n)))]
    best = -(-held[-1] // capacity)
    at = lambda x, side: int(np.searchsorted(sizes, x, side))
    for k in [int(s) for s in sizes if 2 * s <= capacity]:
        a, b, c = at(capacity - k, "right"), at(capacity // 2, "right"), at(k, "left")
        large, middle = many[-1] - many[a], many[a] - many[b]
        small, free = held[b] - held[c], middle * capacity - (held[a] - held[b])
        best = max(best, large + middle + max(0, -(-(small - free) // capacity)))
    for k in range(1, ROUNDED + 1):
        parts = sum(m * (k * s if (k + 1) * s % capacity == 0 else (k + 1) * s // capacity * capacity) for s, m in zip(map(int, sizes), n, strict=True))
        best = max(best, -(-parts // (k * capacity)))
    large = many[-1] - many[at(capacity // 2, "right")]
    return max(best, large)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over equal items at once: sequences of one history are one group, of which a length splits off two at most."""
    groups: list[list[tuple[Pattern, int]]] = [[] for _ in range(capacity + 1)]
    for size in sorted(counts, reverse=True):
        left = counts[size]
        for room in range(size, capacity + 1):
            if not left or not groups[room] and room < capacity:
                continue
            have = groups[room] if room < capacity else [((), -(-left // (capacity // size)))]
            keep = []
            for pattern, n in have:
                each = room // size
                full = min(n, left // each)
                if full:
                    groups[room - each * size].append(((*pattern, (size, each)), full))
                    left, n = left - full * each, n - full
                if n and left:  # fewer than one sequence takes
                    groups[room - left * size].append(((*pattern, (size, left)), 1))
                    left, n = 0, n - 1
                if n:
                    keep.append((pattern, n))
            if room < capacity:
                groups[room] = keep + [g for g in groups[room] if g not in have and g not in keep]
    return [g for room in groups for g in room if g[0]]


def _reached(sizes: list[int], count: list[int], room: int) -> list[int]:
    """For each k, the sums up to room (as bits) of items among the k smallest sizes, each as often as it is there."""
    out, mask = [1], (1 << room + 1) - 1
    for s in sizes:
        sums, left, part = out[-1], min(count[s], room // s), 1
        while left:
            part = min(part, left)
            sums |= sums << s * part & mask
            left, part = left - part, 2 * part
        out.append(sums)
    return out


def _exact(sizes: list[int], reached: list[int], count: list[int], k: int, room: int) -> Iterator[Pattern]:
    """All ways to fill room without waste from the k smallest sizes, those with the largest items first."""
    if not room:
        yield ()
        return
    for i in range(min(k, bisect_right(sizes, room)) - 1, -1, -1):
        if not reached[i + 1] >> room & 1:
            return
        s = sizes[i]
        for n in range(min(count[s], room // s), 0, -1):
            if reached[i] >> room - n * s & 1:
                for rest in _exact(sizes, reached, count, i, room - n * s):
                    yield ((s, n), *rest)


def _dominated(filling: Pattern, waste: int, count: list[int], there: int) -> bool:
    """Whether a size left out (of those in the bits ``there``) could take the place of some items within the waste.

    Then the other way leaves smaller items over and wastes less.
    """
    one, two = 0, 0  # sums of one item or more, of two or more
    for s, n in filling:
        if count[s] == n:
            there &= ~(1 << s)
        for _ in range(n):
            two |= (two | one) << s
            one |= one << s | 1 << s
    return bool(two & there) or any((one | 1) << w & there for w in range(1, waste + 1))


def _perfect(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Sequences of one piece or two equal to the capacity; some plan with the fewest sequences has them all.

    What stands beside the two pieces of such a pair in other sequences fits into one.
    """
    found: list[tuple[Pattern, int]] = []
    for s in sorted(counts, reverse=True):
        other = capacity - s
        if not other:
            found.append((((s, 1),), counts[s]))
        elif s > other and other in counts:
            found.append((((s, 1), (other, 1)), min(counts[s], counts[other])))
        elif s == other and counts[s] > 1:
            found.append((((s, 2),), counts[s] // 2))
    return found


def bin_completion(counts: dict[int, int], capacity: int, steps: int = STEPS) -> Plan:
    """Fills sequences around the largest item left, by branch and bound; the best-fit plan is the first incumbent.

    counts: how many pieces have each length from 1 to capacity. Perfect pairs are fixed, the search is on the rest. The
    fillings around an item come one by one, of any number of items, those that waste least first, and each as often as
    the counts allow, then less often; so the first way down follows the number of lengths and not that of pieces, and
    without a limit no plan is left out. A branch ends where the waste so far exceeds what a plan with one sequence less
    may waste; the search ends at the lower bound or when ``steps`` fillings and nodes have been looked at, at some 2 ms
    each. Where it doesn't reach the bound, Plan tells both.
    """
    counts = {int(s): int(n) for s, n in counts.items() if n}
    best, bound = best_fit(counts, capacity), lower_bound(counts, capacity)
    fewest, total, spent = sum(n for _, n in best), sum(s * n for s, n in counts.items()), 0
    if fewest == bound:
        return Plan(best, fewest, bound)
    plan = _perfect(counts, capacity)
    count, there = [0] * (capacity + 1), 0
    for s, n in counts.items():
        count[s] = n
    for pattern, n in plan:
        for s, k in pattern:
            count[s] -= n * k
    for s in counts:
        there |= (count[s] > 0) << s
    wasted, nodes = 0, 0

    def move(pattern: Pattern, n: int) -> None:
        nonlocal there
        for s, k in pattern:
            count[s] -= n * k
            there = there | 1 << s if count[s] else there & ~(1 << s)

    def fillings(largest: int, sizes: list[int], reached: list[int]) -> Iterator[tuple[Pattern, int, int]]:
        """(pattern, times, waste of one): what may come next; counts are the same again each time it goes on."""
        nonlocal spent
        room, waste = capacity - largest, 0
        while waste <= min(room, (fewest - 1) * capacity - total - wasted):
            rest = [*count]
            rest[largest] -= 1
            left = there if rest[largest] else there & ~(1 << largest)
            for filling in _exact(sizes, reached, rest, len(sizes), room - waste):
                spent += 1
                if spent > steps:
                    return
                if not _dominated(filling, waste, rest, left):
                    own = sum(n for s, n in filling if s == largest)
                    pattern = ((largest, own + 1), *(x for x in filling if x[0] != largest))
                    most = min(count[s] // n for s, n in pattern)
                    for times in range(most, 0, -1):
                        if wasted + times * waste <= (fewest - 1) * capacity - total:
                            yield pattern, times, waste
            waste += 1

    def node(below: int, sizes: list[int], reached: list[int]) -> tuple[int, list[int], list[int], Iterator]:
        largest = below
        while not count[largest]:
            largest -= 1
        if largest != below:  # the sums of the node above, where counts were greater, still hold for the same item
            room = capacity - largest
            sizes = [s for s in range(1, min(room, largest) + 1) if count[s]]
            reached = _reached(sizes, count, room)
        return largest, sizes, reached, fillings(largest, sizes, reached)

    taken: list[tuple[Pattern, int, int]] = []
    stack = [node(capacity, [], [])] if there else []
    if not there:
        best, fewest = plan, sum(n for _, n in plan)
    while stack and fewest > bound and spent <= steps:
        largest, sizes, reached, ways = stack[-1]
        if len(taken) == len(stack):  # back from the node below
            pattern, times, waste = taken.pop()
            move(pattern, -times)
            wasted -= times * waste
        way = next(ways, None)
        if way is None:
            stack.pop()
            continue
        pattern, times, waste = way
        taken.append(way)
        move(pattern, times)
        wasted += times * waste
        nodes, spent = nodes + 1, spent + 1
        so_far = sum(n for _, n in plan) + sum(n for _, n, _ in taken) if not there or nodes & nodes - 1 == 0 else 0
        if not there:
            best, fewest = plan + [w[:2] for w in taken], so_far
        else:
            if nodes & nodes - 1 == 0:  # what is left, by best fit: a full solution now and then
                rest = best_fit({s: n for s, n in enumerate(count) if n}, capacity)
                if (n := so_far + sum(k for _, k in rest)) < fewest:
                    best, fewest = plan + [w[:2] for w in taken] + rest, n
            stack.append(node(largest, sizes, reached))
    return Plan(best, fewest, bound, min(spent, steps))


def _places(plan: Plan) -> dict[str, np.ndarray]:
    """For each length, runs of its pieces by rank: where a run begins, its first sequence, first offset and pieces a sequence."""
    used: dict[int, int] = {}
    runs, sequence = [], 0
    for pattern, n in plan.patterns:
        offset = 0
        for length, each in pattern:
            runs.append((length, used.get(length, 0), sequence, offset, each))
            used[length] = used.get(length, 0) + n * each
            offset += length * each
        sequence += n
    runs.sort()
    return dict(zip(("length", "rank", "sequence", "offset", "each"), np.array(runs, np.int64).reshape(-1, 5).T, strict=True))


def pieces(documents: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids, task, nth): each text's ids and the end id, cut where they exceed capacity.

    ids is binary, little-endian unsigned 32-bit; nth counts pieces of a length within the task that encoded them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, end = TaskContext.get().partitionId(), {}, end_id.to_bytes(4, "little")
        for batch in batches:
            for first, texts in grouped(batch.column(1)):
                at, piece, start, length, ids, nth = [], [], [], [], [], []
                for k, got in enumerate(encoded(texts, tokenizer_path)):
                    whole = got + end
                    for p, s in enumerate(range(0, len(whole), 4 * capacity)):
                        n = min(len(whole) - s, 4 * capacity) // 4
                        at.append(first + k)
                        piece.append(p)
                        start.append(s // 4)
                        length.append(n)
                        ids.append(whole[s : s + 4 * n])
                        nth.append(seen.get(n, 0))
                        seen[n] = nth[-1] + 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array([task] * len(at), pa.int64()), pa.array(nth, pa.int64())], names=["doc_id", "piece", "start", "length", "ids", "task", "nth"])

    src = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, task long, nth long")


def pack(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) for each piece of each document.

    Null and empty texts are the end id alone. Repeated rows and null ids are packed like others; ties between pieces of
    one length are broken by where they were encoded; no rows give no pieces. Other columns play no part.

    Only the histogram of lengths (at most ``capacity`` rows) comes to the driver, which plans on it; pieces find their
    place by their rank within their length, from counts of (task, length), and are never moved.
    """
    spark = documents.sparkSession
    cut = materialize(pieces(documents, id_col, text_col, capacity, end_id, tokenizer_path), "packing-pieces")
    counts = materialize(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "packing-counts")
    plan = bin_completion({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    runs = spark.sparkContext.broadcast(_places(plan))

    @F.arrow_udf(LongType())
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        """The sequence times the capacity, and the offset: ids themselves stay out of Python."""
        r = runs.value
        length, rank = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (length, rank))
        at = np.searchsorted((r["length"] << 44) + r["rank"], (length << 44) + rank, "right") - 1
        past = rank - r["rank"][at]
        return pa.array((r["sequence"][at] + past // r["each"][at]) * capacity + r["offset"][at] + past % r["each"][at] * length)

    before = counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    before = F.broadcast(before) if counts.count() <= BROADCAST_ROWS else before
    ranked = cut.join(before, ["task", "length"]).withColumn("place", place("length", F.col("before") + F.col("nth")))
    return ranked.select("doc_id", "piece", "start", "length", "ids", F.expr(f"place div {capacity}").alias("sequence_id"), (F.col("place") % capacity).alias("offset"))
