"""Problem 8: items of varying size into containers of one capacity, with little unused space.

Items of one size are alike, so the instance is the histogram of sizes: at most as many rows as the capacity, however
many documents there are. On it runs the reduction of Martello and Toth: for the largest size, a small set that provably
dominates every other way to fill its container is fixed, as many times as the counts allow, until no such set is found:
nothing, if nothing fits; one partner that fills it exactly, or is the largest where no two others fit, or is no smaller
than any two others that fit together; two partners, where no three others fit and each two that do are covered by them
(the larger one by the larger, and the smaller by the smaller or both by the larger). Then the size is released, and best
fit places what remains, largest first, again many equal items at a time. The result is a list of container patterns,
each with its number of containers. Spark ranks the documents of each size and hands the ranks out along the patterns.

An item larger than the capacity fills whole containers alone; what is left over is a part of its own, packed with the
rest. Defined results: null and empty texts have size 0 and no container (a null container_id); equal items are
ranked by doc_id; repeated ids are items of their own only if they differ in size; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrove.session import cut

CAPACITY = 4096
#: Hash buckets within which documents of one size are ranked; a window spans one size and bucket only.
BUCKETS = 1024


def smallest_sum(sizes: list[int], counts: dict[int, int], k: int) -> float:
    """The sum of the ``k`` smallest items; infinite if there are fewer."""
    total = 0
    for size in sizes:
        n = min(k, counts[size])
        total, k = total + n * size, k - n
        if not k:
            return total
    return float("inf")


def largest_pair(room: int, sizes: list[int], counts: dict[int, int], over: int = 0) -> int:
    """The greatest sum, at most ``room``, of two items that are both larger than ``over``; 0 if there is none."""
    best, low, high = 0, bisect.bisect_right(sizes, over), len(sizes) - 1
    while low <= high:
        total = sizes[low] + sizes[high]
        if total > room or (low == high and counts[sizes[low]] < 2):
            high -= 1
        else:
            best = max(best, total)
            low += 1
    return best


def dominating(room: int, sizes: list[int], counts: dict[int, int]) -> tuple[int, ...] | None:
    """The sizes of the partners that provably dominate every other way to use ``room``, empty if nothing fits, None if unproven.

    ``sizes`` are the sizes of the other items, rising, with their ``counts``. Partners dominate a way to fill the room if
    its items can be shared out to them so that none gets more than its size: then the two can be exchanged in any solution.
    """
    fitting = bisect.bisect_right(sizes, room)
    if not fitting:
        return ()
    partner = sizes[fitting - 1]
    if partner == room or smallest_sum(sizes, counts, 2) > room:
        return (partner,)
    if smallest_sum(sizes, counts, 3) <= room:
        return None
    # at most two others fit together
    if largest_pair(room, sizes, counts) <= partner:
        return (partner,)
    second = bisect.bisect_right(sizes, room - partner) - 1
    if second >= 0 and sizes[second] == partner and counts[partner] < 2:
        second -= 1
    if second < 0:
        return None
    # a pair with one item up to the second's size is covered one by one; any other must fit into the partner alone
    return (partner, sizes[second]) if largest_pair(room, sizes, counts, sizes[second]) <= partner else None


def reduce_instance(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The patterns that are fixed, with their numbers of containers; their items are taken from ``counts``.

    What makes partners dominate stays true as other items are taken away, so a pattern is fixed for as many items as there are.
    """
    sizes = sorted(counts)
    patterns: list[tuple[tuple[int, ...], int]] = []

    def take(size: int, n: int) -> None:
        counts[size] -= n
        if not counts[size]:
            del counts[size]
            sizes.pop(bisect.bisect_left(sizes, size))

    for largest in reversed(sizes.copy()):
        while n := counts.get(largest, 0):
            take(largest, 1)
            partners = dominating(capacity - largest, sizes, counts)
            if partners is None:
                counts[largest] = n
                if n == 1:
                    bisect.insort(sizes, largest)
                break
            pattern = (largest, *partners)
            counts[largest] = n
            if n == 1:
                bisect.insort(sizes, largest)
            times = min(counts[size] // pattern.count(size) for size in set(pattern))
            for size in set(pattern):
                take(size, times * pattern.count(size))
            patterns.append((pattern, times))
    return patterns


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int, bool]]:
    """Patterns (sizes in one container) with their numbers of containers, and whether the reduction fixed them."""
    counts = {s: n for s, n in histogram.items() if n > 0 and 0 < s <= capacity}
    fixed = reduce_instance(counts, capacity)
    return [(*x, True) for x in fixed] + [(*x, False) for x in best_fit(counts, capacity)]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, largest first: each item into the fullest container that has room, else into a new one."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in open_:
            bisect.insort(rooms, room)
            open_[room] = []
        open_[room].append((pattern, n))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            k = bisect.bisect_left(rooms, size)
            if k == len(rooms):
                # new containers take as many of this size as fit
                each = capacity // size
                if left >= each:
                    put(capacity - each * size, (size,) * each, left // each)
                    left %= each
                if left:
                    put(capacity - left * size, (size,) * left, 1)
                    left = 0
                continue
            room = rooms[k]
            pattern, n = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(k)
            each = room // size
            full = min(n, left // each)
            if full:
                put(room - each * size, pattern + (size,) * each, full)
                left -= full * each
            if full < n:
                if left and left < each:
                    put(room - left * size, pattern + (size,) * left, 1)
                    full, left = full + 1, 0
                if n - full:
                    put(room, pattern, n - full)
    return [x for held in open_.values() for x in held]


def patterns_of(histogram: DataFrame, capacity: int) -> DataFrame:
    """size, start, stop, base, per, fixed: ranks start..stop of a size lie, per to a container, in the containers from base on.

    ``histogram`` (size, n) has at most ``capacity`` rows, so one task solves it.
    """

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([pd.DataFrame({"size": [], "n": []}, dtype="int64"), *batches])
        base, handed, rows = 0, {}, []
        for pattern, n, fixed in pack_histogram(dict(zip(pdf["size"].tolist(), pdf["n"].tolist())), capacity):
            for size in sorted(set(pattern)):
                per, start = pattern.count(size), handed.get(size, 0)
                rows.append((size, start, start + per * n, base, per, fixed))
                handed[size] = start + per * n
            base += n
        yield pd.DataFrame(rows, columns=["size", "start", "stop", "base", "per", "fixed"])

    return histogram.repartition(1).mapInPandas(solve, "size long, start long, stop long, base long, per long, fixed boolean")


def pack(sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, part, tokens, container_id, fixed for items of doc_id and tokens; part counts an item's pieces from 0, fixed is
    whether the reduction proved the container (null where there was nothing to place)."""
    sized = cut(sized.select("doc_id", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")))
    whole = F.floor(F.col("tokens") / capacity)
    rests = sized.where(F.col("tokens") > 0).select("doc_id", whole.alias("whole"), (F.col("tokens") - whole * capacity).alias("size"))
    small = rests.where(F.col("size") > 0).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
    tally = cut(small.groupBy("size", "bucket").agg(F.count("*").alias("n")))
    histogram = tally.groupBy("size").agg(F.sum("n").alias("n"))
    slots = cut(patterns_of(histogram, capacity))
    before = tally.select("size", "bucket", (F.sum("n").over(Window.partitionBy("size").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = small.withColumn("at", F.row_number().over(Window.partitionBy("size", "bucket").orderBy("doc_id")) - 1)
    ranked = ranked.join(before, ["size", "bucket"]).select("doc_id", "whole", "size", (F.col("before") + F.col("at")).alias("rank"))
    # each size's ranges as one array: as many as patterns hold the size, a few dozen
    ranges = slots.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "base", "per", "fixed"))).alias("ranges"))
    placed = ranked.join(ranges, "size").withColumn("r", F.get(F.filter("ranges", lambda r: (r["start"] <= F.col("rank")) & (F.col("rank") < r["stop"])), F.lit(0)))
    packed = placed.select("doc_id", F.col("whole").alias("part"), F.col("size").alias("tokens"), (F.col("r.base") + F.floor((F.col("rank") - F.col("r.start")) / F.col("r.per"))).alias("container_id"), F.col("r.fixed").alias("fixed"))
    nothing = sized.where("tokens = 0").select("doc_id", F.lit(0).cast("long").alias("part"), "tokens", F.lit(None).cast("long").alias("container_id"), F.lit(None).cast("boolean").alias("fixed"))
    # the full containers of items beyond the capacity are numbered from -1 down, along the buckets
    bulk = rests.where(F.col("whole") > 0).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
    sums = bulk.groupBy("bucket").agg(F.sum("whole").alias("n"))
    sums = sums.select("bucket", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("bucket")) - F.col("n")).alias("before"))
    numbered = bulk.withColumn("run", F.sum("whole").over(Window.partitionBy("bucket").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("whole")).join(sums, "bucket")
    parts = numbered.select("doc_id", (F.col("before") + F.col("run")).alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("part"))
    full = parts.select("doc_id", "part", F.lit(capacity).cast("long").alias("tokens"), (-1 - F.col("first") - F.col("part")).alias("container_id"), F.lit(None).cast("boolean").alias("fixed"))
    return packed.unionByName(nothing).unionByName(full)


def summary(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """containers, tokens, least_containers (the bound by total size), share of space used, the fullest, and how many the reduction fixed."""
    per = packed.where("tokens > 0").groupBy("container_id").agg(F.sum("tokens").alias("used"), F.bool_or("fixed").alias("fixed"))
    return per.agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.ceil(F.sum("used") / capacity).alias("least_containers"), (F.sum("used") / (F.count("*") * capacity)).alias("used_share"), F.max("used").alias("fullest"),
        F.count(F.when(F.col("fixed"), 1)).alias("fixed_containers"),
    )
