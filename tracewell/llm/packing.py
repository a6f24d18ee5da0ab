"""Items into containers of fixed capacity, by minimum bin slack (problem 7).

The packing is worked out on the histogram of item sizes, which has at most ``capacity`` entries however many items there are.
Each step seeds a container with the largest size left and fills the rest by a subset-sum over the multiset of remaining sizes:
bit sets of reachable sums, one for each size in turn, backtracked to counts.  The content found is a pattern; it is used as many
times as the counts allow, so that the number of steps depends on the sizes, not on the items.

Items are then given ranks within their size.  Ranks come from counts of (size, salt) groups and a rank inside each group, so a
size that a third of all items have is numbered by many tasks.  A step takes the next ranks of each of its sizes, so an item's
container follows from its size and rank by a binary search in a table that is bounded like the histogram.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 2_048
#: Items numbered by one task, about.
PER_TASK = 200_000


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Sizes with their numbers whose sum comes closest to ``room`` from below.  ``counts`` holds what is left of each size."""
    sizes = sorted((s for s in counts if 0 < s <= room and counts[s] > 0), reverse=True)
    mask, full = (1 << (room + 1)) - 1, 1 << room
    reach, before = 1, []
    for s in sizes:
        before.append(reach)
        left, step = min(counts[s], room // s), 1
        while left > 0:  # 1, 2, 4 ... of a size, and the rest
            take = min(step, left)
            reach |= (reach << (s * take)) & mask
            left -= take
            step *= 2
        if reach & full:
            break
    total = reach.bit_length() - 1
    out: dict[int, int] = {}
    for s, earlier in zip(reversed(sizes[: len(before)]), reversed(before)):
        n = 0
        while not (earlier >> total) & 1:  # at most counts[s] times, as the sum was reached with them
            total -= s
            n += 1
        if n:
            out[s] = n
    return out


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (size to number in a container, how many such containers) that hold every item of the histogram."""
    left = {s: n for s, n in histogram.items() if s > 0 and n > 0}
    if any(s > capacity for s in left):
        raise ValueError("an item is larger than the capacity")
    steps = []
    while left:
        seed = max(left)
        left[seed] -= 1
        pattern = best_fill(left, capacity - seed)
        left[seed] += 1
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(left[s] // n for s, n in pattern.items())
        for s, n in pattern.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        steps.append((pattern, times))
    return steps


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece_no from 1, offset, n, container): every item in a container of ``capacity``, split only if it is larger.

    A larger item is cut into pieces of ``capacity`` and a rest, which is packed like any item.  Items of size 0 or null take no
    room: they come as one piece of ``n`` 0, dealt out over all containers by rank.  Repeated keys are separate items.  Without
    items there are no rows.  Containers count from 0.  ``items`` is read three times; pass a written table or a checkpoint if it
    is dear or not deterministic.
    """
    base = items.select(F.col(key), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("_size"))
    cut = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_size") / F.lit(capacity)) - 1, F.lit(0)).cast("int"))
    pieces = base.select(key, "_size", F.explode(cut).alias("_k")).select(
        key, (F.col("_k") + 1).alias("piece_no"), (F.col("_k") * F.lit(capacity)).cast("long").alias("offset"),
        F.least(F.lit(capacity), F.col("_size") - F.col("_k") * F.lit(capacity)).cast("int").alias("n"))

    # At most capacity + 1 rows, by construction: the only thing that is gathered.
    histogram = {r["n"]: r["c"] for r in pieces.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    steps = pack_histogram(histogram, capacity)
    table: dict[int, tuple[list[int], list[int], list[int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for pattern, times in steps:
        for s, number in pattern.items():
            starts, firsts, numbers = table.setdefault(s, ([], [], []))
            starts.append(taken.get(s, 0))
            firsts.append(first)
            numbers.append(number)
            taken[s] = taken.get(s, 0) + number * times
        first += times
    containers = max(first, 1)

    salts = max(1, -(-max(histogram.values(), default=1) // PER_TASK))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(key, "piece_no"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("n", "_salt").agg(F.count(F.lit(1)).alias("_c"))
    bases = counts.select("n", "_salt", (F.sum("_c").over(Window.partitionBy("n").orderBy("_salt")) - F.col("_c")).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("n", "_salt").orderBy(key, "piece_no")) - 1
    ranked = salted.withColumn("_inside", inside).join(bases, ["n", "_salt"])
    ranked = ranked.select(key, "piece_no", "offset", "n", (F.col("_base") + F.col("_inside")).alias("_rank"))

    def place(batches: Iterable[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sizes, ranks in batches:
            out = np.empty(len(sizes), np.int64)
            for i, (s, r) in enumerate(zip(sizes.tolist(), ranks.tolist())):
                if s == 0:
                    out[i] = r % containers
                    continue
                starts, firsts, numbers = table[s]
                k = bisect_right(starts, r) - 1
                out[i] = firsts[k] + (r - starts[k]) // numbers[k]
            yield pd.Series(out)

    place.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return ranked.select(key, "piece_no", "offset", "n", F.pandas_udf(place, "long")("n", "_rank").alias("container"))
