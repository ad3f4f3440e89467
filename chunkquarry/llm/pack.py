"""Filling fixed-capacity containers with items.

Items of the same size are interchangeable, so the packing is planned on the histogram of sizes, which has at most
``capacity`` rows whatever the number of items: items above a third of the capacity (at most two of them fit into one
container) are matched greedily, the largest with the largest that still fits; smaller ones, in falling size, fill the
smallest gap they fit into, many containers of the same filling at a time. A plan line says which ranks of a size go to
which containers. Every item gets its rank within its size from salted windows (a hot size is many windows) and looks
its container up. An item above the capacity is cut into full pieces and a rest; nothing else is divided.

Items of size 0 go to container 0 and take no room there. Items without id or size are no items. An id that comes twice
is two items of its own. Equal sizes are taken in the order of ids within a salt.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import buckets_for


class _Gaps:
    """Ranges of containers by what is left in them."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in self.ranges:
                insort(self.sizes, gap)
                self.ranges[gap] = []
            self.ranges[gap].append((first, count))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """(gap, first, count) of a range with the smallest sufficient gap."""
        i = bisect_left(self.sizes, least)
        if i == len(self.sizes):
            return None
        gap = self.sizes[i]
        first, count = self.ranges[gap].pop()
        if not self.ranges[gap]:
            del self.ranges[gap], self.sizes[i]
        return gap, first, count


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Lines (size, first rank, first container, items a container), and the number of containers."""
    left = {s: n for s, n in counts.items() if n > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("a size is out of range")
    used, lines, bins, gaps = {s: 0 for s in left}, [], 0, _Gaps()

    def place(size: int, copies: int, first: int, count: int) -> None:
        lines.append((size, used[size], first, copies))
        used[size] += copies * count
        left[size] -= copies * count

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        i = bisect_right(large, capacity - a) - 1
        if i >= 0 and large[i] == a and left[a] == 1:
            i -= 1
        if i < 0:
            count = left[a]
            place(a, 1, bins, count)
            gaps.add(capacity - a, bins, count)
        else:
            b = large[i]
            count = left[a] // 2 if a == b else min(left[a], left[b])
            place(a, 2 if a == b else 1, bins, count)
            if a != b:
                place(b, 1, bins, count)
                if not left[b]:
                    large.remove(b)
            gaps.add(capacity - a - b, bins, count)
        bins += count
        if not left[a]:
            large.remove(a)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            gap, first, count = gaps.take(s) or (capacity, bins, 1 << 60)
            fresh = first == bins
            copies = min(gap // s, left[s])
            count = min(count, left[s] // copies) if fresh else count
            filled = min(count, left[s] // copies)
            place(s, copies, first, filled)
            gaps.add(gap - copies * s, first, filled)
            if fresh:
                bins += filled
            else:
                gaps.add(gap, first + filled, count - filled)
    return lines, bins


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """container, piece, start, size for every item (id bigint, size bigint; other columns ignored) or piece of one."""
    if capacity < 1:
        raise ValueError("a capacity is at least 1")
    cut = items.where("id is not null and size >= 0").select("id", F.col("size").cast("long").alias("whole"))
    last = F.greatest(F.expr(f"(whole - 1) div {capacity}"), F.lit(0))
    parts = cut.select("id", "whole", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(
        "id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("whole") - F.col("piece") * capacity).alias("size")
    )
    salts = buckets_for(items)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).cast("int"))
    by_salt = salted.groupBy("size", "salt").agg(F.count("*").alias("n"))
    histogram = {r.size: r.n for r in by_salt.groupBy("size").agg(F.sum("n").alias("n")).where("size > 0").collect()}  # at most capacity rows
    lines, _ = plan(histogram, capacity)
    table: dict[int, tuple[np.ndarray, ...]] = {}
    frame = pd.DataFrame(lines, columns=["size", "rank", "first", "copies"])
    for size, g in frame.groupby("size"):
        g = g.sort_values("rank")
        table[int(size)] = tuple(g[c].to_numpy(np.int64) for c in ("rank", "first", "copies"))
    handle = items.sparkSession.sparkContext.broadcast(table)  # bounded by the capacity

    @F.pandas_udf("long")
    def container(size: pd.Series, rank: pd.Series) -> pd.Series:
        out, sizes, ranks = np.zeros(len(size), dtype=np.int64), size.to_numpy(), rank.to_numpy()
        for s in np.unique(sizes):
            if s:
                at = np.flatnonzero(sizes == s)
                ranks_from, first, copies = handle.value[int(s)]
                i = np.searchsorted(ranks_from, ranks[at], side="right") - 1
                out[at] = first[i] + (ranks[at] - ranks_from[i]) // copies[i]
        return pd.Series(out)

    before = W.partitionBy("size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = by_salt.select("size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(W.partitionBy("size", "salt").orderBy("id", "piece")) - 1
    ranked = salted.withColumn("within", rank).join(offsets, ["size", "salt"])
    return ranked.select("id", "piece", "start", "size", container("size", F.col("offset") + F.col("within")).alias("container"))
