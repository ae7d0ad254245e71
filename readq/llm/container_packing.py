"""Filling fixed-capacity containers with items (problem 9).

Only the histogram of sizes (at most one number for each size up to the capacity) decides how containers are filled.
Patterns of few items that fill a container exactly are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares and rounded, and what is left over is packed best fit first, largest sizes first. For containers
that hold many items, the same is done for half a container, a quarter and so on: a half that is filled exactly is an item
of its own. The outcome is a plan over (size, number within the size); the items are numbered by a two-level count and get
their container from the plan, so neither items nor containers are gathered anywhere.

Defined results: an item larger than the capacity is cut into whole containers and a rest, which is packed as an item; nothing
else is cut. Items of size 0 (null and empty texts) take no room and are spread over the containers; if there is no
other item, they share container 0. Null sizes count as 0. A capacity below 1 raises an error. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Of a filling, about so many patterns of three items are enumerated: those whose smallest item is one of the commonest sizes.
PATTERNS = 1_000_000
#: Fillings smaller than this are not tried.
LEAST_FILLING = 64
#: A capacity above this is refused, as the plan is held by the driver.
MAX_CAPACITY = 1 << 20


def exact_patterns(counts: np.ndarray, total: int) -> np.ndarray:
    """Rows of three sizes (0: none) that add up to the total, each combination once. counts[s]: number of items of size s."""
    sizes = np.flatnonzero(counts[: total + 1])
    sizes = sizes[sizes > 0]
    there = np.zeros(total + 1, dtype=bool)
    there[sizes] = True
    first = sizes[(sizes * 2 <= total)]
    pairs = first[there[total - first]]
    rows = [np.stack([np.zeros_like(pairs), pairs, total - pairs], 1)]
    smallest = sizes[sizes * 3 <= total]
    for a in smallest[np.argsort(-counts[smallest], kind="stable")][: max(1, PATTERNS // max(1, len(sizes)))]:
        b = sizes[(sizes >= a) & (sizes * 2 <= total - a)]
        b = b[there[total - a - b]]
        rows.append(np.stack([np.full_like(b, a), b, total - a - b], 1))
    return np.concatenate(rows)


def fit_counts(patterns: np.ndarray, counts: np.ndarray, steps: int = 300) -> np.ndarray:
    """Non-negative least squares: how often to repeat each pattern so that their items come close to the histogram. Multiplicative
    steps keep the numbers non-negative and never increase the squared error."""
    n, m = len(patterns), len(counts)
    used = patterns > 0
    uses = lambda x: np.bincount(patterns[used], weights=np.repeat(x[:, None], 3, 1)[used], minlength=m)
    back = lambda v: (v[patterns] * used).sum(1)
    x = np.full(n, counts.sum() / max(1, 3 * n))
    want = back(counts.astype(float))
    for _ in range(steps):
        x *= want / np.maximum(back(uses(x)), 1e-12)
    return x


class PackingPlan:
    """Where the i-th item of each size goes. Rows: (size, from, to, each, inner size, first): items from..to-1, `each` of them at a
    time, go to the units numbered from `first`; a unit is a container (inner size 0) or an exactly filled part of that size."""

    def __init__(self, histogram: np.ndarray, capacity: int):
        """histogram[s]: number of items of size s, for s up to the capacity; size 0 is not packed."""
        if not 0 < capacity <= MAX_CAPACITY:
            raise ValueError(f"the capacity must lie between 1 and {MAX_CAPACITY}")
        self.capacity = capacity
        self.there = np.zeros(capacity + 1, dtype=np.int64)
        self.there[: len(histogram)] = histogram
        self.there[0] = 0
        self.next = np.zeros(capacity + 1, dtype=np.int64)
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.containers = 0
        self._fit(capacity, 1)
        part, times = capacity // 2, 2
        while part >= LEAST_FILLING:
            self._fit(part, times)
            part, times = part // 2, times * 2
        self._best_fit()
        table = np.array(sorted(self.rows), dtype=np.int64).reshape(-1, 6)
        self.size, self.start, self.end, self.each, self.inner, self.first = table.T

    def _take(self, size: int, number: int, each: int, inner: int, first: int) -> None:
        at = int(self.next[size])
        self.rows.append((size, at, at + number, each, inner, first))
        self.next[size] += number

    def _left(self) -> np.ndarray:
        return self.there - self.next

    def _fit(self, part: int, times: int) -> None:
        """Fill parts exactly by fitted patterns; `times` of them make a container."""
        left = self._left()
        patterns = exact_patterns(left, part)
        if left[part] and times == 1:  # an item as large as the container
            n = int(left[part])
            self._take(part, n, 1, 0, self.containers)
            self.containers += n
        if not len(patterns):
            return
        fitted = np.rint(fit_counts(patterns, left)).astype(np.int64)
        for i in np.argsort(-fitted, kind="stable"):
            if fitted[i] < 1:
                break
            sizes, mult = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
            n = int(min(fitted[i], ((self.there[sizes] - self.next[sizes]) // mult).min()))
            if n < 1:
                continue
            if times == 1:
                first, inner = self.containers, 0
                self.containers += n
            else:
                first, inner = int(self.there[part]), part
                self.there[part] += n
            for s, m in zip(sizes, mult):
                self._take(int(s), n * int(m), int(m), inner, first)
        if times > 1:
            n = int(self._left()[part]) // times
            if n:
                self._take(part, n * times, times, 0, self.containers)
                self.containers += n

    def _best_fit(self) -> None:
        """What is left, from the largest size: into the fullest containers with room, else into new ones; runs of equal containers
        are handled at once."""
        rooms: list[int] = []  # free sizes, ascending
        runs: dict[int, list[tuple[int, int]]] = {}  # free size: runs (first container, number)

        def put(free: int, first: int, number: int) -> None:
            if free > 0 and number > 0:
                if free not in runs:
                    runs[free] = []
                    rooms.insert(bisect_left(rooms, free), free)
                runs[free].append((first, number))

        for size in np.nonzero(self._left())[0][::-1]:
            size = int(size)
            while n := int(self.there[size] - self.next[size]):
                at = bisect_left(rooms, size)
                if at < len(rooms):
                    free = rooms[at]
                    first, number = runs[free].pop()
                    if not runs[free]:
                        del runs[free]
                        rooms.pop(at)
                    full = min(n, number)
                    self._take(size, full, 1, 0, first)
                    put(free - size, first, full)
                    put(free, first + full, number - full)
                else:
                    each = min(self.capacity // size, n)
                    number = n // each
                    self._take(size, number * each, each, 0, self.containers)
                    put(self.capacity - each * size, self.containers, number)
                    self.containers += number

    def place(self, size: np.ndarray, index: np.ndarray) -> np.ndarray:
        """The container of the index-th item of each size."""
        size, index = size.astype(np.int64), index.astype(np.int64)
        out = index % max(1, self.containers)  # items without size
        todo = np.nonzero(size > 0)[0]
        keys = self.size * (1 << 42) + self.start
        while len(todo):
            row = np.searchsorted(keys, size[todo] * (1 << 42) + index[todo], side="right") - 1
            unit = self.first[row] + (index[todo] - self.start[row]) // self.each[row]
            final = self.inner[row] == 0
            out[todo[final]] = unit[final]
            size, index = size.copy(), index.copy()
            size[todo], index[todo] = self.inner[row], unit
            todo = todo[~final]
        return out


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id", slice_rows: int = 1_000_000) -> DataFrame:
    """(id, piece, size, container) of each item of (id, size). slice_rows: about so many items of one size are numbered by one task."""
    kind = dict(sizes.dtypes)[id_col]
    n = F.coalesce(F.col("size"), F.lit(0)).cast("bigint")
    whole = F.when(n > capacity, F.floor(n / capacity)).otherwise(0).cast("bigint")
    rest = F.when(n > capacity, n % capacity).otherwise(n)
    last = F.when((n > capacity) & (rest == 0), whole - 1).otherwise(whole)
    items = sizes.select(F.col(id_col), n.alias("n"), whole.alias("whole"), rest.alias("rest"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    items = items.select(id_col, F.col("piece").cast("int").alias("piece"), F.when(F.col("piece") < F.col("whole"), capacity).otherwise(F.col("rest")).cast("int").alias("size"))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for size, number in items.groupBy("size").count().collect():  # at most capacity + 1 rows
        histogram[size] = number
    plan = PackingPlan(histogram, capacity)
    slices = max(8, int(histogram.max() // slice_rows) + 1)
    sliced = items.withColumn("slice", F.pmod(F.xxhash64(id_col, "piece"), F.lit(slices)).cast("int"))
    ahead = Window.partitionBy("size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy("size", "slice").count().select("size", "slice", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("start"))
    numbered = sliced.withColumn("own", F.row_number().over(Window.partitionBy("size", "slice").orderBy(id_col, "piece")))
    numbered = numbered.join(starts, ["size", "slice"]).select(id_col, "piece", "size", (F.col("start") + F.col("own") - 1).alias("index"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "piece": b["piece"], "size": b["size"], "container": plan.place(b["size"].to_numpy(), b["index"].to_numpy())})

    return numbered.mapInPandas(place, f"`{id_col}` {kind}, piece INT, size INT, container BIGINT")
