"""Filling containers of a fixed capacity (problem 7): variable-capacity best-fit over the histogram of sizes.

Sizes are whole numbers of at most ``capacity``, so all that a global best-fit needs to know is how many items there are of
each size: at most ``capacity`` numbers, however many items. The plan is made from these on the driver, in descending
order of size, with ranges of equally filled containers in place of single ones. Each item then finds its container from
its rank among the items of its size. The plan is the one that best-fit would make item by item.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What opening a container costs, in units of size, beside its length.
OPENING = 16


class Plan:
    """Runs (size, first rank, items, first container, items in each container) and the containers' ranges."""

    def __init__(self, counts: dict[int, int], lengths: Sequence[int], opening: int = OPENING):
        self.lengths = sorted(lengths)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.containers = 0
        self.mass_to = np.zeros(self.lengths[-1] + 1, dtype="float64")  # of the sizes up to each
        for size, n in counts.items():
            self.mass_to[size] += size * n
        self.mass_to = np.cumsum(self.mass_to)
        self.opening = opening
        open_ranges: dict[int, list[tuple[int, int, int]]] = {}  # room left -> (first, number, length)
        rooms: list[int] = []
        self.closed: list[tuple[int, int, int]] = []  # first, number, contents

        def put(room: int, first: int, number: int, length: int) -> None:
            if not number:
                return
            if room not in open_ranges:
                bisect.insort(rooms, room)
                open_ranges[room] = []
            open_ranges[room].append((first, number, length))

        for size in sorted((s for s in counts if s > 0), reverse=True):
            left, rank = counts[size], 0
            self.mass_to[size:] -= size * left  # what remains to come is smaller
            after: list[tuple[int, int, int, int]] = []
            while left and (at := bisect.bisect_left(rooms, size)) < len(rooms):
                room = rooms[at]
                first, number, length = open_ranges[room].pop()
                if not open_ranges[room]:
                    del open_ranges[room], rooms[at]
                each = room // size
                full = min(number, left // each)
                if full:
                    self.runs.append((size, rank, full * each, first, each))
                    after.append((room - each * size, first, full, length))
                    rank, left = rank + full * each, left - full * each
                if full < number:
                    if left:
                        self.runs.append((size, rank, left, first + full, left))
                        after.append((room - left * size, first + full, 1, length))
                        rank, left, full = rank + left, 0, full + 1
                    if full < number:
                        after.append((room, first + full, number - full, length))
            while left:
                length = self.opened(size, left)
                each = length // size
                number, rest = max(1, left // each), left if left < each else each
                self.runs.append((size, rank, number * rest, self.containers, rest))
                after.append((length - rest * size, self.containers, number, length))
                rank, left, self.containers = rank + number * rest, left - number * rest, self.containers + number
            for x in after:
                put(*x)
        for room, ranges in open_ranges.items():
            self.closed += [(first, number, length - room) for first, number, length in ranges]
        self.closed.sort()

    def opened(self, size: int, left: int) -> int:
        """The length that costs least for each unit it is expected to hold, given what is still to come."""
        best = None
        for length in (x for x in self.lengths if x >= size):
            own = min(left, length // size) * size
            room = length - own
            held = own + (min(room, self.mass_to[min(room, size - 1)]) if size > 1 else 0)
            cost = (length + self.opening) / held
            if best is None or cost <= best[0]:
                best = (cost, length)
        return best[1]

    def length_of(self, contents: int) -> int:
        """The shortest permitted length for contents."""
        return self.lengths[bisect.bisect_left(self.lengths, contents)]


def permitted(capacity: int) -> list[int]:
    """The lengths that are offered for a capacity: itself, and its half, quarter and eighth."""
    return sorted({max(1, capacity // k) for k in (1, 2, 4, 8)})


def pieces(sized: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """Items of at most the capacity: each row as it is, rows above it as full pieces and a rest."""
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / capacity)).cast("int")
    cut = sized.select(F.col(key), F.col(size).cast("bigint").alias("_all"), F.explode(F.sequence(F.lit(1), n)).alias("piece_no"))
    start = ((F.col("piece_no") - 1) * capacity).cast("bigint")
    return cut.select(key, "piece_no", start.alias("piece_start"), F.least(F.col("_all") - start, F.lit(capacity).cast("bigint")).alias("piece_size"))


def packed(sized: DataFrame, key: str, size: str, capacity: int, lengths: Sequence[int] | None = None, buckets: int = 256) -> DataFrame:
    """(key, piece_no, piece_start, piece_size, container_id, container_size, container_length) of every row.

    ``sized``: one row an item, with an integer size. A row is cut only if it exceeds the capacity. Null or negative
    sizes count as 0; items of size 0 lie in container 0. Null keys and repeated keys are items like others. An empty
    table gives an empty one. ``sized`` is read twice; write or checkpoint it where it is dear.

    To the driver come at most ``capacity`` counts. Ranks are counted in ``buckets`` parts of each size, so that a size
    which a third of all items have is not one task's work.
    """
    sized = sized.select(F.col(key), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).alias(size))
    items = pieces(sized, key, size, capacity)
    items = items.withColumn("_bucket", F.pmod(F.xxhash64(key, "piece_no"), F.lit(buckets)))
    parts = items.groupBy("piece_size", "_bucket").agg(F.count("*").alias("_n"))
    counts = {r[0]: r[1] for r in parts.groupBy("piece_size").agg(F.sum("_n")).collect()}  # at most capacity + 1 rows
    plan = Plan({s: n for s, n in counts.items() if s > 0}, lengths or permitted(capacity))
    before = Window.partitionBy("piece_size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("piece_size", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("piece_size", "_bucket").orderBy(key, "piece_no")
    ranked = items.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, ["piece_size", "_bucket"])
    ranked = ranked.select(key, "piece_no", "piece_start", "piece_size", (F.col("_rank") + F.col("_offset")).alias("_rank"))

    runs = np.array(sorted(plan.runs), dtype="int64").reshape(-1, 5)
    # (size, rank) as one ascending number
    wide = int(max(counts.values(), default=0)) + 1
    starts = runs[:, 0] * wide + runs[:, 1]
    closed = np.array([(*c, plan.length_of(c[2])) for c in plan.closed], dtype="int64").reshape(-1, 4)
    shared = sized.sparkSession.sparkContext.broadcast((runs, starts, closed, wide))  # bounded by the capacity

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs, starts, closed, wide = shared.value
        for batch in batches:
            of, rank = batch["piece_size"].to_numpy(), batch["_rank"].to_numpy()
            container = np.zeros(len(batch), dtype="int64")
            real = of > 0
            if real.any():
                run = runs[np.searchsorted(starts, of[real] * wide + rank[real], side="right") - 1]
                container[real] = run[:, 3] + (rank[real] - run[:, 1]) // run[:, 4]
            out = batch.drop(columns="_rank")
            if len(closed):
                own = closed[np.searchsorted(closed[:, 0], container, side="right") - 1]
                contents, length = own[:, 2], own[:, 3]
            else:
                contents = length = np.zeros(len(batch), dtype="int64")
            yield out.assign(container_id=container, container_size=contents, container_length=length)

    kind = sized.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece_no int, piece_start bigint, piece_size bigint, container_id bigint, container_size bigint, container_length bigint"
    return ranked.mapInPandas(assign, schema)


def best_fit(sizes: Sequence[int], capacity: int) -> int:
    """Containers of plain best-fit decreasing, item by item: the measure for tests."""
    rooms: list[int] = []
    number = 0
    for size in sorted(sizes, reverse=True):
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            number += 1
            room = capacity - size
        else:
            room = rooms.pop(at) - size
        bisect.insort(rooms, room)
    return number


def lower_bound(sizes: Sequence[int], capacity: int) -> int:
    """Containers that any packing needs at least."""
    large = [s for s in sizes if 2 * s > capacity]
    return max(-(-sum(sizes) // capacity), len(heapq.nlargest(len(large), large)))
