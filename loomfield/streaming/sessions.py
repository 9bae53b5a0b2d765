"""What a service has served so far, kept as state of a stream: ranges, repeats, epochs, handles.

State is keyed and bounded by key; its batch forms are in ``operators.intervals`` and ``operators.usage``. Events of a
key are taken in the order of their sequence number within a batch.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as their union; adjacent ones become one."""
    out: list[list[int]] = []
    for a, b in sorted(s for s in spans if s[0] <= s[1]):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def overlap(span: tuple[int, int], known: list[tuple[int, int]]) -> int:
    """Lines of a span that merged spans already hold."""
    return sum(max(0, min(span[1], b) - max(span[0], a) + 1) for a, b in known)


def added_to(starts: list[int], ends: list[int], span: tuple[int, int]) -> int:
    """Put a span into merged ones, given by their starts and ends; how many of its lines are new. Only the spans that it meets are looked at."""
    a, b = span
    if a > b:
        return 0
    first, last = bisect_left(ends, a - 1), bisect_right(starts, b + 1)
    new = b - a + 1 - overlap(span, list(zip(starts[first:last], ends[first:last], strict=True)))
    low, high = min([a, *starts[first : first + 1]]) if first < last else a, max(b, ends[last - 1]) if first < last else b
    starts[first:last], ends[first:last] = [low], [high]
    return new


def ordered(batches: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    """The rows of a key's batches by sequence number, as plain tuples: groups are many and small, so no frame is made or sorted."""
    rows: list[tuple] = []
    for batch in batches:
        rows += zip(*(batch[c].tolist() for c in ("seq", *columns)), strict=True)
    if any(a[0] > b[0] for a, b in zip(rows, rows[1:], strict=False)):
        rows.sort(key=lambda r: r[0])
    return rows


def framed(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return pd.DataFrame(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in names}, copy=False)


LEDGER_OUT = "workspace_id string, file_path string, seq long, start long, end long, added_lines long, served_lines long, reset boolean"


def served_ranges(events: DataFrame) -> DataFrame:
    """For each served range how many lines are new and how many of the file have been served.

    ``events``: workspace_id, file_path, fingerprint, seq, start, end. A new fingerprint of a file resets its state. A stream in
    append mode; state is all merged spans of a file, so it is bounded by the file's lines.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, starts, ends = state.get if state.exists else (None, [], [])
        starts, ends, rows = list(starts), list(ends), []
        total = sum(ends) - sum(starts) + len(starts)
        for seq, fingerprint, start, end in ordered(batches, "fingerprint", "start", "end"):
            reset = mark is not None and fingerprint != mark
            if reset:
                starts, ends, total = [], [], 0
            mark = fingerprint
            added = added_to(starts, ends, (start, end))
            total += added
            rows.append((*key, seq, start, end, added, total, reset))
        state.update((mark, starts, ends))
        yield framed(rows, LEDGER_OUT)

    keyed = events.groupBy("workspace_id", "file_path")
    return keyed.applyInPandasWithState(step, LEDGER_OUT, "mark string, starts array<long>, ends array<long>", "append", GroupStateTimeout.NoTimeout)


def repeat_counts(events: DataFrame) -> DataFrame:
    """How often each range of a file has been asked for, kept up to date."""
    return events.groupBy("workspace_id", "file_path", "start", "end").agg(F.count("*").alias("reads"))


EPOCH_OUT = "workspace_id string, seq long, epoch long, is_new boolean"


def epochs(queries: DataFrame) -> DataFrame:
    """A number for each query of a workspace: it goes on if the query shares a word with those of the epoch so far, else it is a new one.

    ``queries``: workspace_id, seq, tokens (array of strings).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, words = state.get if state.exists else (0, [])
        known, rows = set(words), []
        for seq, tokens in ordered(batches, "tokens"):
            asked = set(tokens)
            new = not known & asked
            number, known = (number + 1, asked) if new else (number, known | asked)
            rows.append((*key, seq, number, new))
        state.update((number, sorted(known)))
        yield framed(rows, EPOCH_OUT)

    return queries.groupBy("workspace_id").applyInPandasWithState(step, EPOCH_OUT, "number long, words array<string>", "append", GroupStateTimeout.NoTimeout)


GOVERNOR_OUT = "workspace_id string, seq long, file_path string, allowed boolean, reason string"


def read_governor(requests: DataFrame, per_task: int = 6, per_task_allowed: int = 12) -> DataFrame:
    """Whether a full read is let through: one a file and fingerprint, ``per_task`` in all, more with an explicit allowance; a range asked for
    three times or more tightens the limit by one.

    ``requests``: workspace_id, seq, file_path, fingerprint, explicit, repeats.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, files, marks = state.get if state.exists else (0, [], [])
        read, rows = dict(zip(files, marks, strict=True)), []
        for seq, path, fingerprint, explicit, repeats in ordered(batches, "file_path", "fingerprint", "explicit", "repeats"):
            limit = max(1, (per_task_allowed if explicit else per_task) - (repeats >= 3))
            if read.get(path) == fingerprint:
                rows.append((*key, seq, path, False, "already-read"))
            elif total >= limit:
                rows.append((*key, seq, path, False, "task-limit"))
            else:
                total += 1
                read[path] = fingerprint
                rows.append((*key, seq, path, True, ""))
        state.update((total, list(read), list(read.values())))
        yield framed(rows, GOVERNOR_OUT)

    return requests.groupBy("workspace_id").applyInPandasWithState(step, GOVERNOR_OUT, "total long, files array<string>, marks array<string>", "append", GroupStateTimeout.NoTimeout)


HANDLE_OUT = "workspace_id string, seq long, place string, handle string, is_new boolean, evicted long"


def handles(requests: DataFrame, capacity: int = 1024) -> DataFrame:
    """A lasting short id for each place (kind, path, range); at the capacity the oldest quarter is forgotten.

    ``requests``: workspace_id, seq, place. The id is a digest of the place and of when it was first asked for.
    """
    from hashlib import sha256

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        places, ids = state.get if state.exists else ([], [])
        known, rows = dict(zip(places, ids, strict=True)), []
        for seq, place in ordered(batches, "place"):
            evicted, new = 0, place not in known
            if new:
                if len(known) >= capacity:
                    old = list(known)[: max(1, capacity // 4)]
                    evicted = len(old)
                    for p in old:
                        del known[p]
                known[place] = sha256(f"{key[0]}\0{place}\0{seq}".encode()).hexdigest()[:11]
            rows.append((*key, seq, place, known[place], new, evicted))
        state.update((list(known), list(known.values())))
        yield framed(rows, HANDLE_OUT)

    return requests.groupBy("workspace_id").applyInPandasWithState(step, HANDLE_OUT, "places array<string>, ids array<string>", "append", GroupStateTimeout.NoTimeout)


def windowed_usage(events: DataFrame, ts: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(window, event_type, n, total): usage by event time, with late events up to a limit."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def rectangles_contained(requests: DataFrame, served: DataFrame, keys: list[str]) -> DataFrame:
    """Requests (keys, top, left, bottom, right) that one recorded rectangle holds; rectangles are not put together."""
    held = (F.col("r.top") <= F.col("q.top")) & (F.col("r.left") <= F.col("q.left")) & (F.col("r.bottom") >= F.col("q.bottom")) & (F.col("r.right") >= F.col("q.right"))
    same = [F.col(f"q.{k}") == F.col(f"r.{k}") for k in keys]
    on = held
    for s in same:
        on = on & s
    return requests.alias("q").join(served.alias("r"), on, "left_semi")
