"""Usage events: summaries, sessions, counters, and look-ups by pattern.

An event: tool, client, outcome, response (size), baseline (null where not measured), and a time. Prices and estimates of
savings are rules of a business and not here; what remains is their arithmetic: weighted rates and pattern look-ups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfield.functions import text as tx

#: The fifteen fields of a usage event; a line with any other set of keys is none.
EVENT = T.StructType(
    [
        T.StructField("schemaVersion", T.IntegerType()), T.StructField("eventId", T.StringType()), T.StructField("occurredAt", T.StringType()), T.StructField("workspaceId", T.StringType()), T.StructField("sessionId", T.StringType()),
        T.StructField("client", T.StringType()), T.StructField("tool", T.StringType()), T.StructField("outcome", T.StringType()), T.StructField("durationMs", T.LongType()), T.StructField("responseBytes", T.LongType()),
        T.StructField("estimatedResponseTokens", T.LongType()), T.StructField("baselineTokens", T.LongType()), T.StructField("estimatedSavedTokens", T.LongType()), T.StructField("baselineMethod", T.StringType()), T.StructField("writeEnabled", T.BooleanType()),
    ]
)


def events_from_lines(lines: DataFrame, column: str = "value", since: str | None = None, workspace: str | None = None) -> DataFrame:
    """The events among JSON lines: exactly the fifteen keys, a readable time, within the window and workspace.

    Torn, foreign and null lines drop out. The comparison of keys is one of sorted arrays; nothing is inferred.
    """
    keys = F.array_sort(F.json_object_keys(column))
    wanted = F.array(*[F.lit(n) for n in sorted(EVENT.fieldNames())])
    valid = lines.where(F.try_parse_json(column).isNotNull()).where(keys == wanted)
    parsed = valid.select(F.from_json(column, EVENT).alias("e")).select("e.*").withColumn("ts", F.try_to_timestamp("occurredAt"))
    parsed = parsed.where(F.col("ts").isNotNull() & (F.col("schemaVersion") == 1) & F.col("eventId").isNotNull())
    if since:
        parsed = parsed.where(F.col("ts") >= F.try_to_timestamp(F.lit(since)))
    return parsed.where(F.col("workspaceId") == workspace) if workspace else parsed


def summary(events: DataFrame, tools: list[str], clients: list[str]) -> DataFrame:
    """One row: counts, measured sums, savings and their share, and a count for each known tool and client.

    Measured are successful events with a baseline; savings are signed. The share is null without a positive baseline. An
    empty table gives zeros.
    """
    ok = F.col("outcome") == "ok"
    measured = ok & F.col("baseline").isNotNull()
    total = lambda cond, value: F.coalesce(F.sum(F.when(cond, value)), F.lit(0.0))
    sums = events.agg(
        F.count("*").alias("event_count"),
        F.count_if(ok).alias("successful_calls"),
        F.coalesce(F.sum("response"), F.lit(0.0)).alias("response_sum"),
        F.count_if(measured).alias("measured_calls"),
        total(measured, F.col("response")).alias("measured_response"),
        total(measured, F.col("baseline")).alias("measured_baseline"),
        *[F.count_if(F.col("tool") == t).alias(f"tool_{t}") for t in tools],
        *[F.count_if(F.col("client") == c).alias(f"client_{c}") for c in clients],
    )
    saved = F.col("measured_baseline") - F.col("measured_response")
    return sums.withColumns({"failed_calls": F.col("event_count") - F.col("successful_calls"), "saved": saved, "reduction_percent": 100 * tx.ratio(saved, F.col("measured_baseline"))})


def by_client_and_model(records: DataFrame, counters: list[str]) -> DataFrame:
    """Sums of the counters for each client and model; groups of no positive total drop out."""
    sums = records.groupBy("client", "model").agg(*[F.sum(c).alias(c) for c in counters], F.count("*").alias("request_count"))
    return sums.where(sum((F.coalesce(F.col(c), F.lit(0)) for c in counters), F.lit(0)) > 0)


def weighted_rate(records: DataFrame, rate: str, weight: str, keys: list[str]) -> DataFrame:
    """(keys, rate, weight): the mean of a rate, weighted by a size of at least 1; null rates take no part."""
    w = F.greatest(F.lit(1.0), F.coalesce(F.col(weight), F.lit(0.0)))
    rated = records.where(F.col(rate).isNotNull())
    return rated.groupBy(*keys).agg((F.sum(F.col(rate) * w) / F.sum(w)).alias("rate"), F.sum(w).alias("weight"))


def mean_turns(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("client").agg(F.avg("turns").alias("mean_turns"), F.count("*").alias("sessions"))


def largest_per_message(rows: DataFrame, keys: list[str], total: str, order: str) -> DataFrame:
    """Of the rows of each key the one of the largest total, the first of equals: streamed repeats of a message count once."""
    whole = F.struct(*rows.columns)
    best = rows.groupBy(*keys).agg(F.max_by(whole, F.struct(F.col(total), -F.col(order))).alias("_row"))
    return best.select("_row.*")


def counter_delta(snapshots: DataFrame, key: str, counters: list[str], order: list[str], ts: str, since: str) -> DataFrame:
    """(key, counters, requests): what cumulative counters grew by since a time: the last snapshot, less the last one before it,
    not below zero. Snapshots without a time are left out; keys without any in the window drop out."""
    timed = snapshots.where(F.col(ts).isNotNull())
    inside = F.col(ts) >= F.to_timestamp(F.lit(since))
    by = F.struct(*order)
    last = [F.max_by(F.when(inside, F.col(c)), F.when(inside, by)).alias(f"_a_{c}") for c in counters]
    before = [F.max_by(F.when(~inside, F.col(c)), F.when(~inside, by)).alias(f"_b_{c}") for c in counters]
    sums = timed.groupBy(key).agg(*last, *before, F.count_if(inside).alias("requests")).where("requests > 0")
    return sums.select(key, *[F.greatest(F.lit(0.0), F.col(f"_a_{c}") - F.coalesce(F.col(f"_b_{c}"), F.lit(0.0))).alias(c) for c in counters], "requests")


def first_pattern(values: DataFrame, column: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """Adds ``matched``: the label of the first of a short list of patterns that a value matches, any case, from its beginning; null
    for none. The list is a parameter, so it becomes one expression instead of a join of every value with every pattern."""
    out = F.lit(None).cast("string")
    for pattern, label in reversed(patterns):
        out = F.when(F.col(column).rlike(f"(?i)^(?:{pattern})"), label).otherwise(out)
    return values.withColumn("matched", out)


def last_reset(markers: DataFrame, column: str = "reset_at", order: str = "line_no") -> DataFrame:
    """(reset_at): the last marker, in order of writing, whose time can be read; no row without one."""
    valid = markers.withColumn("_ts", F.try_to_timestamp(column)).where(F.col("_ts").isNotNull())
    return valid.agg(F.max_by("_ts", order).alias("reset_at")).where("reset_at is not null")


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """(key, session_no, started, ended, n): runs of a key's events with no gap above the limit; ties in time are one moment."""
    w = Window.partitionBy(key).orderBy(ts)
    before = F.lag(ts).over(w)
    new = before.isNull() | (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp")) > gap_seconds * 1_000_000)
    numbered = events.where(F.col(ts).isNotNull()).withColumn("_new", new.cast("int")).withColumn("session_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session_no").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))


def idle_evicted(last_seen: DataFrame, key: str, ts: str, now: str, idle_hours: int = 24, keep: int = 8) -> DataFrame:
    """(key): sessions idle for longer than the limit, if there are more than ``keep`` of them."""
    n = last_seen.agg(F.count("*").alias("_n")).scalar()
    old = F.col(ts) < F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(0), F.lit(idle_hours))
    return last_seen.where((n > keep) & old).select(key)
