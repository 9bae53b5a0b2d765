"""Queries of usage events on the ``events`` table: event types are tools, users are clients, props.k a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.operators import usage
from loomfield.session import table

TYPES = ["click", "purchase", "signup", "view"]


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """events with the roles of usage events; a baseline only where k is above 20."""
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").try_cast("double")
    return e.select("event_id", "ts", "user_id", F.col("event_type").alias("tool"), F.concat(F.lit("c"), F.col("user_id") % 5).alias("client"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("outcome"), F.col("value").alias("response"), F.when(k > 20, k).alias("baseline"))


def usage_summary(spark: SparkSession, folder: str) -> DataFrame:
    out = usage.summary(_events(spark, folder), TYPES, [f"c{n}" for n in range(5)])
    return out.withColumns({c: F.round(c, 4) for c in ("response_sum", "measured_response", "measured_baseline", "saved", "reduction_percent")})


def usage_by_type_day(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder)
    return e.groupBy("tool", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("response"), 4).alias("response_sum"), F.countDistinct("user_id").alias("users"))


def usage_by_client_model(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder).withColumnRenamed("tool", "model")
    return usage.by_client_and_model(e, ["response", "baseline"]).withColumns({c: F.round(c, 4) for c in ("response", "baseline")})


def weighted_rates(spark: SparkSession, folder: str) -> DataFrame:
    out = usage.weighted_rate(_events(spark, folder), "baseline", "response", ["client"])
    return out.withColumns({c: F.round(c, 5) for c in ("rate", "weight")})


def counter_delta(spark: SparkSession, folder: str) -> DataFrame:
    out = usage.counter_delta(_events(spark, folder), "user_id", ["response", "baseline"], ["ts", "event_id"], "ts", "2024-01-15 00:00:00")
    return out.withColumns({c: F.round(c, 4) for c in ("response", "baseline")})


def max_usage_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The largest event of each user and hour, summed up by type."""
    e = _events(spark, folder).withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH"))
    best = usage.largest_per_message(e, ["user_id", "hour"], "response", "event_id")
    return best.groupBy("tool").agg(F.count("*").alias("n"), F.round(F.sum("response"), 4).alias("response_sum"))


def mean_turns(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder)
    days = e.groupBy("client", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("turns"))
    return usage.mean_turns(days).withColumn("mean_turns", F.round("mean_turns", 6))


def user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of a user's events without a gap of more than six hours."""
    return usage.sessions(_events(spark, folder), "user_id", "ts", 6 * 3600)


def pattern_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue by the first pattern that a part's type matches."""
    p = usage.first_pattern(table(spark, folder, "part"), "p_type", [(r"standard.*brass", "brass"), (r"(standard|small)", "basic"), (r".*steel", "steel"), (r"promo", "promo")])
    lines = table(spark, folder, "lineitem").select("l_partkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    joined = lines.join(p.select("p_partkey", "matched"), lines["l_partkey"] == F.col("p_partkey"))
    return joined.groupBy(F.coalesce("matched", F.lit("none")).alias("matched")).agg(F.count("*").alias("n"), F.round(F.sum("revenue"), 2).alias("revenue"))


def client_rates(spark: SparkSession, folder: str) -> DataFrame:
    """A fixed rate for each client, applied to its measured events."""
    rates = spark.createDataFrame([(f"c{n}", 0.5 + n) for n in range(4)], "client string, rate double")
    e = _events(spark, folder).where("outcome = 'ok' and baseline is not null")
    return e.join(rates, "client", "left").groupBy("client").agg(F.count("*").alias("n"), F.round(F.sum((F.col("baseline") - F.col("response")) * F.col("rate")) / 1e6, 9).alias("cost"))


def idle_users(spark: SparkSession, folder: str) -> DataFrame:
    last = _events(spark, folder).groupBy("user_id").agg(F.max("ts").alias("seen"))
    return usage.idle_evicted(last, "user_id", "seen", "2024-01-31 00:00:00", 24, 8)


QUERIES = {f.__name__: f for f in (usage_summary, usage_by_type_day, usage_by_client_model, weighted_rates, counter_delta, max_usage_dedup, mean_turns, user_sessions, pattern_lookup, client_rates, idle_users)}

_E = """e AS (SELECT event_id, ts, user_id, event_type AS tool, 'c' || (user_id % 5) AS client, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS outcome, value AS response,
  CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 20 THEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS baseline FROM events)"""

SQL = {
    "usage_summary": f"""WITH {_E}, s AS (SELECT count(*) AS event_count, count(*) FILTER (outcome = 'ok') AS successful_calls, coalesce(sum(response), 0) AS response_sum,
  count(*) FILTER (outcome = 'ok' AND baseline IS NOT NULL) AS measured_calls, coalesce(sum(response) FILTER (outcome = 'ok' AND baseline IS NOT NULL), 0) AS mr,
  coalesce(sum(baseline) FILTER (outcome = 'ok' AND baseline IS NOT NULL), 0) AS mb, {", ".join(f"count(*) FILTER (tool = '{t}') AS tool_{t}" for t in TYPES)},
  {", ".join(f"count(*) FILTER (client = 'c{n}') AS client_c{n}" for n in range(5))} FROM e)
SELECT event_count, successful_calls, event_count - successful_calls AS failed_calls, round(response_sum, 4) AS response_sum, measured_calls, round(mr, 4) AS measured_response, round(mb, 4) AS measured_baseline,
  round(mb - mr, 4) AS saved, CASE WHEN mb > 0 THEN round(100 * (mb - mr) / mb, 4) END AS reduction_percent, {", ".join(f"tool_{t}" for t in TYPES)}, {", ".join(f"client_c{n}" for n in range(5))} FROM s""",
    "usage_by_type_day": f"WITH {_E} SELECT tool, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(response), 4) AS response_sum, count(DISTINCT user_id) AS users FROM e GROUP BY 1, 2",
    "usage_by_client_model": f"""WITH {_E} SELECT client, tool AS model, round(sum(response), 4) AS response, round(sum(baseline), 4) AS baseline, count(*) AS request_count FROM e GROUP BY 1, 2
HAVING coalesce(sum(response), 0) + coalesce(sum(baseline), 0) > 0""",
    "weighted_rates": f"""WITH {_E}, w AS (SELECT client, baseline, greatest(1.0, coalesce(response, 0)) AS w FROM e WHERE baseline IS NOT NULL)
SELECT client, round(sum(baseline * w) / sum(w), 5) AS rate, round(sum(w), 5) AS weight FROM w GROUP BY client""",
    "counter_delta": f"""WITH {_E}, s AS (SELECT user_id, arg_max(response, (ts, event_id)) FILTER (ts >= TIMESTAMP '2024-01-15') AS a, arg_max(response, (ts, event_id)) FILTER (ts < TIMESTAMP '2024-01-15') AS b,
  arg_max_null(baseline, (ts, event_id)) FILTER (ts >= TIMESTAMP '2024-01-15') AS c, arg_max_null(baseline, (ts, event_id)) FILTER (ts < TIMESTAMP '2024-01-15') AS d,
  count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS requests FROM e WHERE ts IS NOT NULL GROUP BY user_id)
SELECT user_id, round(greatest(0, a - coalesce(b, 0)), 4) AS response, round(greatest(0, c - coalesce(d, 0)), 4) AS baseline, requests FROM s WHERE requests > 0""",
    "max_usage_dedup": f"""WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d %H') ORDER BY response DESC, event_id) AS rn FROM e)
SELECT tool, count(*) AS n, round(sum(response), 4) AS response_sum FROM r WHERE rn = 1 GROUP BY tool""",
    "mean_turns": f"""WITH {_E}, d AS (SELECT client, user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS turns FROM e GROUP BY ALL)
SELECT client, round(avg(turns), 6) AS mean_turns, count(*) AS sessions FROM d GROUP BY client""",
    "user_sessions": f"""WITH {_E}, g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM e WHERE ts IS NOT NULL),
s AS (SELECT user_id, ts, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM g)
SELECT user_id, session_no, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, session_no""",
    "pattern_lookup": r"""WITH m AS (SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)^(standard.*brass)') THEN 'brass' WHEN regexp_matches(p_type, '(?i)^(standard|small)') THEN 'basic'
  WHEN regexp_matches(p_type, '(?i)^(.*steel)') THEN 'steel' WHEN regexp_matches(p_type, '(?i)^promo') THEN 'promo' ELSE 'none' END AS matched FROM part)
SELECT matched, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN m ON l_partkey = p_partkey GROUP BY matched""",
    "client_rates": f"""WITH {_E}, r AS (SELECT 'c' || n AS client, 0.5 + n AS rate FROM range(4) t(n))
SELECT e.client, count(*) AS n, round(sum((baseline - response) * rate) / 1e6, 9) AS cost FROM e LEFT JOIN r USING (client) WHERE outcome = 'ok' AND baseline IS NOT NULL GROUP BY e.client""",
    "idle_users": f"""WITH {_E}, l AS (SELECT user_id, max(ts) AS seen FROM e GROUP BY user_id) SELECT user_id FROM l WHERE (SELECT count(*) FROM l) > 8 AND seen < TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR""",
}
