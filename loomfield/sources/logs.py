"""Usage logs: event lines, session logs of two dialects, and what is written back."""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.operators import usage
from loomfield.session import spread


def read_events(spark: SparkSession, path: str, since: str | None = None, workspace: str | None = None) -> DataFrame:
    """The valid events of a folder of daily NDJSON files."""
    return usage.events_from_lines(spark.read.option("pathGlobFilter", "usage-*.ndjson").text(path), "value", since, workspace)


def write_events(events: DataFrame, path: str) -> None:
    """Appends events as JSON lines, a folder a day; nulls are written, so that each line has all its keys."""
    day = F.substring("occurredAt", 1, 10)
    events.select(*usage.EVENT.fieldNames()).withColumn("day", day).write.mode("append").partitionBy("day").option("ignoreNullFields", "false").json(path)


def mentions_tool(value: object, names: frozenset[str], depth: int = 0) -> bool:
    """Whether any object down to twelve levels names one of the tools under name, tool, tool_name, server or server_name."""
    if depth > 12:
        return False
    if isinstance(value, dict):
        for key, inner in value.items():
            if key in ("name", "tool", "tool_name", "server", "server_name") and isinstance(inner, str) and any(n in inner for n in names):
                return True
            if mentions_tool(inner, names, depth + 1):
                return True
        return False
    return isinstance(value, list) and any(mentions_tool(v, names, depth + 1) for v in value)


_FIELDS = "session string, line_no bigint, dialect string, ts string, model string, message_key string, input bigint, cache_write bigint, cache_read bigint, output bigint, is_turn boolean, mentions boolean"


def session_rows(lines: DataFrame, tools: list[str]) -> DataFrame:
    """Each readable line of session logs (session, line_no, value) as one row, both dialects in the same columns.

    In the first, a line of type assistant has a message with its own usage; in the second, event lines have running totals,
    of which the cached part is taken off the input, and the model stands in lines of its own.
    """
    names = frozenset(tools)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for session, number, line in zip(batch["session"], batch["line_no"], batch["value"], strict=True):
                try:
                    o = json.loads(line)
                except (ValueError, TypeError):
                    continue
                if not isinstance(o, dict):
                    continue
                seen = mentions_tool(o, names)
                ts = o.get("timestamp") or o.get("created_at")
                m, p = o.get("message"), o.get("payload")
                m, p = m if isinstance(m, dict) else {}, p if isinstance(p, dict) else {}
                u = m.get("usage") if isinstance(m.get("usage"), dict) else None
                count = lambda d, k: int(d[k]) if isinstance(d.get(k), (int, float)) and not isinstance(d.get(k), bool) and d[k] > 0 else 0
                if o.get("type") == "assistant" and u is not None:
                    key = m.get("id") or o.get("requestId") or o.get("uuid") or f"line-{number}"
                    rows.append((session, number, "message", ts, m.get("model"), key, count(u, "input_tokens"), count(u, "cache_creation_input_tokens"), count(u, "cache_read_input_tokens"), count(u, "output_tokens"), True, seen))
                elif p.get("type") == "token_count":
                    info = p.get("info") if isinstance(p.get("info"), dict) else {}
                    t = info.get("total_token_usage") if isinstance(info.get("total_token_usage"), dict) else {}
                    cached = count(t, "cached_input_tokens")
                    rows.append((session, number, "counter", ts, None, None, max(0, count(t, "input_tokens") - cached), 0, cached, count(t, "output_tokens"), True, seen))
                else:
                    model = p.get("model") if o.get("type") == "turn_context" else None
                    rows.append((session, number, "other", ts, model, None, 0, 0, 0, 0, False, seen))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _FIELDS.split(", ")])

    return spread(lines.select(F.col("session").cast("string").alias("session"), F.col("line_no").cast("bigint").alias("line_no"), "value")).mapInPandas(run, _FIELDS)


def session_usage(rows: DataFrame, since: str | None = None) -> DataFrame:
    """(session, model, input, cache_write, cache_read, output, requests) of the sessions that call one of the tools.

    Messages count once, by their largest total; counters by what they grew since the window began. Within a window, lines
    without a time don't count.
    """
    ts = F.try_to_timestamp("ts")
    inside = (ts >= F.try_to_timestamp(F.lit(since))) if since else F.lit(True)
    rows = rows.withColumn("_in", F.coalesce(inside, F.lit(False)))
    calling = rows.where("_in and mentions").select("session").distinct()
    kept = rows.join(calling, "session", "left_semi")
    total = F.col("input") + F.col("cache_write") + F.col("cache_read") + F.col("output")
    messages = kept.where("dialect = 'message' and _in").withColumn("total", total)
    best = usage.largest_per_message(messages, ["session", "model", "message_key"], "total", "line_no")
    sums = [F.sum(c).alias(c) for c in ("input", "cache_write", "cache_read", "output")]
    a = best.groupBy("session", "model").agg(*sums, F.count("*").alias("requests"))
    counters = kept.where("dialect = 'counter'").where(ts.isNotNull() if since else F.lit(True))
    names = ("input", "cache_write", "cache_read", "output")
    last = [F.max_by(F.when(F.col("_in"), F.col(c)), F.when(F.col("_in"), F.col("line_no"))).alias(f"a_{c}") for c in names]
    before = [F.max_by(F.when(~F.col("_in"), F.col(c)), F.when(~F.col("_in"), F.col("line_no"))).alias(f"b_{c}") for c in names]
    grown = counters.groupBy("session").agg(*last, *before, F.count_if("_in").alias("requests")).where("requests > 0")
    models = kept.where("model is not null and dialect = 'other'").groupBy("session").agg(F.max_by("model", "line_no").alias("model"))
    b = grown.join(models, "session", "left").select("session", "model", *[F.greatest(F.lit(0), F.col(f"a_{c}") - F.coalesce(F.col(f"b_{c}"), F.lit(0))).alias(c) for c in names], "requests")
    return a.unionByName(b)


TELLING = re.compile(r"(?i)path|file|folder|user|session|workspace|client|email|host")
OPAQUE = re.compile(r"[0-9a-f]{12,64}\Z")


def export_bundle(target: str, parts: dict[str, DataFrame], notes: dict[str, str]) -> None:
    """A zip file of small results, one JSON-lines entry each, and notes; with a manifest, diagnostics (rows and columns of each part), and a
    report of the columns whose names say that they tell of people or places, and whether all their values are digests. For reports, which a driver can hold."""
    diagnostics, privacy = {}, {}
    with zipfile.ZipFile(Path(target), "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("manifest.json", json.dumps({"version": 1, "parts": sorted(parts), "notes": sorted(notes)}, sort_keys=True))
        for name, df in sorted(parts.items()):
            telling = {c: True for c in df.columns if TELLING.search(c)}
            lines = []
            for line in df.toJSON().toLocalIterator():
                lines.append(line + "\n")
                row = json.loads(line)
                for c in telling:
                    telling[c] = telling[c] and (row.get(c) is None or bool(OPAQUE.match(str(row[c]))))
            z.writestr(f"{name}.ndjson", "".join(lines))
            diagnostics[name] = {"rows": len(lines), "columns": df.columns}
            privacy[name] = {c: "digest" if safe else "plain" for c, safe in telling.items()}
        z.writestr("diagnostics.json", json.dumps(diagnostics, sort_keys=True))
        z.writestr("privacy.json", json.dumps(privacy, sort_keys=True))
        for name, text in sorted(notes.items()):
            z.writestr(name, text)


def write_index(path: str, **tables: DataFrame) -> None:
    """Tables of an index as Parquet folders below one path, each replaced as a whole by Spark's commit."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def render_skeleton(files: list[tuple[str, float, list[str]]], modules: list[tuple[str, list[str]]], most_bytes: int = 65_536) -> tuple[str, str]:
    """(markdown, digest) of ranked files with signatures and of the module map: line feeds only, within a number of bytes, cut after
    the last whole line. The digest is the first 32 hex digits of the body's SHA-256."""
    import hashlib

    lines = ["# Repository", "", "## Files", ""]
    for path, score, signatures in files:
        lines.append(f"- {path} ({score:.3f})")
        lines += [f"  - `{s}`" for s in signatures]
    lines += ["", "## Modules", ""] + [f"- {d}: {', '.join(c)}" for d, c in modules]
    out, size = [], 0
    for line in lines:
        size += len(line.encode()) + 1
        if size > most_bytes:
            break
        out.append(line)
    body = "\n".join(out) + "\n"
    return body, hashlib.sha256(body.encode()).hexdigest()[:32]
