import json
import random

from loomfield.operators import drift

SCHEMA = "stream_id string, file_no int, raw_line string, previous string, path string"


def lines(spark, data):
    return spark.createDataFrame([(s, n, x, "own", "own") for s, n, x in data], SCHEMA)


def test_quantities():
    for path, field in {
        "usage.cache_creation_input_tokens": "cacheWriteTokens", "cachereadtokens": "cacheReadTokens", "cachedTokens": "cacheReadTokens", "cacheHitTokens": "cacheReadTokens", "cacheHit": "other:cachehit",
        "inTok": "inputTokens", "tokens_out": "outputTokens", "completionTokens": "outputTokens", "promptTokens": "inputTokens", "usage.total_tokens": "totalTokens", "turns": "requestCount", "request_count": "requestCount",
        "agent.client": "client", "client_name": "client", "meta.model": "model", "llm": "model", "toolName": "other:toolname", "stop_reason": "other:stopreason", "latencyMs": "other:latencyms",
    }.items():
        assert drift.quantity(path) == field, path


def test_changes(spark, rows):
    data = [
        ("s", 1, '{"client":"a","inputTokens":1,"tags":["x"]}'), ("s", 1, '{"client":null,"inputTokens":2}'), ("s", 1, '{"cli'),
        ("s", 2, "torn"), ("s", 2, None), ("s", 2, "[1]"),
        ("s", 5, '{"agent":{"client":"a"},"usage":{"input_tokens":"1"},"lane":null}'),
        ("s", 6, '{"agent":{"client":"a"},"usage":{"input_tokens":1.0},"lane":"x"}'),
        ("s", 6, '{"agent":{"client":"a"},"usage":{"input_tokens":1.0},"lane":"x"}'),
        ("t", 2000, '{"client":"a"}'), ("t", 1, '{"client":1}'), (None, 1, '{"a":1}'), ("u", None, '{"a":1}'),
    ]
    assert rows(drift.changes(lines(spark, data))) == sorted(
        [
            ("s", 5, "renamed", "client", "agent.client"), ("s", 5, "renamed", "inputTokens", "usage.input_tokens"), ("s", 5, "retyped", "inputTokens", "usage.input_tokens"), ("s", 5, "removed", "tags", ""), ("s", 5, "added", "", "lane"),
            ("s", 6, "retyped", "usage.input_tokens", "usage.input_tokens"), ("t", 2000, "retyped", "client", "client"),
        ]
    )
    assert drift.changes(lines(spark, data).limit(0)).count() == 0


def test_changes_equal_a_plain_loop(spark, rows):
    random.seed(5)
    names = ["client", "model", "modelName", "inputTokens", "usage.input_tokens", "hostOs", "tags", "requests", "requestCount"]
    values = ["x", 1, 1.5, True, None, ["y"]]
    data = []
    for s in ("a", "b"):
        for f in random.sample(range(1, 3000), 60):
            for _ in range(random.randint(1, 3)):
                record: dict = {}
                for name in random.sample(names, random.randint(0, 5)):
                    at = record
                    *up, leaf = name.split(".")
                    for u in up:
                        at = at.setdefault(u, {})
                    at[leaf] = random.choice(values)
                data.append((s, f, json.dumps(record)[: 1000 if random.random() < 0.9 else 5]))
    want = []
    for s in ("a", "b"):
        before = None
        for f in sorted({f for t, f, _ in data if t == s}):
            tags: dict = {}
            read = False
            for t, g, line in data:
                if (t, g) == (s, f) and (value := drift.readable(line)) is not None:
                    read = True
                    for path, leaf in drift.leaves(value):
                        tags.setdefault(path, set()).add(drift.tag(leaf))
            if not read:
                continue
            now = {p: drift.union_type(x) for p, x in tags.items()}
            if before is not None:
                want += [(s, f, *c) for c in drift.compare(before, now)]
            before = now
    assert rows(drift.changes(lines(spark, data))) == sorted(want)


def test_renames_to_unknown_words_by_values(spark, rows):
    random.seed(1)
    models, hosts = ["lumen-2", "tern-1", "basalt"], ["linux", "mac", "win"]

    def file(n, tokens, time, model, host, retries):
        return [("s", n, json.dumps({tokens: random.randint(20_000, 60_000), time: random.randint(1500, 4000), model: models[k % 3], host: hosts[k % 3], retries: k % 2})) for k in range(12)]

    data = file(1, "inputTokens", "latency_ms", "model", "hostOs", "retries") + file(2, "ingressVolume", "elapsedMillis", "flavour", "machine", "attempts") + file(3, "ingressVolume", "bytesOut", "flavour", "lane", "attempts")
    got = rows(drift.changes(lines(spark, data)), "file_no", "change_kind", "old_field", "new_field")
    assert [r for r in got if r[0] == 2] == sorted(
        [(2, "renamed", "inputTokens", "ingressVolume"), (2, "renamed", "latency_ms", "elapsedMillis"), (2, "renamed", "model", "flavour"), (2, "renamed", "hostOs", "machine"), (2, "removed", "retries", ""), (2, "added", "", "attempts")]
    )  # numbers of one or two tell nothing
    assert [r for r in got if r[0] == 3] == sorted([(3, "renamed", "machine", "lane"), (3, "removed", "elapsedMillis", ""), (3, "added", "", "bytesOut")])  # milliseconds are no bytes


def test_values_that_fit_two_fields_decide_nothing(spark, rows):
    a = [("s", 1, json.dumps({"x": 1000 + k})) for k in range(5)]
    b = [("s", 2, json.dumps({"y": 1000 + k, "z": 1100 + k})) for k in range(5)]
    assert rows(drift.changes(lines(spark, a + b)), "change_kind", "new_field") == [("added", "y"), ("added", "z"), ("removed", "")]


def test_another_record(spark, rows):
    rules = (("temperature", ("temp temperature",), "", ""), ("place", ("site station",), "", ""))
    data = [("s", 1, '{"siteName":"a","temp":3}'), ("s", 2, '{"station":"b","air":{"temperature":"4"}}')]
    out = drift.records(lines(spark, data), ["file_no"], {"place": "string", "temperature": "bigint"}, rules)
    assert rows(out, "file_no", "place", "temperature") == [(1, "a", 3), (2, "b", 4)]
    assert rows(drift.changes(lines(spark, data), rules), "change_kind", "old_field", "new_field") == [("renamed", "siteName", "station"), ("renamed", "temp", "air.temperature"), ("retyped", "temp", "air.temperature")]


def test_records(spark):
    data = [("s", 1, '{"agent":{"client":"a"},"llm":["m"],"tokens_in":"12","usage":{"total_tokens":7.0},"requests":1.5,"x":1}'), ("s", 1, "torn"), ("s", 1, None), ("s", 1, '{"inputTokens":99999999999999999999}')]
    out = drift.records(lines(spark, data), ["stream_id", "path"]).collect()
    assert len(out) == 4
    a = next(r for r in out if r["client"] == "a")
    assert (a["model"], a["inputTokens"], a["totalTokens"], a["requestCount"]) == ("m", 12, 7, None)
    assert json.loads(a["other_fields"]) == {"x": 1, "requests": 1.5}
    assert sum(not r["is_readable"] for r in out) == 2 and all(r["path"] == "own" for r in out)


def test_branches(spark, rows):
    data = [("s", 1, '{"a":1}'), ("s", 1, '{"a":"x"}'), ("s", 1, '{"a":"y"}'), ("s", 1, "{}")]
    assert rows(drift.branches(lines(spark, data)), "path", "tag", "lines") == [("", "null", 4), ("a", "integer", 1), ("a", "string", 2)]
