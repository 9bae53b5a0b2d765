"""Queries and operators that have to take every row, on tables small enough to tell the result."""

import pytest

from loomfield.operators import graph, rejects, retrieval, search
from loomfield.plans import retrieval_queries, structure_queries
from loomfield.streaming import runner, sessions


def written(spark, folder, name, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_snapshot_actions_take_every_path(spark, rows, tmp_path):
    data = [("often", n, "5:7", "h") for n in range(1, 16)] + [("often", 100, "5:7", "h"), ("gone", 2, "1:1", "h"), ("fresh", 99, "1:1", "h")]
    data += [("moved", 3, "4:1", "h"), ("moved", 98, "4:2", "h"), ("grown", 4, "4:1", "h"), ("grown", 97, "6:2", "h"), ("lost", 5, "4:1", "h"), ("lost", 96, "4:1", None), (None, 6, "1:1", "h"), ("bad", 7, "", "h")]
    written(spark, tmp_path, "served_surfaces", [(n, *d) for n, d in enumerate(data)], "surface_id long, file_path string, served_at long, fingerprint string, handle string")
    got = rows(structure_queries.snapshot_actions(spark, str(tmp_path)))
    assert got == [("fresh", "add"), ("gone", "drop"), ("grown", "reparse"), ("lost", "reparse"), ("moved", "reuse-hash"), ("often", "reuse-stat")]


HOPS = "hop_id long, file_path string, code string, code_lang string, served_at long"


def test_file_graph_has_short_names_and_no_cap(spark, rows, tmp_path):
    many = [(n, f"lib/d{n}.ts", f"export function helperName{n}() {{\n}}\n", "ts", n) for n in range(60)]
    code = "\n".join(f"helperName{n}();" for n in range(60)) + "\nRun();\n"
    written(spark, tmp_path, "hop1_context", [*many, (90, "lib/run.ts", "export function Run() {\n}\n", "ts", 90), (91, "app/use.ts", code, "ts", 91)], HOPS)
    got = rows(structure_queries.file_graph(spark, str(tmp_path)))
    assert got == sorted(("app/use.ts", d, 1.0) for d in ["lib/run.ts", *(f"lib/d{n}.ts" for n in range(60))])
    ranked = {r["path"]: r["score"] for r in structure_queries.ranked_files(spark, str(tmp_path)).collect()}
    assert len(ranked) == 40
    s = spark.createDataFrame([(f"d{n}", f"n{n}", n) for n in range(60)], "path string, name string, position long")
    t = spark.createDataFrame([("u", f"n{n}") for n in range(60)], "path string, token string")
    assert graph.file_edges(s, t).count() == 60 and graph.targets(s, t).count() == 50


def test_ranked_files_count_short_names(spark, tmp_path):
    use = [(n, f"app/u{n}.ts", f"export function caller{n}() {{\n  Run();\n}}\n", "ts", n) for n in range(3)]
    written(spark, tmp_path, "hop1_context", [*use, (9, "lib/run.ts", "export function Run() {\n}\n", "ts", 9)], HOPS)
    assert structure_queries.ranked_files(spark, str(tmp_path)).orderBy("place").first()["path"] == "lib/run.ts"


def test_token_pack_gives_every_item_a_fate(spark, tmp_path):
    data = [(n, "x" * 9700, 9.0) for n in range(2400)] + [(n, "", 8.0) for n in range(2400, 2500)] + [(2500, "x" * 4000, 7.0), (2501, "x" * 8000, 6.0), (2502, "x", 5.0)]
    written(spark, tmp_path, "query_evidence", data, "evidence_id long, content_text string, score double")
    got = {r["evidence_id"]: (r["item_no"], r["fate"]) for r in retrieval_queries.token_pack(spark, str(tmp_path)).collect()}
    assert got == {n: (n + 1, "cap-exceeded" if n < 2400 else "served" if n < 2501 else "cap-exhausted" if n == 2501 else "omitted") for n in range(2503)}


def test_selected_evidence_is_greedy_over_all(spark, rows):
    schema = "concern string, class string, order_no long, bytes int, served boolean"
    data = [(f"c{n}", "a", n, 2000, False) for n in range(3)] + [("c3", "a", 3, 200, False), ("c4", "a", 4, 100, False), ("c5", "a", 5, 50, False), ("c6", "a", 6, 40, False)]
    data += [(f"s{n}", "a", n, 9000, True) for n in range(10, 6300)]
    got = rows(retrieval.selected_evidence(spark.createDataFrame(data, schema)), "order_no")
    assert got == [(n,) for n in (0, 1, 2, 4, 6, *range(10, 6300))]
    # what does not fit over all uses up nothing of its concern
    data = [(f"c{n}", "a", n, 2000, False) for n in range(3)] + [("x", "a", 3, 400, False), ("x", "a", 4, 300, False), ("x", "a", 5, 100, False)]
    assert rows(retrieval.selected_evidence(spark.createDataFrame(data, schema)), "order_no") == [(0,), (1,), (2,), (5,)]


def test_served_ranges_keep_all_spans(spark, tmp_path):
    schema = "workspace_id string, file_path string, fingerprint string, seq long, start long, end long"
    data = [("w", "f", "v", n, 10 * n, 10 * n + 1) for n in range(300)] + [("w", "f", "v", 300, 0, 1)]
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = runner.drained(sessions.served_ranges(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))).orderBy("seq").collect()
    assert (out[-2]["served_lines"], out[-1]["served_lines"], out[-1]["added_lines"]) == (600, 600, 0)


def test_rejects_of_wide_files(spark):
    width = 1000
    good, short = ";".join(["1", '"a;b"', *["2"] * (width - 2)]), ";".join(["1"] * (width - 1))
    r = spark.createDataFrame([(1, 1, 1, good), (2, 1, 2, good), (3, 1, 3, short), (4, 1, 4, "x" + good[1:])], "row_id long, file_id long, row_no int, raw_record string")
    f = spark.createDataFrame([(1, False, [f"c{n}" for n in range(width)], ["integer", "text", *["integer"] * (width - 2)])], "file_id long, has_header boolean, column_names array<string>, column_types array<string>")
    assert {x["row_id"]: x["reason"] for x in rejects.parsed(r, f).collect()} == {1: None, 2: None, 3: "columns", 4: "values"}


def test_too_many_terms_are_refused(spark):
    lines = spark.createDataFrame([("a", 1, "x")], "path string, line int, text string")
    for call in (lambda: search.union_of(lines, list("abcdef")), lambda: search.absence(lines, lines, list("abcdefghijklm")), lambda: search.all_or_any(lines, list("abcdefghijklm"))):
        with pytest.raises(ValueError):
            call()


def test_selected_evidence_goes_on_past_a_round(spark, rows, monkeypatch):
    monkeypatch.setattr(retrieval, "ROUND", 2)
    data = [("a", "t", 1, 90, False), ("a", "t", 2, 20, False), ("b", "t", 3, 50, False), (None, "t", 4, 0, True), ("a", "t", 5, 10, False), ("a", "t", 6, 0, True), ("c", None, 7, None, True), ("c", None, 8, None, False), ("d", "t", 9, 40, False)]
    got = rows(retrieval.selected_evidence(spark.createDataFrame(data, "concern string, class string, order_no int, bytes int, served boolean"), 2, 100, 180), "order_no")
    assert got == [(1,), (3,), (4,), (5,), (7,)]


def test_files_reached_through_names_are_those_of_all_pairs(spark, rows):
    import random

    random.seed(6)
    files, names = [f"f{n}" for n in range(30)], [f"n{n}" for n in range(25)]
    uses = sorted({(random.choice(files), random.choice(names)) for _ in range(40)})
    defs = sorted({(random.choice(files), random.choice(names)) for _ in range(30)})
    u, d = spark.createDataFrame(uses, "path string, name string"), spark.createDataFrame(defs, "path string, name string")
    start = spark.createDataFrame([("f0",), ("f1",), ("f0",)], "id string")
    edges = spark.createDataFrame(sorted({(a, b) for a, n in uses for b, m in defs if n == m and a != b}), "src string, dst string")
    want = rows(retrieval.reachable(edges, start, 4))
    assert rows(retrieval.reachable_through(u, d, start, 4)) == want and len(want) > 3


def test_verification_and_includes(spark, rows):
    edited = spark.createDataFrame([("a/m/src/lease.ts",), ("a/m/src/other.ts",), ("b/m/src/lease.ts",), (None,)], "path string")
    data = [("a/m/t/lease.test.ts", "test", ["src/lease.ts"]), ("a/m/t/x.spec.ts", "test", ["m/src/other.ts", "other.ts"]), ("a/m/mocks/other_mock.ts", "mock", None), ("a/m/src/lease.ts", "test", [])]
    surfaces = spark.createDataFrame(data, "path string, role string, refs array<string>")
    assert rows(retrieval.verification(edited, surfaces)) == [
        ("a/m/src/lease.ts", "a/m/t/lease.test.ts", "test", "reference"), ("a/m/src/other.ts", "a/m/mocks/other_mock.ts", "mock", "stem"), ("a/m/src/other.ts", "a/m/t/x.spec.ts", "test", "reference"), ("b/m/src/lease.ts", "a/m/t/lease.test.ts", "test", "reference"),
    ]
    files = spark.createDataFrame([("a/x.h",), ("a/b/y.h",), ("c/b/y.h",), ("d/z/only.h",)], "path string")
    asked = spark.createDataFrame([("a/m.c", "x.h"), ("a/b/n.c", "../x.h"), ("a/b/n.c", "./y.h"), ("q/r.c", "b/y.h"), ("q/r.c", "z/only.h"), ("q/r.c", "none.h"), ("q/r.c", None)], "path string, target string")
    assert rows(retrieval.includes(asked, files)) == [("a/b/n.c", "../x.h", "a/x.h"), ("a/b/n.c", "./y.h", "a/b/y.h"), ("a/m.c", "x.h", "a/x.h"), ("q/r.c", "b/y.h", None), ("q/r.c", "none.h", None), ("q/r.c", "z/only.h", "d/z/only.h")]


def test_dialects_of_records_of_any_number(spark, rows):
    data = [(1, n, "a;b" if n == 1 else f"{n};x") for n in range(1, 400)] + [(2, 1, "q"), (2, 2, ""), (3, 1, None), (4, 1, "1|2|3"), (4, 25, "1|2|3|4")]
    r = spark.createDataFrame(data, "file_id long, row_no int, raw_record string")
    f = spark.createDataFrame([(n, "csv") for n in range(1, 5)], "file_id long, ext string")
    from loomfield.sources import delimited

    assert rows(delimited.record_dialects(r, f)) == [(1, ";", True, 398, 2), (2, ",", True, 0, 1), (4, "|", False, 2, 4)]
