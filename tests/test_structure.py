import random

from pyspark.sql import functions as F

from loomfield.functions import paths
from loomfield.functions import text as tx
from loomfield.operators import graph, intervals, search, trees, usage
from loomfield.session import lag_in_blocks


def test_interval_union_equals_line_sets(spark, rows):
    random.seed(1)
    data = [(random.choice("ab"), s := random.randint(1, 80), s + random.randint(-1, 9), "own") for _ in range(200)] + [("a", None, 4, "own")]
    df = spark.createDataFrame(data, "k string, start long, end long, _island string").drop("_island")
    merged = rows(intervals.union(df, ["k"]))
    for k in "ab":
        held = {n for x, a, b, _ in data if x == k and a is not None for n in range(a, b + 1)}
        spans = [(a, b) for x, a, b in merged if x == k]
        assert {n for a, b in spans for n in range(a, b + 1)} == held
        assert all(b + 1 < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
    assert intervals.union(df.limit(0), ["k"]).count() == 0
    gaps = intervals.complement(intervals.union(df, ["k"]).withColumn("total", F.lit(100).cast("long")), ["k"], "total")
    for k in "ab":
        held = {n for x, a, b, _ in data if x == k and a is not None for n in range(a, b + 1)}
        assert {n for x, a, b in rows(gaps) if x == k for n in range(a, b + 1)} == set(range(1, 101)) - held


def test_overlaps_equal_all_pairs(spark, rows):
    random.seed(2)
    make = lambda n: sorted({(random.choice("ab"), s := random.randint(1, 400), s + random.randint(0, 90)) for _ in range(n)})
    a, b = make(60), make(60)
    frame = lambda x: spark.createDataFrame(x, "k string, start long, end long")
    want = sorted((k, s, e, t, u) for k, s, e in a for j, t, u in b if k == j and s <= u and e >= t)
    assert rows(intervals.overlaps(frame(a), frame(b), ["k"], 16), "k", "a_start", "a_end", "b_start", "b_end") == want


def test_overlap_counts_equal_all_pairs(spark, rows):
    random.seed(4)
    data = [(random.choice("ab"), a := random.randint(1, 60), a + random.randint(-2, 25)) for _ in range(300)] + [("c", None, 3), ("c", 3, None), ("d", 5, 5)]
    df = spark.createDataFrame(data, "k string, start long, end long")
    real = {x for x in data if None not in x and x[1] <= x[2]}
    want = sorted((k, a, b, sum(k == q and a <= d and b >= c for q, c, d in real)) for k, a, b in real)
    assert rows(intervals.overlap_counts(df, ["k"])) == want
    assert intervals.overlap_counts(df.limit(0), ["k"]).count() == 0


def test_parsed_ranges_and_containing(spark, rows):
    df = spark.createDataFrame([("L3-9",), ("4",), ("5,7",), ("x",), (None,), ("",)], "r string")
    assert rows(intervals.parsed(df, "r"), "start", "end") == [(None, None)] * 3 + [(3, 9), (4, 4), (5, 7)]
    spans = spark.createDataFrame([("a", 1, 10, "outer"), ("a", 3, 5, "inner")], "k string, start long, end long, label string")
    points = spark.createDataFrame([("a", 2), ("a", 4), ("a", 6), ("a", 11), ("b", 1)], "k string, line long")
    assert rows(intervals.containing(points, spans, ["k"])) == [("a", 2, "outer"), ("a", 4, "inner"), ("a", 6, "outer"), ("a", 11, None), ("b", 1, None)]


def test_lag_in_blocks(spark):
    random.seed(4)
    data = [(k, n, f"{k}{n}") for k in "ab" for n in random.sample(range(5000), 300)]
    df = lag_in_blocks(spark.createDataFrame(data, "k string, n long, v string"), "k", "n", F.col("v"), 64)
    for k in "ab":
        own = sorted(n for x, n, _ in data if x == k)
        before = dict(zip(own[1:], own, strict=False))
        assert all(r["previous"] == (f"{k}{before[r['n']]}" if r["n"] in before else None) for r in df.where(F.col("k") == k).collect())


def test_trees(spark, rows):
    df = spark.createDataFrame([("a/b/x.ts",), ("a/y.ts",), ("z.ts",), (None,)], "path string")
    assert rows(trees.tree_counts(df)) == [("a", 1, 2), ("a/b", 2, 1)]
    assert rows(trees.module_map(df)) == [(".", "a", 2), (".", "z.ts", 2), ("a", "b", 2), ("a", "y.ts", 2), ("a/b", "x.ts", 1)]
    marks = spark.createDataFrame([("a",), ("a/b",)], "root string")
    assert rows(trees.roots_of(df.where("path is not null"), marks)) == [("a/b/x.ts", "a/b"), ("a/y.ts", "a"), ("z.ts", None)]
    assert trees.dominant(df.where("false"), "path").count() == 0


def test_folder_digests(spark):
    def digest(data):
        return {r["dir"]: r["digest"] for r in trees.folder_digests(spark.createDataFrame(data, "path string, hash string")).collect()}

    base = [("a/x", "1"), ("a/c/y", "2"), ("b/z", "3")]
    one, other = digest(base), digest([*reversed(base)])
    assert one == other and set(one) == {".", "a", "a/c", "b"}
    changed = digest([("a/x", "1"), ("a/c/y", "9"), ("b/z", "3")])
    assert changed["b"] == one["b"] and all(changed[d] != one[d] for d in (".", "a", "a/c"))
    assert trees.folder_digests(spark.createDataFrame([], "path string, hash string")).count() == 0


def test_pagerank_equals_a_plain_loop(spark):
    random.seed(6)
    nodes = [f"n{k}" for k in range(12)]
    edges = sorted({(random.choice(nodes), random.choice(nodes), float(random.randint(1, 3))) for _ in range(40)})
    edges = [(a, b, w) for a, b, w in {(a, b): (a, b, w) for a, b, w in edges}.values()]
    pref = {n: 2.0 if n in ("n1", "n2") else 1.0 for n in nodes}
    rank = dict(pref)
    total = {n: sum(w for a, _, w in edges if a == n) for n in nodes}
    for _ in range(7):
        rank = {n: 0.15 * pref[n] + 0.85 * sum(rank[a] * w / total[a] for a, b, w in edges if b == n) for n in nodes}
    df = graph.pagerank(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([(n, pref[n]) for n in nodes], "id string, preference double"), iterations=7)
    assert all(abs(r["rank"] - rank[r["id"]]) < 1e-9 for r in df.collect()) and df.count() == 12


def test_symbol_ranks_equal_pagerank_over_edges(spark):
    random.seed(8)
    names = [f"name{k}" for k in range(9)]
    data = [(f"f{k % 7}", random.choice(names), k) for k in range(30)]
    s = spark.createDataFrame(data, "path string, name string, position long")
    t = spark.createDataFrame(sorted({(f"f{k}", random.choice(names)) for k in range(8) for _ in range(5)}), "path string, token string")
    likes = spark.createDataFrame([("f1", 2.0)], "path string, preference double")
    nodes = s.join(likes, "path", "left").select(F.concat("path", F.lit(":"), "name").alias("id"), "preference")
    for cap in (50, 4):
        want = {r["path"]: r["score"] for r in graph.file_scores(graph.pagerank(graph.lexical_edges(s, t, cap), nodes, iterations=6), s, None).collect()}
        for small in (0, graph.SMALL):  # by joins, and in one task
            got = {r["path"]: r["score"] for r in graph.file_scores(graph.symbol_ranks(s, t, likes, iterations=6, cap=cap, small=small), s, None).collect()}
            assert want.keys() == got.keys() and all(abs(want[p] - got[p]) < 1e-9 for p in want)
    assert graph.symbol_ranks(s.limit(0), t).count() == 0 and graph.symbol_ranks(s, t.limit(0)).count() == 7


def test_lexical_edges(spark, rows):
    s = spark.createDataFrame([("a", "foo", 1), ("b", "bar", 2), ("c", "foo", 3), ("c", "foo", 4)], "path string, name string, position long")
    t = spark.createDataFrame([("a", "bar"), ("b", "foo"), ("b", "bar"), ("c", "foo")], "path string, token string")
    assert rows(graph.lexical_edges(s, t)) == [("a:foo", "b:bar", 1.0), ("b:bar", "a:foo", 1.0), ("b:bar", "c:foo", 2.0)]
    assert len(rows(graph.lexical_edges(s, t, cap=1))) == 2


def test_symbol_search(spark):
    s = spark.createDataFrame([("src/a.ts", 1, "sealManifest"), ("src/a.ts", 9, "manifest"), ("src/b.test.ts", 1, "manifest"), ("dist/c.ts", 1, "manifest"), ("src/d.ts", 1, "other")], "path string, line long, name string")
    got = graph.symbol_search(s, "manifest").collect()
    assert [(r["path"], r["name"]) for r in got] == [("src/a.ts", "manifest"), ("src/b.test.ts", "manifest"), ("dist/c.ts", "manifest")] and got[0]["total"] == 3
    assert got[0]["score"] == 7.5 and got[1]["score"] == 8.0 - 1.0 or got[1]["score"] == 6.5
    assert graph.symbol_search(s.limit(0), "x").count() == 0 and graph.symbol_search(s, "").count() == 0


def test_search(spark, rows):
    files = spark.createDataFrame([("a", "one\r\ntwo token\nToken"), ("b", None), ("c", ""), ("d", "x" * 300 + " token " + "y" * 300)], "path string, content string")
    lines = search.line_table(files)
    assert rows(lines.where("path in ('a', 'c')")) == [("a", 1, "one"), ("a", 2, "two token"), ("a", 3, "Token"), ("c", 1, "")]
    assert rows(search.matching(lines, "token"), "path", "line", "start") == [("a", 2, 5), ("a", 3, 1), ("d", 1, 302)]
    assert rows(search.matching(lines, "two token"), "path", "line") == [("a", 2)]
    snippet = search.grouped(search.matching(lines, "token", ignore_case=False)).where("path = 'd'").first()["snippet"]
    assert snippet.startswith("…") and snippet.endswith("…") and "token" in snippet and len(snippet) == 82
    assert not search.safe_pattern("(a+)+") and not search.safe_pattern("(?=x)") and search.safe_pattern(r"def \w+\(")
    assert search.read_cursor(search.cursor("p:q", 3)) == ("p:q", 3) and search.read_cursor("@@") is None
    seen, mark = [], None
    hits = search.matching(lines, "token").select("path", "line")
    while page := search.page(hits, mark, 1).collect():
        seen += [tuple(r) for r in page]
        mark = search.cursor(*seen[-1])
    assert seen == [("a", 2), ("a", 3), ("d", 1)]


def test_references_and_unicode_bounds(spark, rows):
    lines = spark.createDataFrame([("a.py", 1, "日本foo bar"), ("a.py", 2, "# foo"), ("a.py", 3, "x = 'foo'"), ("a.py", 4, "foobar")], "path string, line long, text string")
    assert rows(search.references(lines, "foo"), "line", "in_comment") == [(1, False), (2, True)]
    assert search.references(lines, "not a name").count() == 0


def test_evidence_windows(spark):
    lines = spark.createDataFrame([("a", n, "lease router" if n in (10, 80) else "lease" if n == 40 else "x") for n in range(1, 101)], "path string, line long, text string")
    r = search.evidence_windows(lines, {"lease": 2.0, "router": 4.0}).first()
    assert r["line"] == 1 and r["margin"] == 0.0 and r["score"] > 3


def test_text_functions(spark):
    df = spark.createDataFrame([("a\r\nb\n", "getHTTPServer_name-x"), ("", ""), ("\n", None), (None, "A")], "t string, n string")
    assert [r[0] for r in df.select(tx.line_count(F.col("t"))).collect()] == [2, 0, 0, 0]
    assert df.select(tx.identifier_parts(F.col("n"))).first()[0] == ["get", "http", "server", "name", "x"]
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    assert [pick(tx.column_letters(F.lit(n))) for n in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"] and pick(tx.column_letters(F.lit(0))) is None
    assert pick(tx.column_number(F.lit("AAA"))) == 703 and pick(tx.column_number(F.lit("a1"))) is None
    assert [pick(tx.endpoint(F.lit(u))) for u in ("https://h:1/a//b/?q#f", "a", "/", "http://h")] == ["/a/b", "/a", "/", "/"]
    assert [pick(tx.nonnegative_integer(F.lit(x))) for x in (1.5, -1.0, float("nan"))] == [2, 0, 0]
    assert pick(tx.compressed(F.lit("a  \r\n\r\n\r\n\r\nb"))) == "a\n\nb"
    assert [pick(paths.surface(F.lit(p))) for p in ("src/types/a.ts", "a/__tests__/b.ts", "src/control/x.ts", "README.md", "x/migrations/1.py", "zzz.rs")] == ["contract", "test", "domain", "doc", "data", "unknown"]
    assert pick(paths.language(F.lit("x.h"), F.lit("class A {}"))) == "cpp" and pick(paths.language(F.lit("x.h"))) == "c" and pick(paths.language(F.lit("x"))) is None


def test_usage(spark, rows):
    e = spark.createDataFrame([("read", "x", "ok", 10.0, 30.0), ("read", "y", "error", 5.0, 50.0), ("edit", "x", "ok", 4.0, None)], "tool string, client string, outcome string, response double, baseline double")
    r = usage.summary(e, ["read", "edit", "none"], ["x"]).first()
    assert (r["event_count"], r["failed_calls"], r["measured_calls"], r["saved"], r["tool_none"], r["client_x"]) == (3, 1, 1, 20.0, 0, 2) and abs(r["reduction_percent"] - 66.6667) < 1e-3
    empty = usage.summary(e.limit(0), [], []).first()
    assert empty["event_count"] == 0 and empty["reduction_percent"] is None
    m = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("b", 1, 3)], "k string, total long, no long")
    assert rows(usage.largest_per_message(m, ["k"], "total", "no")) == [("a", 5, 1), ("b", 1, 3)]
    resets = spark.createDataFrame([("2024-01-01T00:00:00Z", 1), ("bad", 3), ("2023-01-01T00:00:00Z", 2)], "reset_at string, line_no long")
    assert str(usage.last_reset(resets).first()[0])[:4] == "2023" and usage.last_reset(resets.limit(0)).count() == 0
