"""Operators whose queries show them on given data, here on nulls, empty tables, ties and planted cases."""

import io
import zipfile

from pyspark.sql import functions as F

from loomfield.operators import edits, outline, retrieval, trees
from loomfield.sources import delimited, files, office, repository


def test_located_by_every_source(spark, rows):
    symbols = spark.createDataFrame([("a/s.ts", 3, "LeaseRouter"), ("b/f.ts", 4, "leaseHolder"), ("t/tests/x.ts", 5, "leaseRouter")], "path string, line int, name string")
    lines = spark.createDataFrame([("c/t.ts", 7, "x = leaseRouter()"), ("d/v.ts", 8, "load('lease-router')"), ("e/r.ts", 9, "a seal b"), ("g/n.ts", 1, "nothing")], "path string, line int, text string")
    names = spark.createDataFrame([("h/seal_lease.ts",), ("lease/router/x.ts",), (None,)], "path string")
    got = {r["path"]: (r["line"], r["kind"], r["score"]) for r in retrieval.located(symbols, lines, names, "leaseRouter seal", most=20).collect()}
    assert got == {
        "a/s.ts": (3, "symbol", 2.0), "b/f.ts": (4, "symbol", 0.8), "t/tests/x.ts": (5, "symbol", 1.7), "c/t.ts": (7, "text", 0.6), "d/v.ts": (8, "variant", 0.7), "e/r.ts": (9, "text", 0.6), "h/seal_lease.ts": (1, "filename", 1.5), "lease/router/x.ts": (1, "path", 0.6),
    }
    assert retrieval.located(symbols, lines, names, "the of").count() == 0 and retrieval.located(symbols.limit(0), lines.limit(0), names.limit(0), "x y").count() == 0
    best = retrieval.decided(spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 1.0)], "path string, score double"))
    assert rows(best) == [(True, 1.0, "a")]


def test_query_shapes(spark):
    asked = {"Where is FooKind defined?": ["enum", "code", "question"], "fix src/a.ts": ["path", "change"], "plain words here": [], "": [], "add a status": ["enum", "change"], "statement": []}
    df = spark.createDataFrame([(q,) for q in asked] + [(None,)], "q string").select("q", retrieval.query_shapes(F.col("q")).alias("s"))
    assert {r["q"]: r["s"] for r in df.collect()} == asked | {None: None}


def test_stale(spark):
    one, other = (spark.createDataFrame([(".", d), ("a", "x")], "dir string, digest string") for d in ("1", "2"))
    assert [trees.stale(a, b).first()[0] for a, b in ((one, one), (one, other), (one.limit(0), one), (one, one.limit(0)))] == [False, True, True, True]


def test_omission_layers(spark, rows):
    data = [("a.ts", 1, b"x", None), ("b.ts", 1, b"x", True), ("gen/c.ts", 1, b"x", False), ("mock/d.ts", 1, b"x", None), ("dist/e.ts", 1, b"x", None), ("f.ts", 9, b"x", None), ("id_rsa", 1, b"x", None), (None, 1, b"x", None)]
    df = spark.createDataFrame(data, "path string, size_bytes long, content binary, is_link boolean")
    got = rows(files.classified(df, gitignore=["gen/"], tool=["mock/"]), "path", "omission")
    assert got == [(None, "non_text"), ("a.ts", None), ("b.ts", "symlinks"), ("dist/e.ts", "ignored"), ("f.ts", "changed"), ("gen/c.ts", "gitignored"), ("id_rsa", "secrets"), ("mock/d.ts", "tool-ignored")]
    assert files.omissions(df.limit(0)).count() == 0


def test_previews_media_and_scalars(spark, rows):
    cells = spark.createDataFrame([("b", "S", False, r, c, f"{r}{c}", "number" if r > 1 else "string") for r in (1, 2, 3, 9) for c in (1, 3)] + [("b", "huge", False, 2_000_000, 1, "x", "string")], "k string, sheet string, hidden boolean, row long, col long, value string, kind string")
    assert rows(office.preview(cells, "k", rows=2), "line_no", "line") == [(1, "| 11 |  | 13 |"), (2, "| number |  | number |"), (3, "| 21 |  | 23 |"), (4, "| 31 |  | 33 |")]
    assert office.preview(cells.limit(0), "k").count() == 0
    assert [office.scalar(x) for x in ("1.5", "-2e3", " 7 ", "x", "", "1,000", "NaN")] == [1.5, -2000.0, 7.0, "x", "", "1,000", "NaN"]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="w" xmlns:r="http://x/r"><w:pic><cNvPr descr="A &amp; B"/><blip r:embed="i1"/></w:pic><w:pic><cNvPr/></w:pic><w:pic><cNvPr title="T"/><blip r:embed="none"/></w:pic></w:d>')
        z.writestr("word/_rels/document.xml.rels", '<R><Relationship Id="i1" Target="media/a.png"/></R>')
    assert list(office.media(out.getvalue())) == [("word/document.xml", "word/media/a.png", "A & B"), ("word/document.xml", "", "T")]


def test_windows_of_tables(spark, rows):
    df = spark.createDataFrame([(1, b"a;b\n1;\"x;y\"\n3;4\n5;6\n", "csv"), (2, None, "csv"), (3, b"", "csv")], "id int, content binary, ext string")
    assert rows(delimited.windows(df, "id", (2, 3), ["b"])) == [(1, 2, 1, "b", "x;y"), (1, 3, 1, "b", "4")]
    assert delimited.windows(df.limit(0), "id", (1, 2)).count() == 0


def test_scip_round_trip(spark, rows):
    data = repository.scip_bytes([("a/b.ts", [("sym", 300, 7, True), ("ünï", 1, 0, False)]), ("c", [])])
    assert list(repository.scip_occurrences(data)) == [("a/b.ts", "sym", 300, 7, True), ("a/b.ts", "ünï", 1, 0, False)]


def test_logs_of_any_length(spark, rows):
    log = [("commit 1111111",), ("a",)] + [(f"f{n}",) for n in range(3000)] + [("commit 2222222",), ("b",), ("commit 3333333",), ("c",)]
    df = spark.createDataFrame([(n, *x) for n, x in enumerate(log)], "line_no long, value string")
    assert repository.recent_files(df, commits=2).count() == 3002 and repository.recent_files(df, commits=9).count() == 3003 and repository.recent_files(df.limit(0)).count() == 0
    hunks = spark.createDataFrame([(n, v) for n, v in enumerate(["x", "diff --git a/p b/p", "@@ -1 +2,3 @@", "diff --git a/q b/q", None])], "line_no long, value string")
    assert rows(repository.diff_hunks(hunks)) == [("p", "modified", 1, 1, 2, 3), ("q", "modified", None, None, None, None)]


def test_doc_map_and_compact(spark, rows):
    code = "// Opens it.\n// Twice.\nfunction a() {\n}\nfunction b() {}\n"
    assert outline.bare_outline(code, "javascript", "doc-map") == "a L3-4: Opens it.\nb L5-5"
    ranked = spark.createDataFrame([(f"f{n:03}", 1.0 / (n + 1), 0 if n % 2 else 3) for n in range(200)], "path string, rank double, tokens long")
    assert outline.compact(ranked, 10, 2).count() == 4 and outline.compact(ranked.limit(0)).count() == 0


def test_of_each_text(spark, rows):
    df = spark.createDataFrame([(1, "a\\n", "x"), (2, None, "x"), (3, "", "x")], "k int, t string, ok string")
    assert rows(edits.of_each(df, ["k"], "t", lambda t: (edits.unescaped(t), len(t)), "ok string, n int")) == [(1, "a\n", 3), (3, "", 0)]
