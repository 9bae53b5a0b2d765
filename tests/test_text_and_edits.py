from loomfield.operators import documents, edits, retrieval, source
from loomfield.streaming import runner, sessions


def test_headings(spark, rows):
    text = "---\ntitle: x\n# no\n---\n# A\ntext\n```\n# no\n```\n## B ##\nSet\n===\n- item\n---\n#none\n"
    got = [(h["level"], h["text"], h["line"], h["end_line"], h["style"]) for h in documents.headings_of(text)]
    assert got == [(1, "A", 5, 10, "atx"), (2, "B", 10, 10, "atx"), (1, "Set", 11, 15, "setext")]
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    marks = documents.headings(df, "id", "text")
    assert marks.count() == 3 and marks.where("heading_no = 2").first()["path"] == ["A", "B"]
    assert rows(documents.select_sections(marks, "id", "b"), "heading_no", "how") == [(2, "exact")]
    assert documents.normalized_label("**Ｓｅｔ** [up](x)") == "set up"
    assert documents.headings(df.limit(0), "id", "text").count() == 0


def test_html_and_steps(spark, rows):
    html = spark.createDataFrame([("<h2>A</h2><p>x <b>y</b><br/>z</p><ul><li>i</li></ul><table><tr><td>1</td><td>2</td></tr></table>&lt;&amp;",), (None,)], "h string")
    assert html.select(documents.html_to_markdown(html["h"])).first()[0] == "## A\nx **y**\nz\n\n- i\n| 1 | 2 |\n<&"
    df = spark.createDataFrame([(1, "1. one\n- two\\_x\nStep 3: go\nplain\n- " + "y" * 300)], "id long, t string")
    assert rows(documents.steps(df, "id", "t")) == [(1, 1, "one"), (1, 2, "two_x"), (1, 3, "go")]
    assert documents.page_numbers(["3", "5-7", "x", "6"]) == [3, 5, 6, 7]
    cut = spark.createDataFrame([("a" * 9 + "\n\n" + "é" * 9,), ("short",), (None,)], "t string")
    assert [r[0] for r in cut.select(documents.cut_at_break(cut["t"], 12)).collect()] == ["a" * 9, "short", None]


def test_comments():
    code = 'x = "// no"; // yes\n/* a\nb */ y\n'
    assert source.without_comments(code, "typescript") == 'x = "// no";       \n    \n     y\n'
    assert source.line_kinds(code, "typescript") == ["code", "comment", "code", "blank"]
    assert source.line_kinds('"""doc\nmore"""\nx = "#" # c\n\n# d', "python") == ["comment", "comment", "code", "blank", "comment"]
    assert source.without_comments("/* a /* b */ c */ d", "rust").strip() == "d" and source.without_comments("/* a /* b */ c", "java").strip() == "c"
    shown = source.elided("a\n/* x\ny\nz */\nb", "java")
    assert shown == "a\n/* [lines 2-4 elided] */\nb" and source.shown_lines(shown, 1, 5) == [(1, 1), (5, 5)]


ROUTES = {
    "kotlin": ('routing {\n  route("/api") {\n    route("/users") {\n      get("/{id}") {\n        respond(1)\n      }\n      post { }\n    }\n    get("/health") { }\n  }\n  get("/top") {}\n}\nget { }', [(4, "GET", "/api/users/{id}", ""), (7, "POST", "/api/users", ""), (9, "GET", "/api/health", ""), (11, "GET", "/top", "")]),
    "javascript": ("app.get('/users/:id', getUser);\n// app.get('/no', x)\nrouter.post('/a//', auth, async (req, res) => {\n});\napp.use('/static', serve)\nx = \"app.get('/s')\"", [(1, "GET", "/users/:id", "getUser"), (3, "POST", "/a", ""), (5, "ANY", "/static", "serve"), (6, "GET", "/s", "")]),
    "java": ('@RequestMapping("/v1")\npublic class A {\n  @GetMapping("/x")\n  public List<String> list(int a) {\n  }\n  @PostMapping(value = "/y?z=1")\n  @Deprecated\n  public void make() {\n  }\n}\n', [(3, "GET", "/v1/x", "list"), (6, "POST", "/v1/y", "make")]),
    "python": ('@app.route("/p/<id>")\ndef page(id):\n    return 1\n@bp.post("/q")\nasync def q():\n', [(1, "ANY", "/p/<id>", "page"), (4, "POST", "/q", "q")]),
    "go": ('mux.HandleFunc("/go", handleGo)\nr.GET("/gin/:id", ctl.Show)\n', [(1, "ANY", "/go", "handleGo"), (2, "GET", "/gin/:id", "ctl.Show")]),
    "csharp": ('[Route("api/cs")]\npublic class C {\n  [HttpGet("{id}")]\n  public string Get(int id) {\n', [(3, "GET", "/api/cs/{id}", "Get")]),
}


def test_routes(spark, rows):
    for language, (text, want) in ROUTES.items():
        assert [r[:4] for r in source.routes_of(text, language)] == want, language
    df = spark.createDataFrame([(1, ROUTES["go"][0], "go", "x"), (2, None, "go", "x"), (3, "", None, "x")], "k int, text string, lang string, line string")
    assert rows(source.routes(df, ["k"]), "k", "line", "snippet", "confidence") == [(1, 1, 'mux.HandleFunc("/go", handleGo)', 0.8), (1, 2, 'r.GET("/gin/:id", ctl.Show)', 0.9)]


def test_bindings_imports(spark, rows):
    lines = spark.createDataFrame([("f", 1, "const limit = 5;"), ("f", 2, "limit = 7"), ("f", 3, "| Width | 12 |"), ("f", 4, "# depth: 3"), ("g", 1, "limit: 6"), ("f", 5, "app.get('/a//b', h)"), ("f", 6, '@PostMapping("/c")'), ("f", 7, "import { x } from './y'"), ("f", 8, "from a.b import c")], "path string, line long, text string")
    assert rows(source.bindings(lines.where("line < 5"), "path")) == [("f", 1, "limit", "5"), ("f", 3, "width", "12"), ("f", 4, "depth", "3"), ("g", 1, "limit", "6")]
    assert rows(source.imports(lines, "path"), "line", "imported") == [(7, "./y"), (8, "a.b")]
    bound = source.bindings(lines.where("line < 5"), "path").withColumn("kind", source.F.col("path"))
    assert rows(source.conflicts(bound, "path", "kind"), "name", "values") == [("limit", 2)]


def test_edits(spark, rows):
    assert edits.apply_edit("a\r\nb\r\n", "b", "x") == (True, "", "a\r\nx\r\n")
    assert edits.apply_edit("a a", "a", "b")[1] == "ambiguous" and edits.apply_edit("a", "z", "b")[1] == "not-found" and edits.apply_edit("a", "", "b")[1] == "empty-search"
    assert edits.apply_edit("a\nb", "a\\nb", "c\\nd")[2] == "c\nd"
    assert edits.apply_edit("  if x:\n\ty\n", "if x:\n  y", "z")[2] == "z\n"
    assert edits.replace_range("1\n2\n3\n", 2, 2, "x\ny\n") == (True, "", "1\nx\ny\n3\n") and edits.replace_range("1\n", 2, 2, "x")[1] == "out-of-bounds"
    assert edits.line_delta("a\nb\nc", "b\n", "x\ny\n") == (2, 1, 2) and edits.line_delta("a", "z", "") is None
    assert edits.rename('foo(foo2, "foo") // foo', "foo", "bar", "typescript") == ('bar(foo2, "foo") // foo', 1)
    assert edits.append_member("enum A { X, Y }", "A", "Z") == "enum A { X, Y, Z }" and edits.append_member("enum A { X }", "A", "X") is None
    assert edits.duplicate_branches("if (a) {\n  x();\n} else if (b) {\n  x();\n} else if (c) {\n  y();\n}") == [(1, 3)]
    assert edits.nearest_line("a\n b  c\nd", "b c\nd\nq")[:2] == (2, 2) and edits.blast_radius("x" * 300, 0, 290, "")[0]
    texts = spark.createDataFrame([("p", "one two"), ("q", "one"), ("r", None)], "path string, content string")
    steps = spark.createDataFrame([("p", 2, "three", "four"), ("p", 1, "one", "three"), ("q", 1, "zzz", "x"), ("r", 1, "a", "b")], "path string, edit_no int, search string, replace string")
    done = edits.edited(texts, steps)
    assert rows(done) == [("p", True, "", "four two"), ("q", False, "not-found", "one"), ("r", False, "no-text", None)]


def test_all_or_nothing(spark, tmp_path):
    good = spark.createDataFrame([("p", True, "", "x")], "path string, ok boolean, code string, content string")
    bad = good.selectExpr("path", "false ok", "'c' code", "content")
    assert not edits.all_or_nothing(good.union(bad), str(tmp_path / "a")) and not (tmp_path / "a").exists()
    assert edits.all_or_nothing(good, str(tmp_path / "b")) and spark.read.parquet(str(tmp_path / "b")).count() == 1


def test_retrieval(spark, rows):
    assert retrieval.query_terms('find "exact phrase" for sealManifest and API') == ["exact phrase", "sealManifest", "find", "API", "Manifest", "seal"] or "sealManifest" in retrieval.query_terms("sealManifest x")
    assert retrieval.variants("fooBar")[:5] == ["fooBar", "foobar", "FooBar", "foo-bar", "foo_bar"] and retrieval.stem("a-bcd-e") == "a-bcd" and retrieval.stem("ab-c") is None
    assert retrieval.probes("oneTwoThree") == ["oneTwo", "TwoThree", "one", "Two", "Three"]
    assert retrieval.nearest_key("paht", ["path", "part"]) == "path" and retrieval.nearest_key("zzzzz", ["path"]) is None
    items = spark.createDataFrame([(1, 5), (2, 99), (3, 4), (4, 3), (5, 1)], "item_no long, tokens long")
    assert [f for _, _, f in rows(retrieval.packed(items, 10), "item_no", "tokens", "fate")] == ["served", "cap-exceeded", "served", "cap-exhausted", "omitted"]
    c = spark.createDataFrame([("a.ts", 1, 2.0), ("b.ts", 1, 1.0)], "path string, line long, score double")
    assert rows(retrieval.decided(c)) == [(True, 1.0, "a.ts")] and retrieval.decided(c.limit(0)).count() == 0
    e = spark.createDataFrame([("x", "a"), ("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert rows(retrieval.reachable(e, spark.createDataFrame([("x",)], "id string"))) == [("a", 1), ("b", 2), ("c", 3), ("x", 0)]
    s = spark.createDataFrame([("k", "t", 1, 10, False), ("k", "t", 2, 10, False), ("k", "t", 3, 1, False), ("k", "u", 4, 9000, False), ("k", "u", 5, 9000, True)], "concern string, class string, order_no long, bytes long, served boolean")
    assert rows(retrieval.selected_evidence(s), "order_no") == [(1,), (2,), (5,)]


def test_ledger_equals_line_sets(spark, tmp_path):
    import random

    random.seed(3)
    rows_ = [("w", random.choice("ab"), "v1" if n < 60 else "v2", n, s := random.randint(1, 60), s + random.randint(0, 9)) for n in range(90)]
    schema = "workspace_id string, file_path string, fingerprint string, seq long, start long, end long"
    spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = runner.drained(sessions.served_ranges(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))).orderBy("seq").collect()
    held: dict = {}
    marks: dict = {}
    for (_, f, mark, seq, a, b), r in zip(rows_, out, strict=True):
        if marks.get(f, mark) != mark:
            held[f] = set()
        marks[f] = mark
        before = len(held.setdefault(f, set()))
        held[f] |= set(range(a, b + 1))
        assert (r["seq"], r["added_lines"], r["served_lines"]) == (seq, len(held[f]) - before, len(held[f]))


def test_epochs_governor_and_handles(spark, tmp_path):
    def run(data, schema, step, name):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / name))
        return runner.drained(step(spark.readStream.schema(schema).parquet(str(tmp_path / name)))).orderBy("seq").collect()

    e = run([("w", 1, ["a", "b"]), ("w", 2, ["b", "c"]), ("w", 3, ["c"]), ("w", 4, ["z"])], "workspace_id string, seq long, tokens array<string>", sessions.epochs, "e")
    assert [r["epoch"] for r in e] == [1, 1, 1, 2]
    g = run([("w", 1, "a", "v", False, 0), ("w", 2, "a", "v", False, 0), ("w", 3, "a", "v2", False, 0), ("w", 4, "b", "v", False, 0), ("w", 5, "b", "v", True, 0), ("w", 6, "c", "v", True, 3)], "workspace_id string, seq long, file_path string, fingerprint string, explicit boolean, repeats long", lambda s: sessions.read_governor(s, 2, 4), "g")
    assert [(r["allowed"], r["reason"]) for r in g] == [(True, ""), (False, "already-read"), (True, ""), (False, "task-limit"), (True, ""), (False, "task-limit")]
    h = run([("w", n, p) for n, p in enumerate("abcabd")], "workspace_id string, seq long, place string", lambda s: sessions.handles(s, 3), "h")
    assert h[0]["handle"] == h[3]["handle"] and h[5]["is_new"] and h[5]["evicted"] == 1 and len(h[0]["handle"]) == 11
