from loomfield.operators import outline, symbols

CODE = "import { x } from './y';\n\nexport class A {\n  m() {\n    x();\n  }\n}\n\nfunction f(a) {\n  return x(a);\n}\n"


def test_bare_outline():
    assert outline.bare_outline(CODE, "typescript") == "import { x } from './y';\nexport class A {\n  m() { ... }\nfunction f(a) { ... }"
    assert outline.bare_outline(CODE, "typescript", "class-map") == "export class A {" and outline.bare_outline(CODE, "typescript", "symbol-map") == "A L3-7\nm L4-6\nf L9-11"
    assert outline.bare_outline("", "typescript") == ""


def test_context_roles_and_chunks(spark, rows):
    files = spark.createDataFrame([("a.ts", CODE), ("b.md", "# Title here\ntext"), ("c.py", "# says what this does\nx = 1"), ("d.ts", None)], "path string, content string")
    assert rows(outline.roles(files)) == [("a.ts", "export class A"), ("b.md", "Title here"), ("c.py", "says what this does")]
    s = symbols.symbols(files)
    lines = spark.createDataFrame([("a.ts", n, t) for n, t in enumerate(CODE.split("\n"), 1)], "path string, line long, text string")
    got = rows(outline.symbol_with_context(lines, s, "f"), "part", "line")
    assert got == [("body", 9), ("body", 10), ("body", 11), ("import", 1), ("sibling", 3), ("sibling", 4)]
    chunks = outline.symbol_chunks(s.where("path = 'a.ts'"), most=16)
    assert rows(chunks, "chunk_name", "line_start", "line_end") == [("A#1", 3, 4), ("A#2", 5, 6), ("A#3", 7, 7), ("f#1", 9, 10), ("f#2", 11, 11), ("m#1", 4, 5), ("m#2", 6, 6)]
    assert {r["name"]: len(r["chunk_ids"]) for r in outline.chunks_of_symbols(s.where("path = 'a.ts'"), chunks).collect()} == {"A": 3, "f": 2, "m": 2}


def test_compact_and_entry_points(spark, rows):
    ranked = spark.createDataFrame([("a", 3.0, 50), ("b", 2.0, 60), ("c", 1.0, 10)], "path string, rank double, tokens long")
    assert rows(outline.compact(ranked, 100, 1), "path") == [("a",)] and rows(outline.compact(ranked, 120, 0), "path") == [("a",), ("b",), ("c",)]
    p = spark.createDataFrame([("src/index.ts",), ("bin/cli.js",), ("x/other.ts",), ("x/main.py",)], "path string")
    assert [tuple(r) for r in outline.entry_points(p).collect()] == [("bin/cli.js", 6), ("src/index.ts", 6), ("x/main.py", 5)]
    j = spark.createDataFrame([("a/package.json", '{"name":"n","scripts":{"b":"x","a":"y"}}'), ("package.json", "torn")], "path string, content string")
    assert [tuple(r) for r in outline.packages(j).collect()] == [("a", "n", None, None, ["a", "b"])]


def test_spans_taken_back(spark, rows):
    served = spark.createDataFrame([("r", "a", 1, 10), ("r", "a", 20, 30), ("q", "a", 1, 5)], "request_id string, path string, start long, end long")
    carried = spark.createDataFrame([("r", "a", 5, 22)], "request_id string, path string, start long, end long")
    assert rows(outline.retracted(served, carried)) == [("r", "a", 5, 10), ("r", "a", 20, 22)]
    texts = spark.createDataFrame([("a", "one two"), ("b", "two two"), ("c", "three")], "path string, content string")
    assert rows(outline.unique_target(texts, "one")) == [("a",)] and outline.unique_target(texts, "two").count() == 0
