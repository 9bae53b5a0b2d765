import pytest

from loomfield.llm import origins

BODIES = [
    ("// Code generated by x-gen v2. DO NOT EDIT.\npackage a", "generated"), ("# Automatisch erzeugt durch x - nicht bearbeiten\nx = 1", "generated"), ("// 自動生成ファイルです。編集しないでください。", "generated"), ("// This file was automatically created by a-gen; manual changes will be lost.", "generated"),
    ("// a b\n\n// Produced by a-gen from the b schema. Edits here are overwritten at the next build.\n", "generated"), ("// <auto-generated />", "generated"), ("# AUTOGENERATED FILE, run `x` to refresh it", "generated"), ("/* @generated from a.graphql */", "generated"),
    ("// lib.js v9.4.7 | (c) the lib contributors | permissive licence", "vendored"), ("# Imported unchanged from the lib distribution, version 0.7.4.", "vendored"), ("// Upstream: lib v7.4.4. Local copy, keep in sync, do not modify.", "vendored"), ("/*! lib v1.2.3 */\nx();", "vendored"), ("// lib 1.2.3 - third-party code, copied from https://lib.example/r", "vendored"),
    ("// licence line\n" * 45 + "// Code generated by x. DO NOT EDIT.\nx()", "generated"), ("/*\n" + "Permission is granted\n" * 80 + "Code generated by x. DO NOT EDIT.\n*/\nx()", "generated"), ("// " + "a b " * 200 + "was generated by x, do not edit", "generated"),
    ("".join(f"!function(){{a.b{n}=!0}}();var c=d({n});" for n in range(30)), "minified"), ("static const int t[] = {\n" + "    0x0016, 0x007b, 0x001e, 0x0005, 0x0060, 0x00d8,\n" * 20 + "};", "data"), ('x = "' + "QUJDREVG0Zz" * 60 + '";', "data"),
    ("# the header check: output must start with \"DO NOT EDIT\"\nx = 1", None), ('expect(x).toContain("generated by")', None), ("// covers the minified bundle writer\nf();", None), ("// compares our own part with the vendor feed", None), ("/* (c) the workspace maintainers, internal use */", None), ("", None), ("x = 1\n" * 50, None),
]


@pytest.mark.parametrize(("code", "want"), BODIES)
def test_bodies(code, want):
    assert origins.body_kind(code) == want


def test_paths(spark):
    want = {
        "a/b/node_modules/x/y.js": "vendored", "a/b/Third-Party/x/y.rb": "vendored", "a/deps/lib-2.3.0/src/s.c": "vendored", "a/b/public/x.min.js": "minified", "a/www/x.MIN.JS": "minified", "a/dist/x.js": "minified", "a/assets/x.5511ac9b.js": "minified", "a/static/x-min.js": "minified",
        "a/p/x.pb.go": "generated", "a/p/x_pb2.py": "generated", "a/src/HandleGrpc.java": "generated", "a/ui/X.Designer.cs": "generated", "a/x.tab.c": "generated", "a/moc_x.cpp": "generated", "a/zz_generated.x.go": "generated", "a/src/__generated__/x.rb": "generated", "a/x.auto.ts": "generated", "a/x_gen.go": "generated",
        "a/x.data.js": "data", "a/res/x_bin.h": "data", "a/x_font_data.c": "data", "a/x.wasm.js": "data",
        "a/src/vendors_list/x.ts": None, "a/src/vendor_portal/x.ts": None, "a/src/codegen/emit_x.py": None, "a/src/generator/x_templates.ts": None, "a/src/regenerate_x.go": None, "a/tests/minifier_x_test.ts": None, "a/src/minimap/x.ts": None, "a/src/x_minutes.kt": None, "a/src/distribution/x.py": None, "a/mocks/x_mock.ts": None, "a/src/blob_store/x.ts": None, None: None,
    }
    df = spark.createDataFrame([(p,) for p in want], "p string")
    got = {r["p"]: r["k"] for r in df.select("p", origins.path_kind(df["p"]).alias("k")).collect()}
    assert got == want


def test_merkle(spark):
    leaves = [("r1", "lib/a.c", 1, 1), ("r1", "lib/sub/b.c", 2, 2), ("r1", "own.c", 3, 3), ("r2", "x/lib/sub/b.c", 2, 2), ("r2", "x/lib/a.c", 1, 1), ("r3", "lib/a.c", 1, 1), ("r3", "lib/sub/b.c", 9, 2), ("r3", None, 1, 1), ("r3", "n", None, 1)]
    df = spark.createDataFrame([(*x, "o" + x[0], "p" + x[0]) for x in leaves], "repository string, path string, hash_hi long, hash_lo long, owner string, root string")
    folders = origins.merkle(df, keep=("owner", "root"))
    h = {(r["repository"], r["folder"]): (r["hash_hi"], r["hash_lo"], r["n_files"]) for r in folders.collect()}
    assert h["r1", "lib"] == h["r2", "x/lib"] != h["r3", "lib"] and h["r1", ""][2] == 3 and h["r1", "lib/sub"] == h["r2", "x/lib/sub"]
    assert {(r[0], r[1]) for r in origins.shared_folders(folders).collect()} == {("r1", "lib"), ("r2", "x/lib")}
    assert {(r[0], r[1]) for r in origins.shared_folders(folders, least_files=1).collect()} == {("r1", "lib"), ("r1", "lib/sub"), ("r2", "x/lib"), ("r2", "x/lib/sub")}
    assert origins.merkle(df.limit(0)).count() == 0


def test_folders_of_any_depth(spark):
    data = [(r, "/".join(["d"] * 44 + tail), n) for r in ("r1", "r2") for n, tail in enumerate((["f"], ["e", "g"]))] + [("r2", "/".join(["d"] * 44 + ["e", "h"]), 9)]
    folders = origins.merkle(spark.createDataFrame([(r, p, n, n, r, r) for r, p, n in data], "repository string, path string, hash_hi long, hash_lo long, owner string, root string"))
    assert folders.where("folder = ''").select("hash_hi").distinct().count() == 2  # told apart below forty levels
    assert folders.count() == 2 * 46


@pytest.mark.parametrize(("a", "b", "shared"), [(("w1", "a/r1"), ("w2", "b/r9"), True), (("w1", "a/r1"), ("w2", "a/r1"), False), (("w1", "a/r1"), ("w1", "b/r9"), False), (("w1", "a/r1"), (None, "b/r9"), False)])
def test_unrelated_repositories(spark, a, b, shared):
    rows = [(f"{root}/{below}/{name}", owner, code) for (owner, root), below in ((a, "v/k"), (b, "q/k")) for name, code in (("x.c", "int f() { return 1; }"), ("y.c", "int g() { return 2; }"))]
    df = spark.createDataFrame([*rows, ("a/r1/src/own.c", "w1", "int h() { return 3; }")], "file_path string, workspace_id string, code string")
    got = {r["file_path"]: r["told_by"] for r in origins.origins(df.select("file_path"), df, rules=False).collect()}
    assert {p for p, by in got.items() if by == "tree"} == ({p for p, _, _ in rows} if shared else set()) and got["a/r1/src/own.c"] is None


def test_origins(spark, rows):
    paths = spark.createDataFrame([("a/r1/src/x.ts",), ("a/r1/src/x.ts",), (None,), ("a/r2/dist/y.js",)], "file_path string")
    one, two = "int f() { return 1; }", "int g() { return 2; }"
    bodies = [("a/r1/v/k.c", "w1", one), ("a/r1/v/l.c", "w1", two), ("b/r9/q/k.c", "w2", one), ("b/r9/q/l.c", "w2", two), ("c/r5/q/k.c", "w3", one), ("a/r1/src/z.ts", "w1", None), ("a/r1/src/g.ts", None, "// @generated from x\n"), (None, "w1", "x")]
    df = spark.createDataFrame(bodies, "file_path string, workspace_id string, code string").selectExpr("*", "'own' AS body_kind", "'x' AS owner")
    assert rows(origins.origins(paths, df)) == [
        ("a/r1/src/g.ts", "generated", "body"), ("a/r1/src/x.ts", "hand-written", None), ("a/r1/src/z.ts", "hand-written", None), ("a/r1/v/k.c", "vendored", "tree"), ("a/r1/v/l.c", "vendored", "tree"), ("a/r2/dist/y.js", "minified", "path"),
        ("b/r9/q/k.c", "vendored", "tree"), ("b/r9/q/l.c", "vendored", "tree"), ("c/r5/q/k.c", "hand-written", None),
    ]
    assert origins.origins(paths.limit(0), df.limit(0)).count() == 0
