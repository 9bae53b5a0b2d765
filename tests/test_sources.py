import io
import json
import os
import tarfile
import zipfile

from pyspark.sql import functions as F

from loomfield.operators import usage
from loomfield.sources import delimited, files, logs, office, repository

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def package(**parts):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/"), body)
    return buffer.getvalue()


def zipped(parts):
    return package(**{k.replace("/", "__"): v for k, v in parts.items()})


XLSX = zipped(
    {
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" r:id="r1"/><sheet name="Two" state="hidden" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>Name</t></si><si><r><t>A</t></r><r><t>b</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/s1.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Day</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><f>1+1</f><v>2</v></c><c r="C2" s="1"><v>45292</v></c><c r="AA2" t="b"><v>1</v></c></row></sheetData></worksheet>',
        "xl/worksheets/s2.xml": f'<worksheet {S}><sheetData><row><c><v>7</v></c></row></sheetData></worksheet>',
    }
)
DOCX = zipped({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t></w:r><w:r><w:t>text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
PPTX = zipped(
    {
        "ppt/presentation.xml": f'<p:presentation {A}><p:sldIdLst><p:sldId id="1" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="r1" Target="slides/slide1.xml"/></Relationships>',
        "ppt/slides/slide1.xml": f'<p:sld {A}><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>Title</a:t></a:r></a:p></p:sp><p:sp><a:p><a:r><a:t>Body</a:t></a:r></a:p></p:sp></p:sld>',
        "ppt/charts/chart1.xml": '<c:chartSpace xmlns:c="x"><c:chart><c:title><c:tx><t>T</t></c:tx></c:title><c:barChart><c:ser><c:tx><c:v>S</c:v></c:tx><c:cat><c:v>q1</c:v></c:cat><c:val><c:v>3</c:v></c:val></c:ser></c:barChart></c:chart></c:chartSpace>',
    }
)


def test_office(spark, rows):
    data = [("a.xlsx", XLSX), ("b.docx", DOCX), ("c.pptx", PPTX), ("d.docx", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1rest"), ("e.docx", b"no zip"), ("f.pdf", b"%PDF"), ("g.txt", b"x"), ("h.docx", None)]
    df = spark.createDataFrame(data, "path string, content binary")
    out = {r["path"]: r for r in office.extracts(df.withColumn("k", F.col("path")), "k").withColumnRenamed("k", "path").collect()}
    assert out["b.docx"]["text"] == "## Head\n\nSome text\n\na | b" and out["c.pptx"]["text"] == "## Slide 1\n\n### Title\n\nBody" and "| Ab | 2 | 2024-01-01 | true |" in out["a.xlsx"]["text"]
    assert out["d.docx"]["problem"] == "encrypted" and out["e.docx"]["problem"].startswith("not-a-zip") and out["f.pdf"]["problem"].startswith("unsupported") and "h.docx" not in out
    cells = office.workbook_cells(df.where("path = 'a.xlsx'"), "path")
    assert rows(cells.where("sheet = 'One' and row = 2"), "col", "value", "kind") == [(1, "Ab", "string"), (2, "2", "formula(number)"), (3, "2024-01-01", "date"), (27, "true", "boolean")]
    assert rows(office.roster(cells, "path"), "sheet", "hidden", "cells", "fullest") == [("One", False, 6, True), ("Two", True, 1, False)]
    assert office.table_window(cells, "path", "One", (1, 1), (2, 3)).orderBy("row").collect()[0]["values"] == ["Name", None, "Day"]
    assert list(office.charts(PPTX)) == [("ppt/charts/chart1.xml", "bar", "T", "S", ["q1"], ["3"])]
    ok = office.preflight(zipped({"big": "0" * 5_000_000}))
    assert ok[1] == "ratio" and office.preflight(DOCX)[0]


def test_archives(spark, rows):
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        for name, body in (("x/a.txt", b"lease router lease"), ("../up", b"x")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    z = zipped({"src/lease.ts": "x", "b.bin": b"\xff\xfe\x00", "c.txt": "router " * 30})
    df = spark.createDataFrame([("1", "a.tgz", tar.getvalue()), ("2", "b.zip", z), ("3", "c.rar", b"Rar!\x1a\x07\x00"), ("4", "d", b"junk")], "id string, path string, content binary")
    assert rows(df.select("id", office.archive_format(F.col("content"), F.col("path")).alias("f"))) == [("1", "tar.gz"), ("2", "zip"), ("3", "rar"), ("4", None)]
    m = office.manifest(df, "id")
    got = {(r["id"], r["member"]): r["problem"] for r in m.collect()}
    assert got[("1", "x/a.txt")] == "" and got[("1", "../up")] == "unsafe-name" and got[("2", "b.bin")] == "binary" and got[("3", "")] == "unsupported: rar"
    best = rows(office.ranked_members(m, "id", ["lease", "router"]))
    assert best == [("1", "x/a.txt", 6), ("2", "c.txt", 20), ("2", "src/lease.ts", 25)]


def test_delimited(spark):
    assert delimited.records('a,"b""c\nd",e\r\nx,"open', ",") == [["a", 'b"c\nd', "e"], ["x", "open"]]
    assert delimited.records("a\rb\n", ",") == [["a"], ["b"]] and delimited.records("", ",") == [] and delimited.records('a"b,c', ",") == [['a"b', "c"]]
    assert delimited.dialect("a;b\n1;2\n3;4") == (";", True) and delimited.dialect("1,2\n3,4")[1] is False and delimited.dialect("x", "tsv")[0] == "\t"
    t = delimited.window(b"\xef\xbb\xbfName,Size,Name2\n1,2,3\n4\n", columns=["name2", "zzz"], rows=(3, 9))
    assert (t["columns"], t["missing"], t["rows"], t["first_row"]) == (["Name2"], ["zzz"], [[None]], 3)
    wide = delimited.window(b"a,b\n1,2\n3,4\n5,6\n", most_rows=2)
    assert wide["truncated"] and wide["total_rows"] == 3 and len(wide["rows"]) == 2
    df = spark.createDataFrame([(1, b"a,b\n1,2\n", "csv"), (2, None, "csv"), (3, b"", "csv")], "id long, content binary, ext string")
    out = {r["id"]: r for r in delimited.dialects(df, "id").collect()}
    assert set(out) == {1, 3} and (out[1]["n_records"], out[1]["n_columns"], out[1]["has_header"]) == (1, 2, True)
    assert delimited.cells(df, "id").count() == 2


def test_files(spark, rows, tmp_path):
    tree = {"src/a.ts": b"x", "src/b.bin": b"\x00", "dist/c.js": b"x", "d.md": b"y", "keep.log": b"z", "x.log": b"z", ".env": b"S=1", "big.py": b"x" * 1_000_001, "bad.py": b"\xff", "lib/e.py": b""}
    for name, body in tree.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(body)
    listing = files.listed(spark, str(tmp_path))
    assert listing.count() == len(tree) - 2  # neither hidden nor empty files
    rules = [*files.DEFAULT_IGNORES, "*.log", "!keep.log"]
    kept = [r["path"] for r in files.sources(listing, rules=rules).collect()]
    assert kept == ["d.md", "src/a.ts"]
    assert dict(rows(files.omissions(listing, rules=rules))) == {"ignored": 2, "non_text": 3, "oversize": 1}
    assert "dist/c.js" in [r["path"] for r in files.sources(listing, rules=rules, full=True).collect()]
    m = files.Matcher(["/only", "docs/**/x.md", "a?c", "[!x]y", "build/"], protected=[".git/"])
    assert [m.ignored(p) for p in ("only", "a/only", "docs/q/r/x.md", "abc", "zy", "xy", "build", "q/build/x", ".git/config")] == [True, False, True, True, True, False, False, True, True]


EVENT = dict.fromkeys(usage.EVENT.fieldNames()) | {"schemaVersion": 1, "eventId": "e", "occurredAt": "2024-01-02T03:04:05Z", "workspaceId": "w", "outcome": "ok", "responseBytes": 5}


def test_event_logs(spark, rows, tmp_path):
    good, extra, missing = json.dumps(EVENT), json.dumps(EVENT | {"more": 1}), json.dumps({k: v for k, v in EVENT.items() if k != "tool"})
    lines = spark.createDataFrame([(x, "own") for x in (good, extra, missing, good[:30], "", None, json.dumps(EVENT | {"occurredAt": "bad"}), good)], "value string, e string")
    assert usage.events_from_lines(lines).count() == 2
    assert usage.events_from_lines(lines, since="2024-02-01").count() == 0 and usage.events_from_lines(lines, workspace="w").count() == 2
    logs.write_events(usage.events_from_lines(lines), str(tmp_path / "sink"))
    back = spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "sink"))
    assert usage.events_from_lines(back).count() == 2
    logs.export_bundle(str(tmp_path / "b.zip"), {"events": usage.events_from_lines(lines).select("eventId")}, {"note.txt": "x"})
    assert set(zipfile.ZipFile(tmp_path / "b.zip").namelist()) == {"manifest.json", "diagnostics.json", "privacy.json", "events.ndjson", "note.txt"}
    told = spark.createDataFrame([("a" * 12, "x/y"), (None, "z")], "user string, path string")
    logs.export_bundle(str(tmp_path / "c.zip"), {"p": told}, {})
    with zipfile.ZipFile(tmp_path / "c.zip") as z:
        assert json.loads(z.read("privacy.json")) == {"p": {"user": "digest", "path": "plain"}} and json.loads(z.read("diagnostics.json"))["p"]["rows"] == 2
    logs.write_index(str(tmp_path / "ix"), a=lines.select("e"))
    assert logs.read_index(spark, str(tmp_path / "ix"), "a")["a"].count() == 8
    body = logs.render_skeleton([("a", 1.0, ["f()"])], [("d", ["x"])], 60)[0]
    assert len(body) <= 60 and "`f()`" in body and "d: x" not in body


def test_session_logs(spark, rows):
    use = {"content": [{"type": "tool_use", "name": "mcp_lens"}]}
    message = lambda i, n, ts, **m: json.dumps({"type": "assistant", "timestamp": ts, "message": {"id": i, "model": "m1", "usage": {"input_tokens": n, "output_tokens": 1}} | m})
    counter = lambda n, c, ts: json.dumps({"type": "event_msg", "timestamp": ts, "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": n, "cached_input_tokens": c, "output_tokens": 2}}}})
    data = [
        ("s1", 1, message("a", 10, "2024-01-02T00:00:00Z")), ("s1", 2, message("a", 50, "2024-01-02T00:00:01Z", **use)), ("s1", 3, message("b", 5, "2024-01-02T00:00:02Z")), ("s1", 4, "torn"),
        ("s2", 1, message("a", 10, "2024-01-02T00:00:00Z")),
        ("s3", 1, json.dumps({"type": "turn_context", "payload": {"model": "m2"}})), ("s3", 2, counter(400, 0, "2023-12-31T00:00:00Z")), ("s3", 3, counter(1000, 200, "2024-01-02T00:00:00Z")), ("s3", 4, json.dumps({"timestamp": "2024-01-02T00:00:00Z", "payload": {"server": "lens"}})),
    ]
    got = rows(logs.session_usage(logs.session_rows(spark.createDataFrame(data, "session string, line_no long, value string"), ["lens"]), "2024-01-01"))
    assert got == [("s1", "m1", 55, 0, 0, 2, 2), ("s3", "m2", 400, 0, 200, 0, 1)]


DIFF = "diff --git a/x.ts b/x.ts\nindex 1..2\n--- a/x.ts\n+++ b/x.ts\n@@ -1,2 +3 @@ f\n-a\n+b\n@@ -9 +8,4 @@\ndiff --git a/new b/new\nnew file mode 100644\n@@ -0,0 +1,5 @@\ndiff --git a/bin b/bin\nBinary files differ"


def varint(n):
    out = b""
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def field(number, value):
    return varint(number << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(number << 3) + varint(value)


def test_repository(spark, rows, tmp_path):
    lines = spark.createDataFrame(list(enumerate(DIFF.split("\n"))), "line_no long, value string")
    assert rows(repository.diff_hunks(lines)) == [("bin", "modified", None, None, None, None), ("new", "added", 0, 0, 1, 5), ("x.ts", "modified", 1, 2, 3, 1), ("x.ts", "modified", 9, 1, 8, 4)]
    log = spark.createDataFrame(list(enumerate(["commit 1234567", "Author: x", "", "    message", "", "a.ts", "b.ts", "commit 89abcde", "c.ts"])), "line_no long, value string")
    assert rows(repository.recent_files(log, commits=1)) == [("a.ts",), ("b.ts",)] and repository.recent_files(log).count() == 3
    occurrence = lambda symbol, line, role: field(1, varint(line) + varint(4) + varint(9)) + field(2, symbol) + field(3, role)
    one = field(1, b"a.ts") + field(2, occurrence(b"sym", 4, 1)) + field(2, occurrence(b"other", 300, 0))
    two = field(1, b"b.ts") + field(2, occurrence(b"other", 1, 1)) + field(2, occurrence(b"sym", 2, 1))
    data = spark.createDataFrame([("i", field(1, b"meta") + field(2, one) + field(2, two)), ("torn", b"\x12\xff"), ("none", None)], "id string, content binary")
    found = repository.scip_index(data, "id")
    assert rows(repository.scip_definitions(found)) == [("other", "b.ts", 2), ("sym", "a.ts", 5)]
    assert rows(repository.scip_imports(found)) == [("a.ts", "b.ts")]
    graph = {"version": 1, "symbols": [{"name": "f", "definition": {"path": "a", "line": 1, "column": 0}, "references": [{"path": "b", "line": 2, "column": 0}]}, {"name": "f", "definition": {"path": "c", "line": 3, "column": 0}, "references": []}], "files": [{"path": "b", "imports": ["a"], "exports": []}]}
    (tmp_path / "g.json").write_text(json.dumps(graph, indent=1))
    defs, refs, imports = repository.graph_file(spark, str(tmp_path / "g.json"))
    assert rows(defs) == [("f", "c", 3, 0)] and rows(refs) == [("f", "b", 2, 0)] and rows(imports) == [("b", "a")]
