"""Queries of sources and sinks: what is written from the tables and read back, and listings judged by rules."""

from __future__ import annotations

import io
import json
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.functions import paths
from loomfield.operators import edits, graph, outline, source, trees, usage
from loomfield.operators import symbols as sy
from loomfield.plans.retrieval_queries import SQL as _RETRIEVAL
from loomfield.session import checkpointed, spread, table
from loomfield.sources import delimited, files, logs, office, pdf, repository
from loomfield.streaming import runner

RULES = (*files.DEFAULT_IGNORES, "*.pb.*")
LAYERS = {"gitignore": ("vendor/", "third_party/"), "tool": ("**/mocks/",)}


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    """Served files with the size of their last fingerprint, and the bodies of those that were verified."""
    s = table(spark, folder, "served_surfaces").where("file_path is not null and fingerprint rlike '^[0-9]+:[0-9]+$'")
    last = s.groupBy(F.col("file_path").alias("path")).agg(F.max_by("fingerprint", F.struct("served_at", "surface_id")).alias("f"))
    sized = last.select("path", F.split_part("f", F.lit(":"), F.lit(1)).cast("bigint").alias("size_bytes"))
    v = table(spark, folder, "verification_surfaces").groupBy(F.col("file_path").alias("path")).agg(F.max("code").alias("code"))
    return sized.join(v, "path", "left").select("path", "size_bytes", F.encode(F.coalesce("code", F.lit("x")), "UTF-8").alias("content")).withColumn("size_bytes", F.when(F.col("size_bytes") > files.MOST_BYTES, F.col("size_bytes")).otherwise(F.length("content")))


def classified_files(spark: SparkSession, folder: str) -> DataFrame:
    """Which files of a listing are left out, and why; and which are sources apart from build output."""
    c = files.classified(_listing(spark, folder), rules=RULES, **LAYERS)
    lifted = files.lifted(F.col("path"), list(RULES), [".git/"], "core")
    return c.select("path", F.coalesce("language", F.lit("")).alias("language"), "text_only", F.coalesce("omission", F.lit("")).alias("omission"), files.source_only(F.col("path")).alias("source_only"), lifted.alias("lifted"))


def omission_counts(spark: SparkSession, folder: str) -> DataFrame:
    return files.omissions(_listing(spark, folder), rules=RULES, **LAYERS)


def text_probe(spark: SparkSession, folder: str) -> DataFrame:
    """Which encodings of documents a probe takes for text."""
    d = table(spark, folder, "documents").where("length(text) > 0")
    return d.select("doc_id", files.is_text(F.encode("text", "UTF-8")).alias("utf8"), files.is_text(F.encode("text", "UTF-16BE")).alias("utf16"))


def header_languages(spark: SparkSession, folder: str) -> DataFrame:
    """What the windows would be as header files: C, or C++ by their beginning."""
    h = table(spark, folder, "hop1_context").where("code is not null")
    return h.select("hop_id", paths.language(F.lit("x.h"), F.col("code")).alias("language"))


def usage_event_files(spark: SparkSession, folder: str) -> DataFrame:
    """Events written as usage events, a folder a day, and read again: calls and bytes by day and tool."""
    e = table(spark, folder, "events").where("ts is not null and event_id is not null")
    made = {
        "schemaVersion": F.lit(1), "eventId": F.col("event_id").cast("string"), "occurredAt": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "workspaceId": F.lit("w"), "sessionId": F.col("user_id").cast("string"), "client": F.lit("c"),
        "tool": F.col("event_type"), "outcome": F.lit("ok"), "durationMs": F.lit(1).cast("bigint"), "responseBytes": F.floor("value").cast("bigint"), "estimatedResponseTokens": F.lit(0).cast("bigint"), "baselineTokens": F.lit(None).cast("bigint"),
        "estimatedSavedTokens": F.lit(0).cast("bigint"), "baselineMethod": F.lit(None).cast("string"), "writeEnabled": F.lit(False),
    }
    target = f"{runner.shared_folder(spark)}/events"
    logs.write_events(e.select(*[c.alias(k) for k, c in made.items()]), target)
    back = usage.events_from_lines(spark.read.option("recursiveFileLookup", "true").text(target))
    return back.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "tool").agg(F.count("*").alias("n"), F.sum("responseBytes").alias("bytes"))


def session_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of session logs, several a message, of which the largest counts; sessions that call a tool by purchase."""
    e = table(spark, folder, "events").where("ts is not null and user_id is not null")
    used = F.struct(F.floor("value").cast("bigint").alias("input_tokens"), F.lit(1).alias("output_tokens"))
    tool = F.when(F.col("event_type") == "purchase", F.array(F.struct(F.lit("tool_use").alias("type"), F.lit("mcp_lens").alias("name"))))
    message = F.struct(F.date_format("ts", "yyyyMMdd").alias("id"), F.lit("m1").alias("model"), used.alias("usage"), tool.alias("content"))
    lines = e.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("line_no"), F.to_json(F.struct(F.lit("assistant").alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), message.alias("message"))).alias("value"))
    return logs.session_usage(checkpointed(logs.session_rows(lines, ["lens"])), "2024-01-10T00:00:00Z").select("session", "model", "input", "output", "requests")


def last_reset(spark: SparkSession, folder: str) -> DataFrame:
    """The last readable marker; every line that is no purchase has a torn one."""
    e = table(spark, folder, "events").where("ts is not null")
    torn = F.when(F.col("event_type") == "purchase", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("torn")
    return usage.last_reset(e.select(torn.alias("reset_at"), F.col("event_id").alias("line_no"))).select(F.date_format("reset_at", "yyyy-MM-dd HH:mm:ss").alias("reset_at"))


def index_files(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols and files of an index written and read again: declarations a file."""
    h = table(spark, folder, "hop1_context").where("file_path is not null")
    target = f"{runner.shared_folder(spark)}/index"
    logs.write_index(target, files=h.groupBy(F.col("file_path").alias("path")).agg(F.max("served_at").alias("at")), names=h.where("relation = 'definition'").select(F.col("file_path").alias("path"), F.col("search_token").alias("name")))
    back = logs.read_index(spark, target, "files", "names")
    return back["files"].join(back["names"].groupBy("path").agg(F.count("*").alias("n")), "path", "left").select("path", "at", F.coalesce("n", F.lit(0)).alias("n"))


def _scip(spark: SparkSession, folder: str) -> DataFrame:
    """An index file a window, with one occurrence: where its search token stands."""
    h = table(spark, folder, "hop1_context").where("file_path is not null and search_token is not null and line_no > 0")

    def run(batches):
        for b in batches:
            made = [repository.scip_bytes([(p, [(s, int(n), 2, r == "definition")])]) for p, s, n, r in zip(b["file_path"], b["search_token"], b["line_no"], b["relation"], strict=True)]
            yield pd.DataFrame({"hop_id": b["hop_id"], "content": made})

    data = spread(h.select("hop_id", "file_path", "search_token", "line_no", "relation")).mapInPandas(run, "hop_id bigint, content binary")
    return checkpointed(repository.scip_index(data, "hop_id"))


def scip_definitions(spark: SparkSession, folder: str) -> DataFrame:
    return repository.scip_definitions(_scip(spark, folder))


def scip_imports(spark: SparkSession, folder: str) -> DataFrame:
    """Files by the definitions that they use."""
    return repository.scip_imports(_scip(spark, folder))


def diff_hunks(spark: SparkSession, folder: str) -> DataFrame:
    """Hunks of a diff a file, made of the line ranges of its windows."""
    h = table(spark, folder, "hop1_context").where(F.col("line_range").rlike(r"^\d+-\d+$") & F.col("file_path").isNotNull())
    a, b = F.split_part("line_range", F.lit("-"), F.lit(1)).cast("bigint"), F.split_part("line_range", F.lit("-"), F.lit(2)).cast("bigint")
    size = (b - a + 1).cast("string")
    heads = h.select("file_path").distinct().select("file_path", F.lit(-1).cast("bigint").alias("line_no"), F.concat(F.lit("diff --git a/"), "file_path", F.lit(" b/"), "file_path").alias("value"))
    hunks = h.select("file_path", F.col("hop_id").alias("line_no"), F.concat(F.lit("@@ -"), a.cast("string"), F.lit(","), size, F.lit(" +"), (a + 1).cast("string"), F.lit(" @@")).alias("value"))
    return repository.diff_hunks(heads.unionByName(hunks), group="file_path").drop("file_path")


def recent_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the 50 packs served last, from a log with a commit a pack."""
    s = table(spark, folder, "served_surfaces").where("file_path is not null and pack_id is not null").select("pack_id", "file_path", "served_at").distinct()
    packs = s.groupBy("pack_id").agg(F.max("served_at").alias("last"))
    place = lambda k: F.concat_ws("|", F.lpad((F.lit(10**12) - F.col("last")).cast("string"), 14, "0"), "pack_id", F.lit(k))
    heads = packs.select(place("0").alias("line_no"), F.concat(F.lit("commit "), F.substring(F.md5("pack_id"), 1, 12)).alias("value"))
    named = s.join(packs, "pack_id").select(F.concat_ws("|", place("1"), "file_path").alias("line_no"), F.col("file_path").alias("value"))
    return repository.recent_files(heads.unionByName(named))


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


def _letters(n: int) -> str:
    return chr(64 + n) if n <= 26 else chr(64 + (n - 1) // 26) + chr(65 + (n - 1) % 26)


def _workbook(sheet: str, rows: list[list[object]]) -> bytes:
    cell = lambda r, c, v: f'<c r="{_letters(c)}{r}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{_letters(c)}{r}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
    body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row, 1) if v is not None) + "</row>" for r, row in enumerate(rows, 1))
    relations = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return _zipped({
        "xl/workbook.xml": f'<workbook xmlns:r="{relations}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{body}</sheetData></worksheet>",
    })


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    """The cells of a workbook a supplier's nation: supplier, name and balance, under a header; written and read again."""
    s = table(spark, folder, "supplier").where("s_nationkey is not null").select("s_nationkey", "s_suppkey", "s_name", F.round("s_acctbal", 2).alias("bal"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s_suppkey")
        rows = [["key", "name", "balance"], *([int(k), n, float(b)] for k, n, b in zip(pdf["s_suppkey"], pdf["s_name"], pdf["bal"], strict=True))]
        return pd.DataFrame({"book": [int(pdf["s_nationkey"].iloc[0])], "content": [_workbook("Suppliers", rows)]})

    return checkpointed(office.workbook_cells(s.groupBy("s_nationkey").applyInPandas(run, "book bigint, content binary"), "book"))


def workbook_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rectangle A2:C5 of each workbook."""
    return office.table_window(_cells(spark, folder), "book", "Suppliers", (2, 1), (5, 3)).select("book", "row", F.col("values")[0].alias("key"), F.col("values")[1].alias("name"), F.round(F.col("values")[2].cast("double"), 2).alias("balance"))


def workbook_roster(spark: SparkSession, folder: str) -> DataFrame:
    return office.roster(_cells(spark, folder), "book")


def workbook_preview(spark: SparkSession, folder: str) -> DataFrame:
    return office.preview(_cells(spark, folder).where("col <> 3"), "book")


def workbook_types(spark: SparkSession, folder: str) -> DataFrame:
    return office.sheet_types(_cells(spark, folder), "book")


def _office(df: DataFrame, key: str, name: str, fn, *columns: str) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pd.DataFrame({key: b[key], "path": name, "content": [fn(*row) for row in zip(*(b[c] for c in columns), strict=True)]})

    return spread(df.select(key, *columns)).mapInPandas(run, f"`{key}` {kind}, path string, content binary")


def _document(sections) -> bytes:
    clean = lambda t: escape("".join(c for c in t if c >= " " or c in "\t\n"))
    paragraph = lambda t, style: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t xml:space="preserve">{clean(t)}</w:t></w:r></w:p>'
    body = "".join((paragraph(s["heading"], "Heading2") if s["heading"] else "") + (paragraph(s["body_text"], "Normal") if s["body_text"] else "") for s in sections)
    return _zipped({"word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'})


def document_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Text documents written from sections and read as markdown, whole."""
    d = table(spark, folder, "docx_artifacts").where("size(sections) > 0")
    out = office.extracts(_office(d, "docx_id", "a.docx", _document, "sections"), "docx_id", most_tokens=1_000_000_000, most_bytes=1_000_000_000)
    return out.select("docx_id", F.sha2("text", 256).alias("text_sha"), "problem", "truncated")


def _slides(region: str, nations) -> bytes:
    relations = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shape = lambda role, text: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{role}"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{escape(text)}</a:t></a:r></a:p></p:txBody></p:sp>'
    row = "".join(f"<a:tc><a:txBody><a:p><a:r><a:t>{n}</a:t></a:r></a:p></a:txBody></a:tc>" for n in nations[:2])
    space = 'xmlns:p="p" xmlns:a="a"'
    slide = lambda inner: f"<p:sld {space}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>"
    return _zipped({
        "ppt/presentation.xml": f'<p:presentation {space} xmlns:r="{relations}"><p:sldIdLst><p:sldId r:id="r1"/><p:sldId r:id="r2"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="slides/slide2.xml"/></Relationships>',
        "ppt/slides/slide1.xml": slide(shape("title", region) + "".join(shape("body", n) for n in nations) + f'<p:pic><p:nvPicPr><p:cNvPr id="9" name="x" descr="Map of {escape(region)}"/></p:nvPicPr><p:blipFill><a:blip xmlns:r="{relations}" r:embed="m1"/></p:blipFill></p:pic>'),
        "ppt/slides/_rels/slide1.xml.rels": '<Relationships><Relationship Id="m1" Target="../media/map.png"/></Relationships>', "ppt/slides/slide2.xml": slide(f"<a:tbl><a:tr>{row}</a:tr></a:tbl>"),
        "ppt/charts/chart1.xml": '<c:chartSpace xmlns:c="c"><c:chart><c:plotArea><c:barChart><c:ser><c:tx><c:v>' + escape(region) + "</c:v></c:tx><c:cat>" + "".join(f"<c:pt><c:v>{n}</c:v></c:pt>" for n in nations) + "</c:cat><c:val>" + "".join(f"<c:pt><c:v>{len(n)}</c:v></c:pt>" for n in nations) + "</c:val></c:ser></c:barChart></c:plotArea></c:chart></c:chartSpace>",
    })


def _shows(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    by = n.groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("nations"))  # 25 rows at every scale
    return _office(by.withColumn("region", F.col("r_name")), "r_name", "a.pptx", _slides, "region", "nations")


def slide_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Presentations of a region's nations, read as markdown."""
    return office.extracts(_shows(spark, folder), "r_name").select("r_name", "text", "truncated")


def chart_points(spark: SparkSession, folder: str) -> DataFrame:
    """The points of the charts in presentations, numbers as numbers."""

    def run(batches):
        for b in batches:
            rows = [(k, kind, series, c, office.scalar(v)) for k, d in zip(b["r_name"], b["content"], strict=True) for _, kind, _, series, cats, vals in office.charts(bytes(d)) for c, v in zip(cats, vals, strict=True)]
            yield pd.DataFrame(rows, columns=["r_name", "kind", "series", "category", "value"])

    return _shows(spark, folder).mapInPandas(run, "r_name string, kind string, series string, category string, value double")


def shown_media(spark: SparkSession, folder: str) -> DataFrame:
    """The pictures of presentations with their alternative texts."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame([(k, *m) for k, d in zip(b["r_name"], b["content"], strict=True) for m in office.media(bytes(d))], columns=["r_name", "part", "target", "alt_text"])

    return _shows(spark, folder).mapInPandas(run, "r_name string, part string, target string, alt_text string")


def pdf_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written as PDF files of two pages, one of them empty, and read again."""
    p = table(spark, folder, "pdf_pages").where("length(page_text) > 0")
    made = _office(p, "page_id", "a.pdf", lambda t: pdf.written([t.replace("\r\n", "\n"), ""]), "page_text")
    out = pdf.page_texts(made, "page_id")
    return out.select("page_id", "page_no", F.sha2("page_text", 256).alias("text_sha"), "problem")


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    """An archive a piece of evidence, with its text under its path, one under a path that climbs up, and some bytes."""
    e = table(spark, folder, "query_evidence").where("file_path is not null and content_text is not null")
    return _office(e, "evidence_id", "a.zip", _packed, "file_path", "content_text")


def _packed(path: str, text: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, body in ((path, text.encode("utf-8", "replace")), (f"../{path}", b"x"), ("x.bin", b"\xff\xfe\x00")):
            z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


def archive_members(spark: SparkSession, folder: str) -> DataFrame:
    return office.manifest(_archives(spark, folder), "evidence_id").select("evidence_id", "member", "size", "problem", F.length("text").alias("n_chars"))


def archive_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The members that say most about two words."""
    return office.ranked_members(office.manifest(_archives(spark, folder), "evidence_id"), "evidence_id", ["lease", "router"])


def csv_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows 2 to 6 of each delimited file, from its first records."""
    r = table(spark, folder, "csv_rows").where((F.col("row_no") <= delimited.HEAD) & F.col("raw_record").isNotNull())
    body = r.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "raw_record"))), lambda x: x["raw_record"]), "\n").alias("content"))
    named = body.join(table(spark, folder, "csv_tables").select("file_id", F.col("file_ext").alias("ext")), "file_id", "left")
    return delimited.windows(named, "file_id", (2, 6)).drop("column_name")


def graph_files(spark: SparkSession, folder: str) -> DataFrame:
    """A graph in JSON of nations as symbols, defined under their region and used by the next region, written and read: definitions and uses."""
    n = table(spark, folder, "nation")
    place = lambda r, line: F.struct(F.concat(F.lit("r"), r.cast("string")).alias("path"), line.cast("bigint").alias("line"), F.lit(1).cast("bigint").alias("column"))
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    symbol = F.struct(F.col("n_name").alias("name"), place(region, key).alias("definition"), F.array(place((region + 1) % 5, key + 1)).alias("references"))
    doc = n.groupBy().agg(F.collect_list(symbol).alias("symbols")).select(F.to_json(F.struct(F.lit(1).alias("version"), "symbols", F.array().cast("array<struct<path:string,imports:array<string>>>").alias("files"))).alias("value"))  # 25 rows at every scale
    target = f"{runner.shared_folder(spark)}/graph"
    doc.coalesce(1).write.text(target)
    defs, refs, _ = repository.graph_file(spark, target)
    return defs.select("name", "path", "line", F.lit("definition").alias("role")).unionByName(refs.select("name", "path", "line", F.lit("reference").alias("role")))


def trace_files(spark: SparkSession, folder: str) -> DataFrame:
    """Events appended to a trace and read again: how many of each type, and the last of them."""
    e = table(spark, folder, "events").where("event_id is not null").select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))
    target = f"{runner.shared_folder(spark)}/trace"
    outline.write_trace(e, target)
    return spark.read.schema("seq bigint, kind string").json(target).groupBy("kind").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


def listed_files(spark: SparkSession, folder: str) -> DataFrame:
    """A tree written with a folder a region and listed: files and bytes of each folder."""
    n = table(spark, folder, "nation").select(F.col("n_name").alias("value"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("region"))
    target = f"{runner.shared_folder(spark)}/tree"
    n.coalesce(1).write.partitionBy("region").text(target)
    found = files.listed(spark, target, glob="part-*", with_content=False)
    return found.groupBy(F.substring_index("path", "/", 1).alias("dir")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def committed_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Edits of all windows, which are not written as some fail, and of those that can be edited, which are, once."""
    w = table(spark, folder, "hop1_context").where("code is not null").select(F.col("hop_id").cast("string").alias("path"), F.col("code").alias("content"))
    done = checkpointed(edits.edited(w, w.select("path", F.lit(1).alias("edit_no"), F.lit("token").alias("search"), F.lit("mark").alias("replace"))))
    base = runner.shared_folder(spark)
    wrote = [edits.all_or_nothing(done, f"{base}/all"), edits.all_or_nothing(done.where("ok"), f"{base}/some")]
    back = spark.read.parquet(f"{base}/some")
    return back.agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("n_chars")).select(F.lit(wrote[0]).alias("all_written"), F.lit(wrote[1]).alias("some_written"), "n", "n_chars")


def style_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Custom properties of a style sheet with a line a part."""
    p = table(spark, folder, "part").where("p_partkey is not null")
    lines = p.select(F.lit("parts.css").alias("path"), F.col("p_partkey").cast("bigint").alias("line"), F.concat(F.lit("  --part-"), F.col("p_partkey").cast("string"), F.lit(": "), F.col("p_size").cast("string"), F.lit("px; color: red;")).alias("text"))
    return source.css_properties(lines, "path")


def skeleton(spark: SparkSession, folder: str) -> DataFrame:
    """A skeleton of the ten best files by declarations and of the first two hundred entries of folders, within 16,384 bytes: its size and digest."""
    w = table(spark, folder, "hop1_context").where("code is not null").select(F.concat("file_path", F.lit("@"), "hop_id").alias("path"), F.col("code").alias("content"))
    s = checkpointed(sy.symbols(w))
    best = graph.count_scores(s).orderBy(F.desc("score"), "path").limit(10)
    named = s.join(best, "path").groupBy("path", "score").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "signature"))), lambda x: x["signature"]).alias("sigs")).collect()  # ten files
    listed: dict[str, list[str]] = {}
    for r in trees.module_map(table(spark, folder, "served_surfaces").select(F.col("file_path").alias("path"))).orderBy("dir", "child").limit(200).collect():
        listed.setdefault(r["dir"], []).append(r["child"])
    ranked = sorted(((r["path"], r["score"], r["sigs"]) for r in named), key=lambda r: (-r[1], r[0]))
    body, digest = logs.render_skeleton(ranked, list(listed.items()), 16_384)
    return spark.createDataFrame([(len(body.encode()), digest, body.count("\n"))], "bytes long, digest string, lines long")


def package_files(spark: SparkSession, folder: str) -> DataFrame:
    """Packages described in JSON, a file a customer segment: name, version and commands."""
    c = table(spark, folder, "customer").where("c_mktsegment is not null").select("c_mktsegment").distinct()
    doc = F.to_json(F.struct(F.lower("c_mktsegment").alias("name"), F.lit("1.2.0").alias("version"), F.struct(F.lit("y").alias("test"), F.lit("x").alias("build")).alias("scripts")))
    found = outline.packages(c.select(F.concat("c_mktsegment", F.lit("/package.json")).alias("path"), doc.alias("content")))
    return found.select("root", "name", "version", F.array_join("commands", ",").alias("commands"))


QUERIES = {f.__name__: f for f in (classified_files, omission_counts, text_probe, header_languages, usage_event_files, session_logs, last_reset, index_files, scip_definitions, scip_imports, diff_hunks, recent_files, workbook_rows, workbook_roster, workbook_preview, workbook_types, document_texts, slide_texts, chart_points, shown_media, pdf_texts, archive_members, archive_ranking, style_properties, csv_windows, graph_files, trace_files, listed_files, committed_edits, skeleton, package_files)}

_LIST = r"""s AS (SELECT file_path AS path, arg_max(fingerprint, (served_at, surface_id)) AS f FROM served_surfaces WHERE file_path IS NOT NULL AND regexp_matches(fingerprint, '^[0-9]+:[0-9]+$') GROUP BY 1),
l AS (SELECT path, CAST(split_part(f, ':', 1) AS BIGINT) AS size, lower(regexp_extract(path, '[^/][.]([A-Za-z0-9]+)$', 1)) AS ext FROM s),
c AS (SELECT *, """ + "CASE ext " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in paths.LANGUAGES.items()) + r""" ELSE '' END AS language, ext IN ('md', 'json', 'yaml', 'yml', 'toml', 'txt', 'css') AS plain, regexp_matches(path, '(^|/)[.]git/') AS firm,
  regexp_matches(path, '(^|/)(node_modules|[.]git|dist|build|out|coverage|target|[.]next|__pycache__)/|[^/]*[.](min[.]js|lock|map)(/|$)|[.]pb[.][^/]*(/|$)') AS hidden FROM l),
o AS (SELECT *, CASE WHEN hidden THEN 'ignored' WHEN regexp_matches(path, '(^|/)(vendor|third_party)/') THEN 'gitignored' WHEN regexp_matches(path, '(^|/)mocks/') THEN 'tool-ignored' WHEN regexp_matches(path, '(?i)(^|/)([.]env([.]|$)|id_rsa|[^/]*[.](pem|key|p12|pfx)$)') THEN 'secrets' WHEN size > 1000000 THEN 'oversize' WHEN language = '' AND NOT plain THEN 'non_text' ELSE '' END AS omission FROM c)"""
_EV = "e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE ts IS NOT NULL)"
_SUP = "s AS (SELECT s_nationkey AS book, s_suppkey AS k, s_name AS n, round(s_acctbal, 2) AS b, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) + 1 AS r FROM supplier WHERE s_nationkey IS NOT NULL)"
_ARC = """a AS (SELECT evidence_id, file_path AS p, content_text AS t FROM query_evidence WHERE file_path IS NOT NULL AND content_text IS NOT NULL)"""
_HIT = "least(20, 2 * (length(lower(t)) - length(replace(lower(t), '{w}', ''))) // length('{w}')) + CASE WHEN contains(lower(p), '{w}') THEN 25 ELSE 0 END"
_OCC = "h AS (SELECT file_path AS path, search_token AS symbol, line_no AS line, relation = 'definition' AS def FROM hop1_context WHERE file_path IS NOT NULL AND search_token IS NOT NULL AND line_no > 0), d AS (SELECT symbol, min((path, line)) AS x FROM h WHERE def GROUP BY symbol)"

_DIALECT = _RETRIEVAL["csv_dialects"]
SQL = {
    "csv_windows": _DIALECT[: _DIALECT.index("c AS (SELECT file_id, list_transform")]
    + r"""z AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY row_no) AS row FROM a WHERE row_no <= 20),
v AS (SELECT file_id, row, unnest(cells) AS c, unnest(range(1, len(cells) + 1)) AS column_no FROM (SELECT file_id, row, regexp_extract_all(x || d, '("(?:[^"]|"")*(?:"[^' || e || '
]*|$)|[^' || e || '
]*)(?:' || e || ')', 1) AS cells FROM z WHERE row BETWEEN 2 AND 6))
SELECT file_id, row, column_no, CASE WHEN starts_with(c, '"') THEN replace(regexp_extract(c, '^"((?:[^"]|"")*)"?', 1), '""', '"') || regexp_extract(c, '^"(?:[^"]|"")*"([^"]*)$', 1) ELSE c END AS value FROM v""",
    "graph_files": "SELECT n_name AS name, 'r' || n_regionkey AS path, n_nationkey AS line, 'definition' AS role FROM nation UNION ALL SELECT n_name, 'r' || (n_regionkey + 1) % 5, n_nationkey + 1, 'reference' FROM nation",
    "trace_files": "SELECT event_type AS kind, count(*) AS n, max(event_id) AS last FROM events WHERE event_id IS NOT NULL GROUP BY 1",
    "listed_files": "SELECT 'region=r' || n_regionkey AS dir, 1 AS files, CAST(sum(strlen(n_name) + 1) AS BIGINT) AS bytes FROM nation GROUP BY n_regionkey",
    "committed_edits": """WITH w AS (SELECT code, (length(code) - length(replace(code, 'token', ''))) // 5 AS n FROM hop1_context WHERE code IS NOT NULL)
SELECT bool_and(n = 1) AS all_written, true AS some_written, count(*) FILTER (n = 1) AS n, CAST(sum(length(code) - 1) FILTER (n = 1) AS BIGINT) AS n_chars FROM w""",
    "classified_files": f"""WITH {_LIST} SELECT path, language, language = '' AND plain AS text_only, omission, NOT regexp_matches(path, '(^|/)(dist|build|out|coverage|[.]next|target)/|node_modules/|dist/|cache/|bench/fixtures/') AS source_only,
  CASE WHEN starts_with(path, 'core/') THEN firm ELSE hidden END AS lifted FROM o""",
    "omission_counts": f"WITH {_LIST} SELECT omission, count(*) AS files FROM o WHERE omission <> '' GROUP BY omission",
    "text_probe": "SELECT doc_id, NOT contains(text, chr(0)) AS utf8, NOT regexp_matches(text, '[\\x{00}-\\x{ff}]') AS utf16 FROM documents WHERE length(text) > 0",
    "header_languages": r"""SELECT hop_id, CASE WHEN regexp_matches(left(code, 8192), '::|(^|[^\w"])(class|namespace|template|typename|constexpr|nullptr|virtual|public|private|protected)(\s*[<:{]|\s+\w)') THEN 'cpp' ELSE 'c' END AS language FROM hop1_context WHERE code IS NOT NULL""",
    "usage_event_files": f"WITH {_EV} SELECT day, event_type AS tool, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS bytes FROM e WHERE event_id IS NOT NULL GROUP BY ALL",
    "session_logs": f"""WITH {_EV}, w AS (SELECT user_id, event_id, day, event_type, greatest(0, CAST(floor(value) AS BIGINT)) AS v FROM e WHERE user_id IS NOT NULL AND date_trunc('second', ts) >= TIMESTAMP '2024-01-10'),
b AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY v DESC, event_id) = 1)
SELECT CAST(user_id AS VARCHAR) AS session, 'm1' AS model, CAST(sum(v) AS BIGINT) AS input, count(*) AS output, count(*) AS requests FROM b WHERE user_id IN (SELECT user_id FROM w WHERE event_type = 'purchase') GROUP BY user_id""",
    "last_reset": f"WITH {_EV} SELECT strftime(arg_max(ts, event_id), '%Y-%m-%d %H:%M:%S') AS reset_at FROM e WHERE event_type = 'purchase'",
    "index_files": "SELECT file_path AS path, max(served_at) AS at, count(*) FILTER (relation = 'definition') AS n FROM hop1_context WHERE file_path IS NOT NULL GROUP BY 1",
    "scip_definitions": f"WITH {_OCC} SELECT symbol, x[1] AS path, x[2] AS line FROM d",
    "scip_imports": f"WITH {_OCC} SELECT DISTINCT h.path, x[1] AS imported FROM h JOIN d USING (symbol) WHERE NOT h.def AND h.path <> x[1]",
    "diff_hunks": r"""WITH h AS (SELECT file_path AS path, CAST(split_part(line_range, '-', 1) AS BIGINT) AS a, CAST(split_part(line_range, '-', 2) AS BIGINT) AS b FROM hop1_context WHERE regexp_matches(line_range, '^\d+-\d+$') AND file_path IS NOT NULL)
SELECT path, 'modified' AS status, a AS old_start, b - a + 1 AS old_lines, a + 1 AS new_start, 1 AS new_lines FROM h""",
    "recent_files": """WITH s AS (SELECT DISTINCT pack_id, file_path, served_at FROM served_surfaces WHERE file_path IS NOT NULL AND pack_id IS NOT NULL), p AS (SELECT pack_id FROM s GROUP BY pack_id ORDER BY max(served_at) DESC, pack_id LIMIT 50)
SELECT DISTINCT file_path AS path FROM s WHERE pack_id IN (SELECT pack_id FROM p)""",
    "workbook_rows": f"WITH {_SUP} SELECT book, r AS row, CAST(k AS VARCHAR) AS key, n AS name, b AS balance FROM s WHERE r <= 5",
    "workbook_roster": f"WITH {_SUP} SELECT book, 'Suppliers' AS sheet, false AS hidden, max(r) AS rows, 3 AS cols, 3 * count(*) + 3 AS cells, true AS fullest FROM s GROUP BY book",
    "workbook_preview": f"""WITH {_SUP} SELECT book, 'Suppliers' AS sheet, CAST(r + 1 AS INTEGER) AS line_no, '| ' || k || ' | ' || n || ' |' AS line FROM s WHERE r <= 6
UNION ALL SELECT DISTINCT book, 'Suppliers', 1, '| key | name |' FROM s UNION ALL SELECT DISTINCT book, 'Suppliers', 2, '| number | string |' FROM s""",
    "workbook_types": f"WITH {_SUP}, b AS (SELECT DISTINCT book FROM s) SELECT book, 'Suppliers' AS sheet, col, ['key', 'name', 'balance'][col] AS header, ['number', 'string', 'number'][col] AS kind FROM b, range(1, 4) t(col)",
    "document_texts": r"""WITH d AS (SELECT docx_id, unnest(sections) AS s, unnest(range(len(sections))) AS i FROM docx_artifacts WHERE len(sections) > 0),
t AS (SELECT docx_id, i, 0 AS k, CASE WHEN trim(s.heading) <> '' THEN '## ' || s.heading END AS t FROM d UNION ALL SELECT docx_id, i, 1, CASE WHEN regexp_matches(s.body_text, '\S') THEN regexp_replace(replace(s.body_text, chr(13), ''), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') END FROM d)
SELECT docx_id, sha256(coalesce(string_agg(t, chr(10) || chr(10) ORDER BY i, k), '')) AS text_sha, '' AS problem, false AS truncated FROM t GROUP BY docx_id""",
    "slide_texts": """WITH n AS (SELECT r_name, list_sort(list(n_name)) AS l FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)
SELECT r_name, '## Slide 1' || chr(10) || chr(10) || '### ' || r_name || chr(10) || chr(10) || array_to_string(l, chr(10) || chr(10)) || chr(10) || chr(10) || '## Slide 2' || chr(10) || chr(10) || l[1] || ' | ' || l[2] AS text, false AS truncated FROM n""",
    "shown_media": "SELECT r_name, 'ppt/slides/slide1.xml' AS part, 'ppt/media/map.png' AS target, 'Map of ' || r_name AS alt_text FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)",
    "pdf_texts": "SELECT page_id, 1 AS page_no, sha256(replace(page_text, chr(13) || chr(10), chr(10))) AS text_sha, CASE WHEN regexp_matches(page_text, '\\S') THEN '' ELSE 'no-text-layer' END AS problem FROM pdf_pages WHERE length(page_text) > 0 UNION ALL SELECT page_id, 2, sha256(''), CASE WHEN regexp_matches(page_text, '\\S') THEN '' ELSE 'no-text-layer' END FROM pdf_pages WHERE length(page_text) > 0",
    "chart_points": "SELECT r_name, 'bar' AS kind, r_name AS series, n_name AS category, CAST(length(n_name) AS DOUBLE) AS value FROM nation JOIN region ON n_regionkey = r_regionkey",
    "archive_members": f"WITH {_ARC} SELECT evidence_id, p AS member, strlen(t) AS size, '' AS problem, length(t) AS n_chars FROM a UNION ALL SELECT evidence_id, '../' || p, 1, 'unsafe-name', NULL FROM a UNION ALL SELECT evidence_id, 'x.bin', 3, 'binary', NULL FROM a",
    "archive_ranking": f"WITH {_ARC}, s AS (SELECT evidence_id, p AS member, {_HIT.format(w='lease')} + {_HIT.format(w='router')} AS score FROM a) SELECT * FROM s WHERE score >= 4",
    "style_properties": "SELECT 'parts.css' AS path, p_partkey AS line, '--part-' || p_partkey AS property, p_size || 'px' AS value FROM part WHERE p_partkey IS NOT NULL AND p_size IS NOT NULL",
    "package_files": "SELECT DISTINCT c_mktsegment AS root, lower(c_mktsegment) AS name, '1.2.0' AS version, 'build,test' AS commands FROM customer WHERE c_mktsegment IS NOT NULL",
}
