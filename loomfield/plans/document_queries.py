"""Queries of documents and source text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.functions import paths
from loomfield.functions import text as tx
from loomfield.operators import documents, intervals, search, source
from loomfield.plans.lexed_sql import BARE, COMMENTS
from loomfield.session import table


def _doc_lines(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return search.line_table(d)


def markdown_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Headings of all documents with their sections."""
    return documents.headings(table(spark, folder, "documents"), "doc_id", "text").withColumn("path", F.array_join("path", " > "))


def section_ends(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that begin with # as headings, with the ends of their sections: all in the JVM."""
    lines = _doc_lines(spark, folder)
    totals = lines.groupBy("path").agg(F.max("line").alias("total"))
    marks = lines.where(F.col("text").rlike(r"^#{1,6} ")).select("path", "line", F.length(F.regexp_extract("text", r"^(#{1,6}) ", 1)).alias("level"))
    return documents.section_ends(marks.join(totals, "path"), "path", "total").select("path", "line", "level", "end_line")


def lines_in_sections(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines with a code span each innermost section has."""
    marks = documents.headings(table(spark, folder, "documents"), "doc_id", "text").select(F.col("doc_id").cast("string").alias("path"), F.col("line").cast("bigint").alias("start"), F.col("end_line").cast("bigint").alias("end"), F.col("heading").alias("label"))
    points = _doc_lines(spark, folder).where(F.col("text").contains("`")).select("path", "line")
    held = intervals.containing(points, marks, ["path"])  # a line counts once
    return held.groupBy("path", "label").agg(F.count("*").alias("n"))


def section_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The section of each document that a title means most likely."""
    marks = documents.headings(table(spark, folder, "documents"), "doc_id", "text")
    return documents.select_sections(marks, "doc_id", "Cached cache envelope")


def heading_index(spark: SparkSession, folder: str) -> DataFrame:
    marks = documents.headings(table(spark, folder, "documents"), "doc_id", "text")
    return documents.heading_index(marks, "doc_id", 12, 512, (1, 20))


def procedure_steps(spark: SparkSession, folder: str) -> DataFrame:
    return documents.steps(table(spark, folder, "pdf_pages"), "page_id", "page_text")


def matching_pages(spark: SparkSession, folder: str) -> DataFrame:
    return documents.pages_with(table(spark, folder, "pdf_pages"), "page_text", "sealed by lease").select("page_id", "page_no")


def xml_to_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of configuration in tags, as text."""
    h = table(spark, folder, "hop1_context").where(F.col("code").contains("</"))
    return h.select("hop_id", documents.html_to_markdown(F.col("code")).alias("markdown"))


def documents_within(spark: SparkSession, folder: str) -> DataFrame:
    """Documents cut to 1,024 bytes at a blank line near the end where there is one."""
    d = table(spark, folder, "documents")
    cut = documents.cut_at_break(F.col("text"), 1024)
    return d.select("doc_id", F.octet_length(cut).alias("n_bytes"), (F.octet_length("text") > 1024).alias("was_cut"))


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "hop1_context").where("code is not null")
    return h.select("hop_id", "file_path", "code", F.coalesce(paths.language(F.col("file_path")), F.lit("")).alias("lang"))


def line_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return source.kinds_of_lines(_windows(spark, folder), ["hop_id"], "code", "lang")


def lexical_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Comments and literals by kind."""
    s = source.segments(_windows(spark, folder), ["hop_id"], "code", "lang")
    return s.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("col_end") - F.col("col_start")).alias("n_chars"))


def without_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of windows without their comments, runs of blanks as one."""
    bare = F.regexp_replace(F.regexp_replace(F.replace("bare_text", F.lit("\r")), r"[ \t]+", " "), r" (?=\n|\z)", "")
    return source.stripped(_windows(spark, folder), ["hop_id"], "code", "lang").select("hop_id", F.sha2(bare, 256).alias("bare_sha"))


def _code_lines(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "hop1_context").where("code is not null")
    return search.line_table(h.select(F.col("hop_id").cast("string").alias("path"), F.col("code").alias("content")))


def code_bindings(spark: SparkSession, folder: str) -> DataFrame:
    return source.bindings(_code_lines(spark, folder), "path")


def binding_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Names that configuration and code bind to different values."""
    h = table(spark, folder, "hop1_context").where("code is not null").select(F.col("hop_id").cast("string").alias("path"), F.coalesce("code_lang", F.lit("config")).alias("group"))
    bound = code_bindings(spark, folder).join(h, "path")
    return source.conflicts(bound, "path", "group").select("name", "values", F.array_join("examples", " | ").alias("examples"))


def code_imports(spark: SparkSession, folder: str) -> DataFrame:
    return source.imports(_code_lines(spark, folder), "path")


def http_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Routes of three frameworks, in sources put together from regions and nations: nested blocks, a class with a prefix, and calls."""
    n = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    by = n.groupBy("r_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("k"))  # 25 rows at every scale
    lines = lambda *parts: F.array_join(F.transform("k", lambda k: F.concat(*[k.cast("string") if p is None else F.lit(p) for p in parts])), "")
    region = F.col("r_regionkey").cast("string")
    nested = F.concat(F.lit('routing {\n  route("/r'), region, F.lit('") {\n'), lines('    get("/', None, '") { }\n'), F.lit("  }\n  post(\"/top\") { }\n}\n"))
    marked = F.concat(F.lit('@RequestMapping("/r'), region, F.lit('/")\npublic class A {\n'), lines('  @PutMapping("', None, '")\n  public String make', None, "(int a) {\n  }\n"), F.lit("}\n"))
    called = F.concat(F.lit("// app.get('/no', no)\n"), lines("app.delete('/x/", None, "?q=1', drop", None, ");\n"))
    files = [by.select(F.concat(F.lit(f"{name}/"), region).alias("path"), text.alias("text"), F.lit(lang).alias("lang")) for name, lang, text in (("nested", "kotlin", nested), ("marked", "java", marked), ("called", "javascript", called))]
    return source.routes(files[0].union(files[1]).union(files[2]), ["path"]).drop("snippet")


def endpoints(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the URLs in windows."""
    urls = table(spark, folder, "hop1_context").select("hop_id", F.explode(F.regexp_extract_all("code", F.lit(r"([a-z]+://[A-Za-z0-9.:/?&=_-]+)"), F.lit(1))).alias("url"))
    return urls.select("hop_id", "url", tx.endpoint(F.col("url")).alias("endpoint"))


QUERIES = {f.__name__: f for f in (markdown_headings, section_ends, lines_in_sections, section_selection, heading_index, procedure_steps, matching_pages, xml_to_markdown, documents_within, line_kinds, lexical_segments, without_comments, code_bindings, binding_conflicts, code_imports, http_routes, endpoints)}

_DOC_LINES = r"""s AS (SELECT CAST(doc_id AS VARCHAR) AS path, string_split_regex(text, '\r?\n') AS parts FROM documents WHERE text IS NOT NULL),
l AS (SELECT path, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS text FROM s)"""

# Headings by patterns on lines; a fence is a toggle here, and the open headings at one are those that no later one of their level or above has closed.
_MD = rf"""ls AS (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS parts FROM documents WHERE text IS NOT NULL),
ln AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS t, len(parts) - CASE WHEN len(parts) > 1 AND parts[len(parts)] = '' THEN 1 ELSE 0 END AS total, len(parts) AS n,
  CASE WHEN trim(parts[1]) = '---' THEN coalesce((SELECT min(i) FROM unnest(range(2, len(parts) + 1)) u(i) WHERE trim(parts[i]) IN ('---', '...')), 0) ELSE 0 END AS front FROM ls),
fe AS (SELECT *, regexp_matches(t, '^ {{0,3}}(`{{3,}}|~{{3,}})') AND line > front AS fence FROM ln),
fl AS (SELECT *, sum(CAST(fence AS INT)) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) % 2 = 1 AS within, lead(t) OVER (PARTITION BY doc_id ORDER BY line) AS nxt FROM fe),
hs AS (SELECT doc_id, line, total, CASE WHEN regexp_matches(t, '^ {{0,3}}#{{1,6}}([ \t]|$)') THEN 'atx' WHEN trim(t) <> '' AND regexp_matches(nxt, '^ {{0,3}}(=+|-+)[ \t]*$') AND NOT regexp_matches(t, '^\s*([-*+>]|\d+[.)])\s') THEN 'setext' END AS style, t, nxt FROM fl WHERE NOT within AND NOT fence AND line > front),
hd AS (SELECT doc_id, line, total, style, CASE WHEN style = 'atx' THEN length(regexp_extract(t, '^ {{0,3}}(#{{1,6}})', 1)) WHEN starts_with(trim(nxt), '=') THEN 1 ELSE 2 END AS level,
  CASE WHEN style = 'atx' THEN trim(regexp_extract(t, '^ {{0,3}}#{{1,6}}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$', 1)) ELSE trim(t) END AS heading FROM hs WHERE style IS NOT NULL),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS heading_no, coalesce((SELECT min(n.line) FROM hd n WHERE n.doc_id = hd.doc_id AND n.line > hd.line AND n.level <= hd.level) - 1, greatest(total, line)) AS end_line FROM hd)"""
_BOUND = r"""s AS (SELECT CAST(hop_id AS VARCHAR) AS path, string_split_regex(code, '\r?\n') AS parts FROM hop1_context WHERE code IS NOT NULL), l AS (SELECT path, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS text FROM s),
b AS (SELECT path, line, regexp_replace(text, '^\s*(?://+|#+|/?\*+|--)\s*', '') AS t FROM l),
p AS (SELECT path, line, t, '^\s*\|\s*`?([A-Za-z_][\w.-]*)`?\s*\|\s*`?([^|`]+?)`?\s*\|\s*$' AS r, '^\s*(?:(?:export|const|let|var|val|final|static|public|private)\s+)*([A-Za-z_][\w.-]*)["'']?\s*(?::=|=|:)\s*["''`]?([^"''`;,{}()\[\]=]+?)["''`]?\s*[;,]?\s*$' AS a FROM b),
f AS (SELECT path, line, lower(coalesce(nullif(regexp_extract(t, r, 1), ''), nullif(regexp_extract(t, a, 1), ''))) AS name, trim(coalesce(nullif(regexp_extract(t, r, 2), ''), nullif(regexp_extract(t, a, 2), ''))) AS value FROM p),
bound AS (SELECT path, line, name, value FROM f WHERE name IS NOT NULL AND value <> '' QUALIFY row_number() OVER (PARTITION BY path, name ORDER BY line) = 1)"""
_IMPORTS = (r"""^\s*import\b.*?["'']([^"'']+)["'']""", r"""^\s*(?:const|let|var)\s.*?\brequire\(\s*["'']([^"'']+)["'']\s*\)""", r"^\s*from\s+([\w.]+)\s+import\b", r"^\s*import\s+(?:static\s+)?([\w.*]+)", r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;", r"^\s*use\s+([\w:]+)", r"""^\s*#include\s+["<]([^">]+)[">]""", r"""^\s*require\s+["'']([^"'']+)["'']""")


def _markdown(column: str) -> str:
    out = column
    steps = [(rf"(?is)<h{n}[^>]*>(.*?)</h{n}>", "chr(10) || '" + "#" * n + r" \1' || chr(10)") for n in range(1, 5)]
    steps += [(rf"(?is)<(?:{t})(?:\s[^>]*)?>(.*?)</(?:{t})>", rf"'{m}\1{m}'") for t, m in (("strong|b", "**"), ("em|i", "*"))]
    steps += [(r"(?is)<li[^>]*>(.*?)</li>", r"'- \1' || chr(10)"), (r"(?i)<br\s*/?>", "chr(10)"), (r"(?is)<p[^>]*>(.*?)</p>", r"'\1' || chr(10) || chr(10)"), (r"(?is)</t[dh]>\s*<t[dh][^>]*>", "' | '")]
    steps += [(r"(?is)<tr[^>]*>\s*<t[dh][^>]*>(.*?)</t[dh]>\s*</tr>", r"'| \1 |' || chr(10)"), ("<[^>]+>", "''")]
    for pattern, to in steps:
        out = f"regexp_replace({out}, '{pattern}', {to}, 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return rf"regexp_replace(regexp_replace({out}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


SQL = {
    "line_kinds": f"""WITH {COMMENTS}, k AS (SELECT path, CASE WHEN trim(raw, ' ' || chr(9) || chr(13)) = '' THEN 'blank' WHEN trim({BARE}, ' ' || chr(9) || chr(13)) = '' THEN 'comment' ELSE 'code' END AS k FROM cm)
SELECT path AS hop_id, count(*) FILTER (k = 'code') AS code_lines, count(*) FILTER (k = 'comment') AS comment_lines, count(*) FILTER (k = 'blank') AS blank_lines FROM k GROUP BY path""",
    "without_comments": rf"""WITH {COMMENTS}, j AS (SELECT path, string_agg(regexp_replace(regexp_replace(replace({BARE}, chr(13), ''), '[ \t]+', ' ', 'g'), ' $', ''), chr(10) ORDER BY line) AS t FROM cm GROUP BY path) SELECT path AS hop_id, sha256(t) AS bare_sha FROM j""",
    "lexical_segments": f"""WITH {COMMENTS}, x AS (SELECT 'comment' AS kind, unnest(regexp_extract_all(m, chr(1) || '([^' || chr(2) || ']*)', 1)) AS t FROM cm UNION ALL SELECT 'string', unnest(regexp_extract_all(m, chr(3) || '([^' || chr(4) || ']*)', 1)) FROM cm
  UNION ALL SELECT 'doc', unnest(regexp_extract_all(m, chr(5) || '([^' || chr(6) || ']*)', 1)) FROM cm) SELECT kind, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS n_chars FROM x WHERE t <> '' GROUP BY kind""",
    "markdown_headings": f"""WITH {_MD} SELECT doc_id, heading_no, level, heading, line, end_line, style, (SELECT string_agg(a.heading, ' > ' ORDER BY a.line) FROM h a WHERE a.doc_id = h.doc_id AND a.line <= h.line
  AND NOT EXISTS (SELECT 1 FROM h x WHERE x.doc_id = a.doc_id AND x.line > a.line AND x.line <= h.line AND x.level <= a.level)) AS path FROM h""",
    "lines_in_sections": rf"""WITH {_MD}, pt AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS t FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS parts FROM documents WHERE text IS NOT NULL)),
i AS (SELECT doc_id, line, (SELECT arg_max(h.heading, h.line) FROM h WHERE h.doc_id = pt.doc_id AND pt.line BETWEEN h.line AND h.end_line) AS label FROM pt WHERE contains(t, '`'))
SELECT CAST(doc_id AS VARCHAR) AS path, label, count(*) AS n FROM i GROUP BY ALL""",
    "section_selection": rf"""WITH {_MD}, n AS (SELECT doc_id, heading_no, trim(regexp_replace(regexp_replace(lower(heading), '[`*_~]', '', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS a, 'cached cache envelope' AS b FROM h),
w AS (SELECT *, CASE WHEN a = b THEN 3 WHEN regexp_matches(a, '^[0-9]+( [0-9]+)* cached cache envelope$') THEN 2 WHEN contains(a, b) THEN 1 END AS how,
  CASE WHEN a = '' THEN 0 WHEN contains(b, a) THEN length(a) / length(b) ELSE len(list_intersect(list_distinct(string_split(a, ' ')), string_split(b, ' '))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))) END AS s FROM n),
x AS (SELECT doc_id, heading_no, coalesce(how, 0) AS how, CASE WHEN how IS NULL THEN s ELSE 1 END AS s FROM w WHERE how IS NOT NULL OR s >= 0.72),
r AS (SELECT *, row_number() OVER o AS k, lead(how) OVER o AS nh, lead(s) OVER o AS ns FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY how DESC, s DESC, heading_no))
SELECT doc_id, heading_no, ['fuzzy', 'substring', 'numbered', 'exact'][how + 1] AS how, round(s, 6) AS score FROM r WHERE k = 1 AND NOT coalesce(nh = how AND abs(ns - s) <= 0.001, false)""",
    "heading_index": f"""WITH {_MD}, r AS (SELECT *, CASE WHEN line <= 20 AND end_line >= 1 THEN 0 WHEN level = min(level) OVER (PARTITION BY doc_id) THEN 1 WHEN level = min(level) OVER (PARTITION BY doc_id) + 1 THEN 2 ELSE 3 END AS k,
  CASE WHEN line <= 20 AND end_line >= 1 THEN 0 ELSE least(abs(line - 1), abs(line - 20)) END AS away, strlen(CAST(to_json({{'level': level, 'heading': heading, 'line': line, 'end_line': end_line}}) AS VARCHAR)) + 1 AS size FROM h)
SELECT doc_id, level, heading, line, end_line FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k, away, line) <= 12 AND sum(size) OVER (PARTITION BY doc_id ORDER BY k, away, line ROWS UNBOUNDED PRECEDING) <= 512""",
    "xml_to_markdown": f"SELECT hop_id, {_markdown('code')} AS markdown FROM hop1_context WHERE contains(code, '</')",
    "documents_within": """WITH c AS (SELECT doc_id, text, unnest(range(1, least(length(text), 1024) + 1)) AS i FROM documents WHERE strlen(text) > 1024),
n AS (SELECT doc_id, any_value(text) AS text, count(*) FILTER (size <= 1024) AS n FROM (SELECT doc_id, text, i, sum(strlen(substr(text, i, 1))) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS size FROM c) GROUP BY doc_id),
w AS (SELECT doc_id, left(text, n) AS whole FROM n), b AS (SELECT doc_id, whole, CASE WHEN contains(whole, chr(10) || chr(10)) THEN length(whole) - strpos(reverse(whole), chr(10) || chr(10)) - 1 ELSE -2 END AS blank FROM w)
SELECT d.doc_id, coalesce(strlen(CASE WHEN blank >= length(whole) * 0.8 THEN left(whole, blank) ELSE whole END), strlen(text)) AS n_bytes, strlen(text) > 1024 AS was_cut FROM documents d LEFT JOIN b USING (doc_id)""",
    "code_bindings": f"WITH {_BOUND} SELECT path, line, name, value FROM bound",
    "binding_conflicts": f"""WITH {_BOUND}, g AS (SELECT b.*, coalesce(code_lang, 'config') AS grp FROM bound b JOIN hop1_context ON hop_id = CAST(path AS BIGINT)), v AS (SELECT DISTINCT name, value FROM g),
c AS (SELECT name, count(DISTINCT value) AS n FROM g GROUP BY name HAVING count(DISTINCT value) > 1 AND count(DISTINCT grp) > 1), k AS (SELECT v.*, n FROM v JOIN c USING (name) QUALIFY row_number() OVER (PARTITION BY name ORDER BY value) <= 3)
SELECT name, any_value(n) AS "values", string_agg(value, ' | ' ORDER BY value) AS examples FROM k GROUP BY name""",
    "code_imports": f"""WITH {_BOUND.split(", l AS")[0]}, l AS (SELECT path, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS text FROM s),
i AS (SELECT path, line, coalesce({", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in _IMPORTS)}) AS imported FROM l WHERE line <= 60) SELECT path, line, imported FROM i WHERE imported IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY line) <= 12""",
    "http_routes": """WITH k AS (SELECT n_nationkey AS k, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation)
SELECT 'nested/' || r AS path, i + 2 AS line, 'GET' AS method, '/r' || r || '/' || k AS route, '' AS handler, 0.7::DOUBLE AS confidence FROM k UNION ALL SELECT 'nested/' || r, n + 4, 'POST', '/top', '', 0.7::DOUBLE FROM k WHERE i = 1
UNION ALL SELECT 'marked/' || r, 3 * i, 'PUT', '/r' || r || '/' || k, 'make' || k, 0.9::DOUBLE FROM k UNION ALL SELECT 'called/' || r, i + 1, 'DELETE', '/x/' || k, 'drop' || k, 0.9::DOUBLE FROM k""",
    "section_ends": rf"""WITH {_DOC_LINES}, t AS (SELECT path, max(line) AS total FROM l GROUP BY path),
m AS (SELECT path, line, length(regexp_extract(text, '^(#{{1,6}}) ', 1)) AS level FROM l WHERE regexp_matches(text, '^#{{1,6}} '))
SELECT m.path, m.line, m.level, coalesce((SELECT min(n.line) FROM m n WHERE n.path = m.path AND n.line > m.line AND n.level <= m.level) - 1, t.total) AS end_line FROM m JOIN t ON t.path = m.path""",
    "procedure_steps": r"""WITH s AS (SELECT page_id, string_split_regex(page_text, '\r\n|\r|\n') AS parts FROM pdf_pages WHERE page_text IS NOT NULL),
l AS (SELECT page_id, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS t FROM s),
x AS (SELECT page_id, line, nullif(regexp_extract(t, '(?i)^\s*(?:[-*+•]\s+)?(?:step\s+\d+|procedure)\s*[:.]\s*(.*\S)', 1), '') AS a, nullif(regexp_extract(t, '^\s*\d+[.)]\s+(.*\S)', 1), '') AS b,
  nullif(regexp_extract(t, '^\s*[-*+•]\s+(.*\S)', 1), '') AS c FROM l)
SELECT page_id, line, regexp_replace(coalesce(a, b, CASE WHEN length(c) <= 200 THEN c END), '\\([\\`*_{}\[\]()#+\-.!])', '\1', 'g') AS step FROM x WHERE coalesce(a, b, CASE WHEN length(c) <= 200 THEN c END) IS NOT NULL""",
    "matching_pages": "SELECT page_id, page_no FROM pdf_pages WHERE strpos(lower(page_text), 'sealed') > 0 OR strpos(lower(page_text), 'lease') > 0",
    "endpoints": r"""WITH u AS (SELECT hop_id, unnest(regexp_extract_all(code, '[a-z]+://[A-Za-z0-9.:/?&=_-]+')) AS url FROM hop1_context),
p AS (SELECT hop_id, url, regexp_replace('/' || regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/{2,}', '/', 'g') AS q FROM u)
SELECT hop_id, url, CASE WHEN length(q) > 1 THEN regexp_replace(q, '/$', '') ELSE q END AS endpoint FROM p""",
}
