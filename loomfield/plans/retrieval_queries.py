"""Queries of compound retrieval, of delimited files as a whole, and of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.functions import text as tx
from loomfield.operators import documents, edits, intervals, outline, retrieval, search, source, symbols
from loomfield.plans.document_queries import _IMPORTS, _MD
from loomfield.plans.lexed_sql import BARE, IS_NOISE, IS_TEST, SYMBOLS, WINDOWS, comments, parts
from loomfield.plans.search_queries import surface_case, windows
from loomfield.session import checkpointed, running_sums, spread, table
from loomfield.sources import delimited, files
from loomfield.streaming import runner, sessions


def _parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    code = windows(spark, folder)
    return checkpointed(symbols.symbols(code).select("path", "line", "end_line", "name", "kind")), search.line_table(code), code.select("path")


def located(spark: SparkSession, folder: str) -> DataFrame:
    """Where a query leads, best places first."""
    s, lines, names = _parts(spark, folder)
    return retrieval.located(s, lines, names, "leaseRouter seal", most=20)


def located_decision(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.decided(located(spark, folder))


def surface_map(spark: SparkSession, folder: str) -> DataFrame:
    """The best evidence of each kind of surface."""
    e = table(spark, folder, "query_evidence").where("file_path is not null and score is not null")
    return retrieval.one_a_surface(e.select(F.col("file_path").alias("path"), F.coalesce("line_no", F.lit(0)).alias("line"), "score"))


def related_files(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "query_evidence").where("file_path is not null and score is not null")
    return retrieval.related(e.select(F.col("file_path").alias("path"), F.coalesce("line_no", F.lit(0)).alias("line"), "score"))


def line_slices(spark: SparkSession, folder: str) -> DataFrame:
    """Lines 2 to 4 of every window that has a second line."""
    code = windows(spark, folder)
    return retrieval.slices(search.line_table(code), code.select("path", F.lit("L2-4").alias("range")))


def token_pack(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of each piece of evidence, in order of score, within 2,400 tokens."""
    e = table(spark, folder, "query_evidence").where("content_text is not null and score is not null")
    items = running_sums(e.select("evidence_id", "score", F.ceil(F.length("content_text") / 4).cast("bigint").alias("tokens")), [F.desc("score"), F.asc("evidence_id")], item_no=F.lit(1)).drop("score")
    return retrieval.packed(items, 2400)


def evidence_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence by workspace under caps of number and bytes."""
    e = table(spark, folder, "query_evidence").where("content_text is not null and workspace_id is not null")
    s = e.select("evidence_id", F.col("workspace_id").alias("concern"), F.col("evidence_kind").alias("class"), F.col("evidence_id").alias("order_no"), F.octet_length("content_text").alias("bytes"), F.lit(False).alias("served"))
    return retrieval.selected_evidence(s).select("evidence_id", "concern", "class")


def fitting_sections(spark: SparkSession, folder: str) -> DataFrame:
    """How many sections of each text document fit 4,096 bytes."""
    d = table(spark, folder, "docx_artifacts").select("docx_id", F.posexplode("sections").alias("at", "s"))
    sizes = d.select("docx_id", "at", (F.coalesce(F.octet_length("s.heading"), F.lit(0)) + F.coalesce(F.octet_length("s.body_text"), F.lit(0))).cast("bigint").alias("bytes"))
    return retrieval.largest_fitting(sizes, "docx_id", "at", "bytes", 4096)


def small_files(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "verification_surfaces")
    return retrieval.small_files(v.select(F.col("vsurface_id").alias("path"), F.col("code").alias("content"))).select("path", "tiny", "lines", "bytes")


def window_digests(spark: SparkSession, folder: str) -> DataFrame:
    s, lines, _ = _parts(spark, folder)
    return retrieval.digests(lines, s, source.imports(lines, "path"), "lease")


def section_plans(spark: SparkSession, folder: str) -> DataFrame:
    """The best section of each document for two words."""
    d = table(spark, folder, "documents")
    marks = documents.headings(d, "doc_id", "text")
    lines = search.line_table(d.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))).withColumnRenamed("path", "doc_id")
    return retrieval.section_plans(marks, lines, "doc_id", ["snapshot", "handle"])


def closure_checks(spark: SparkSession, folder: str) -> DataFrame:
    lines = search.line_table(windows(spark, folder))
    return retrieval.closure(lines, {"a": ["lease", "router"], "b": ["lease", "quokka"], "c": ["token"]})


def reachable_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files within three steps of use from the files of one folder."""
    h = table(spark, folder, "hop1_context").where("file_path is not null and search_token is not null")
    named = lambda relation: h.where(F.col("relation") == relation).select(F.col("file_path").alias("path"), F.col("search_token").alias("name")).distinct()
    start = h.where(F.col("file_path").startswith("core/")).select(F.col("file_path").alias("id"))
    return retrieval.reachable_through(checkpointed(named("reference")), checkpointed(named("definition")), start, 3)


def renamed_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """How often a rename of one word would change each window, strings and comments left alone."""
    h = table(spark, folder, "hop1_context").where(F.col("code").contains("router")).select("hop_id", "code", F.coalesce("code_lang", F.lit("ts")).alias("lang"))

    def run(batches):
        for batch in batches:
            done = [edits.rename(t, "router", "switch_", {"py": "python", "rb": "ruby"}.get(g, g)) for t, g in zip(batch["code"], batch["lang"], strict=True)]
            yield batch[["hop_id"]].assign(times=[n for _, n in done])

    return spread(h).mapInPandas(run, "hop_id bigint, times bigint").where("times > 0")


def csv_dialects(spark: SparkSession, folder: str) -> DataFrame:
    """Delimiter, header, records and width of every file."""
    return delimited.record_dialects(table(spark, folder, "csv_rows"), table(spark, folder, "csv_tables").select("file_id", F.col("file_ext").alias("ext")))


def ignored_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Which served files gitignore rules would leave out."""
    p = table(spark, folder, "served_surfaces").select("file_path").where("file_path is not null").distinct()
    rules = ["*.min.*", "!important.min.js", "dist/", "/core/**/generated/", "node_modules/", "**/vendor/*/"]
    return spread(p).select("file_path", files.ignored(F.col("file_path"), rules).alias("ignored"))


def served_ledger_stream(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines of each file a stream of served windows has covered in the end."""
    s = runner.table_stream(spark, folder, "hop1_context").where("workspace_id is not null and file_path is not null")
    spans = intervals.parsed(s, "line_range").where("start is not null and start <= end")
    events = spans.select("workspace_id", "file_path", F.lit("v1").alias("fingerprint"), F.col("hop_id").alias("seq"), "start", "end")
    out = runner.drained(sessions.served_ranges(events))
    return out.groupBy("workspace_id", "file_path").agg(F.max("served_lines").alias("served_lines"), F.sum("added_lines").alias("added_lines"), F.count("*").alias("events"))


def query_epochs_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Epochs of related queries in each workspace."""
    s = runner.table_stream(spark, folder, "query_evidence").where("workspace_id is not null and matched_terms is not null")
    out = runner.drained(sessions.epochs(s.select("workspace_id", F.col("evidence_id").alias("seq"), F.col("matched_terms").alias("tokens"))))
    return out.groupBy("workspace_id").agg(F.max("epoch").alias("epochs"), F.count("*").alias("queries"))


def daily_usage_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events by day and type in event time; the days whose watermark has passed."""
    s = runner.table_stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = runner.drained(sessions.windowed_usage(s))
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def query_words(spark: SparkSession, folder: str) -> DataFrame:
    """In how many rows each term of the evidence was matched and missing."""
    e = table(spark, folder, "query_evidence")
    hit = e.select(F.explode("matched_terms").alias("term"), F.lit(1).alias("m"), F.lit(0).alias("x"))
    miss = e.select(F.explode("missing_terms").alias("term"), F.lit(0).alias("m"), F.lit(1).alias("x"))
    return hit.unionByName(miss).groupBy("term").agg(F.sum("m").alias("matched"), F.sum("x").alias("missing"))


def name_parts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each part occurs in the names that are declared."""
    s, _, _ = _parts(spark, folder)
    return s.select(F.explode(tx.identifier_parts(F.col("name"))).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


def file_outlines(spark: SparkSession, folder: str) -> DataFrame:
    """Windows without the bodies of their functions."""
    return outline.outlines(windows(spark, folder)).select("path", F.length("outline").alias("n_chars"), F.round("kept", 6).alias("kept"))


def compact_outline(spark: SparkSession, folder: str) -> DataFrame:
    """The 40 largest windows by declarations, within 800 tokens."""
    best = checkpointed(symbols.symbols(windows(spark, folder))).groupBy("path").agg(F.count("*").cast("double").alias("rank"), F.ceil(F.sum(F.length("signature")) / 4).cast("bigint").alias("tokens"))
    return outline.compact(best.orderBy(F.desc("rank"), "path").limit(40))


def file_roles(spark: SparkSession, folder: str) -> DataFrame:
    return outline.roles(windows(spark, folder))


def symbol_chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols with the chunks of their lines."""
    s = checkpointed(symbols.symbols(windows(spark, folder)).select("path", "name", "line", "end_line"))
    return outline.chunks_of_symbols(s, outline.symbol_chunks(s)).select("path", "name", F.size("chunk_ids").alias("n_chunks"))


def sibling_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Further lines with the stem of a query in the files that have the query."""
    lines = search.line_table(windows(spark, folder))
    return outline.sibling_stems(lines, search.matching(lines, "sample_index", ignore_case=False), "sample_index").select("path", "line")


def fullest_windows(spark: SparkSession, folder: str) -> DataFrame:
    return outline.fullest_window(search.line_table(windows(spark, folder)), ["lease", "router"], 20)


def symbol_context(spark: SparkSession, folder: str) -> DataFrame:
    """What belongs around each declaration of the name that is declared most."""
    s = checkpointed(symbols.symbols(windows(spark, folder)).select("path", "name", "line", "end_line", "signature"))
    most = s.groupBy("name").count().orderBy(F.desc("count"), "name").limit(1).select("name")
    return outline.symbol_with_context(search.line_table(windows(spark, folder)), s, most).select("path", "part", "line", "text")


def served_and_carried(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of windows of definitions, cut to what windows of the same file carry."""
    h = intervals.parsed(table(spark, folder, "hop1_context").where("file_path is not null"), "line_range").where("start <= end")
    spans = h.select(F.col("search_token").alias("request_id"), F.col("file_path").alias("path"), "start", "end", "relation").where("request_id is not null").distinct()
    return outline.retracted(spans.where("relation = 'definition'").drop("relation"), spans.drop("relation"))


def entry_points(spark: SparkSession, folder: str) -> DataFrame:
    return outline.entry_points(table(spark, folder, "served_surfaces").select(F.col("file_path").alias("path")).where("path is not null"))


QUERIES = {
    f.__name__: f
    for f in (file_outlines, compact_outline, file_roles, symbol_chunk_ids, sibling_lines, fullest_windows, symbol_context, served_and_carried, entry_points, located, located_decision, surface_map, related_files, line_slices, token_pack, evidence_selection, fitting_sections, small_files, window_digests, section_plans, closure_checks, reachable_files, renamed_symbols, csv_dialects, ignored_paths, served_ledger_stream, query_epochs_stream, daily_usage_stream, query_words, name_parts)
}

_LINES = r"""s AS (SELECT file_path || '@' || hop_id AS path, string_split_regex(code, '\r?\n') AS parts FROM hop1_context WHERE code IS NOT NULL)"""

_L = _LINES + ", l AS (SELECT path, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS text FROM s)"

_BEST = f"""e AS (SELECT file_path AS path, coalesce(line_no, 0) AS line, score, {surface_case("file_path")} AS surface FROM query_evidence WHERE file_path IS NOT NULL AND score IS NOT NULL)"""

_PENALTY = f"- CASE WHEN {IS_TEST.format(path='path')} THEN 0.3 ELSE 0 END - CASE WHEN {IS_NOISE.format(path='path')} OR regexp_matches(path, '(^|/)(dist|build|out|coverage|[.]next|target)/') THEN 0.5 ELSE 0 END"
_LOCATED = f"""{SYMBOLS}, sl AS (SELECT path, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS text FROM (SELECT path, string_split_regex(content, '\\r?\\n') AS parts FROM {WINDOWS})),
pool AS (SELECT path, line, CASE WHEN lower(name) IN ('leaserouter', 'seal', 'router', 'lease') THEN 2.0 ELSE 0.8 END AS s, 1 AS prio, 'symbol' AS kind FROM sym WHERE regexp_matches(lower(name), 'router|lease|seal')
  UNION ALL SELECT path, line, 1.2 * (CAST(contains(lower(text), 'leaserouter') AS INT) + CAST(contains(lower(text), 'seal') AS INT)) / 2, 2, 'text' FROM sl WHERE regexp_matches(lower(text), 'leaserouter|seal')
  UNION ALL SELECT path, 1, CASE n WHEN 3 THEN 1.7 WHEN 2 THEN 1.5 ELSE 1.25 END, 3, 'filename' FROM (SELECT path, len(list_intersect({parts("regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', '')")}, ['router', 'lease', 'seal', 'leaserouter'])) AS n FROM {WINDOWS}) WHERE n > 0
  UNION ALL SELECT path, line, 0.7, 4, 'variant' FROM sl WHERE regexp_matches(lower(text), 'lease[-_]router') UNION ALL SELECT path, line, 0.55, 5, 'family' FROM sym WHERE {parts("name")}[1] = 'lease'
  UNION ALL SELECT path, line, 0.5, 6, 'reference' FROM sl WHERE regexp_matches(text, '(?i)(^|[^\\w$])(leaserouter|seal|router|lease)([^\\w$]|$)')
  UNION ALL SELECT path, 1, 0.3 * n, 7, 'path' FROM (SELECT path, len(list_intersect(list_distinct({parts("regexp_replace(regexp_replace(path, '/[^/]*$', ''), '/', ' ', 'g')")}), ['router', 'lease', 'seal'])) AS n FROM {WINDOWS}) WHERE n > 0),
once AS (SELECT path, line, kind, s {_PENALTY} AS score FROM pool QUALIFY row_number() OVER (PARTITION BY path, line ORDER BY prio, s DESC) = 1),
loc AS (SELECT path, line, kind, round(score, 6) AS score FROM (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, line) = 1) ORDER BY score DESC, path, line LIMIT 20)"""

#: A line of ``cm`` without comments, with its marks around literals.
BARE_MARKED = BARE.removeprefix("replace(replace(").removesuffix(", chr(3), ''), chr(4), '')")

SQL = {
    "located": f"WITH {_LOCATED} SELECT path, line, kind, score FROM loc",
    "file_outlines": rf"""WITH {SYMBOLS}, sl AS (SELECT path, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS text FROM (SELECT path, string_split_regex(content, '\r\n|\r|\n') AS parts FROM {WINDOWS})),
i AS (SELECT path, length(rtrim(text)) AS n FROM sl WHERE line <= 60 AND regexp_matches(text, '^\s*(import\b|from\s+\S+\s+import|using\s|use\s|#include|require\b|package\s)') QUALIFY row_number() OVER (PARTITION BY path ORDER BY line) <= 12),
o AS (SELECT path, n FROM i UNION ALL SELECT s.path, length(regexp_extract(sl.text, '^\s*')) + length(s.signature) + CASE WHEN kind IN ('class', 'interface', 'enum') OR end_line <= s.line THEN 0 WHEN ends_with(s.signature, '{{') THEN 6 ELSE 4 END FROM sym s JOIN sl ON sl.path = s.path AND sl.line = s.line),
t AS (SELECT path, CAST(sum(n) + count(*) - 1 AS BIGINT) AS n FROM o GROUP BY path) SELECT w.path, coalesce(n, 0) AS n_chars, round(coalesce(n, 0) / greatest(1, length(content)), 6) AS kept FROM {WINDOWS} w LEFT JOIN t ON t.path = w.path""",
    "located_decision": f"""WITH {_LOCATED}, r AS (SELECT *, lead(score) OVER (ORDER BY score DESC, path) AS nxt, row_number() OVER (ORDER BY score DESC, path) AS n FROM loc)
SELECT coalesce(score - nxt >= 0.8, true) AND score >= 0.8 AS hit, greatest(0.0, least(1.0, score / 2)) AS confidence, path FROM r WHERE n = 1""",
    "name_parts": f"WITH {SYMBOLS} SELECT part, count(*) AS n FROM (SELECT unnest({parts('name')}) AS part FROM sym) GROUP BY part",
    "symbol_chunk_ids": f"WITH {SYMBOLS} SELECT DISTINCT path, name, CAST(sum((end_line - line) // 50 + 1) OVER (PARTITION BY path, name) AS INTEGER) AS n_chunks FROM sym",
    "window_digests": f"""WITH {SYMBOLS}, sl AS (SELECT path, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS text FROM (SELECT path, string_split_regex(content, '\\r?\\n') AS parts FROM {WINDOWS})),
i AS (SELECT path, least(count(*), 12) AS n FROM sl WHERE line <= 60 AND coalesce({", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in _IMPORTS)}) IS NOT NULL GROUP BY path), s AS (SELECT path, count(*) AS n FROM sym GROUP BY path),
h AS (SELECT path, count(*) FILTER (contains(lower(text), 'lease')) AS hits FROM sl GROUP BY path) SELECT h.path, coalesce(i.n, 0) AS imports, coalesce(s.n, 0) AS names, hits FROM h LEFT JOIN i USING (path) LEFT JOIN s USING (path)""",
    "symbol_context": rf"""WITH {SYMBOLS}, sl AS (SELECT path, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS text FROM (SELECT path, string_split_regex(content, '\r?\n') AS parts FROM {WINDOWS})),
top AS (SELECT name FROM sym GROUP BY name ORDER BY count(*) DESC, name LIMIT 1),
own AS (SELECT path, line AS a, end_line AS b FROM sym WHERE name IN (SELECT name FROM top)), inn AS (SELECT path, line, text FROM sl JOIN own USING (path) WHERE line BETWEEN a AND b),
used AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*')) AS w FROM inn),
imp AS (SELECT path, line, text, unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*')) AS w FROM sl WHERE path IN (SELECT path FROM own) AND line <= 60 AND regexp_matches(text, '^\s*(import\b|from\s|using\s|use\s|const .*require\()'))
SELECT path, 'body' AS part, line, text FROM inn UNION ALL SELECT DISTINCT path, 'import', line, text FROM imp JOIN used USING (path, w) UNION ALL SELECT path, 'sibling', line, signature FROM sym WHERE name NOT IN (SELECT name FROM top) AND path IN (SELECT path FROM own)""",
    "compact_outline": f"""WITH {SYMBOLS}, b AS (SELECT path, CAST(count(*) AS DOUBLE) AS rank, CAST(ceil(sum(length(signature)) / 4.0) AS BIGINT) AS tokens FROM sym GROUP BY path ORDER BY rank DESC, path LIMIT 40)
SELECT path, rank, tokens FROM b QUALIFY row_number() OVER (ORDER BY rank DESC, path) <= 10 OR sum(tokens) OVER (ORDER BY rank DESC, path ROWS UNBOUNDED PRECEDING) <= 800""",
    "section_plans": rf"""WITH {_MD}, sl AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS text FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS parts FROM documents WHERE text IS NOT NULL)),
r AS (SELECT doc_id, line, end_line, 3 * (CAST(contains(lower(heading), 'snapshot') AS INT) + CAST(contains(lower(heading), 'handle') AS INT)) + least(6, (SELECT count(*) FROM sl WHERE sl.doc_id = h.doc_id AND sl.line > h.line AND sl.line <= h.end_line AND regexp_matches(lower(sl.text), 'snapshot|handle'))) AS score FROM h)
SELECT doc_id, line, end_line, score FROM r WHERE score >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, end_line - line, line) = 1""",
    "file_roles": rf"""WITH w AS (SELECT path, content, lower(regexp_extract(path, '[.]([^.]*)$', 1)) IN ('md', 'mdx', 'markdown') AS md FROM {WINDOWS}),
x AS (SELECT path, CASE WHEN md THEN nullif(trim(regexp_extract(content, '(?m)^#{{1,3}}\s+(\S.*)$', 1)), '') END AS h, trim(regexp_extract(content, '^(?:#!.*\n)?\s*(?:/\*\*?\s*\n?\s*\*?|//+|#|"{{3}})\s*([^\n*"]*[^\s\n*"][^\n*"]*)', 1)) AS c,
  nullif(trim(regexp_extract(content, '(?m)^\s*((?:export\s+|public\s+|pub\s+)?(?:abstract\s+)?(?:class|interface|function|def|func|fn|fun|struct|enum|type|const)\s+\w+)', 1)), '') AS d FROM w),
b AS (SELECT path, coalesce(h, CASE WHEN len(string_split_regex(c, '\s+')) >= 3 THEN c END, d) AS r FROM x) SELECT path, CASE WHEN length(r) > 72 THEN left(r, 71) || '…' ELSE r END AS role FROM b WHERE r IS NOT NULL""",
    "query_epochs_stream": """WITH RECURSIVE q AS (SELECT workspace_id, matched_terms AS t, row_number() OVER (PARTITION BY workspace_id ORDER BY evidence_id) AS n FROM query_evidence WHERE workspace_id IS NOT NULL AND matched_terms IS NOT NULL),
e AS (SELECT workspace_id, n, 1 AS epoch, t AS known FROM q WHERE n = 1 UNION ALL SELECT q.workspace_id, q.n, CASE WHEN list_has_any(known, t) THEN epoch ELSE epoch + 1 END, CASE WHEN list_has_any(known, t) THEN list_distinct(list_concat(known, t)) ELSE t END FROM e JOIN q ON q.workspace_id = e.workspace_id AND q.n = e.n + 1)
SELECT workspace_id, CAST(max(epoch) AS BIGINT) AS epochs, count(*) AS queries FROM e GROUP BY workspace_id""",
    "renamed_symbols": rf"""WITH {comments("(SELECT hop_id AS path, CASE coalesce(code_lang, 'ts') WHEN 'py' THEN 'python' WHEN 'rb' THEN 'ruby' ELSE code_lang END AS lang, code AS content FROM hop1_context WHERE contains(code, 'router'))")}, x AS (SELECT path, len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace({BARE_MARKED}, chr(3) || '[^' || chr(4) || ']*(' || chr(4) || '|$)', ' ', 'g'), '[A-Za-z0-9_$]+', '<\0>', 'g'), '<router>', chr(7), 'g'), chr(7))) AS n FROM cm)
SELECT path AS hop_id, CAST(sum(n) AS BIGINT) AS times FROM x GROUP BY path HAVING sum(n) > 0""",
    "ignored_paths": r"""WITH p AS (SELECT DISTINCT file_path FROM served_surfaces WHERE file_path IS NOT NULL)
SELECT file_path, regexp_matches(file_path, '(^|/)dist/|^core/(.+/)?generated/|(^|/)node_modules/|(^|/)vendor/[^/]+/') OR (regexp_matches(file_path, '(^|/)[^/]*[.]min[.][^/]*(/|$)') AND NOT regexp_matches(file_path, '(^|/)important[.]min[.]js$')) AS ignored FROM p""",
    "csv_dialects": r"""WITH d AS (SELECT * FROM (VALUES (0, ',', ','), (1, chr(9), chr(9)), (2, ';', ';'), (3, '|', '\|')) v(k, d, e)),
r AS (SELECT file_id, row_no, regexp_replace(raw_record, '[\r\n]+$', '') AS x FROM csv_rows WHERE raw_record IS NOT NULL),
w AS (SELECT file_id, row_no, x, k, d, e, len(regexp_extract_all(x || d, '(?:"(?:[^"]|"")*(?:"[^' || e || '\r\n]*|$)|[^' || e || '\r\n]*)(?:' || e || ')')) AS n FROM r, d),
h AS (SELECT file_id, k, n, count(*) AS c, sum(count(*)) OVER (PARTITION BY file_id, k) AS total FROM w WHERE row_no <= 20 AND (n > 1 OR trim(x) <> '') GROUP BY file_id, k, n),
m AS (SELECT file_id, k, n, c / total AS share FROM h QUALIFY row_number() OVER (PARTITION BY file_id, k ORDER BY c DESC, n DESC) = 1),
best AS (SELECT f.file_id, coalesce(CASE WHEN f.file_ext = 'tsv' THEN 1 END, (SELECT arg_max(k, (share, n, -k)) FROM m WHERE m.file_id = f.file_id AND n >= 2), 0) AS k FROM csv_tables f),
a AS (SELECT w.file_id, w.d, w.e, w.row_no, w.x, w.n FROM w JOIN best USING (file_id, k) WHERE n > 1 OR trim(x) <> ''),
c AS (SELECT file_id, list_transform(regexp_extract_all(regexp_replace(x, '^\x{FEFF}', '') || d, '("(?:[^"]|"")*(?:"[^' || e || '\r\n]*|$)|[^' || e || '\r\n]*)(?:' || e || ')', 1), lambda v: trim(replace(v, '"', ''))) AS v FROM a WHERE row_no = (SELECT min(row_no) FROM a b WHERE b.file_id = a.file_id)),
t AS (SELECT file_id, len(list_filter(v, lambda y: y = '')) = 0 AND len(list_distinct(v)) = len(v) AND 2 * len(list_filter(v, lambda y: regexp_full_match(y, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)'))) < len(v) AS header FROM c)
SELECT a.file_id, any_value(d) AS delimiter, any_value(header) AS has_header, count(*) - CAST(any_value(header) AS INT) AS n_records, max(n) AS n_columns FROM a JOIN t USING (file_id) GROUP BY a.file_id""",
    "surface_map": f"""WITH {_BEST} SELECT surface, path, line, score FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY surface ORDER BY score DESC, line, path DESC) = 1) ORDER BY score DESC, path LIMIT 8""",
    "related_files": f"""WITH {_BEST}, o AS (SELECT *, floor(score / 0.001) AS s FROM e QUALIFY row_number() OVER (PARTITION BY path ORDER BY floor(score / 0.001) DESC, line) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY s DESC, path, line) AS k FROM o) SELECT path, line, surface, score FROM k ORDER BY least(k, 2), s DESC, path, line LIMIT 6""",
    "daily_usage_stream": """WITH d AS (SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2)
SELECT strftime(day, '%Y-%m-%d') AS day, event_type, n, total FROM d WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "sibling_lines": f"""WITH {_L}, h AS (SELECT path, line FROM l WHERE contains(text, 'sample_index'))
SELECT path, line FROM l WHERE contains(lower(text), 'sample') AND path IN (SELECT path FROM h) AND (path, line) NOT IN (SELECT path, line FROM h)""",
    "fullest_windows": f"""WITH {_L}, h AS (SELECT path, line, CAST(contains(lower(text), 'lease') AS INT) + CAST(contains(lower(text), 'router') AS INT) AS n FROM l),
w AS (SELECT path, line, sum(n) OVER (PARTITION BY path ORDER BY line RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) AS hits FROM h WHERE n > 0)
SELECT path, line, line + 19 AS last_line, CAST(hits AS BIGINT) AS hits FROM w QUALIFY row_number() OVER (PARTITION BY path ORDER BY hits DESC, line) = 1""",
    "served_and_carried": r"""WITH sp AS (SELECT DISTINCT search_token AS request_id, file_path AS path, relation, CAST(regexp_extract(line_range, '^(\d+)-(\d+)$', 1) AS BIGINT) AS a, CAST(regexp_extract(line_range, '^(\d+)-(\d+)$', 2) AS BIGINT) AS b
  FROM hop1_context WHERE file_path IS NOT NULL AND search_token IS NOT NULL AND regexp_matches(line_range, '^(\d+)-(\d+)$'))
SELECT DISTINCT s.request_id, s.path, greatest(s.a, c.a) AS "start", least(s.b, c.b) AS "end" FROM sp s JOIN sp c ON s.request_id = c.request_id AND s.path = c.path AND s.a <= c.b AND s.b >= c.a WHERE s.relation = 'definition' AND s.a <= s.b AND c.a <= c.b""",
    "entry_points": r"""WITH p AS (SELECT DISTINCT file_path AS path, lower(regexp_replace(regexp_extract(file_path, '[^/]*$'), '\..*$', '')) AS stem FROM served_surfaces WHERE file_path IS NOT NULL),
x AS (SELECT path, CASE WHEN stem = 'index' THEN 6 WHEN stem IN ('main', 'app') THEN 5 WHEN stem IN ('server', 'worker', 'cli', 'bin') THEN 4 WHEN stem = 'extension' THEN 3 ELSE 0 END AS s FROM p)
SELECT path, s + CASE WHEN regexp_matches(lower(path), '(^|/)(server|worker|bin|cli)/') THEN 2 ELSE 0 END AS score FROM x WHERE s > 0 ORDER BY score DESC, path LIMIT 10""",
    "line_slices": f"""WITH {_LINES} SELECT path, 2 AS "start", least(4, len(parts)) AS "end", array_to_string(parts[2:4], chr(10)) AS text FROM s WHERE len(parts) >= 2""",
    "token_pack": """WITH best AS (SELECT evidence_id, row_number() OVER (ORDER BY score DESC, evidence_id) AS item_no, CAST(ceil(length(content_text) / 4.0) AS BIGINT) AS tokens FROM query_evidence
  WHERE content_text IS NOT NULL AND score IS NOT NULL),
r AS (SELECT *, sum(CASE WHEN tokens > 2400 THEN 0 ELSE tokens END) OVER (ORDER BY item_no) AS run FROM best), x AS (SELECT min(item_no) AS stop FROM r WHERE tokens <= 2400 AND run > 2400)
SELECT evidence_id, item_no, tokens, CASE WHEN item_no > stop THEN 'omitted' WHEN item_no = stop THEN 'cap-exhausted' WHEN tokens > 2400 THEN 'cap-exceeded' ELSE 'served' END AS fate FROM r, x""",
    "evidence_selection": """WITH RECURSIVE s AS (SELECT row_number() OVER (ORDER BY evidence_id) AS n, evidence_id, workspace_id AS concern, evidence_kind AS class, strlen(content_text) AS b FROM query_evidence
  WHERE content_text IS NOT NULL AND workspace_id IS NOT NULL),
r AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(evidence_id BIGINT, concern VARCHAR, class VARCHAR, b BIGINT)[]) AS taken UNION ALL
  SELECT s.n, CASE WHEN coalesce(list_sum(list_transform(taken, lambda x: x.b)), 0) + s.b <= 6144 AND coalesce(list_sum(list_transform(list_filter(taken, lambda x: x.concern = s.concern), lambda x: x.b)), 0) + s.b <= 2048
    AND len(list_filter(taken, lambda x: x.concern = s.concern AND x.class IS NOT DISTINCT FROM s.class)) < 2 THEN list_append(taken, {'evidence_id': s.evidence_id, 'concern': s.concern, 'class': s.class, 'b': s.b}) ELSE taken END
  FROM r JOIN s ON s.n = r.n + 1)
SELECT t.evidence_id, t.concern, t.class FROM (SELECT unnest(taken) AS t FROM r WHERE n = (SELECT max(n) FROM s))""",
    "fitting_sections": """WITH d AS (SELECT docx_id, unnest(sections) AS s, unnest(range(len(sections))) AS pos FROM docx_artifacts WHERE sections IS NOT NULL),
r AS (SELECT docx_id, sum(coalesce(strlen(s.heading), 0) + coalesce(strlen(s.body_text), 0)) OVER (PARTITION BY docx_id ORDER BY pos) AS run FROM d) SELECT docx_id, count(*) FILTER (run <= 4096) AS n FROM r GROUP BY docx_id""",
    "small_files": r"""WITH b AS (SELECT vsurface_id AS path, strlen(code) AS bytes, regexp_replace(code, '(\r\n|\r|\n)\z', '') AS body FROM verification_surfaces WHERE code IS NOT NULL),
n AS (SELECT path, bytes, CASE WHEN body = '' THEN 0 ELSE len(string_split_regex(body, '\r\n|\r|\n')) END AS lines FROM b) SELECT path, bytes <= 8192 AND lines <= 250 AS tiny, lines, bytes FROM n""",
    "closure_checks": f"""WITH {_LINES}, j AS (SELECT array_to_string(parts, chr(10)) AS t FROM s)
SELECT 'a' AS "check", bool_or(contains(t, 'lease') AND contains(t, 'router')) AS done FROM j UNION ALL SELECT 'b', bool_or(contains(t, 'lease') AND contains(t, 'quokka')) FROM j UNION ALL SELECT 'c', bool_or(contains(t, 'token')) FROM j""",
    "served_ledger_stream": r"""WITH sp AS (SELECT workspace_id, file_path, CAST(regexp_extract(line_range, '^(\d+)-(\d+)$', 1) AS BIGINT) AS a, CAST(regexp_extract(line_range, '^(\d+)-(\d+)$', 2) AS BIGINT) AS b FROM hop1_context
  WHERE workspace_id IS NOT NULL AND file_path IS NOT NULL AND regexp_matches(line_range, '^(\d+)-(\d+)$')),
l AS (SELECT DISTINCT workspace_id, file_path, unnest(range(a, b + 1)) AS line FROM sp WHERE a <= b), n AS (SELECT workspace_id, file_path, count(*) AS events FROM sp WHERE a <= b GROUP BY ALL)
SELECT l.workspace_id, l.file_path, count(*) AS served_lines, count(*) AS added_lines, any_value(events) AS events FROM l JOIN n USING (workspace_id, file_path) GROUP BY l.workspace_id, l.file_path""",
    "query_words": """SELECT term, CAST(sum(m) AS BIGINT) AS matched, CAST(sum(x) AS BIGINT) AS missing FROM (SELECT unnest(matched_terms) AS term, 1 AS m, 0 AS x FROM query_evidence UNION ALL SELECT unnest(missing_terms), 0, 1 FROM query_evidence) GROUP BY term""",
    "reachable_files": """WITH RECURSIVE h AS (SELECT * FROM hop1_context WHERE file_path IS NOT NULL AND search_token IS NOT NULL),
e AS (SELECT DISTINCT u.file_path AS src, d.file_path AS dst FROM h u JOIN h d USING (search_token) WHERE u.relation = 'reference' AND d.relation = 'definition' AND u.file_path <> d.file_path),
r AS (SELECT DISTINCT file_path AS id, 0 AS steps FROM h WHERE starts_with(file_path, 'core/') UNION SELECT e.dst, r.steps + 1 FROM r JOIN e ON e.src = r.id WHERE r.steps < 3)
SELECT id, min(steps) AS steps FROM r GROUP BY id""",
}
