"""Queries of trees, intervals, symbols, chunks and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.functions import text as tx
from loomfield.operators import graph, intervals, search, symbols, trees
from loomfield.plans.lexed_sql import IS_NOISE, IS_TEST, SYMBOLS, parts
from loomfield.plans.search_queries import windows
from loomfield.session import checkpointed, likely, table


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "served_surfaces").select(F.col("file_path").alias("path")).where("path is not null").distinct()


def tree_counts(spark: SparkSession, folder: str) -> DataFrame:
    return trees.tree_counts(_paths(spark, folder))


def tree_top(spark: SparkSession, folder: str) -> DataFrame:
    """The tree down to two folders."""
    return trees.tree_counts(_paths(spark, folder), depth=2).select("dir", "files")


def module_map(spark: SparkSession, folder: str) -> DataFrame:
    return trees.module_map(_paths(spark, folder))


def folder_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the folders of verification_surfaces, from the digests of their files' code."""
    v = table(spark, folder, "verification_surfaces").where("code is not null")
    files = v.groupBy("file_path").agg(F.min(F.sha2("code", 256)).alias("hash"))
    return trees.folder_digests(files.withColumnRenamed("file_path", "path"))


def stale_index(spark: SparkSession, folder: str) -> DataFrame:
    """Whether an index of files would have to be written again: after nothing, and after the files of one folder changed."""
    v = table(spark, folder, "verification_surfaces").where("code is not null and file_path is not null")
    digests = lambda code: trees.folder_digests(v.groupBy(F.col("file_path").alias("path")).agg(F.min(F.sha2(code, 256)).alias("hash")))
    before = checkpointed(digests(F.col("code")).where("dir = '.'"))
    changed = digests(F.when(F.col("file_path").startswith("core/"), F.concat("code", F.lit(" "))).otherwise(F.col("code")))
    same, other = (trees.stale(before, x).select(F.lit(n).alias("change"), "stale") for n, x in (("none", digests(F.col("code"))), ("core", changed)))
    return same.unionByName(other)


def folder_digests_flat(spark: SparkSession, folder: str) -> DataFrame:
    """One level: the digest of each source's documents."""
    d = table(spark, folder, "documents").where("source is not null and text is not null")
    files = d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("hash"))
    return trees.folder_digests(files).where("dir <> '.'").select("dir", "digest", "entries")


def root_markers(spark: SparkSession, folder: str) -> DataFrame:
    """Each path's nearest folder called src, lib, internal or index."""
    p = _paths(spark, folder)
    marks = p.select(F.explode(tx.ancestors(F.col("path"))).alias("root")).distinct().where(F.col("root").rlike(r"/(?:src|lib|internal|index)\z"))
    return trees.roots_of(p, marks)


def dominant_root(spark: SparkSession, folder: str) -> DataFrame:
    """The top folder served most."""
    s = table(spark, folder, "served_surfaces").where("file_path is not null").withColumn("top", F.substring_index("file_path", "/", 1))
    return trees.dominant(s, "top", order="top")


def cluster_root(spark: SparkSession, folder: str) -> DataFrame:
    """The folder that holds most of the best evidence."""
    e = table(spark, folder, "query_evidence").where("file_path is not null and score is not null")
    best = e.groupBy("file_path").agg(F.max("score").alias("score"))
    return trees.cluster_root(best.withColumnRenamed("file_path", "path"), share=0.1, least_depth=1)


def surface_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return trees.coverage(table(spark, folder, "served_surfaces"), "surface_role", ["api", "ui", "data", "test", "style", "domain"])


def basename_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return trees.basename_frequency(_paths(spark, folder))


def snapshot_actions(spark: SparkSession, folder: str) -> DataFrame:
    """What a rebuild would do from the last fingerprints of files served up to the middle of the sequence to the last of those served after it.

    A file that is served in one half only is dropped or added. Its symbols count as still found if it was last served with a handle.
    """
    s = table(spark, folder, "served_surfaces").where("file_path is not null and fingerprint rlike '^[0-9]+:[0-9]+$'")
    s = s.select(F.col("file_path").alias("path"), F.split_part("fingerprint", F.lit(":"), F.lit(1)).cast("bigint").alias("size_bytes"), F.split_part("fingerprint", F.lit(":"), F.lit(2)).cast("bigint").alias("mtime_ms"), "served_at", "surface_id", "handle")
    middle = s.agg(((F.min("served_at") + F.max("served_at")) / 2).alias("middle")).scalar()
    last = lambda half: half.groupBy("path").agg(F.max_by(F.struct("size_bytes", "mtime_ms", "handle"), F.struct("served_at", "surface_id")).alias("x")).select("path", "x.size_bytes", "x.mtime_ms", F.col("x.size_bytes").cast("string").alias("hash"), F.col("x.handle").isNotNull().alias("valid"))
    old, new = last(s.where(F.col("served_at") <= middle)), last(s.where(F.col("served_at") > middle))
    return trees.snapshot_actions(old, new)


def _spans(spark: SparkSession, folder: str, relation: str | None = None) -> DataFrame:
    h = table(spark, folder, "hop1_context").where("file_path is not null")
    h = h.where(F.col("relation") == relation) if relation else h
    return intervals.parsed(h.select("file_path", "line_range"), "line_range").select("file_path", "start", "end")


def interval_union(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of each file that were served, as merged ranges."""
    return intervals.union(_spans(spark, folder), ["file_path"])


def interval_complement(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of each file, up to the last one served and ten more, that were not."""
    merged = interval_union(spark, folder)
    total = merged.withColumn("total", F.max("end").over(Window.partitionBy("file_path")) + 10)
    return intervals.complement(total, ["file_path"], "total")


def interval_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """With how many distinct windows of its file each one shares a line, itself included."""
    return intervals.overlap_counts(_spans(spark, folder).distinct(), ["file_path"])


def text_chunks(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return symbols.chunks(d)


def line_offsets(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "query_evidence").select(F.col("evidence_id").cast("string").alias("path"), F.col("content_text").alias("content"))
    return symbols.line_offsets(search.line_table(d))


def text_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Content digests, short and salted ids."""
    d = table(spark, folder, "documents")
    return d.select("doc_id", tx.digest(F.col("text")).alias("sha256"), tx.digest(F.col("text"), 12).alias("short_id"), tx.opaque_id("salt", "doc", F.col("doc_id").cast("string")).alias("opaque_id"))


def compressed_text(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "pdf_pages").where("page_text is not null")
    return d.select("page_id", F.sha2(tx.compressed(F.col("page_text")), 256).alias("compressed_sha"), F.length(tx.compressed(F.col("page_text"))).alias("n_chars"))


def column_letters(spark: SparkSession, folder: str) -> DataFrame:
    """Spreadsheet letters of the columns of delimited files, and back."""
    t = table(spark, folder, "csv_tables")
    cells = t.select("file_id", F.posexplode("column_names").alias("at", "column_name"))
    letters = tx.column_letters((F.col("at") + 1) * 37)
    return cells.select("file_id", "column_name", ((F.col("at") + 1) * 37).cast("bigint").alias("number"), letters.alias("letters"), tx.column_number(letters).alias("back"))


def code_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Declarations of all windows."""
    return symbols.symbols(windows(spark, folder)).drop("doc").withColumn("body_tokens", tx.body_tokens(F.col("line"), F.col("end_line")))


def symbol_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Declarations by kind, and by the kind that their signature alone tells."""
    s = code_symbols(spark, folder).withColumn("said", symbols.kind_of(F.col("signature")))
    return s.groupBy("kind", "said").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


def find_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """The best symbols for a query of two words."""
    found = checkpointed(code_symbols(spark, folder).select("path", "line", "name"))
    return graph.symbol_search(found, "seal manifest", scores=graph.count_scores(found), limit=20)


def _declared_and_used(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(symbols, tokens): the names declared in windows, by file, and the distinct tokens of windows, by file."""
    code = windows(spark, folder)
    path = F.regexp_replace("path", r"@\d+\z", "").alias("path")
    found = symbols.symbols(code).select(path, "name", F.struct("path", "line").alias("position"))
    return found, code.select(path, F.array_distinct(F.regexp_extract_all("content", F.lit(f"({tx.IDENTIFIER})"), F.lit(1))).alias("tokens"))


def _doc_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(symbols, tokens): the names declared in windows, by file, and the tokens of files."""
    found, used = _declared_and_used(spark, folder)
    found = checkpointed(found)
    return found, checkpointed(likely(used.select("path", F.explode("tokens").alias("token")), ["token"], found.select("name")).distinct())


def file_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between files by names used and declared."""
    return graph.file_edges(*_declared_and_used(spark, folder))


def ranked_files(spark: SparkSession, folder: str) -> DataFrame:
    """The 40 files of the highest rank in the symbol graph; files changed last count double."""
    s, t = _doc_graph(spark, folder)
    recent = table(spark, folder, "hop1_context").where("file_path is not null").groupBy(F.col("file_path").alias("path")).agg(F.max("served_at").alias("at")).orderBy(F.desc("at"), "path").limit(50).select("path", F.lit(2.0).alias("preference"))
    ranks = graph.symbol_ranks(s, t, recent)
    files = table(spark, folder, "hop1_context").select(F.col("file_path").alias("path")).where("path is not null")
    return graph.file_scores(ranks, files)


#: A bounded digraph for comparing ranks with SQL: which top folder's files are served right after which.
def _folder_graph(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "served_surfaces").where("file_path is not null").dropDuplicates(["surface_id"])
    w = Window.partitionBy("pack_id").orderBy("served_at", "surface_id")
    steps = s.select("pack_id", F.substring_index("file_path", "/", 2).alias("src"), F.lead(F.substring_index("file_path", "/", 2)).over(w).alias("dst"))
    return steps.where("dst is not null and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def folder_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Three rounds of PageRank over folders served one after the other."""
    edges = checkpointed(_folder_graph(spark, folder))
    nodes = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct().withColumn("preference", F.lit(1.0))
    return graph.pagerank(edges, nodes, iterations=3).select("id", F.round("rank", 12).alias("rank"))


def defined_and_used(spark: SparkSession, folder: str) -> DataFrame:
    """Search tokens with the file that defines them last and how many others refer to them."""
    h = table(spark, folder, "hop1_context").where("file_path is not null and search_token is not null")
    defs = h.where("relation = 'definition'").select(F.col("file_path").alias("path"), F.col("search_token").alias("name"), F.col("hop_id").alias("position"))
    refs = h.where("relation = 'reference'").select(F.col("file_path").alias("path"), F.col("search_token").alias("name"))
    return graph.definition_references(defs, refs)


def file_imports(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "hop1_context").where("file_path is not null and search_token is not null")
    defs = h.where("relation = 'definition'").select(F.col("file_path").alias("path"), F.col("search_token").alias("name"))
    refs = h.where("relation = 'reference'").select(F.col("file_path").alias("path"), F.col("search_token").alias("name"))
    return graph.imports(defs, refs)


QUERIES = {
    f.__name__: f
    for f in (tree_counts, tree_top, module_map, folder_digests, folder_digests_flat, stale_index, root_markers, dominant_root, cluster_root, surface_coverage, basename_frequency, snapshot_actions, interval_union, interval_complement, interval_overlaps, text_chunks, line_offsets, text_digests, compressed_text, column_letters, code_symbols, symbol_kinds, find_symbols, file_graph, ranked_files, folder_ranks, defined_and_used, file_imports)
}

_PATHS = "p AS (SELECT DISTINCT file_path AS path, string_split(file_path, '/') AS parts FROM served_surfaces WHERE file_path IS NOT NULL)"
_UP = f"{_PATHS}, up AS (SELECT path, parts, unnest(range(1, len(parts))) AS i FROM p), dirs AS (SELECT path, i, array_to_string(parts[1:i], '/') AS dir FROM up)"
_SPANS = r"""spans AS (SELECT file_path, CAST(regexp_extract(r, '^(\d+)(?:[-,](\d+))?$', 1) AS BIGINT) AS "start",
  coalesce(TRY_CAST(nullif(regexp_extract(r, '^(\d+)(?:[-,](\d+))?$', 2), '') AS BIGINT), CAST(regexp_extract(r, '^(\d+)(?:[-,](\d+))?$', 1) AS BIGINT)) AS "end"
  FROM (SELECT file_path, regexp_replace(line_range, '[Ll\s]', '', 'g') AS r FROM {table} WHERE file_path IS NOT NULL) WHERE regexp_matches(r, '^(\d+)(?:[-,](\d+))?$'))"""
_UNION = (
    _SPANS.replace("{table}", "hop1_context")
    + """, reach AS (SELECT *, max("end") OVER (PARTITION BY file_path ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM spans WHERE "start" <= "end"),
islands AS (SELECT *, sum(CASE WHEN r IS NULL OR "start" > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM reach),
merged AS (SELECT file_path, min("start") AS "start", max("end") AS "end" FROM islands GROUP BY file_path, island)"""
)
_DEFREF = """d AS (SELECT file_path AS path, search_token AS name, hop_id FROM hop1_context WHERE relation = 'definition' AND file_path IS NOT NULL AND search_token IS NOT NULL),
r AS (SELECT DISTINCT file_path AS path, search_token AS name FROM hop1_context h WHERE relation = 'reference' AND file_path IS NOT NULL AND search_token IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM d WHERE d.path = h.file_path AND d.name = h.search_token))"""

#: Names declared by file with the order in which they are first seen, and the tokens of files.
_NAMES = rf"""{SYMBOLS}, own AS (SELECT regexp_replace(path, '@\d+$', '') AS path, name, (path, line) AS position FROM sym),
tok AS (SELECT DISTINCT file_path AS path, unnest(regexp_extract_all(code, '[A-Za-z_$][A-Za-z0-9_$]*')) AS name FROM hop1_context WHERE code IS NOT NULL AND file_path IS NOT NULL)"""


def _ranked(rounds: int = 20) -> str:
    """Personalised PageRank over all edges between symbols, a CTE a round; nothing here shares the operator's way of not making the edges."""
    steps = []
    for n in range(1, rounds + 1):
        steps.append(f"r{n} AS MATERIALIZED (SELECT n.id, 0.15 * n.pref + 0.85 * coalesce(sum(sh.w * r.rank), 0) AS rank FROM nodes n LEFT JOIN (sh JOIN r{n - 1} r ON r.id = sh.src) ON sh.dst = n.id GROUP BY n.id, n.pref)")
    return f"""WITH {_NAMES},
def AS (SELECT path, name, count(*) AS times, min(position) AS position FROM own GROUP BY path, name),
kept AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY position, path) AS k FROM def QUALIFY k <= 51),
names AS (SELECT name, min(position) AS seen, count(*) AS n FROM kept GROUP BY name),
hits AS (SELECT tok.path, tok.name, seen, coalesce(sum(n - 1) OVER (PARTITION BY tok.path ORDER BY seen, tok.name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tok JOIN names USING (name)),
tg AS (SELECT h.path AS src_path, k.path AS dst_path, name, times, row_number() OVER (PARTITION BY h.path ORDER BY seen, name, k) AS r FROM hits h JOIN kept k USING (name) WHERE h.before < 50 AND h.path <> k.path QUALIFY r <= 50),
recent AS (SELECT file_path AS path FROM hop1_context WHERE file_path IS NOT NULL GROUP BY 1 ORDER BY max(served_at) DESC, path LIMIT 50),
nodes AS (SELECT path || ':' || name AS id, path, name, CASE WHEN path IN (SELECT path FROM recent) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS pref FROM def),
ed AS (SELECT n.id AS src, t.dst_path || ':' || t.name AS dst, CAST(t.times AS DOUBLE) AS w FROM nodes n JOIN tg t ON t.src_path = n.path WHERE t.name <> n.name),
sh AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM ed),
r0 AS (SELECT id, pref AS rank FROM nodes),
{", ".join(steps)},
best AS (SELECT n.path, max(r.rank) AS rank FROM r{rounds} r JOIN nodes n USING (id) GROUP BY n.path),
files AS (SELECT f.path, coalesce(best.rank, 1.0) AS rank FROM (SELECT DISTINCT file_path AS path FROM hop1_context WHERE file_path IS NOT NULL) f LEFT JOIN best USING (path)),
sc AS (SELECT path, round(CASE WHEN max(rank) OVER () = min(rank) OVER () THEN 1.0 ELSE (rank - min(rank) OVER ()) / (max(rank) OVER () - min(rank) OVER ()) END, 9) AS score FROM files)
SELECT path, score, row_number() OVER (ORDER BY score DESC, path) AS place FROM sc ORDER BY score DESC, path LIMIT 40"""


def _digests(deepest: int = 16) -> str:
    """Folders from the deepest level up, a CTE a level; their lines sorted by name."""
    levels = []
    for d in range(deepest, 0, -1):
        here = f"SELECT dir, name, hash FROM f WHERE depth = {d}"
        if d < deepest:
            here += f" UNION ALL SELECT CASE WHEN contains(dir, '/') THEN regexp_replace(dir, '/[^/]*$', '') ELSE '.' END, regexp_extract(dir, '[^/]*$'), digest FROM d{d + 1}"
        levels.append(f"d{d} AS MATERIALIZED (SELECT dir, sha256(string_agg(name || chr(9) || hash || chr(10), '' ORDER BY name, hash)) AS digest, count(*) AS entries FROM ({here}) GROUP BY dir)")
    union = " UNION ALL ".join(f"SELECT * FROM d{d}" for d in range(1, deepest + 1))
    return f"""WITH v AS (SELECT file_path AS path, min(sha256(code)) AS hash FROM verification_surfaces WHERE code IS NOT NULL AND file_path IS NOT NULL GROUP BY 1),
f AS (SELECT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir, regexp_extract(path, '[^/]*$') AS name, hash, len(string_split(path, '/')) AS depth FROM v), {", ".join(levels)} {union}"""


SQL = {
    "folder_digests": _digests(),
    "stale_index": "SELECT 'none' AS change, false AS stale UNION ALL SELECT 'core', EXISTS (SELECT 1 FROM verification_surfaces WHERE code IS NOT NULL AND starts_with(file_path, 'core/'))",
    "code_symbols": f"WITH {SYMBOLS} SELECT path, name, kind, line, end_line, signature, enclosing, position, greatest(1, (end_line - line + 1) * 8) AS body_tokens FROM sym",
    "symbol_kinds": rf"""WITH {SYMBOLS}, w AS (SELECT kind, name, CASE WHEN regexp_matches(signature, '(^|[^\w$])type\s+\w+\s*(struct|interface)\b') THEN 'class' WHEN regexp_matches(signature, '^(export\s+)?(pub\s+)?type\s') THEN 'type'
  WHEN regexp_matches(signature, '^(export\s+|private\s+|internal\s+|pub\s+)*(const|let|var|val)\s') AND NOT regexp_matches(signature, '=>|\bfunction\b') THEN 'const'
  WHEN regexp_matches(signature, '^[^(=]*\b(class|struct|interface|enum|trait|record|object|module|union|namespace)\s') AND kind NOT IN ('function', 'method') THEN 'class' ELSE 'function' END AS said FROM sym)
SELECT kind, said, count(*) AS n, count(DISTINCT name) AS names FROM w GROUP BY kind, said""",
    "find_symbols": f"""WITH {SYMBOLS}, c AS (SELECT path, count(*) / max(count(*)) OVER () AS file FROM sym GROUP BY path),
p AS (SELECT path, line, name, {parts("name")} AS np, list_concat(list_filter(string_split_regex(lower(path), '[/._]'), lambda x: x <> ''), {parts("regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', '')")}) AS pp, file FROM sym JOIN c USING (path)),
x AS (SELECT path, line, name, (CAST(list_contains(np, 'seal') AS INT) + CAST(list_contains(np, 'manifest') AS INT)) / 2 AS a, (CAST(list_contains(pp, 'seal') AS INT) + CAST(list_contains(pp, 'manifest') AS INT)) / 2 AS b, file FROM p),
s AS (SELECT path, line, name, round(2.0 * a + 1.5 * b + 0.5 * file - CAST({IS_TEST.format(path="path")} AS INT) - 2 * CAST({IS_NOISE.format(path="path")} AS INT), 6) AS score FROM x WHERE a > 0 OR b > 0),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, line, name DESC) = 1)
SELECT *, (SELECT count(*) FROM best) AS total FROM best ORDER BY score DESC, path, line, name LIMIT 20""",
    "file_graph": f"""WITH {_NAMES}, d AS (SELECT DISTINCT path, name FROM own)
SELECT t.path AS src, d.path AS dst, CAST(count(*) AS DOUBLE) AS weight FROM tok t JOIN d USING (name) WHERE t.path <> d.path GROUP BY 1, 2""",
    "ranked_files": _ranked(),
    "tree_counts": f"WITH {_UP} SELECT dir, i AS depth, count(*) AS files FROM dirs GROUP BY dir, i",
    "tree_top": f"WITH {_UP} SELECT dir, count(*) AS files FROM dirs WHERE i <= 2 GROUP BY dir",
    "module_map": f"""WITH {_PATHS}, up AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM p),
c AS (SELECT DISTINCT CASE WHEN i = 1 THEN '.' ELSE array_to_string(parts[1:i - 1], '/') END AS dir, parts[i] AS child FROM up)
SELECT dir, child, count(*) OVER (PARTITION BY dir) AS children FROM c""",
    "folder_digests_flat": r"""SELECT source AS dir, sha256(string_agg(CAST(doc_id AS VARCHAR) || chr(9) || sha256(text) || chr(10), '' ORDER BY CAST(doc_id AS VARCHAR))) AS digest, count(*) AS entries
FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY source""",
    "root_markers": f"""WITH {_UP}, m AS (SELECT path, dir FROM dirs WHERE regexp_matches(dir, '/(src|lib|internal|index)$'))
SELECT p.path, arg_max(m.dir, length(m.dir)) AS root FROM p LEFT JOIN m USING (path) GROUP BY p.path""",
    "dominant_root": """SELECT string_split(file_path, '/')[1] AS top, CAST(count(*) AS DOUBLE) AS weight FROM served_surfaces WHERE file_path IS NOT NULL GROUP BY 1 ORDER BY weight DESC, top LIMIT 1""",
    "cluster_root": """WITH best AS (SELECT file_path AS path, max(score) AS score FROM query_evidence WHERE file_path IS NOT NULL AND score IS NOT NULL GROUP BY 1 ORDER BY score DESC, path LIMIT 8),
up AS (SELECT score, string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')))) AS i FROM best),
mass AS (SELECT array_to_string(parts[1:i], '/') AS dir, i AS depth, sum(score) / (SELECT sum(score) FROM best) AS m FROM up GROUP BY 1, 2)
SELECT dir, depth, round(m, 6) AS mass FROM mass WHERE m >= 0.1 AND depth >= 1 ORDER BY depth DESC, m DESC, dir LIMIT 1""",
    "surface_coverage": """SELECT label, label IN (SELECT surface_role FROM served_surfaces WHERE surface_role IS NOT NULL) AS covered FROM (SELECT unnest(['api', 'ui', 'data', 'test', 'style', 'domain']) AS label)""",
    "basename_frequency": rf"""WITH {_PATHS}, s AS (SELECT path, regexp_replace(parts[len(parts)], '\.[^.]*$', '') AS stem FROM p),
t AS (SELECT DISTINCT path, unnest(list_append(list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(stem, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\-\s.]+'), lambda x: x <> ''), lambda x: lower(x)), lower(stem))) AS token FROM s)
SELECT token, count(*) AS files FROM t GROUP BY token""",
    "snapshot_actions": r"""
WITH s AS (SELECT file_path AS path, CAST(split_part(fingerprint, ':', 1) AS BIGINT) AS size_bytes, CAST(split_part(fingerprint, ':', 2) AS BIGINT) AS mtime_ms, served_at, surface_id, handle
  FROM served_surfaces WHERE file_path IS NOT NULL AND regexp_matches(fingerprint, '^[0-9]+:[0-9]+$')),
m AS (SELECT (min(served_at) + max(served_at)) / 2 AS middle FROM s),
r AS (SELECT s.*, served_at > middle AS late, row_number() OVER (PARTITION BY path, served_at > middle ORDER BY served_at DESC, surface_id DESC) AS k FROM s, m),
o AS (SELECT path, size_bytes AS z, mtime_ms AS m FROM r WHERE k = 1 AND NOT late), w AS (SELECT path, size_bytes AS z, mtime_ms AS m, handle IS NOT NULL AS valid FROM r WHERE k = 1 AND late)
SELECT coalesce(o.path, w.path) AS path, CASE WHEN o.path IS NULL THEN 'add' WHEN w.path IS NULL THEN 'drop' WHEN valid AND o.z = w.z AND o.m = w.m THEN 'reuse-stat'
  WHEN valid AND o.z = w.z THEN 'reuse-hash' ELSE 'reparse' END AS action FROM o FULL JOIN w ON o.path = w.path""",
    "interval_union": f"""WITH {_UNION} SELECT * FROM merged""",
    "interval_complement": f"""WITH {_UNION}, t AS (SELECT *, max("end") OVER (PARTITION BY file_path) + 10 AS total FROM merged),
gaps AS (SELECT file_path, "end" + 1 AS a, coalesce(lead("start") OVER (PARTITION BY file_path ORDER BY "start"), total + 1) - 1 AS b FROM t
  UNION ALL SELECT file_path, 1, min("start") - 1 FROM t GROUP BY file_path)
SELECT file_path, a AS "start", b AS "end" FROM gaps WHERE a <= b""",
    "interval_overlaps": f"""WITH {_SPANS.replace("{table}", "hop1_context")}, u AS (SELECT DISTINCT * FROM spans WHERE "start" <= "end")
SELECT a.file_path, a."start", a."end", count(*) AS overlapping FROM u a JOIN u b ON a.file_path = b.file_path AND a."start" <= b."end" AND a."end" >= b."start" GROUP BY ALL""",
    "text_chunks": r"""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS path, CAST(strlen(text) AS BIGINT) AS n FROM documents WHERE strlen(text) > 0),
c AS (SELECT path, n, unnest(range(0, n, 1600)) AS byte_start FROM d), b AS (SELECT path, byte_start, least(byte_start + 1600, n) AS byte_end FROM c)
SELECT path, CAST(byte_start / 1600 AS BIGINT) + 1 AS chunk_no, byte_start, byte_end, greatest(1, CAST(ceil((byte_end - byte_start) / 4.0) AS BIGINT)) AS tokens,
  sha256(path || chr(0) || byte_start || chr(0) || byte_end || chr(0) || 'text') AS chunk_id FROM b""",
    "line_offsets": r"""
WITH s AS (SELECT CAST(evidence_id AS VARCHAR) AS path, string_split_regex(content_text, '\r?\n') AS parts FROM query_evidence WHERE content_text IS NOT NULL),
l AS (SELECT path, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS text FROM s)
SELECT path, line, CAST(coalesce(sum(strlen(text) + 1) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start FROM l""",
    "text_digests": "SELECT doc_id, sha256(text) AS sha256, substr(sha256(text), 1, 12) AS short_id, substr(sha256('salt' || chr(0) || 'doc' || chr(0) || CAST(doc_id AS VARCHAR)), 1, 24) AS opaque_id FROM documents",
    "compressed_text": r"""SELECT page_id, sha256(t) AS compressed_sha, length(t) AS n_chars FROM (SELECT page_id,
  regexp_replace(regexp_replace(regexp_replace(page_text, '\r\n?', chr(10), 'g'), '[ \t]+(\n|\z)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM pdf_pages WHERE page_text IS NOT NULL)""",
    "column_letters": """WITH c AS (SELECT file_id, unnest(column_names) AS column_name, unnest(range(1, len(column_names) + 1)) * 37 AS number FROM csv_tables)
SELECT file_id, column_name, number, CASE WHEN number > 26 THEN chr(CAST((number - 1) // 26 AS INTEGER) + 64) ELSE '' END || chr(CAST((number - 1) % 26 AS INTEGER) + 65) AS letters, number AS back FROM c""",
    "folder_ranks": """
WITH s AS (SELECT DISTINCT ON (surface_id) surface_id, pack_id, served_at, array_to_string(string_split(file_path, '/')[1:2], '/') AS f FROM served_surfaces WHERE file_path IS NOT NULL),
st AS (SELECT f AS src, lead(f) OVER (PARTITION BY pack_id ORDER BY served_at, surface_id) AS dst FROM s),
e AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM st WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL),
sh AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS x FROM e),
n AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
r1 AS (SELECT n.id, 0.15 + 0.85 * coalesce(sum(x), 0) AS r FROM n LEFT JOIN sh ON sh.dst = n.id GROUP BY n.id),
r2 AS (SELECT n.id, 0.15 + 0.85 * coalesce(sum(x * r), 0) AS r FROM n LEFT JOIN (sh JOIN r1 ON r1.id = sh.src) ON sh.dst = n.id GROUP BY n.id),
r3 AS (SELECT n.id, 0.15 + 0.85 * coalesce(sum(x * r), 0) AS r FROM n LEFT JOIN (sh JOIN r2 ON r2.id = sh.src) ON sh.dst = n.id GROUP BY n.id)
SELECT id, round(r, 12) AS rank FROM r3""",
    "defined_and_used": f"""WITH {_DEFREF}, l AS (SELECT name, arg_max(path, hop_id) AS definition FROM d GROUP BY name)
SELECT l.name, l.definition, r.path AS reference_file, count(*) OVER (PARTITION BY l.name) AS n_files FROM l JOIN r USING (name)""",
    "file_imports": f"WITH {_DEFREF} SELECT DISTINCT r.path, d.path AS imported FROM r JOIN d USING (name) WHERE r.path <> d.path",
}

