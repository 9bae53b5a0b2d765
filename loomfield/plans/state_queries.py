"""Queries of keyed state, of what belongs to files, and of functions that no other query shows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.functions import paths
from loomfield.functions import text as tx
from loomfield.operators import graph, intervals, rejects, retrieval, search, trees
from loomfield.plans.data_quality import _P3_CELLS
from loomfield.session import rows_of, spread, table
from loomfield.streaming import runner, sessions


def repeated_reads(spark: SparkSession, folder: str) -> DataFrame:
    """Ranges of files that a workspace was given more than once."""
    h = intervals.parsed(table(spark, folder, "hop1_context").where("workspace_id is not null and file_path is not null"), "line_range").where("start <= end")
    return sessions.repeat_counts(h).where("reads > 1")


def governed_reads_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Which windows a limit on full reads of a workspace would let through, definitions asked for explicitly."""
    s = runner.table_stream(spark, folder, "hop1_context").where("workspace_id is not null and file_path is not null")
    requests = s.select("workspace_id", F.col("hop_id").alias("seq"), "file_path", F.lit("v1").alias("fingerprint"), F.coalesce(F.col("relation") == "definition", F.lit(False)).alias("explicit"), F.lit(0).alias("repeats"))
    return runner.drained(sessions.read_governor(requests)).select("workspace_id", "seq", "allowed", "reason")


def handles_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Short ids of the places that a workspace was given."""
    s = runner.table_stream(spark, folder, "query_evidence").where("workspace_id is not null and file_path is not null")
    return runner.drained(sessions.handles(s.select("workspace_id", F.col("evidence_id").alias("seq"), F.col("file_path").alias("place"))))


def contained_rectangles(spark: SparkSession, folder: str) -> DataFrame:
    """Parts whose rectangle, made of size and price, lies in that of a part of its brand of size 25 or more."""
    p = table(spark, folder, "part").select("p_partkey", "p_brand", F.lit(1).alias("top"), F.lit(1).alias("left"), F.col("p_size").alias("bottom"), F.floor("p_retailprice").cast("bigint").alias("right"))
    served = p.where("bottom >= 25").drop("p_partkey")
    return sessions.rectangles_contained(p, served, ["p_brand"]).select("p_partkey")


def verification_surfaces(spark: SparkSession, folder: str) -> DataFrame:
    """Tests and mocks of the files that were served."""
    edited = table(spark, folder, "served_surfaces").select(F.col("file_path").alias("path"))
    v = table(spark, folder, "verification_surfaces").where("file_path is not null")
    return retrieval.verification(edited, v.select(F.col("file_path").alias("path"), F.col("surface_role").alias("role"), "refs"))


def resolved_includes(spark: SparkSession, folder: str) -> DataFrame:
    """Includes of every C and C++ file: one of its own name from its folder, one a folder up, and one by the end of its path."""
    c = table(spark, folder, "served_surfaces").select(F.col("file_path").alias("path")).where(paths.extension(F.col("file_path")).isin("c", "cc", "cpp", "h", "hpp")).distinct()
    last_two = F.substring_index("path", "/", -2)
    asked = c.select("path", F.explode(F.array(tx.basename(F.col("path")), F.concat(F.lit("./"), tx.basename(F.col("path"))), F.concat(F.lit("../"), last_two), last_two, F.lit("no/such.h"))).alias("target"))
    return retrieval.includes(asked, c)


def header_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Headers of C and C++ with their sources, where each source has a header beside it."""
    s = table(spark, folder, "served_surfaces").select(F.col("file_path").alias("path")).where(paths.extension(F.col("file_path")).isin("c", "cc", "cpp", "cxx"))
    heads = s.select(F.regexp_replace("path", r"\.[^./]+\z", ".hpp").alias("path"))
    return retrieval.pairs_by_stem(s.union(heads))


def query_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """What the first lines of documents would ask for as queries."""
    d = table(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", F.array_join(retrieval.query_shapes(F.regexp_extract("text", r"^[^\n]*", 0)), ",").alias("shapes"))


PATTERNS = [(r"def \w+\(", True), ("(a+)+", False), ("(a|b)*c", False), (r"(?=x)y", False), (r"(x)\1", False), ("a{2}b", True), ("[(]a+", True), ("(ab)+", True), ("(a", False), ("a)", False), ("x" * 257, False), ("a*" * 17, False), ("(?:a{2,3})+", False), (r"\bfoo\b", True)]


def safe_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Which patterns of a list are let through."""
    return rows_of(spark, [(n, search.safe_pattern(p)) for n, (p, _) in enumerate(PATTERNS)], "n int, safe boolean")


def spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Spellings of every search token, sorted."""
    t = table(spark, folder, "hop1_context").select("search_token").where("search_token is not null").distinct()

    def run(batches):
        for b in batches:
            yield b.assign(spellings=[" ".join(sorted(retrieval.variants(x))) for x in b["search_token"]])

    return spread(t).mapInPandas(run, "search_token string, spellings string")


def nearest_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The kind of event that a mistyped one means: letters swapped, lost, doubled, or too many of them."""
    e = table(spark, folder, "events").select("event_type").distinct().where("length(event_type) > 3")
    typed = {"swapped": lambda t: t[1] + t[0] + t[2:], "lost": lambda t: t[:-1], "doubled": lambda t: t + t[-1], "far": lambda t: t + "xyz"}

    def run(batches):
        for b in batches:
            rows = [(t, k, retrieval.nearest_key(f(t), ["click", "purchase", "signup", "view", "error", "login", "logout"])) for t in b["event_type"] for k, f in typed.items()]
            yield pd.DataFrame(rows, columns=["event_type", "typed", "meant"])

    return e.mapInPandas(run, "event_type string, typed string, meant string")


def first_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """One piece of evidence a file: tests first, then keys, then text, and the lowest id."""
    e = table(spark, folder, "query_evidence").where("file_path is not null")
    rank = F.when(F.col("evidence_kind") == "test-block", 0).when(F.col("evidence_kind") == "json-key", 1).otherwise(2)
    return trees.first_by_priority(e.select("file_path", "evidence_id", "evidence_kind", F.struct(rank, "evidence_id").alias("p")), ["file_path"], "p").drop("p")


def reused_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of files whose first and last fingerprints are the same kept, those of others made anew."""
    s = table(spark, folder, "served_surfaces").where("file_path is not null and fingerprint <> ''")
    by = s.groupBy(F.col("file_path").alias("path")).agg(F.min_by("fingerprint", F.struct("served_at", "surface_id")).alias("a"), F.max_by("fingerprint", F.struct("served_at", "surface_id")).alias("b"))
    edges = lambda made: by.select(F.col("path").alias("src_path"), tx.parent(F.col("path")).alias("dst"), F.lit(made).alias("made"))
    return graph.reused_edges(edges("before"), edges("now"), by.select("path", F.col("a").alias("mtime_ms")), by.select("path", F.col("b").alias("mtime_ms")))


def fitted_tables(spark: SparkSession, folder: str) -> DataFrame:
    """At which step of making it smaller each delimited file fits 1,024 bytes."""
    cells = rejects.typed_cells(table(spark, folder, "csv_rows"), table(spark, folder, "csv_tables"))
    return retrieval.fitted_tables(cells.select("file_id", "row_no", "column_no", F.coalesce(F.trim("text_value"), F.lit("")).alias("value")), "file_id", 1024)


def clamped_values(spark: SparkSession, folder: str) -> DataFrame:
    """Values of events within limits, and as counts."""
    e = table(spark, folder, "events")
    v = F.col("value") - 20
    return e.select("event_id", tx.clamped(v, 5.0, 60.0, 1).alias("limited"), tx.nonnegative_integer(v).alias("counted"))


def middle_lines(spark: SparkSession, folder: str) -> DataFrame:
    """On which line the middle of each document stands."""
    d = table(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", tx.line_of_offset(F.col("text"), F.floor(F.length("text") / 2)).cast("bigint").alias("line"))


QUERIES = {f.__name__: f for f in (repeated_reads, governed_reads_stream, handles_stream, contained_rectangles, verification_surfaces, resolved_includes, header_pairs, query_shapes, safe_patterns, spelling_variants, nearest_keys, first_evidence, reused_edges, fitted_tables, clamped_values, middle_lines)}

_RANGE = r"r AS (SELECT workspace_id, file_path, CAST(regexp_extract(line_range, '^(\d+)-(\d+)$', 1) AS BIGINT) AS a, CAST(regexp_extract(line_range, '^(\d+)-(\d+)$', 2) AS BIGINT) AS b FROM hop1_context WHERE workspace_id IS NOT NULL AND file_path IS NOT NULL AND regexp_matches(line_range, '^\d+-\d+$'))"
_STEM = r"regexp_replace(lower(regexp_extract(regexp_extract({p}, '[^/]*$'), '^[^.]*')), '^(test|mock)_|_(test|spec|mock)$|(test|spec|mock)$', '')"
_CASES = {"swapped": "substr(e, 2, 1) || left(e, 1) || substr(e, 3)", "lost": "left(e, length(e) - 1)", "doubled": "e || right(e, 1)"}
_LADDER = ((24, 12, 160), (12, 8, 80), (8, 4, 64), (4, 2, 32))
SQL = {
    "repeated_reads": f"""WITH {_RANGE} SELECT workspace_id, file_path, a AS "start", b AS "end", count(*) AS reads FROM r WHERE a <= b GROUP BY ALL HAVING count(*) > 1""",
    "governed_reads_stream": """WITH RECURSIVE q AS MATERIALIZED (SELECT workspace_id, hop_id, file_path, coalesce(relation = 'definition', false) AS explicit, row_number() OVER (PARTITION BY workspace_id ORDER BY hop_id) AS n FROM hop1_context WHERE workspace_id IS NOT NULL AND file_path IS NOT NULL),
e AS (SELECT workspace_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST([] AS VARCHAR[]) AS got, true AS allowed, '' AS reason FROM (SELECT DISTINCT workspace_id FROM q) UNION ALL
  SELECT q.workspace_id, q.n, q.hop_id, CASE WHEN NOT list_contains(got, q.file_path) AND len(got) < CASE WHEN explicit THEN 12 ELSE 6 END THEN list_append(got, q.file_path) ELSE got END,
    NOT list_contains(got, q.file_path) AND len(got) < CASE WHEN explicit THEN 12 ELSE 6 END, CASE WHEN list_contains(got, q.file_path) THEN 'already-read' WHEN len(got) >= CASE WHEN explicit THEN 12 ELSE 6 END THEN 'task-limit' ELSE '' END
  FROM e JOIN q ON q.workspace_id = e.workspace_id AND q.n = e.n + 1)
SELECT workspace_id, seq, allowed, reason FROM e WHERE n > 0""",
    "handles_stream": """WITH s AS (SELECT workspace_id, evidence_id AS seq, file_path AS place, min(evidence_id) OVER (PARTITION BY workspace_id, file_path) AS f FROM query_evidence WHERE workspace_id IS NOT NULL AND file_path IS NOT NULL)
SELECT workspace_id, seq, place, left(sha256(workspace_id || chr(0) || place || chr(0) || f), 11) AS handle, seq = f AS is_new, 0 AS evicted FROM s""",
    "contained_rectangles": "SELECT p_partkey FROM part a WHERE EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_size >= 25 AND b.p_size >= a.p_size AND floor(b.p_retailprice) >= floor(a.p_retailprice))",
    "verification_surfaces": f"""WITH e AS (SELECT DISTINCT file_path AS path FROM served_surfaces WHERE file_path IS NOT NULL), v AS (SELECT file_path AS surface, surface_role AS role, refs FROM verification_surfaces WHERE file_path IS NOT NULL),
r AS (SELECT surface, role, unnest(refs) AS ref FROM v), a AS (SELECT e.path, surface, role, 'reference' AS why FROM r JOIN e ON e.path = ref OR ends_with(e.path, '/' || ref)
  UNION ALL SELECT e.path, surface, role, 'stem' FROM v JOIN e ON {_STEM.format(p="surface")} = {_STEM.format(p="e.path")} AND {_STEM.format(p="surface")} <> '' AND array_to_string(string_split(surface, '/')[1:2], '/') = array_to_string(string_split(e.path, '/')[1:2], '/'))
SELECT path, surface, min(role) AS role, min(why) AS why FROM a WHERE path <> surface GROUP BY path, surface""",
    "resolved_includes": """WITH c AS (SELECT DISTINCT file_path AS path, regexp_extract(file_path, '[^/]*$') AS name, regexp_extract(file_path, '[^/]*/[^/]*$') AS two FROM served_surfaces WHERE regexp_matches(lower(file_path), '[^/][.](c|cc|cpp|h|hpp)$')),
t AS (SELECT path, unnest([name, './' || name, '../' || two]) AS target, path AS resolved FROM c UNION ALL SELECT path, two, CASE WHEN (SELECT count(*) FROM c d WHERE d.two = c.two) = 1 THEN path END FROM c UNION ALL SELECT path, 'no/such.h', NULL FROM c) SELECT path, target, resolved FROM t""",
    "header_pairs": """SELECT DISTINCT regexp_replace(file_path, '[.][^./]+$', '.hpp') AS header, file_path AS source FROM served_surfaces WHERE regexp_matches(lower(file_path), '[^/][.](c|cc|cpp|cxx)$')""",
    "query_shapes": r"""WITH q AS (SELECT doc_id, regexp_extract(text, '^[^\n]*') AS q FROM documents WHERE text IS NOT NULL)
SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(q, '(?i)\b(enum|variant|union|kind|mode|status|state)s?\b') OR regexp_matches(q, '[A-Z]\w*(Enum|Kind|Mode|Status|State)\b') THEN 'enum' END, CASE WHEN regexp_matches(q, '[\w.-]+/[\w./-]+|\b[\w-]+\.([a-z]{1,4}|proto)\b') THEN 'path' END,
  CASE WHEN regexp_matches(q, '[a-z][A-Z]|\w_\w|::|\w\(|->') THEN 'code' END, CASE WHEN regexp_matches(q, '(?i)^(how|what|where|when|which|who|why|does|is|are|can)\b|\?\s*$') THEN 'question' END,
  CASE WHEN regexp_matches(q, '(?i)\b(add|change|fix|remove|rename|replace|update|refactor|implement)\b') THEN 'change' END) AS shapes FROM q""",
    "safe_patterns": "SELECT * FROM (VALUES " + ", ".join(f"({n}, {str(ok).lower()})" for n, (_, ok) in enumerate(PATTERNS)) + ") v(n, safe)",
    "spelling_variants": r"""WITH t AS (SELECT DISTINCT search_token AS t FROM hop1_context WHERE search_token IS NOT NULL), p AS (SELECT t, list_filter(string_split_regex(regexp_replace(t, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\-\s]+'), lambda x: x <> '') AS p FROM t),
v AS (SELECT t, lower(array_to_string(p, '-')) AS k, lower(array_to_string(p, '_')) AS s FROM p) SELECT t AS search_token, array_to_string(list_sort(list_distinct([t, lower(t), upper(left(t, 1)) || substr(t, 2), k, s, '-' || k, '--' || k])), ' ') AS spellings FROM v""",
    "nearest_keys": "WITH t AS (SELECT DISTINCT event_type AS e FROM events WHERE length(event_type) > 3), k AS (SELECT unnest(['click', 'purchase', 'signup', 'view', 'error', 'login', 'logout']) AS k), c AS (" + " UNION ALL ".join(f"SELECT e, '{n}' AS typed, {x} AS w FROM t" for n, x in {**_CASES, "far": "e || 'xyz'"}.items())
    + "), d AS (SELECT e, typed, k, damerau_levenshtein(w, k) AS d FROM c, k) SELECT e AS event_type, typed, CASE WHEN min(d) <= 2 THEN arg_min(k, d) END AS meant FROM d GROUP BY e, typed",
    "first_evidence": """SELECT file_path, evidence_id, evidence_kind FROM query_evidence WHERE file_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY CASE evidence_kind WHEN 'test-block' THEN 0 WHEN 'json-key' THEN 1 ELSE 2 END, evidence_id) = 1""",
    "reused_edges": """WITH f AS (SELECT file_path AS p, arg_min(fingerprint, (served_at, surface_id)) AS a, arg_max(fingerprint, (served_at, surface_id)) AS b FROM served_surfaces WHERE file_path IS NOT NULL AND fingerprint <> '' GROUP BY 1)
SELECT p AS src_path, CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '.' END AS dst, CASE WHEN a = b THEN 'before' ELSE 'now' END AS made FROM f""",
    "fitted_tables": _P3_CELLS[: _P3_CELLS.index("SELECT row_id, file_id, row_no, column_no")] + "SELECT file_id, CASE " + " ".join(f"WHEN b{k} <= 1024 THEN {k + 1}" for k in range(4)) + " END AS step, CASE " + " ".join(f"WHEN b{k} <= 1024 THEN CAST(b{k} AS BIGINT)" for k in range(4)) + " END AS bytes FROM (SELECT file_id, "
    + ", ".join(f"sum(CASE WHEN column_no <= {c} AND row_no <= {r} THEN strlen(left(coalesce(v, ''), {n})) + 3 ELSE 0 END) AS b{k}" for k, (c, r, n) in enumerate(_LADDER)) + " FROM each GROUP BY file_id)",
    "clamped_values": "SELECT event_id, CASE WHEN value IS NULL OR isnan(value) OR value - 20 < 1 THEN 5.0 ELSE least(value - 20, 60.0) END AS limited, CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 0 ELSE greatest(0, CAST(floor(value - 20 + 0.5) AS BIGINT)) END AS counted FROM events",
    "middle_lines": "SELECT doc_id, 1 + length(left(text, length(text) // 2)) - length(replace(left(text, length(text) // 2), chr(10), '')) AS line FROM documents WHERE text IS NOT NULL",
}
