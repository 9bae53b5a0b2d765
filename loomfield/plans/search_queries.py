"""Queries of search over the windows of hop1_context, each window taken as a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.functions import paths
from loomfield.functions import text as tx
from loomfield.operators import search
from loomfield.session import table


def windows(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content): hop1_context as files; a window's path ends in its id."""
    return table(spark, folder, "hop1_context").where("code is not null").select(F.concat("file_path", F.lit("@"), "hop_id").alias("path"), F.col("code").alias("content"))


def code_lines(spark: SparkSession, folder: str) -> DataFrame:
    return search.line_table(windows(spark, folder))


LINES = r"""
files AS (SELECT file_path || '@' || hop_id AS path, code AS content FROM hop1_context WHERE code IS NOT NULL),
split AS (SELECT path, string_split_regex(content, '\r?\n') AS parts FROM files),
code_lines AS (SELECT path, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS text FROM split)
"""


def line_stats(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.select("doc_id", tx.line_count(F.col("text")).alias("n_lines"), F.size(tx.lines(F.col("text"))).alias("n_split"), F.octet_length("text").alias("n_bytes"))


def token_estimates(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.select("doc_id", tx.tokens_by_bytes(F.col("text")).alias("by_bytes"), tx.tokens_by_words(F.col("text")).alias("by_words"))


def identifier_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each identifier occurs in each file."""
    found = table(spark, folder, "hop1_context").select("file_path", F.explode(F.regexp_extract_all("code", F.lit(f"({tx.IDENTIFIER})"), F.lit(1))).alias("token"))
    return found.groupBy("file_path", "token").agg(F.count("*").alias("n"))


def identifier_sets(spark: SparkSession, folder: str) -> DataFrame:
    """The first 32 distinct identifiers of each window, sorted."""
    return table(spark, folder, "hop1_context").where("code is not null").select("hop_id", F.array_join(tx.identifiers(F.col("code")), " ").alias("identifiers"))


def identifier_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of the search tokens."""
    return table(spark, folder, "hop1_context").where("search_token is not null").select("hop_id", F.array_join(tx.identifier_parts(F.col("search_token")), " ").alias("parts"))


def find_literal(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with a literal, and where."""
    hits = search.matching(code_lines(spark, folder), "token", ignore_case=False)
    return hits.select("path", "line", "start", F.col("text").alias("line_text"))


def find_pattern(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that match a pattern, any case."""
    hits = search.matching(code_lines(spark, folder), r"def \w+lock", regex=True, ignore_case=True)
    return hits.select("path", "line", "start")


def find_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The matching lines of each file together."""
    return search.grouped(search.matching(code_lines(spark, folder), "lease")).select("path", "line", "n")


def find_snippets(spark: SparkSession, folder: str) -> DataFrame:
    """The match on each line with what stands around it."""
    hits = search.matching(code_lines(spark, folder), "manifest")
    return hits.select("path", "line", tx.snippet(F.col("text"), F.col("start")).alias("snippet"))


def find_inventory(spark: SparkSession, folder: str) -> DataFrame:
    return search.inventory(search.matching(code_lines(spark, folder), "digest"))


def find_folders(spark: SparkSession, folder: str) -> DataFrame:
    return search.by_folder(find_inventory(spark, folder))


def find_all_or_any(spark: SparkSession, folder: str) -> DataFrame:
    return search.all_or_any(code_lines(spark, folder), ["lease", "router", "digest"])


def find_union(spark: SparkSession, folder: str) -> DataFrame:
    return search.union_of(code_lines(spark, folder), ["seal", "Replica", "budget_"]).select("path", "line", "start")


def find_absence(spark: SparkSession, folder: str) -> DataFrame:
    return search.absence(windows(spark, folder), code_lines(spark, folder), ["lease", "zeppelin", "quokka", "router"])


def symbol_references(spark: SparkSession, folder: str) -> DataFrame:
    """Whole-word references outside of strings, comments marked."""
    return search.references(code_lines(spark, folder), "token", F.coalesce(paths.language(F.regexp_replace("path", r"@\d+$", "")), F.lit(""))).select("path", "line", "in_comment")


def references_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page of 200 references after a cursor."""
    return search.page(search.matching(code_lines(spark, folder), "token", ignore_case=False).select("path", "line"), search.cursor("core", 1), 200)


def references_within_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """As many references as fit 4,096 bytes."""
    hits = search.matching(code_lines(spark, folder), "receipt", ignore_case=False).select("path", "line")
    return search.within_bytes(hits, ["path", "line"], 4096, ["path", "line"])


def hit_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return search.line_ranges(search.matching(code_lines(spark, folder), "const", ignore_case=False), 5).select("path", "start", "end", "label")


def hit_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return search.densest(search.matching(code_lines(spark, folder), "return", ignore_case=False))


def comment_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Comment lines by language."""
    w = table(spark, folder, "hop1_context").where("code is not null")
    named = w.select("hop_id", F.coalesce(paths.language(F.col("file_path")), F.lit("none")).alias("language"), F.explode(tx.lines(F.col("code"))).alias("text"))
    comment = paths.looks_like_comment(F.col("text"), F.col("language"))
    return named.groupBy("language").agg(F.count("*").alias("n_lines"), F.sum(comment.cast("bigint")).alias("n_comments"))


def path_classes(spark: SparkSession, folder: str) -> DataFrame:
    """What the paths of served files tell."""
    p = table(spark, folder, "served_surfaces").select("file_path").distinct()
    c = F.col("file_path")
    return p.select("file_path", F.coalesce(paths.language(c), F.lit("none")).alias("language"), paths.is_test(c).alias("is_test"), paths.is_noise(c).alias("is_noise"), paths.is_build_output(c).alias("is_build_output"), paths.is_markdown(c).alias("is_markdown"), paths.under(c, "core").alias("in_core"))


def surface_classes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "served_surfaces").select("file_path").distinct().select("file_path", paths.surface(F.col("file_path")).alias("surface"))


def evidence_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The best window of each file for a few weighted terms, and its lead."""
    return search.evidence_windows(code_lines(spark, folder), {"lease": 2.0, "router": 2.0, "sealManifest": 4.0, "digest": 2.0})


def round_robin(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all matching files by turns within 6,144 bytes."""
    hits = search.matching(code_lines(spark, folder), "snapshot", ignore_case=False)
    return search.fit_round_robin(hits.select("path", "line", (F.octet_length("text") + F.octet_length("path") + 8).alias("bytes")), 6144)


def did_you_mean(spark: SparkSession, folder: str) -> DataFrame:
    return search.did_you_mean(table(spark, folder, "served_surfaces").select(F.col("file_path").alias("path")), ["lease", "router", "digest"], 10)


QUERIES = {
    f.__name__: f
    for f in (line_stats, token_estimates, identifier_counts, identifier_sets, identifier_parts, find_literal, find_pattern, find_groups, find_snippets, find_inventory, find_folders, find_all_or_any, find_union, find_absence, symbol_references, references_page, references_within_bytes, hit_ranges, hit_clusters, comment_lines, path_classes, surface_classes, evidence_windows, round_robin, did_you_mean)
}

_IDENT = "[A-Za-z_$][A-Za-z0-9_$]*"
_LANG = "CASE " + " ".join(f"WHEN ext = '{e}' THEN '{n}'" for e, n in paths.LANGUAGES.items()) + " ELSE 'none' END"
_SLASHED = "('typescript','typescriptreact','javascript','javascriptreact','java','kotlin','go','rust','c','cpp','csharp','php')"



def surface_case(column: str) -> str:
    """The kinds of surface as a CASE expression."""
    out = []
    for name, rule in paths.SURFACES:
        test = f"regexp_matches(lower({column}), '{paths.surface_pattern(rule)}')"
        if "not_top" in rule:
            test += f" AND NOT regexp_matches(lower({column}), '^({'|'.join(rule['not_top'])})/')"
        out.append(f"WHEN {test} THEN '{name}'")
    return "CASE " + " ".join(out) + " ELSE 'unknown' END"


SQL = {
    "did_you_mean": """WITH p AS (SELECT DISTINCT file_path AS path, lower(regexp_extract(file_path, '[^/]*$')) AS n FROM served_surfaces WHERE file_path IS NOT NULL),
h AS (SELECT path, CAST(contains(n, 'lease') AS INT) + CAST(contains(n, 'router') AS INT) + CAST(contains(n, 'digest') AS INT) AS hits FROM p) SELECT path, hits FROM h WHERE hits > 0 ORDER BY hits DESC, path, path LIMIT 10""",
    "round_robin": f"""WITH RECURSIVE {LINES}, hits AS (SELECT path, line, strlen(text) + strlen(path) + 8 AS b, row_number() OVER (PARTITION BY path ORDER BY line) AS k FROM code_lines WHERE contains(text, 'snapshot')),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY k, path) AS n FROM hits WHERE k <= 8 ORDER BY k, path LIMIT 6144),
r AS (SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, CAST([] AS VARCHAR[]) AS dropped, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS BIGINT) AS line UNION ALL
  SELECT o.n, CASE WHEN NOT list_contains(dropped, o.path) AND used + b <= 6144 THEN used + b ELSE used END, CASE WHEN k = 1 AND used + b > 6144 THEN list_append(dropped, o.path) ELSE dropped END,
    CASE WHEN NOT list_contains(dropped, o.path) AND used + b <= 6144 THEN o.path END, o.line FROM r JOIN o ON o.n = r.n + 1)
SELECT path, line FROM r WHERE path IS NOT NULL""",
    "line_stats": r"""
SELECT doc_id, CASE WHEN text IS NULL OR body = '' THEN 0 ELSE len(string_split_regex(body, '\r\n|\r|\n')) END AS n_lines,
       len(string_split_regex(text, '\r?\n')) AS n_split, strlen(text) AS n_bytes
FROM (SELECT doc_id, text, regexp_replace(text, '(\r\n|\r|\n)\z', '') AS body FROM documents)""",
    "token_estimates": r"""
SELECT doc_id, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS by_bytes,
       CAST(ceil(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) * 1.33) AS BIGINT) AS by_words
FROM documents""",
    "identifier_counts": rf"""
SELECT file_path, token, count(*) AS n FROM (SELECT file_path, unnest(regexp_extract_all(code, '{_IDENT}')) AS token FROM hop1_context)
GROUP BY file_path, token""",
    "identifier_sets": rf"""
WITH found AS (SELECT hop_id, regexp_extract_all(code, '{_IDENT}') AS all_found FROM hop1_context WHERE code IS NOT NULL),
single AS (SELECT hop_id, unnest(all_found) AS token, unnest(range(1, len(all_found) + 1)) AS pos FROM found),
firsts AS (SELECT hop_id, token, min(pos) AS pos FROM single GROUP BY hop_id, token),
ranked AS (SELECT *, row_number() OVER (PARTITION BY hop_id ORDER BY pos) AS rn FROM firsts)
SELECT f.hop_id, coalesce(string_agg(r.token, ' ' ORDER BY r.token COLLATE "binary"), '') AS identifiers
FROM found f LEFT JOIN ranked r ON r.hop_id = f.hop_id AND r.rn <= 32 GROUP BY f.hop_id""",
    "identifier_parts": r"""
SELECT hop_id, array_to_string(list_transform(list_filter(string_split_regex(
  regexp_replace(regexp_replace(search_token, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\-\s.]+'),
  lambda p: p <> ''), lambda p: lower(p)), ' ') AS parts
FROM hop1_context WHERE search_token IS NOT NULL""",
    "find_literal": f"WITH {LINES} SELECT path, line, strpos(text, 'token') AS start, text AS line_text FROM code_lines WHERE strpos(text, 'token') > 0",
    "find_pattern": rf"""WITH {LINES}
SELECT path, line, strpos(text, regexp_extract(text, '(?i)def \w+lock')) AS start FROM code_lines WHERE regexp_matches(text, '(?i)def \w+lock')""",
    "find_groups": f"""WITH {LINES}
SELECT path, line, count(*) OVER (PARTITION BY path) AS n FROM code_lines WHERE strpos(lower(text), 'lease') > 0""",
    "find_inventory": f"WITH {LINES} SELECT path, count(*) AS matches FROM code_lines WHERE strpos(lower(text), 'digest') > 0 GROUP BY path",
    "find_folders": rf"""WITH {LINES},
counts AS (SELECT path, count(*) AS matches FROM code_lines WHERE strpos(lower(text), 'digest') > 0 GROUP BY path)
SELECT CASE WHEN strpos(path, '/') > 0 THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir, count(*) AS files, CAST(sum(matches) AS BIGINT) AS matches FROM counts GROUP BY 1""",
    "find_all_or_any": f"""WITH {LINES},
by_file AS (SELECT path, max(CAST(strpos(lower(text), 'lease') > 0 AS INT)) a, max(CAST(strpos(lower(text), 'router') > 0 AS INT)) b,
  max(CAST(strpos(lower(text), 'digest') > 0 AS INT)) c, count(*) AS lines_found FROM code_lines
  WHERE strpos(lower(text), 'lease') > 0 OR strpos(lower(text), 'router') > 0 OR strpos(lower(text), 'digest') > 0 GROUP BY path),
o AS (SELECT coalesce(max(a), 0) + coalesce(max(b), 0) + coalesce(max(c), 0) AS n FROM by_file),
s AS (SELECT coalesce(max(CAST(a + b + c = n AS INT)), 0) AS any_full FROM by_file, o)
SELECT path, a + b + c AS terms_found, lines_found, CASE WHEN any_full = 1 THEN 'all' ELSE 'any' END AS mode FROM by_file, o, s WHERE any_full = 0 OR a + b + c = n""",
    "find_union": f"""WITH {LINES}, p AS (SELECT path, line, strpos(text, 'seal') a, strpos(text, 'Replica') b, strpos(text, 'budget_') c FROM code_lines)
SELECT path, line, least(CASE WHEN a > 0 THEN a END, CASE WHEN b > 0 THEN b END, CASE WHEN c > 0 THEN c END) AS start FROM p WHERE a > 0 OR b > 0 OR c > 0""",
    "find_absence": f"""WITH {LINES}, terms AS (SELECT unnest(['lease', 'zeppelin', 'quokka', 'router']) AS term)
SELECT term, (SELECT count(*) FROM files) AS scanned_files FROM terms WHERE NOT EXISTS (SELECT 1 FROM code_lines WHERE strpos(lower(text), term) > 0)""",
    "symbol_references": rf"""WITH {LINES}, named AS (SELECT path, line, text, lower(regexp_extract(regexp_replace(path, '@\d+$', ''), '[^/]\.([A-Za-z0-9]+)$', 1)) AS ext FROM code_lines WHERE contains(text, 'token')),
kinds AS (SELECT *, {_LANG} AS lang, ltrim(text) AS bare FROM named),
flagged AS (SELECT *, (lang IN ('python', 'ruby') AND starts_with(bare, '#')) OR (lang IN {_SLASHED} AND starts_with(bare, '//')) OR regexp_matches(bare, '^(/\*|\*/|\* )') OR bare = '*' AS in_comment FROM kinds)
SELECT path, line, in_comment FROM flagged WHERE CASE WHEN in_comment THEN regexp_matches(text, '\btoken\b')
  ELSE regexp_matches(regexp_replace(text, '"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''', '''''', 'g'), '\btoken\b') END""",
    "references_page": f"""WITH {LINES} SELECT path, line FROM code_lines WHERE strpos(text, 'token') > 0 AND (path, line) > ('core', 1) ORDER BY path, line LIMIT 200""",
    "references_within_bytes": f"""WITH {LINES}, hits AS (SELECT path, line, strlen('{{"path":"' || path || '","line":' || line || '}}') + 1 AS size FROM code_lines WHERE strpos(text, 'receipt') > 0),
summed AS (SELECT path, line, sum(size) OVER (ORDER BY path, line ROWS UNBOUNDED PRECEDING) AS running_bytes FROM hits)
SELECT path, line, CAST(running_bytes AS BIGINT) AS running_bytes FROM summed WHERE running_bytes <= 4096""",
    "hit_ranges": f"""WITH {LINES}, islands AS (SELECT path, line, line - row_number() OVER (PARTITION BY path ORDER BY line) AS island FROM code_lines WHERE strpos(text, 'const') > 0),
runs AS (SELECT path, min(line) AS "start", max(line) AS "end" FROM islands GROUP BY path, island),
numbered AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY "start") AS n FROM runs)
SELECT path, "start", "end", CASE WHEN "start" = "end" THEN 'L' || "start" ELSE 'L' || "start" || '-' || "end" END AS label FROM numbered WHERE n <= 5""",
    "hit_clusters": f"""WITH {LINES}, hits AS (SELECT path, line FROM code_lines WHERE strpos(text, 'return') > 0),
counted AS (SELECT path, line, count(*) OVER w AS n, max(line) OVER w AS last FROM hits WINDOW w AS (PARTITION BY path ORDER BY line RANGE BETWEEN CURRENT ROW AND 40 FOLLOWING)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, line) AS rn FROM counted)
SELECT path, greatest(1, line - 4) AS first_line, last + 4 AS last_line, n AS hits FROM ranked WHERE rn = 1""",
    "comment_lines": rf"""
WITH named AS (SELECT hop_id, lower(regexp_extract(file_path, '[^/]\.([A-Za-z0-9]+)$', 1)) AS ext, unnest(string_split_regex(code, '\r?\n')) AS text FROM hop1_context WHERE code IS NOT NULL),
kinds AS (SELECT {_LANG} AS language, ltrim(text) AS bare FROM named)
SELECT language, count(*) AS n_lines, CAST(sum(CAST((language IN ('python', 'ruby') AND starts_with(bare, '#')) OR (language IN {_SLASHED} AND starts_with(bare, '//')) OR regexp_matches(bare, '^(/\*|\*/|\* )') OR bare = '*' AS BIGINT)) AS BIGINT) AS n_comments
FROM kinds GROUP BY language""",
    "path_classes": rf"""
WITH p AS (SELECT DISTINCT file_path, lower(regexp_extract(file_path, '[^/]\.([A-Za-z0-9]+)$', 1)) AS ext FROM served_surfaces)
SELECT file_path, {_LANG} AS language, regexp_matches(file_path, '(^|/)(tests?|__tests__|spec|__spec__)(/|$)|\.test\.|\.spec\.') AS is_test,
  regexp_matches(file_path, 'node_modules/|dist/|cache/|bench/fixtures/') AS is_noise, regexp_matches(file_path, '(^|/)(dist|build|out|coverage|\.next|target)/') AS is_build_output,
  regexp_matches(lower(file_path), '\.(md|mdx|markdown)$') AS is_markdown, file_path = 'core' OR starts_with(file_path, 'core/') AS in_core FROM p""",
    "surface_classes": f"SELECT DISTINCT file_path, {surface_case('file_path')} AS surface FROM served_surfaces",
    "find_snippets": rf"""WITH {LINES}, m AS (SELECT path, line, text, strpos(lower(text), 'manifest') AS start FROM code_lines WHERE strpos(lower(text), 'manifest') > 0),
b AS (SELECT path, line, regexp_replace(text, '^\s+|\s+$', '', 'g') AS bare, greatest(1, start - (length(text) - length(regexp_replace(text, '^\s+', '')))) AS a FROM m),
f AS (SELECT path, line, bare, CASE WHEN length(bare) <= 80 THEN 1 ELSE greatest(1, least(a - 20, length(bare) - 79)) END AS first FROM b)
SELECT path, line, CASE WHEN first > 1 THEN '…' ELSE '' END || substr(bare, first, 80) || CASE WHEN first + 79 < length(bare) THEN '…' ELSE '' END AS snippet FROM f""",
    "evidence_windows": f"""WITH {LINES}, h AS (SELECT path, line, CAST(contains(lower(text), 'lease') AS INT) a, CAST(contains(lower(text), 'router') AS INT) b, CAST(contains(lower(text), 'sealmanifest') AS INT) c, CAST(contains(lower(text), 'digest') AS INT) d FROM code_lines),
n AS (SELECT path, count(*) AS n, sum(a) da, sum(b) db, sum(c) dc, sum(d) dd FROM h GROUP BY path HAVING sum(a) + sum(b) + sum(c) + sum(d) > 0),
s AS (SELECT path, line, max(a) OVER w * 2.0 * least(3.0, 1 + ln((n + 1) / (da + 1))) + max(b) OVER w * 2.0 * least(3.0, 1 + ln((n + 1) / (db + 1))) + max(c) OVER w * 4.0 * least(3.0, 1 + ln((n + 1) / (dc + 1)))
  + max(d) OVER w * 2.0 * least(3.0, 1 + ln((n + 1) / (dd + 1))) AS score FROM h JOIN n USING (path) WINDOW w AS (PARTITION BY path ORDER BY line ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
t AS (SELECT path, line, score FROM s QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, line) = 1),
u AS (SELECT t.path, max(s.score) AS second FROM t JOIN s ON s.path = t.path AND abs(s.line - t.line) > 24 GROUP BY t.path)
SELECT t.path, t.line, round(t.score, 3) AS score, round(t.score - u.second, 3) AS margin FROM t LEFT JOIN u USING (path) WHERE t.score >= 3""",
}
