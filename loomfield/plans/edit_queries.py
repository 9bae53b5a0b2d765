"""Queries of edits, over the windows of hop1_context as files and over texts put together from small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.functions import paths
from loomfield.operators import edits, outline, source
from loomfield.plans.lexed_sql import COMMENTS, WINDOWS
from loomfield.plans.search_queries import windows
from loomfield.session import table


def edited_windows(spark: SparkSession, folder: str) -> DataFrame:
    """One word replaced in each window that has it once; all others refused, with why."""
    w = windows(spark, folder)
    asked = w.select("path", F.lit(1).alias("edit_no"), F.lit("token").alias("search"), F.lit("mark").alias("replace"))
    return edits.edited(w, asked).select("path", "ok", "code", F.sha2("content", 256).alias("content_sha"))


def range_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Lines 2 and 3 of each window replaced by one."""

    def change(text: str) -> tuple:
        ok, code, out = edits.replace_range(text, 2, 3, "replaced\n")
        return ok, code, out

    return edits.of_each(windows(spark, folder), ["path"], "content", change, "ok boolean, code string, text string").select("path", "ok", "code", F.sha2("text", 256).alias("content_sha"))


def edit_guards(spark: SparkSession, folder: str) -> DataFrame:
    """Whether an edit that takes the first two thirds of a window away is too large."""
    guard = lambda t: edits.blast_radius(t, 0, len(t) * 2 // 3, "short")
    out = edits.of_each(windows(spark, folder), ["path"], "content", guard, "too_large boolean, removed double, replaced double")
    return out.withColumns({c: F.round(c, 9) for c in ("removed", "replaced")})


def edit_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """Where the first return stands in each window, and how many lines an edit there takes and gives."""
    delta = lambda t: edits.line_delta(t, "return", "a\nb\n") or (None, None, None)
    return edits.of_each(windows(spark, folder), ["path"], "content", delta, "line int, removed int, added int").where("line is not null")


def failed_edits(spark: SparkSession, folder: str) -> DataFrame:
    """What is nearest to a search that no window has."""
    return edits.of_each(windows(spark, folder), ["path"], "content", lambda t: edits.nearest_line(t, "}\n  end  \nno such line")[:2], "line int, present int")


def unescaped_windows(spark: SparkSession, folder: str) -> DataFrame:
    return edits.of_each(windows(spark, folder), ["path"], "content", lambda t: (edits.unescaped(t),), "text string").select("path", F.sha2("text", 256).alias("content_sha"))


def shown_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The line ranges that each window still shows when comments of several lines are elided."""
    h = table(spark, folder, "hop1_context").where("code is not null").select("hop_id", "code", F.coalesce(paths.language(F.col("file_path")), F.lit("")).alias("lang"))

    def shown(text: str, lang: str) -> list[tuple]:
        found = source.shown_lines(source.elided(text, lang), 1, text.count("\n") + 1)
        return [(len(found), sum(b - a + 1 for a, b in found))]

    return source._mapped(h, ["hop_id"], "code", "lang", shown, "ranges int, lines int", ["ranges", "lines"])


def unique_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The nation with a text that no other has, nor itself twice."""
    n = table(spark, folder, "nation")
    return outline.unique_target(n.select(F.col("n_name").alias("path"), F.lower("n_name").alias("content")), "_17")


def _regions(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.replace("r_name", F.lit(" "), F.lit("_")).alias("region"), F.replace("n_name", F.lit(" "), F.lit("_")).alias("nation"), "n_nationkey", "n_regionkey")


def appended_members(spark: SparkSession, folder: str) -> DataFrame:
    """Enums of a region's nations, with a member added, and one that is there already."""
    names = _regions(spark, folder).groupBy("region").agg(F.array_sort(F.collect_list("nation")).alias("names"))
    texts = names.select("region", F.element_at("names", 1).alias("first"), F.concat(F.lit("enum "), "region", F.lit(" {\n  "), F.array_join("names", ",\n  "), F.lit("\n}\n")).alias("text"))

    def run(batches):
        for b in batches:
            yield b[["region"]].assign(text=[edits.append_member(t, r, "ATLANTIS") for t, r in zip(b["text"], b["region"], strict=True)], again=[edits.append_member(t, r, f) is None for t, r, f in zip(b["text"], b["region"], b["first"], strict=True)])

    return texts.mapInPandas(run, "region string, text string, again boolean")


def duplicate_branches(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring branches of equal bodies in a chain over all nations that tells their region."""
    ordered = F.array_sort(F.collect_list(F.struct("n_regionkey", "n_nationkey")))  # 25 rows at every scale
    branch = F.transform("b", lambda x: F.concat(F.lit("if (k === "), x["n_nationkey"].cast("string"), F.lit(") {\n  place("), x["n_regionkey"].cast("string"), F.lit(");\n")))
    text = _regions(spark, folder).groupBy().agg(ordered.alias("b")).select(F.lit("chain").alias("path"), F.concat(F.array_join(branch, "} else "), F.lit("}\n")).alias("text"))
    found = edits.of_each(text, ["path"], "text", lambda t: ([{"first": a, "second": b} for a, b in edits.duplicate_branches(t)],), "pairs array<struct<first:int,second:int>>")
    return found.select(F.explode("pairs").alias("p")).select("p.first", "p.second")


_L = f"ls AS (SELECT path, content, string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS parts, contains(content, chr(13) || chr(10)) AS crlf FROM {WINDOWS})"
SQL = {
    "edited_windows": f"""WITH w AS (SELECT path, content, (length(content) - length(replace(content, 'token', ''))) // 5 AS n FROM {WINDOWS})
SELECT path, n = 1 AS ok, CASE WHEN n = 0 THEN 'not-found' WHEN n > 1 THEN 'ambiguous' ELSE '' END AS code, sha256(CASE WHEN n = 1 THEN replace(content, 'token', 'mark') ELSE content END) AS content_sha FROM w""",
    "range_edits": f"""WITH {_L}, t AS (SELECT *, len(parts) - CASE WHEN len(parts) > 1 AND parts[len(parts)] = '' THEN 1 ELSE 0 END >= 3 AS ok, list_concat(parts[1:1], ['replaced'], parts[4:]) AS x FROM ls)
SELECT path, ok, CASE WHEN ok THEN '' ELSE 'out-of-bounds' END AS code, sha256(CASE WHEN NOT ok THEN content WHEN crlf THEN array_to_string(x, chr(13) || chr(10)) ELSE array_to_string(x, chr(10)) END) AS content_sha FROM t""",
    "edit_guards": f"""WITH w AS (SELECT path, length(content) AS n FROM {WINDOWS}), x AS (SELECT path, n, greatest(0, n * 2 // 3 - 5) / greatest(1, n) AS a, (n * 2 // 3) / greatest(1, n) AS b FROM w)
SELECT path, n > 200 AND (a > 0.5 OR b > 0.9) AS too_large, round(a, 9) AS removed, round(b, 9) AS replaced FROM x""",
    "edit_deltas": f"""SELECT path, length(regexp_replace(left(content, strpos(content, 'return') - 1), '[^\\n]', '', 'g')) + 1 AS line, 1 AS removed, 2 AS added FROM {WINDOWS} WHERE contains(content, 'return')""",
    "failed_edits": f"""WITH s AS (SELECT path, list_transform(string_split(content, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS t FROM {WINDOWS})
SELECT path, coalesce(nullif(list_position(t, '}}'), 0), 1) AS line, CAST(list_contains(t, '}}') AS INT) + CAST(list_contains(t, 'end') AS INT) AS present FROM s""",
    "unescaped_windows": f"""SELECT path, sha256(replace(replace(replace(replace(replace(content, '\\\\', chr(1)), '\\n', chr(10)), '\\t', chr(9)), '\\r', chr(13)), chr(1), '\\')) AS content_sha FROM {WINDOWS}""",
    "shown_lines": f"""WITH {COMMENTS}, o AS (SELECT path, line, coalesce(c > 0 OR d > 0, false) OR length(regexp_replace(m, '[^' || chr(1) || chr(5) || ']', '', 'g')) > length(regexp_replace(m, '[^' || chr(2) || chr(6) || ']', '', 'g')) AS cut FROM st),
s AS (SELECT path, line, line - row_number() OVER (PARTITION BY path ORDER BY line) AS island FROM o WHERE NOT cut)
SELECT p.path AS hop_id, count(DISTINCT island) AS ranges, count(s.line) AS lines FROM (SELECT DISTINCT path FROM o) p LEFT JOIN s USING (path) GROUP BY p.path""",
    "unique_targets": """WITH w AS (SELECT n_name AS path, (length(n_name) - length(replace(lower(n_name), '_17', ''))) // 3 AS n FROM nation) SELECT path FROM w WHERE n = 1 AND (SELECT sum(n) FROM w) = 1""",
    "appended_members": """WITH n AS (SELECT replace(r_name, ' ', '_') AS region, replace(n_name, ' ', '_') AS nation FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT region, 'enum ' || region || ' {' || chr(10) || string_agg('  ' || nation || ',' || chr(10), '' ORDER BY nation) || '  ATLANTIS' || chr(10) || '}' || chr(10) AS text, true AS again FROM n GROUP BY region""",
    "duplicate_branches": """WITH o AS (SELECT row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS i, n_regionkey AS r, lag(n_regionkey) OVER (ORDER BY n_regionkey, n_nationkey) AS before FROM nation) SELECT 2 * i - 3 AS first, 2 * i - 1 AS second FROM o WHERE r = before""",
}
QUERIES = {f.__name__: f for f in (edited_windows, range_edits, edit_guards, edit_deltas, failed_edits, unescaped_windows, shown_lines, unique_targets, appended_members, duplicate_branches)}
