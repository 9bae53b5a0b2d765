"""Queries of problems 1 and 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.operators import drift, rejects
from loomfield.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each change of a file's fields against the file before."""
    return drift.changes(table(spark, folder, "ai_usage_lines"))


def p1_records(spark: SparkSession, folder: str) -> DataFrame:
    """All lines in one table of the record's fields and types."""
    return drift.records(table(spark, folder, "ai_usage_lines"), ["line_id", "stream_id", "file_no", "line_no"])


def p1_branches(spark: SparkSession, folder: str) -> DataFrame:
    """The tagged union of every path over all files."""
    found = drift.branches(table(spark, folder, "ai_usage_lines")).where("path <> ''")
    return found.groupBy("path", "tag").agg(F.sum("lines").alias("lines"), F.count("*").alias("files"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The failing data records and why."""
    return rejects.rejects(table(spark, folder, "csv_rows"), table(spark, folder, "csv_tables")).select("row_id", "reason")


def p3_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """The failing data records with reason, failing columns and the record as it stood."""
    rows = table(spark, folder, "csv_rows")
    failed = rejects.rejects(rows, table(spark, folder, "csv_tables")).select("row_id", "delimiter", "reason", F.array_join("bad_columns", ",").alias("bad_columns"))
    return rows.join(failed, "row_id")


def p3_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The valid rows, typed, cell by cell; values of all types but decimals shown as text."""
    cells = rejects.typed_cells(table(spark, folder, "csv_rows"), table(spark, folder, "csv_tables"))
    return cells.withColumn("trimmed_value", F.nullif(F.trim("text_value"), F.lit(""))).drop("text_value").withColumns({c: F.col(c).cast("string") for c in ("integer_value", "day_value", "flag_value")})


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p1_branches, p3_found, p3_rejects, p3_cells)}
# A cell is well quoted as the operator has it; records are cut into cells by the same shape, and cells are cast by pattern.
_P3 = r"""
WITH t AS (SELECT file_id, coalesce(has_header, false) AS header, len(column_names) AS n, column_types FROM csv_tables),
r AS (SELECT c.row_id, c.file_id, c.row_no, t.header, t.n, t.column_types, regexp_replace(regexp_replace(c.raw_record, '^\x{FEFF}', ''), '[\r\n]+\z', '') AS x FROM csv_rows c JOIN t USING (file_id)),
live AS (SELECT * FROM r WHERE regexp_matches(x, '\S')),
d AS (SELECT * FROM (VALUES (0, ',', ','), (1, ';', ';'), (2, chr(9), chr(9)), (3, '|', '\|')) v(k, d, e)),
s AS (SELECT k, d, e, '(?: *"(?:[^"]|"")*" *|[^"' || e || ']*)' AS cell FROM d),
votes AS (SELECT file_id, k, count(*) FILTER (regexp_full_match(x, cell || '(?:' || e || cell || '){' || (n - 1) || '}')) AS v FROM live, s GROUP BY file_id, k),
best AS (SELECT file_id, CASE WHEN max(v) = 0 THEN 2 ELSE arg_min(k, (-v, k)) END AS k FROM votes GROUP BY file_id),
data AS (SELECT l.*, s.d, s.e, s.cell FROM live l JOIN best USING (file_id) JOIN s USING (k) WHERE NOT (header AND row_no = 1)),
shaped AS (SELECT *, regexp_full_match(x, cell || '(?:' || e || cell || ')*') AS well FROM data),
cut AS (SELECT *, CASE WHEN well THEN regexp_extract_all(x || d, '(' || cell || ')' || e, 1) END AS cells FROM shaped),
bare AS (SELECT *, list_transform(cells, lambda c: trim(CASE WHEN regexp_full_match(c, ' *"(?:[^"]|"")*" *') THEN replace(regexp_extract(c, ' *"((?:[^"]|"")*)" *', 1), '""', '"') ELSE c END)) AS b FROM cut),
pairs AS (SELECT *, list_filter(range(1, len(b) + 1), lambda i: b[i] <> '' AND NOT CASE column_types[i] WHEN 'integer' THEN regexp_full_match(b[i], '[+-]?[0-9]+')
  WHEN 'decimal' THEN regexp_full_match(b[i], '[+-]?[0-9]+(\.[0-9]+)?') WHEN 'flag' THEN lower(b[i]) IN ('true', 'false')
  WHEN 'day' THEN regexp_full_match(b[i], '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND TRY_CAST(b[i] AS DATE) IS NOT NULL ELSE true END) AS wrong FROM bare)
SELECT row_id, CASE WHEN NOT well THEN 'quoting' WHEN len(cells) <> n THEN 'columns' ELSE 'values' END AS reason FROM pairs WHERE NOT well OR len(cells) <> n OR len(wrong) > 0
"""

# Leaves of readable lines, with their tags; names are told apart by patterns here. Renames by values alone have no part in it.
_P1 = r"""
WITH ok AS (SELECT line_id, stream_id, file_no, raw_line FROM ai_usage_lines WHERE stream_id IS NOT NULL AND file_no IS NOT NULL AND json_valid(raw_line) AND json_type(raw_line) = 'OBJECT'),
j AS (SELECT line_id, stream_id, file_no, replace(substr(k.fullkey, 3), '"', '') AS p, CASE k.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'DOUBLE' THEN 'decimal' WHEN 'NULL' THEN 'null' ELSE 'integer' END AS tag
  FROM ok, json_tree(ok.raw_line) k WHERE k.type <> 'OBJECT' AND NOT contains(k.fullkey, '['))"""
_QUANTITY = r"""CASE WHEN regexp_matches(l, 'cache') AND regexp_matches(l, 'tok') AND regexp_matches(l, 'writ|creat|stor') THEN 'cw' WHEN regexp_matches(l, 'cache') AND regexp_matches(l, 'tok') AND regexp_matches(l, 'read|hit|cached') THEN 'cr'
  WHEN regexp_matches(l, 'tok|^usage[.]') AND NOT regexp_matches(l, 'cache') AND regexp_matches(l, 'total') THEN 'tt' WHEN regexp_matches(l, 'tok|^usage[.]') AND NOT regexp_matches(l, 'cache') AND regexp_matches(regexp_replace(l, 'completion', 'out'), 'prompt|in') THEN 'in'
  WHEN regexp_matches(l, 'tok|^usage[.]') AND NOT regexp_matches(l, 'cache') AND regexp_matches(l, 'out|completion') THEN 'ou' WHEN regexp_matches(l, 'request|turn|call') AND regexp_matches(last, '^(requests?|turns?|calls?|count|number|total|[_-])+$') THEN 'rc'
  WHEN regexp_matches(l, 'client|agent') AND regexp_matches(last, '^(client|agent|name|id|[_-])+$') THEN 'cl' WHEN regexp_matches(l, 'model|llm|engine') AND regexp_matches(last, '^(model|llm|engine|name|id|[_-])+$') THEN 'mo' ELSE 'other:' || regexp_replace(last, '[_-]', '', 'g') END"""
_P1_FOUND = _P1 + r""",
files AS (SELECT stream_id, file_no, lag(file_no) OVER (PARTITION BY stream_id ORDER BY file_no) AS before FROM (SELECT DISTINCT stream_id, file_no FROM ok)),
t AS (SELECT stream_id, file_no, p, coalesce(array_to_string(list_sort(list(DISTINCT tag) FILTER (tag <> 'null')), '|'), '') AS ty FROM j GROUP BY ALL),
f AS (SELECT stream_id, file_no, p, CASE WHEN ty = 'decimal|integer' THEN 'decimal' ELSE ty END AS ty, lower(p) AS l, lower(regexp_extract(p, '[^.]*$')) AS last FROM t),
q AS (SELECT stream_id, file_no, p, ty, {quantity} AS q FROM f),
gone AS (SELECT n.stream_id, n.file_no, a.p, a.ty, a.q, row_number() OVER (PARTITION BY n.stream_id, n.file_no, a.q ORDER BY a.p) AS k FROM files n JOIN q a ON a.stream_id = n.stream_id AND a.file_no = n.before
  WHERE NOT EXISTS (SELECT 1 FROM q b WHERE b.stream_id = n.stream_id AND b.file_no = n.file_no AND b.p = a.p)),
came AS (SELECT n.stream_id, n.file_no, b.p, b.ty, b.q, row_number() OVER (PARTITION BY n.stream_id, n.file_no, b.q ORDER BY b.p) AS k FROM files n JOIN q b ON b.stream_id = n.stream_id AND b.file_no = n.file_no
  WHERE n.before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM q a WHERE a.stream_id = n.stream_id AND a.file_no = n.before AND a.p = b.p)),
mix AS (SELECT coalesce(g.stream_id, c.stream_id) AS stream_id, coalesce(g.file_no, c.file_no) AS file_no, g.p AS a, c.p AS b, g.ty AS ta, c.ty AS tb FROM gone g FULL JOIN came c ON g.stream_id = c.stream_id AND g.file_no = c.file_no AND g.q = c.q AND g.k = c.k),
kept AS (SELECT n.stream_id, n.file_no, a.p AS a, a.p AS b, a.ty AS ta, b.ty AS tb FROM files n JOIN q a ON a.stream_id = n.stream_id AND a.file_no = n.before JOIN q b ON b.stream_id = n.stream_id AND b.file_no = n.file_no AND b.p = a.p)
SELECT stream_id, file_no, CASE WHEN b IS NULL THEN 'removed' WHEN a IS NULL THEN 'added' ELSE 'renamed' END AS change_kind, coalesce(a, '') AS old_field, coalesce(b, '') AS new_field FROM mix
UNION ALL SELECT stream_id, file_no, 'retyped', a, b FROM (SELECT * FROM mix UNION ALL SELECT * FROM kept) WHERE ta <> '' AND tb <> '' AND ta <> tb""".replace("{quantity}", _QUANTITY)
_P1_BRANCHES = _P1 + r""",
n AS (SELECT stream_id, file_no, p AS path, tag, count(*) AS lines FROM j GROUP BY ALL)
SELECT path, tag, CAST(sum(lines) AS BIGINT) AS lines, count(*) AS files FROM n GROUP BY path, tag"""
_FIELDS = {"client": "cl", "model": "mo", "inputTokens": "in", "cacheWriteTokens": "cw", "cacheReadTokens": "cr", "outputTokens": "ou", "totalTokens": "tt", "requestCount": "rc"}
_P1_RECORDS = (
    r"""WITH a AS (SELECT *, CASE WHEN json_valid(raw_line) THEN json_type(raw_line) = 'OBJECT' ELSE false END AS is_readable FROM ai_usage_lines), ok AS (SELECT line_id, raw_line FROM a WHERE is_readable),
j AS (SELECT line_id, k.id AS id, replace(substr(k.fullkey, 3), '"', '') AS p, k.type AS type, CAST(k.value AS VARCHAR) AS v, k.value AS jv FROM ok, json_tree(ok.raw_line) k WHERE k.type <> 'OBJECT' AND NOT contains(k.fullkey, '[')),
f AS (SELECT *, lower(p) AS l, lower(regexp_extract(p, '[^.]*$')) AS last, CASE WHEN type = 'ARRAY' THEN CASE WHEN json_array_length(jv) = 1 THEN json_extract_string(jv, '$[0]') END ELSE json_extract_string(jv, '$') END AS t FROM j),
q AS (SELECT *, {quantity} AS q FROM f),
c AS (SELECT *, CASE WHEN q IN ('cl', 'mo') THEN t WHEN q NOT LIKE 'other:%' AND type <> 'BOOLEAN' AND TRY_CAST(t AS DOUBLE) = floor(TRY_CAST(t AS DOUBLE)) THEN CAST(CAST(TRY_CAST(t AS DOUBLE) AS BIGINT) AS VARCHAR) END AS made FROM q),
w AS (SELECT *, min(CASE WHEN made IS NOT NULL THEN id END) OVER (PARTITION BY line_id, q) AS own FROM c),
r AS (SELECT line_id, string_agg('"' || p || '": ' || replace(v, '","', '", "'), ', ' ORDER BY p) AS rest FROM w WHERE q LIKE 'other:%' OR id > own OR ((own IS NULL OR id < own) AND type <> 'NULL' AND made IS NULL) GROUP BY line_id),
o AS (SELECT line_id, """
    + ", ".join(f"""max(made) FILTER (q = '{q}' AND id = own) AS "{n}" """ for n, q in _FIELDS.items())
    + r""" FROM w GROUP BY line_id)
SELECT a.line_id, stream_id, file_no, line_no, """
    + ", ".join(f'"{n}"' if q in ("cl", "mo") else f'CAST("{n}" AS BIGINT) AS "{n}"' for n, q in _FIELDS.items())
    + r""", '{' || rest || '}' AS other_fields, coalesce(is_readable, false) AS is_readable FROM a LEFT JOIN o USING (line_id) LEFT JOIN r USING (line_id)"""
).replace("{quantity}", _QUANTITY)
_P3_REJECTS = _P3.replace("SELECT row_id, CASE WHEN NOT well", "SELECT row_id, file_id, row_no, raw_record, d AS delimiter, CASE WHEN NOT well").replace(
    "AS reason FROM pairs WHERE", "AS reason, CASE WHEN well AND len(cells) = n THEN nullif(array_to_string(list_transform(wrong, lambda i: CAST(i - 1 AS VARCHAR)), ','), '') END AS bad_columns FROM pairs JOIN (SELECT row_id, raw_record FROM csv_rows) USING (row_id) WHERE"
)
_P3_CELLS = _P3[: _P3.index("SELECT row_id, CASE WHEN NOT well")] + r""",
good AS (SELECT row_id, file_id, row_no, column_types, b FROM pairs WHERE well AND len(cells) = n AND len(wrong) = 0),
each AS (SELECT g.row_id, g.file_id, g.row_no, i AS column_no, t.column_names[i] AS column_name, g.column_types[i] AS column_type, nullif(g.b[i], '') AS v FROM good g JOIN csv_tables t USING (file_id), unnest(range(1, len(g.b) + 1)) u(i))
SELECT row_id, file_id, row_no, column_no, column_name, column_type, v AS trimmed_value, CASE WHEN column_type = 'integer' THEN CAST(TRY_CAST(v AS DECIMAL(38, 0)) AS VARCHAR) END AS integer_value, CASE WHEN column_type = 'decimal' THEN TRY_CAST(v AS DOUBLE) END AS decimal_value,
  CASE WHEN column_type = 'day' THEN CAST(TRY_CAST(v AS DATE) AS VARCHAR) END AS day_value, CASE WHEN column_type = 'flag' THEN lower(v) END AS flag_value FROM each"""

SQL: dict[str, str] = {"p1_found": _P1_FOUND, "p1_branches": _P1_BRANCHES, "p1_records": _P1_RECORDS, "p3_found": _P3, "p3_rejects": _P3_REJECTS, "p3_cells": _P3_CELLS}
