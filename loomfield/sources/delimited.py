"""Delimited files as they are served: decoding, dialect, and windows of rows and columns.

Unlike Spark's own reader this one takes ragged rows, lone carriage returns and an open quote at the end as they are, which is why it
reads whole files in Python; files beyond the quotas are refused, so a file fits a task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.session import spread

DELIMITERS = (",", "\t", ";", "|")
# Quotas of a file.
MOST_RECORDS, MOST_CELLS, MOST_FIELDS, MOST_CHARS = 500_000, 5_000_000, 50_000, 25_000_000


class TooLarge(ValueError):
    """A file beyond a quota."""


def decoded(data: bytes) -> str:
    """Text of a file: UTF-8 or UTF-16 by its mark, else UTF-8, else Latin-1."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def records(text: str, delimiter: str, most: int | None = None) -> list[list[str]]:
    """Records of fields: a quote opens only at a field's beginning and is doubled inside; CRLF, CR and LF end a record outside of
    quotes; what an open quote leaves is the last field."""
    if len(text) > MOST_CHARS:
        raise TooLarge("characters")
    d = re.escape(delimiter)
    field = re.compile(rf'"((?:[^"]|"")*)(?:"([^{d}\r\n]*)|\Z)|([^{d}\r\n]*)')
    out: list[list[str]] = []
    row: list[str] = []
    at, cells = 0, 0
    while at <= len(text):
        m = field.match(text, at)
        row.append(m[1].replace('""', '"') + (m[2] or "") if m[1] is not None else m[3])
        cells += 1
        if len(row) > MOST_FIELDS or cells > MOST_CELLS:
            raise TooLarge("cells")
        at = m.end()
        if text.startswith(delimiter, at):
            at += len(delimiter)
            continue
        out.append(row)
        row = []
        if most and len(out) >= most:
            return out
        if len(out) > MOST_RECORDS:
            raise TooLarge("records")
        if at >= len(text):
            break
        at += 2 if text.startswith("\r\n", at) else 1
        if at >= len(text):
            break
    return [r for r in out if len(r) > 1 or r[0].strip()]


def is_number(value: str) -> bool:
    text = value.strip()
    return bool(re.fullmatch(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+", text))


def dialect(text: str, extension: str = "") -> tuple[str, bool]:
    """(delimiter, has header). Of the candidates that give a modal width of at least two over twenty records, the one whose width most
    records share, then the widest. A header has only filled, distinct cells, most of them no numbers."""
    if extension.lower() == "tsv":
        best = "\t"
    else:
        rated = []
        for place, d in enumerate(DELIMITERS):
            widths = Counter(len(r) for r in records(text, d, 20))
            if widths:
                width, n = max(widths.items(), key=lambda x: (x[1], x[0]))
                if width >= 2:
                    rated.append((n / sum(widths.values()), width, -place, d))
        best = max(rated)[3] if rated else ","
    head = next(iter(records(text, best, 1)), [])
    filled = bool(head) and all(c.strip() for c in head) and len(set(head)) == len(head)
    return best, filled and sum(is_number(c) for c in head) * 2 < len(head)


def window(data: bytes, extension: str = "", columns: list[str] | None = None, rows: tuple[int, int] | None = None, most_rows: int = 200, most_cells: int = 10_000) -> dict:
    """Columns, rows, totals and truncation of a part of a table. Rows are numbered as in the file: the first after a header is 2."""
    text = decoded(data)
    delimiter, header = dialect(text, extension)
    table = records(text, delimiter)
    width = max(map(len, table), default=0)
    names = [c.strip() or f"col_{n}" for n, c in enumerate(table[0], 1)] if header and table else []
    names += [f"col_{n}" for n in range(len(names) + 1, width + 1)]
    body = table[1:] if header else table
    first = 2 if header else 1
    picked = list(range(len(names)))
    missing = []
    if columns:
        picked = []
        low = [n.lower() for n in names]
        for c in columns:
            if c in names:
                picked.append(names.index(c))
            elif c.lower() in low:
                picked.append(low.index(c.lower()))
            else:
                missing.append(c)
    a, b = rows or (first, first + len(body) - 1)
    a, b = max(a, first), min(b, first + len(body) - 1)
    wanted = max(0, b - a + 1)
    served = min(wanted, most_rows, most_cells // max(1, len(picked)))
    out = [[r[k] if k < len(r) else None for k in picked] for r in body[a - first : a - first + served]]
    return {"columns": [names[k] for k in picked], "rows": out, "first_row": a, "total_rows": len(body), "total_columns": len(names), "truncated": served < wanted, "missing": missing, "delimiter": delimiter, "has_header": header}


def dialects(files: DataFrame, key: str, content: str = "content", extension: str = "ext") -> DataFrame:
    """(key, delimiter, has_header, n_records, n_columns) of each file's bytes; refused ones have a null delimiter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, data, ext in zip(batch[key], batch["_data"], batch["_ext"], strict=True):
                try:
                    text = decoded(bytes(data))
                    d, header = dialect(text, ext or "")
                    table = records(text, d)
                    rows.append((k, d, header, len(table) - (header and bool(table)), max(map(len, table), default=0)))
                except TooLarge:
                    rows.append((k, None, None, None, None))
            out = pd.DataFrame(rows, columns=[key, "delimiter", "has_header", "n_records", "n_columns"])
            yield out.astype({"has_header": object, "n_records": "Int64", "n_columns": "Int64"})

    given = files.where(F.col(content).isNotNull()).select(key, F.col(content).cast("binary").alias("_data"), F.col(extension).alias("_ext"))
    return spread(given).mapInPandas(run, f"`{key}` {files.schema[key].dataType.simpleString()}, delimiter string, has_header boolean, n_records bigint, n_columns bigint")


#: Records from which a file's dialect is told.
HEAD = 20


def record_dialects(rows: DataFrame, files: DataFrame, text: str = "raw_record") -> DataFrame:
    """(file_id, delimiter, has_header, n_records, n_columns) of files whose records come one a row (file_id, row_no, ``text``).

    The dialect is that of the first records by number; records and the greatest width are counted where the records are, each read on its
    own, and added up, so that a file of any size has a row. ``files``: file_id, ext. Blank and null records are none.
    """
    key = rows.schema["file_id"].dataType.simpleString()
    head = rows.where((F.col("row_no") <= HEAD) & F.col(text).isNotNull()).groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", text))), lambda x: x[text]), "\n").alias("content"))
    told = dialects(head.join(files.select("file_id", "ext"), "file_id", "left"), "file_id").select("file_id", "delimiter", "has_header")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[len(r) for r in records(t, d)] for t, d in zip(batch["_text"], batch["delimiter"], strict=True)]
            out = pd.DataFrame({"file_id": batch["file_id"], "n": [len(w) for w in found], "w": [max(w, default=0) for w in found]})
            yield out.groupby("file_id", as_index=False).agg({"n": "sum", "w": "max"})

    given = spread(rows.where(F.col(text).isNotNull()).select("file_id", F.col(text).alias("_text"))).join(told.select("file_id", "delimiter"), "file_id")
    sums = given.mapInPandas(run, f"file_id {key}, n bigint, w bigint").groupBy("file_id").agg(F.sum("n").alias("_n"), F.max("w").alias("n_columns"))
    return told.join(sums, "file_id").select("file_id", "delimiter", "has_header", (F.col("_n") - F.col("has_header").cast("bigint")).alias("n_records"), "n_columns")


def cells(files: DataFrame, key: str, content: str = "content", extension: str = "ext") -> DataFrame:
    """(key, row, column_no, column_name, value): every cell of each file, rows numbered as in the file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, data, ext in zip(batch[key], batch["_data"], batch["_ext"], strict=True):
                try:
                    t = window(bytes(data), ext or "", most_rows=MOST_RECORDS, most_cells=MOST_CELLS)
                except TooLarge:
                    continue
                rows = [(k, t["first_row"] + n, c + 1, t["columns"][c], v) for n, r in enumerate(t["rows"]) for c, v in enumerate(r) if v is not None]
                yield pd.DataFrame(rows, columns=[key, "row", "column_no", "column_name", "value"])

    given = files.where(F.col(content).isNotNull()).select(key, F.col(content).cast("binary").alias("_data"), F.col(extension).alias("_ext"))
    return spread(given).mapInPandas(run, f"`{key}` {files.schema[key].dataType.simpleString()}, row bigint, column_no int, column_name string, value string")


def windows(files: DataFrame, key: str, rows: tuple[int, int], columns: list[str] | None = None, content: str = "content", extension: str = "ext") -> DataFrame:
    """(key, row, column_no, column_name, value) of a part of each file's table: rows by number, columns by name, at most 200 rows and 10,000 cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, data, ext in zip(batch[key], batch["_data"], batch["_ext"], strict=True):
                try:
                    t = window(bytes(data), ext or "", columns, rows)
                except TooLarge:
                    continue
                out += [(k, t["first_row"] + n, c + 1, t["columns"][c], v) for n, r in enumerate(t["rows"]) for c, v in enumerate(r) if v is not None]
            yield pd.DataFrame(out, columns=[key, "row", "column_no", "column_name", "value"])

    given = files.where(F.col(content).isNotNull()).select(key, F.col(content).cast("binary").alias("_data"), F.col(extension).alias("_ext"))
    return spread(given).mapInPandas(run, f"`{key}` {files.schema[key].dataType.simpleString()}, row bigint, column_no int, column_name string, value string")
