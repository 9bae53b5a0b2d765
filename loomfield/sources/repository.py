"""What version control and code indexers write: diffs, recent changes, graph files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.session import running_sums, spread


def diff_hunks(lines: DataFrame, order: str = "line_no", text: str = "value", group: str | None = None) -> DataFrame:
    """(group, path, status, old_start, old_lines, new_start, new_lines) of each hunk of unified diffs; a file without hunks has one
    row of nulls. Lines belong to the last header above them: a running count in the order of lines."""
    keys = [group] if group else []
    t = F.col(text)
    begins = F.coalesce(t.startswith("diff --git ").cast("int"), F.lit(0))
    if group:
        numbered = lines.withColumn("_file", F.sum(begins).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        numbered = running_sums(lines, [F.col(order)], _file=begins)
    numbered = numbered.where("_file > 0")
    hunk = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    one = lambda n: F.when(F.regexp_extract(t, hunk, n) == "", 1).otherwise(F.regexp_extract(t, hunk, n).try_cast("bigint"))
    heads = numbered.groupBy(*keys, "_file").agg(
        F.max(F.when(t.startswith("diff --git "), F.regexp_extract(t, r" b/(.*)$", 1))).alias("path"),
        F.max(F.when(t.startswith("new file mode"), "added").when(t.startswith("deleted file mode"), "deleted").when(t.startswith("rename to"), "renamed")).alias("_status"),
    )
    hunks = numbered.where(t.rlike(hunk)).select(*keys, "_file", F.col(order).alias("_at"), F.regexp_extract(t, hunk, 1).try_cast("bigint").alias("old_start"), one(2).alias("old_lines"), F.regexp_extract(t, hunk, 3).try_cast("bigint").alias("new_start"), one(4).alias("new_lines"))
    return heads.join(hunks, [*keys, "_file"], "left").select(*keys, "path", F.coalesce("_status", F.lit("modified")).alias("status"), "old_start", "old_lines", "new_start", "new_lines")


def recent_files(log: DataFrame, order: str = "line_no", text: str = "value", commits: int = 50) -> DataFrame:
    """(path): the distinct paths in the first ``commits`` commits of a log with names, commits begin with the word commit. Only the commits' own lines
    are ordered; ``order`` is unique."""
    t = F.col(text)
    commit = t.rlike(r"^commit [0-9a-f]{7,}")
    heads = [r[0] for r in log.where(commit).select(order).orderBy(order).limit(commits + 1).collect()]  # as many as commits are asked for
    if not heads:
        return log.select(t.alias("path")).where("false")
    inside = log.where(F.col(order) > heads[0])
    inside = inside.where(F.col(order) < heads[commits]) if len(heads) > commits else inside
    path = t.rlike(r"^\S") & ~commit & ~t.rlike(r"^(?:Author:|Date:|Merge:)") & (F.length(t) > 0)
    return inside.where(path).select(t.alias("path")).distinct()


def graph_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(definitions, references, imports) of a graph in JSON, version 1: name, path, line, column, position; the last definition of a
    name counts. A file of another version gives empty tables."""
    schema = "version int, symbols array<struct<name:string,definition:struct<path:string,line:bigint,column:bigint>,references:array<struct<path:string,line:bigint,column:bigint>>>>, files array<struct<path:string,imports:array<string>,exports:array<string>>>"
    whole = spark.read.schema(schema).option("multiLine", "true").json(path).where("version = 1")
    symbols = whole.select(F.posexplode("symbols").alias("position", "s"))
    last = symbols.groupBy("s.name").agg(F.max_by("s.definition", "position").alias("d")).select("name", "d.path", "d.line", "d.column")
    refs = symbols.select("s.name", F.explode("s.references").alias("r")).select("name", "r.path", "r.line", "r.column")
    imports = whole.select(F.explode("files").alias("f")).select("f.path", F.explode("f.imports").alias("imported"))
    return last, refs, imports


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("torn number")
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message: numbers and byte strings, fixed ones as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("torn field")
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError("unknown wire type")
        yield key >> 3, value


def scip_occurrences(data: bytes) -> Iterator[tuple[str, str, int, int, bool]]:
    """(path, symbol, line, column, definition) of each occurrence in an index: documents are field 2, their path 1 and
    occurrences 2; of these the range is 1, the symbol 2 and the roles 3, whose lowest bit is set for a definition."""
    for number, document in wire_fields(data):
        if number != 2 or not isinstance(document, bytes):
            continue
        path, found = "", []
        for n, value in wire_fields(document):
            if n == 1 and isinstance(value, bytes):
                path = value.decode("utf-8", "replace")
            elif n == 2 and isinstance(value, bytes):
                place, symbol, roles = [], "", 0
                for k, v in wire_fields(value):
                    if k == 1 and isinstance(v, bytes):
                        at = 0
                        while at < len(v):
                            x, at = _varint(v, at)
                            place.append(x)
                    elif k == 1:
                        place.append(v)
                    elif k == 2 and isinstance(v, bytes):
                        symbol = v.decode("utf-8", "replace")
                    elif k == 3 and isinstance(v, int):
                        roles = v
                if symbol:
                    found.append((symbol, (place[0] if place else 0) + 1, place[1] if len(place) > 1 else 0, bool(roles & 1)))
        yield from ((path, *x) for x in found)


def _number(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def wire_field(number: int, value: int | bytes) -> bytes:
    """A field of a protocol-buffer message."""
    return _number(number << 3 | 2) + _number(len(value)) + value if isinstance(value, bytes) else _number(number << 3) + _number(value)


def scip_bytes(documents: list[tuple[str, list[tuple[str, int, int, bool]]]]) -> bytes:
    """An index file of documents: (path, occurrences), of which each is (symbol, line from 1, column, definition)."""
    out = b""
    for path, found in documents:
        body = wire_field(1, path.encode())
        for symbol, line, column, definition in found:
            body += wire_field(2, wire_field(1, _number(line - 1) + _number(column) + _number(column + len(symbol))) + wire_field(2, symbol.encode()) + wire_field(3, int(definition)))
        out += wire_field(2, body)
    return out


def scip_index(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, path, symbol, line, col, definition, position) of the occurrences in index files; torn files give what could be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, data in zip(batch[key], batch["_data"], strict=True):
                try:
                    for n, o in enumerate(scip_occurrences(bytes(data))):
                        rows.append((k, *o, n))
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=[key, "path", "symbol", "line", "col", "definition", "position"])

    given = files.where(F.col(content).isNotNull()).select(key, F.col(content).alias("_data"))
    return spread(given).mapInPandas(run, f"`{key}` {files.schema[key].dataType.simpleString()}, path string, symbol string, line bigint, col bigint, definition boolean, position bigint")


def scip_definitions(occurrences: DataFrame) -> DataFrame:
    """(symbol, path, line): where each symbol is defined first."""
    first = occurrences.where("definition").groupBy("symbol").agg(F.min_by(F.struct("path", "line"), F.struct("position", "path", "line")).alias("d"))
    return first.select("symbol", "d.path", "d.line")


def scip_imports(occurrences: DataFrame) -> DataFrame:
    """(path, imported): the other files that define what a file uses."""
    uses = occurrences.where("not definition").select("path", "symbol").distinct()
    return uses.join(scip_definitions(occurrences).select("symbol", F.col("path").alias("imported")), "symbol").where("path <> imported").select("path", "imported").distinct()
