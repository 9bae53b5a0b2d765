"""Rows that fail to parse (problem 3): records of delimited files as typed rows, or apart with a reason.

The delimiter of a file is the one under which most of its records are well quoted and have as many cells as the file has
columns; the votes are counted over all records, summed up before the shuffle. Records are then read by pyarrow's CSV
reader: its callback for invalid rows gives the records of another width, fields are read as strings, and whole vectors of
cells are cast, which labels the cells that break their type.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.session import spread

DELIMITERS = (",", ";", "\t", "|")
BYTE_ORDER_MARK = "\ufeff"
# What a cell of each type may look like, spaces around it gone; an empty cell is valid. Days are looked up beyond this.
PATTERNS = {"integer": r"^[+-]?[0-9]+$", "decimal": r"^[+-]?[0-9]+(?:\.[0-9]+)?$", "flag": r"^(?i:true|false)$", "day": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"}
#: A width above this is counted: RE2 has a limit on repetitions.
WIDEST = 900
QUOTED = re.compile('"[^"]*"')


@lru_cache(maxsize=256)
def shape(delimiter: str, columns: int | None = None) -> str:
    """RE2 for a well quoted record: quotes enclose whole cells, spaces aside, and are doubled inside."""
    d = re.escape(delimiter)
    cell = rf"(?: *\"(?:[^\"]|\"\")*\" *|[^\"{d}]*)"
    return rf"(?s)^{cell}(?:{d}{cell})*$" if columns is None else rf"(?s)^{cell}(?:{d}{cell}){{{columns - 1}}}$"


def width_of(record: str, delimiter: str) -> int:
    """Number of cells of a well quoted record: one more than its delimiters outside of quotes."""
    return 1 + (QUOTED.sub("", record) if '"' in record else record).count(delimiter)


def well_quoted(text: pa.Array, delimiter: str, columns: int | None = None) -> np.ndarray:
    """Which records are well quoted, and of so many cells; patterns are for those with a quote, the others are well quoted as they are."""
    quote = pc.match_substring(text, '"').to_numpy(zero_copy_only=False)
    out = np.ones(len(text), dtype=bool)
    if columns is not None:
        count = pc.count_substring(text, delimiter).to_numpy(zero_copy_only=False)
        out = count == columns - 1
        quote &= count >= columns - 1
        out[quote] = False
    if quote.any():
        own = text.filter(pa.array(quote))
        if columns is None or columns <= WIDEST:
            out[quote] = pc.match_substring_regex(own, shape(delimiter, columns)).to_numpy(zero_copy_only=False)
        else:  # RE2 repeats no more often: well quoted at any width, then its cells are counted
            good = pc.match_substring_regex(own, shape(delimiter)).to_pylist()
            out[quote] = [bool(g) and width_of(x, delimiter) == columns for g, x in zip(good, own.to_pylist(), strict=True)]
    return out


def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(file_id, v0..v3): for how many records each delimiter gives the file's width, summed up in the batch."""
    for batch in batches:
        if batch.empty:
            continue
        text = pa.array(batch["_text"], pa.string())
        width = batch["_width"].to_numpy()
        out = {"file_id": batch["file_id"]}
        for k, delimiter in enumerate(DELIMITERS):
            fits = np.zeros(len(batch), dtype="int64")
            for n in sorted({int(w) for w in width if w >= 1}):
                at = width == n
                fits[at] = well_quoted(text.filter(pa.array(at)), delimiter, n)
            out[f"v{k}"] = fits
        yield pd.DataFrame(out).groupby("file_id", as_index=False).sum()


@lru_cache(maxsize=65536)
def is_day(text: str) -> bool:
    try:
        datetime.date.fromisoformat(text)
    except ValueError:
        return False
    return True


CELL = {d: re.compile(rf' *"((?:[^"]|"")*)" *(?={re.escape(d)}|\Z)|([^"{re.escape(d)}]*)(?={re.escape(d)}|\Z)', re.S) for d in DELIMITERS}


def quoted(record: str, delimiter: str) -> str:
    """A well quoted record with the spaces outside of quotes gone."""
    cells, at = [], 0
    while True:
        m = CELL[delimiter].match(record, at)
        cells.append(f'"{m[1]}"' if m[1] is not None else m[2])
        at = m.end() + 1
        if m.end() >= len(record):
            return delimiter.join(cells)


def read(records: list[str], delimiter: str, width: int) -> tuple[pa.Table, np.ndarray, list[int]]:
    """(the table of the valid records, their numbers, the numbers of those of another width) of well quoted records."""
    invalid: list[int] = []

    def skip(row: pacsv.InvalidRow) -> str:
        invalid.append(int(row.text.split(delimiter, 1)[0]))
        return "skip"

    outside = re.compile(rf'(?:^|{re.escape(delimiter)}) +"|" +(?:{re.escape(delimiter)}|$)')
    lines = [f"{k}{delimiter}{quoted(r, delimiter) if '"' in r and outside.search(r) else r}" for k, r in enumerate(records)]
    names = ["_k", *(f"c{n}" for n in range(width))]
    table = pacsv.read_csv(
        pa.BufferReader("\n".join(lines).encode("utf-8", "surrogatepass")),
        read_options=pacsv.ReadOptions(column_names=names, use_threads=False, block_size=max(1 << 20, 2 * sum(map(len, lines)) * 4)),
        parse_options=pacsv.ParseOptions(delimiter=delimiter, quote_char='"', double_quote=True, newlines_in_values=True, ignore_empty_lines=False, invalid_row_handler=skip),
        convert_options=pacsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False, quoted_strings_can_be_null=False),
    )
    return table, table["_k"].cast(pa.int64()).to_numpy(), invalid


def breaks(cells: pa.ChunkedArray, kind: str) -> np.ndarray:
    """Places of a vector's cells that break their type."""
    if kind not in PATTERNS:
        return np.zeros(0, dtype="int64")
    bare = pc.utf8_trim_whitespace(cells)
    good = pc.or_(pc.equal(pc.utf8_length(bare), 0), pc.match_substring_regex(bare, PATTERNS[kind]))
    if kind == "day":  # of the days that look like one, each is looked up once
        wrong = [t for t in pc.unique(bare.filter(good)).to_pylist() if t and not is_day(t)]
        good = pc.and_not(good, pc.is_in(bare, pa.array(wrong, pa.string())))
    return np.flatnonzero(~good.to_numpy(zero_copy_only=False) if isinstance(good, pa.Array) else ~good.to_numpy())


TYPES_END = "\x1f"


def _parse(batches: Iterator[pd.DataFrame], with_cells: bool) -> Iterator[pd.DataFrame]:
    """The records with their reasons; all with their cells, or only those that fail, without."""
    for batch in batches:
        if batch.empty:
            continue
        batch = batch.reset_index(drop=True)
        reason: list[str | None] = [None] * len(batch)
        cells: list[list[str] | None] = [None] * len(batch)
        bad: list[list[int] | None] = [None] * len(batch)
        for (_, delimiter), part in batch.groupby(["file_id", "_delimiter"], sort=False):
            at = part.index.to_numpy()
            kinds = part["_types"].iloc[0].split(TYPES_END)[:-1]
            well = well_quoted(pa.array(part["_text"], pa.string()), delimiter)
            for k in at[~well]:
                reason[k] = "quoting"
            good = at[well]
            if not len(good):
                continue
            table, numbers, invalid = read(part["_text"].to_numpy()[well].tolist(), delimiter, len(kinds))
            for number in invalid:
                reason[good[number]] = "columns"
            for n, kind in enumerate(kinds):
                for k in good[numbers[breaks(table[f"c{n}"], kind)]]:
                    reason[k] = "values"
                    bad[k] = [*(bad[k] or ()), n]
            if with_cells:
                columns = [table[f"c{n}"].to_pylist() for n in range(len(kinds))]
                for number, row in zip(numbers, zip(*columns, strict=True) if kinds else [()] * len(numbers), strict=True):
                    cells[good[number]] = list(row)
        out = batch[["row_id", "file_id", "row_no"]].assign(delimiter=batch["_delimiter"], reason=reason, bad_columns=bad)
        yield out.assign(cells=cells) if with_cells else out[out["reason"].notna()]


def delimiters(records: DataFrame) -> DataFrame:
    """(file_id, _delimiter) by vote; without any vote, a tab, which no text of a single column holds by chance."""
    given = records.select("file_id", "_text", F.size("column_names").alias("_width"))
    kind = records.schema["file_id"].dataType.simpleString()
    counted = given.mapInPandas(votes, f"file_id {kind}, v0 bigint, v1 bigint, v2 bigint, v3 bigint")
    sums = counted.groupBy("file_id").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(4)])
    most = F.greatest("v0", "v1", "v2", "v3")
    choice = F.when(most == 0, F.lit("\t"))
    for k, delimiter in enumerate(DELIMITERS):
        choice = choice.when(F.col(f"v{k}") == most, F.lit(delimiter))
    return sums.select("file_id", choice.alias("_delimiter"))


def parsed(rows: DataFrame, files: DataFrame, with_cells: bool = True) -> DataFrame:
    """(row_id, file_id, row_no, delimiter, reason, bad_columns, cells) of each data record; without cells, of those that fail.

    ``rows``: row_id, file_id, row_no, raw_record; ``files``: file_id, has_header, column_names, column_types. The header
    (row 1 of a file that has one), blank and null records, and records of unknown files are none. ``reason`` is null for a
    valid row, else quoting, columns or values, the first that holds; ``bad_columns`` counts from 0. Repeated records are
    records. Of entries of ``files`` with the same id the least counts. Columns of the inputs beyond these are dropped, whatever they are called.

    Files are joined by equality: small tables of files are broadcast by Spark's own size check, and where they are not,
    adaptive execution splits the partition of a file with a third of all records.
    """
    headed = files.select("file_id", F.coalesce("has_header", F.lit(False)).alias("_header"), "column_names", "column_types")
    headed = headed.groupBy("file_id").agg(F.min(F.struct("_header", "column_names", "column_types")).alias("x")).select("file_id", "x.*")
    text = F.regexp_replace("raw_record", f"^{BYTE_ORDER_MARK}", "")
    text = F.regexp_replace(text, r"[\r\n]+\z", "")
    records = spread(rows.select("row_id", "file_id", "row_no", text.alias("_text"))).join(headed, "file_id")
    records = records.where(F.col("column_types").isNotNull() & F.col("_text").rlike(r"\S"))
    chosen = delimiters(records)
    data = records.where(~(F.col("_header") & (F.col("row_no") == 1)))
    given = data.join(chosen, "file_id").select("row_id", "file_id", "row_no", "_text", "_delimiter", F.concat_ws("", F.transform("column_types", lambda t: F.concat(F.coalesce(t, F.lit("")), F.lit(TYPES_END)))).alias("_types"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = f"row_id {kinds['row_id']}, file_id {kinds['file_id']}, row_no {kinds['row_no']}, delimiter string, reason string, bad_columns array<int>" + ", cells array<string>" * with_cells
    return given.mapInPandas(lambda batches: _parse(batches, with_cells), out)


def rejects(rows: DataFrame, files: DataFrame) -> DataFrame:
    """The failing data records with their reasons."""
    return parsed(rows, files, with_cells=False)


def typed_cells(rows: DataFrame, files: DataFrame) -> DataFrame:
    """The valid rows, cell by cell, cast to their columns' types: one value column a type, null for an empty cell.

    Integers beyond 38 digits stay text only.
    """
    good = parsed(rows, files).where(F.col("reason").isNull())
    named = files.groupBy("file_id").agg(F.min(F.struct(F.coalesce("has_header", F.lit(False)), "column_names", "column_types")).alias("x")).select("file_id", "x.column_names", "x.column_types")
    cells = good.join(named, "file_id").select("row_id", "file_id", "row_no", "column_names", "column_types", F.posexplode("cells").alias("column_no", "text_value"))
    bare = F.nullif(F.trim("text_value"), F.lit(""))
    kind = F.element_at("column_types", F.col("column_no") + 1)
    of = lambda name, to: F.when(F.col("column_type") == name, F.col("_bare").try_cast(to))
    cells = cells.select("row_id", "file_id", "row_no", (F.col("column_no") + 1).alias("column_no"), F.element_at("column_names", F.col("column_no") + 1).alias("column_name"), kind.alias("column_type"), "text_value", bare.alias("_bare"))
    return cells.withColumns({"integer_value": of("integer", "decimal(38,0)"), "decimal_value": of("decimal", "double"), "day_value": of("day", "date"), "flag_value": of("flag", "boolean")}).drop("_bare")
