"""Office packages (zip files of XML) and archives, with the standard library alone.

Every reader first looks at the package's directory against fixed limits, before anything is expanded.
"""

from __future__ import annotations

import io
import re
import tarfile
import unicodedata
import zipfile
from collections.abc import Iterator
from datetime import date, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.session import spread

# Limits of a package or archive.
MOST_PACKED, MOST_EXPANDED, MOST_ENTRIES, MOST_RATIO, MOST_PART = 25_000_000, 100_000_000, 10_000, 100, 16_000_000


def preflight(data: bytes) -> tuple[bool, str, str]:
    """(ok, code, detail) of a zip file, from its directory."""
    if len(data) > MOST_PACKED:
        return False, "too-large", f"{len(data)} bytes"
    end = data.rfind(b"PK\x05\x06")
    if end >= 0 and int.from_bytes(data[end + 10 : end + 12], "little") > MOST_ENTRIES:
        return False, "too-many-entries", str(int.from_bytes(data[end + 10 : end + 12], "little"))
    try:
        infos = zipfile.ZipFile(io.BytesIO(data)).infolist()
    except (zipfile.BadZipFile, ValueError, OSError) as x:
        return False, "not-a-zip", str(x)[:80]
    if len(infos) > MOST_ENTRIES:
        return False, "too-many-entries", str(len(infos))
    total = sum(i.file_size for i in infos)
    if total > MOST_EXPANDED:
        return False, "expands-too-far", str(total)
    for i in infos:
        if i.file_size > MOST_PART:
            return False, "part-too-large", i.filename[:80]
        if i.file_size > 1024 and i.file_size > MOST_RATIO * max(1, i.compress_size):
            return False, "ratio", i.filename[:80]
    return True, "", ""


def archive_format(content: Column, path: Column) -> Column:
    """zip, 7z, rar, gzip or tar by first bytes, else by the name; null for none of them."""
    start = F.hex(F.substring(content, 1, 8))
    name = F.lower(path)
    gz = F.when(name.rlike(r"\.(?:tar\.gz|tgz)\z"), "tar.gz").otherwise("gzip")
    return (
        F.when(start.startswith("377ABCAF271C"), "7z")
        .when(start.startswith("526172211A07"), "rar")
        .when(start.startswith("1F8B"), gz)
        .when(start.startswith("504B0304") | start.startswith("504B0506"), "zip")
        .when(F.hex(F.substring(content, 258, 5)) == "7573746172", "tar")
        .when(name.endswith(".zip"), "zip").when(name.endswith(".tar"), "tar").when(name.rlike(r"\.(?:tar\.gz|tgz)\z"), "tar.gz").when(name.endswith(".7z"), "7z").when(name.endswith(".rar"), "rar")
    )


def safe_member(name: str) -> str | None:
    """A member's name in composed form, or None if it is absolute, climbs up or holds a NUL."""
    name = unicodedata.normalize("NFC", name.replace("\\", "/"))
    if name.startswith("/") or re.match(r"^[A-Za-z]:", name) or "\0" in name or ".." in name.split("/"):
        return None
    return name


def members(data: bytes, kind: str) -> Iterator[tuple[str, int, bytes | None, str]]:
    """(name, size, content, problem) of the files in an archive; formats without a reader here give one row that says so."""
    if kind == "zip":
        ok, code, detail = preflight(data)
        if not ok:
            yield "", 0, None, f"{code}: {detail}"
            return
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i in z.infolist():
                if i.is_dir():
                    continue
                name = safe_member(i.filename)
                if name is None:
                    yield i.filename, i.file_size, None, "unsafe-name"
                elif i.flag_bits & 1:
                    yield name, i.file_size, None, "encrypted"
                else:
                    yield name, i.file_size, z.read(i), ""
    elif kind in ("tar", "tar.gz"):
        total = 0
        try:
            with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
                for n, i in enumerate(t):
                    total += i.size
                    if n >= MOST_ENTRIES or total > MOST_EXPANDED:
                        yield "", 0, None, "too-large"
                        return
                    if not i.isfile():
                        continue
                    name = safe_member(i.name)
                    if name is None:
                        yield i.name, i.size, None, "unsafe-name"
                    elif i.size > MOST_PART:
                        yield name, i.size, None, "part-too-large"
                    else:
                        yield name, i.size, t.extractfile(i).read(), ""
        except (tarfile.TarError, OSError, EOFError) as x:
            yield "", 0, None, f"not-a-tar: {str(x)[:60]}"
    else:
        yield "", 0, None, f"unsupported: {kind}"


def manifest(archives: DataFrame, key: str, content: str = "content", path: str = "path", prefix: str = "") -> DataFrame:
    """(key, member, size, problem, text): the members of archives; text only of valid UTF-8."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, data, kind in zip(batch[key], batch["_data"], batch["_kind"], strict=True):
                for name, size, body, problem in members(bytes(data), kind or "none"):
                    if not name.startswith(prefix):
                        continue
                    text = None
                    if body is not None:
                        try:
                            text = body.decode("utf-8")
                        except UnicodeDecodeError:
                            problem = problem or "binary"
                    rows.append((k, name, size, problem, text))
            yield pd.DataFrame(rows, columns=[key, "member", "size", "problem", "text"])

    given = archives.where(F.col(content).isNotNull()).select(key, F.col(content).alias("_data"), archive_format(F.col(content), F.col(path)).alias("_kind"))
    return spread(given).mapInPandas(run, f"`{key}` {archives.schema[key].dataType.simpleString()}, member string, size bigint, problem string, text string")


def ranked_members(found: DataFrame, key: str, terms: list[str], most: int = 3) -> DataFrame:
    """(key, member, score): members by 25 for each term in the name and at most 20, 2 a time, for each in the text; those of at least a
    tenth of the best score, and 4."""
    score = F.lit(0)
    for t in terms:
        in_text = F.regexp_count(F.lower("text"), F.lit(re.escape(t.lower())))
        score = score + F.when(F.locate(t.lower(), F.lower("member")) > 0, 25).otherwise(0) + F.least(F.lit(20), 2 * F.coalesce(in_text, F.lit(0)))
    from pyspark.sql import Window

    rated = found.where("problem = ''").select(key, "member", score.alias("score")).where("score > 0")
    w = Window.partitionBy(key)
    top = F.max("score").over(w)
    ranked = rated.withColumn("_floor", F.greatest(F.lit(4), F.ceil(top * 0.1))).withColumn("_n", F.row_number().over(w.orderBy(F.desc("score"), "member")))
    return ranked.where((F.col("score") >= F.col("_floor")) & (F.col("_n") <= most)).select(key, "member", "score")


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    try:
        body = z.read(name)
    except KeyError:
        return None
    if b"<!DOCTYPE" in body[:4096] or b"<!ENTITY" in body:
        return None
    return ElementTree.fromstring(body)


def _tag(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2]


def _texts(node: ElementTree.Element, tag: str = "t") -> str:
    return "".join(x.text or "" for x in node.iter() if _tag(x) == tag)


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, _, name = part.rpartition("/")
    root = _xml(z, f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels")
    out = {}
    for r in root if root is not None else ():
        target = r.get("Target", "")
        if r.get("TargetMode") == "External":
            continue
        whole = target.lstrip("/") if target.startswith("/") else f"{folder}/{target}" if folder else target
        steps: list[str] = []
        for s in whole.split("/"):
            if s == "..":
                steps = steps[:-1]
            elif s != ".":
                steps.append(s)
        out[r.get("Id", "")] = "/".join(steps)
    return out


BUILT_IN_DATES = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))


def sheets(data: bytes) -> Iterator[tuple[str, bool, int, int, str, str]]:
    """(sheet, hidden, row, column, value, kind) of every filled cell of a workbook; dates as YYYY-MM-DD, formulas as their results."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = _xml(z, "xl/workbook.xml")
        if book is None:
            return
        strings = [_texts(s) for s in _xml(z, "xl/sharedStrings.xml") or () if _tag(s) == "si"]
        styles, dated = _xml(z, "xl/styles.xml"), set()
        if styles is not None:
            own = {f.get("numFmtId") for f in styles.iter() if _tag(f) == "numFmt" and re.search(r"[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
            formats = next((x for x in styles if _tag(x) == "cellXfs"), ())
            dated = {n for n, x in enumerate(formats) if x.get("numFmtId") in own or int(x.get("numFmtId") or 0) in BUILT_IN_DATES}
        early = any(_tag(p) == "workbookPr" and p.get("date1904") in ("1", "true") for p in book.iter())
        targets = _relations(z, "xl/workbook.xml")
        for s in (x for x in book.iter() if _tag(x) == "sheet"):
            ref = next((v for k, v in s.attrib.items() if k.endswith("}id")), "")
            root = _xml(z, targets.get(ref, ""))
            if root is None:
                continue
            hidden = s.get("state", "visible") != "visible"
            row_no = 0
            for row in (x for x in root.iter() if _tag(x) == "row"):
                row_no = int(row.get("r") or row_no + 1)
                column = 0
                for c in row:
                    place = re.match(r"([A-Z]+)", c.get("r") or "")
                    column = sum((ord(x) - 64) * 26**n for n, x in enumerate(reversed(place[1]))) if place else column + 1
                    kind, value = c.get("t", "n"), next((x.text or "" for x in c if _tag(x) == "v"), None)
                    formula = any(_tag(x) == "f" for x in c)
                    if kind == "inlineStr":
                        value, kind = _texts(c), "string"
                    elif value is None:
                        continue
                    elif kind == "s":
                        value, kind = strings[int(value)] if int(value) < len(strings) else "", "string"
                    elif kind == "b":
                        value, kind = "true" if value == "1" else "false", "boolean"
                    elif kind == "n" and int(c.get("s") or 0) in dated:
                        try:
                            value, kind = str(date(1904, 1, 1) + timedelta(int(float(value))) if early else date(1899, 12, 30) + timedelta(int(float(value)))), "date"
                        except (OverflowError, ValueError):
                            kind = "number"
                    else:
                        kind = {"n": "number", "str": "string", "e": "error"}.get(kind, kind)
                    yield s.get("name", ""), hidden, row_no, column, value, f"formula({kind})" if formula else kind


def paragraphs(data: bytes) -> Iterator[tuple[int, str, bool]]:
    """(heading level or 0, text, in a table) of each paragraph or table row of a text document."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = _xml(z, "word/document.xml")
        body = next((x for x in root if _tag(x) == "body"), ()) if root is not None else ()
        for block in body:
            if _tag(block) == "p":
                style = next((next((v for k, v in x.attrib.items() if k.endswith("}val")), "") for x in block.iter() if _tag(x) == "pStyle"), "")
                m = re.match(r"(?i)heading ?([1-6])$|(title)$", style)
                yield int(m[1] or 1) if m else 0, _texts(block), False
            elif _tag(block) == "tbl":
                for row in (x for x in block.iter() if _tag(x) == "tr"):
                    yield 0, " | ".join(_texts(c) for c in row if _tag(c) == "tc"), True


def slides(data: bytes) -> Iterator[tuple[int, str, str]]:
    """(slide, kind, text) of each title, paragraph and table row of a presentation, in the order of the slides."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        show = _xml(z, "ppt/presentation.xml")
        targets = _relations(z, "ppt/presentation.xml")
        ids = [next((v for k, v in s.attrib.items() if k.endswith("}id")), "") for s in show.iter() if _tag(s) == "sldId"] if show is not None else []
        for n, ref in enumerate(ids, 1):
            root = _xml(z, targets.get(ref, ""))
            for shape in root.iter() if root is not None else ():
                if _tag(shape) == "sp":
                    role = next((x.get("type", "") for x in shape.iter() if _tag(x) == "ph"), "")
                    for p in (x for x in shape.iter() if _tag(x) == "p"):
                        if text := _texts(p).strip():
                            yield n, "title" if "itle" in role else "body", text
                elif _tag(shape) == "tr":
                    yield n, "table", " | ".join(_texts(c).strip() for c in shape if _tag(c) == "tc")


def charts(data: bytes, most: int = 32, most_series: int = 16, most_points: int = 50) -> Iterator[tuple[str, str, str, str, list[str], list[str]]]:
    """(part, type, title, series, categories, values) of the series of a package's charts."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for part in sorted(n for n in z.namelist() if re.search(r"/charts/chart\d*\.xml$", n))[:most]:
            root = _xml(z, part)
            if root is None:
                continue
            kind = next((_tag(x)[:-5] for x in root.iter() if _tag(x).endswith("Chart") and _tag(x) != "chart"), "")
            title = next((_texts(x) for x in root.iter() if _tag(x) == "title"), "")
            for s in [x for x in root.iter() if _tag(x) == "ser"][:most_series]:
                points = {}
                for role in ("tx", "cat", "val", "xVal", "yVal"):
                    node = next((x for x in s if _tag(x) == role), None)
                    points[role] = [p.text or "" for p in node.iter() if _tag(p) == "v"][:most_points] if node is not None else []
                yield part, kind, title, (points["tx"] or [""])[0], points["cat"] or points["xVal"], points["val"] or points["yVal"]


def media(data: bytes, most: int = 100) -> Iterator[tuple[str, str, str]]:
    """(part, target, alternative text) of each picture that a part of a package shows, in the order of the parts."""
    found = 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for part in sorted(n for n in z.namelist() if re.search(r"^(?:word|ppt/slides|xl/drawings)/[^/]+\.xml$", n)):
            root, targets = _xml(z, part), _relations(z, part)
            for node in root.iter() if root is not None else ():
                if _tag(node) != "pic":
                    continue
                refs = [v for x in node.iter() if _tag(x) == "blip" for k, v in x.attrib.items() if k.endswith("}embed")]
                if not refs or found >= most:
                    continue
                text = next((x.get("descr") or x.get("title") or "" for x in node.iter() if _tag(x) in ("cNvPr", "docPr")), "")
                found += 1
                yield part, targets.get(refs[0], ""), text


def scalar(value: str) -> float | str:
    """A chart's point: a number if it is written as one, else the text."""
    return float(value) if re.fullmatch(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*", value) else value


def kind_of(path: str) -> str | None:
    m = re.search(r"\.(docx|xlsx|pptx|pdf)\Z", path.lower())
    return m[1] if m else None


ENCRYPTED = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"


def extracted(data: bytes, path: str) -> tuple[str, str]:
    """(markdown, problem) of an office file by its extension. Encrypted and unreadable ones, and PDFs, for which no reader is at hand,
    give a problem and no text."""
    kind = kind_of(path)
    if kind is None or kind == "pdf":
        return "", f"unsupported: {kind or 'unknown'}"
    if data[:8] == ENCRYPTED:
        return "", "encrypted"
    ok, code, detail = preflight(data)
    if not ok:
        return "", f"{code}: {detail}"
    try:
        if kind == "docx":
            return "\n\n".join(("#" * level + " " if level else "") + text for level, text, _ in paragraphs(data) if text.strip()), ""
        if kind == "pptx":
            out, last = [], 0
            for n, role, text in slides(data):
                if n != last:
                    out.append(f"## Slide {n}")
                    last = n
                out.append(f"### {text}" if role == "title" else text)
            return "\n\n".join(out), ""
        out, last, row, cells = [], None, 0, []
        for sheet, _, r, _, value, _ in [*sheets(data), ("", False, -1, 0, "", "")]:
            if (sheet, r) != (last, row) and cells:
                out.append("| " + " | ".join(cells) + " |")
                cells = []
            if sheet != last and r >= 0:
                out.append(f"## {sheet}")
            last, row = sheet, r
            cells.append(value)
        return "\n".join(out), ""
    except (ElementTree.ParseError, zipfile.BadZipFile, KeyError, ValueError) as x:
        return "", f"unreadable: {str(x)[:60]}"


def extracts(files: DataFrame, key: str, content: str = "content", path: str = "path", most_tokens: int = 4000, most_bytes: int = 12_288) -> DataFrame:
    """(key, text, problem, truncated): office files as markdown, within a number of tokens by words and of bytes."""
    from loomfield.functions import text as tx
    from loomfield.operators.documents import cut_at_break

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [extracted(bytes(d), p) for d, p in zip(batch["_data"], batch["_path"], strict=True)]
            yield pd.DataFrame({key: batch[key], "_text": [t for t, _ in made], "problem": [p for _, p in made]})

    given = files.where(F.col(content).isNotNull()).select(key, F.col(content).alias("_data"), F.col(path).alias("_path"))
    out = spread(given).mapInPandas(run, f"`{key}` {files.schema[key].dataType.simpleString()}, _text string, problem string")
    words = int(most_tokens / 1.33)
    capped = F.when(tx.tokens_by_words(F.col("_text")) > most_tokens, F.regexp_extract("_text", rf"(?s)^(?:\s*\S+){{0,{words}}}", 0)).otherwise(F.col("_text"))
    cut = cut_at_break(capped, most_bytes)
    return out.select(key, cut.alias("text"), "problem", (F.octet_length(cut) < F.octet_length("_text")).alias("truncated"))


def workbook_cells(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, sheet, hidden, row, col, value, kind) of every filled cell; refused and unreadable workbooks have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, data in zip(batch[key], batch["_data"], strict=True):
                if preflight(bytes(data))[0]:
                    try:
                        rows += [(k, *c) for c in sheets(bytes(data))]
                    except (ElementTree.ParseError, KeyError, ValueError):
                        continue
            yield pd.DataFrame(rows, columns=[key, "sheet", "hidden", "row", "col", "value", "kind"])

    given = files.where(F.col(content).isNotNull()).select(key, F.col(content).alias("_data"))
    return spread(given).mapInPandas(run, f"`{key}` {files.schema[key].dataType.simpleString()}, sheet string, hidden boolean, row bigint, col bigint, value string, kind string")


def roster(cells: DataFrame, key: str) -> DataFrame:
    """(key, sheet, hidden, rows, cols, cells, fullest): each sheet's extent, and whether it has most cells of its workbook."""
    from pyspark.sql import Window

    by = cells.groupBy(key, "sheet").agg(F.first("hidden").alias("hidden"), F.max("row").alias("rows"), F.max("col").alias("cols"), F.count("*").alias("cells"))
    w = Window.partitionBy(key).orderBy(F.desc("cells"), "sheet")
    return by.withColumn("fullest", F.row_number().over(w) == 1)


def table_window(cells: DataFrame, key: str, sheet: str, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """(key, row, values): a rectangle of a sheet, row by row, nulls where cells are empty; rows without a cell are left out."""
    (r1, c1), (r2, c2) = first, last
    inside = cells.where((F.col("sheet") == sheet) & F.col("row").between(r1, r2) & F.col("col").between(c1, c2))
    by = inside.groupBy(key, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("_m"))  # at most a rectangle's width
    wide = F.transform(F.sequence(F.lit(c1), F.lit(c2)), lambda c: F.try_element_at("_m", c.cast("bigint")))
    return by.select(key, "row", wide.alias("values"))


def sheet_types(cells: DataFrame, key: str) -> DataFrame:
    """(key, sheet, col, header, kind): the first row's cell and the kind of the second's, the preview of a sheet."""
    from pyspark.sql import Window

    numbered = cells.withColumn("_r", F.dense_rank().over(Window.partitionBy(key, "sheet").orderBy("row"))).where("_r <= 2")
    return numbered.groupBy(key, "sheet", "col").agg(F.max(F.when(F.col("_r") == 1, F.col("value"))).alias("header"), F.max(F.when(F.col("_r") == 2, F.col("kind"))).alias("kind"))


def preview(cells: DataFrame, key: str, rows: int = 5, columns: int = 50, most_cells: int = 1_000_000) -> DataFrame:
    """(key, sheet, line_no, line): a sheet as a table: its first row, the kinds of its second, and up to so many rows, of the first columns.

    Sheets that reach over more than ``most_cells`` places are left out; empty cells are empty.
    """
    extent = cells.groupBy(key, "sheet").agg(F.max("row").alias("_rows"), F.least(F.max("col"), F.lit(columns)).cast("int").alias("_cols"), F.max("col").alias("_all"), F.min("row").alias("_first"))
    wide = extent.where(F.col("_rows") * F.col("_all") <= most_cells)
    near = cells.where(F.col("col") <= columns).join(wide, [key, "sheet"]).where(F.col("row") <= F.col("_first") + rows)
    by = near.groupBy(key, "sheet", "row", "_cols", "_first").agg(F.map_from_entries(F.collect_list(F.struct("col", F.struct("value", "kind")))).alias("_m"))  # at most ``columns``
    line = lambda field: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(1), F.col("_cols")), lambda c: F.coalesce(F.try_element_at("_m", c.cast("bigint"))[field], F.lit(""))), " | "), F.lit(" |"))
    offset = F.col("row") - F.col("_first")
    told = by.select(key, "sheet", F.when(offset == 0, 1).otherwise(offset + 2).cast("int").alias("line_no"), line("value").alias("line"))
    kinds = by.where(offset == 1).select(key, "sheet", F.lit(2).alias("line_no"), line("kind").alias("line"))
    return told.unionByName(kinds)
