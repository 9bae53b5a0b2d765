"""Text of PDF files, page by page, with the standard library alone.

Objects are found by their marks, so that a broken cross-reference table does no harm; streams are plain or deflated. Text comes from the
operators that show strings, decoded by a font's ToUnicode table where it has one, else as Windows Latin. Positions only tell
lines and wide gaps apart. Pages without a text layer are empty; encrypted files and filters beyond deflate give a problem.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.session import spread

# Limits of a file.
MOST_PAGES, MOST_CHARS, MOST_BYTES = 500, 4_000_000, 64_000_000

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|[\[\]]|/[^\s/<>\[\]()]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


class Unreadable(ValueError):
    """A file that has text which can't be had; the reason is its text."""


def _value(body: bytes, key: bytes) -> bytes:
    """What follows a key in a dictionary: a reference, a list, a dictionary's beginning, a name or a number."""
    m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R|<<.*?>>|/?[^\s/<>\[\]]+)", body, re.S)
    return m[1] if m else b""


class File:
    """The objects of a file by number."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise Unreadable("not-a-pdf")
        if len(data) > MOST_BYTES:
            raise Unreadable("too-large")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise Unreadable("encrypted")
        self.objects = {int(m[1]): m[2] for m in OBJECT.finditer(data)}
        for body in [b for b in self.objects.values() if b"/ObjStm" in b.partition(b"stream")[0]]:
            self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        count, first = int(_value(body, b"N") or 0), int(_value(body, b"First") or 0)
        text = self.stream(body)
        numbers = [int(x) for x in text[:first].split()[: 2 * count]]
        places = sorted(zip(numbers[1::2], numbers[::2], strict=True))
        for (at, number), (end, _) in zip(places, [*places[1:], (len(text) - first, 0)], strict=True):
            self.objects.setdefault(number, text[first + at : first + end])

    def get(self, value: bytes) -> bytes:
        m = REFERENCE.fullmatch(value.strip())
        return self.objects.get(int(m[1]), b"") if m else value

    def stream(self, body: bytes) -> bytes:
        m = STREAM.search(body)
        if not m:
            return b""
        head = body[: m.start()]
        if b"/Filter" not in head:
            return m[1]
        filters = re.findall(rb"/(\w+)", self.get(_value(head, b"Filter")))
        if set(filters) - {b"FlateDecode", b"Fl"}:
            raise Unreadable(f"filter: {filters[0].decode('latin-1')}")
        try:
            return zlib.decompressobj().decompress(m[1], MOST_CHARS * 16)
        except zlib.error:
            raise Unreadable("torn-stream") from None

    def pages(self) -> list[bytes]:
        """Bodies of the pages in reading order: along the tree of pages, or as they stand where there is none."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
        out: list[bytes] = []
        todo, seen = [_value(root, b"Pages")], set()
        while todo:
            ref = todo.pop()
            if ref in seen:
                continue
            seen.add(ref)
            body = self.get(ref)
            if re.search(rb"/Type\s*/Pages\b", body):
                todo += reversed([m[0] for m in REFERENCE.finditer(self.get(_value(body, b"Kids")))])
            elif body:
                out.append(body)
        return out or [b for _, b in sorted(self.objects.items()) if re.search(rb"/Type\s*/Page\b(?!s)", b)]


def _bytes(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else PLAIN.get(m[1], m[1]), token[1:-1])


def _mapping(table: bytes) -> tuple[int, list[tuple[int, int, int]], dict[int, bytes]]:
    """(bytes a code, ranges, single codes) of a ToUnicode table; targets in UTF-16."""
    number = lambda x: int(x, 16)
    width = max((len(x) // 2 for x in re.findall(rb"<([0-9A-Fa-f]+)>", table.partition(b"endcodespacerange")[0])), default=1)
    ranges, single = [], {}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", table, re.S):
        ranges += [(number(a), number(b), number(c)) for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]{1,4})>", block)]
        for a, _, items in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*\[(.*?)\]", block, re.S):
            single |= {number(a) + k: bytes.fromhex(x.decode()) for k, x in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", items))}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", table, re.S):
        single |= {number(a): bytes.fromhex(b.decode()) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    return width, ranges, single


def _decoded(raw: bytes, mapping) -> bytes:
    """A shown string as UTF-16."""
    if mapping is None:
        return raw.decode("cp1252", "replace").encode("utf-16-be")
    width, ranges, single = mapping
    out = []
    for at in range(0, len(raw), width):
        code = int.from_bytes(raw[at : at + width], "big")
        to = single.get(code)
        if to is None:
            to = next(((c + code - a).to_bytes(2, "big") for a, b, c in ranges if a <= code <= b), b"")
        out.append(to)
    return b"".join(out)


def page_text(file: File, page: bytes) -> str:
    """The text of a page, a line a line."""
    owner = page
    while b"/Resources" not in owner and (up := file.get(_value(owner, b"Parent"))) and up is not owner:
        owner = up
    at = owner.find(b"/Font", max(0, owner.find(b"/Resources")))
    fonts = owner[at:] if at >= 0 else file.get(_value(owner, b"Resources"))
    if m := re.match(rb"/Font\s+(\d+\s+\d+\s+R)", fonts[fonts.find(b"/Font") :] if b"/Font" in fonts else b""):
        fonts = file.get(m[1])
    mappings = {}
    for name, ref in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+\s+\d+\s+R)", fonts):
        table = _value(file.get(ref), b"ToUnicode")
        mappings[name] = _mapping(file.stream(file.get(table))) if table else None
    content = b"\n".join(file.stream(file.get(m[0])) for m in REFERENCE.finditer(_value(page, b"Contents")))
    lines, stack, mapping = [[]], [], None
    for m in TOKEN.finditer(content):
        token = m[0]
        if not (token[:1].isalpha() or token in (b"'", b'"', b"T*")):
            stack.append(token)
            continue
        if token == b"Tf":
            mapping = next((mappings.get(x[1:]) for x in reversed(stack) if x[:1] == b"/"), None)
        elif token in (b"T*", b"'", b'"') or token == b"Tm" and lines[-1] or token in (b"Td", b"TD") and lines[-1] and stack and float(stack[-1] if re.fullmatch(rb"[-+.\d]+", stack[-1]) else 0):
            lines.append([])
        if token in (b"Tj", b"TJ", b"'", b'"'):
            for x in stack:
                if x[:1] in b"(<":
                    lines[-1].append(_decoded(_bytes(x), mapping))
                elif token == b"TJ" and re.fullmatch(rb"[-+.\d]+", x) and float(x) < -200:
                    lines[-1].append(b"\0 ")
        stack = []
    return "\n".join(b"".join(x).decode("utf-16-be", "surrogatepass") for x in lines).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def pages(data: bytes) -> tuple[list[str], str]:
    """(texts of the pages, problem). What can't be read gives a problem and the pages before it."""
    out: list[str] = []
    try:
        file = File(data)
        for n, page in enumerate(file.pages()):
            if n >= MOST_PAGES or sum(map(len, out)) > MOST_CHARS:
                return out, "too-many-pages" if n >= MOST_PAGES else "too-much-text"
            out.append(page_text(file, page))
    except Unreadable as x:
        return out, str(x)
    except (ValueError, IndexError) as x:
        return out, f"unreadable: {str(x)[:60]}"
    return out, "" if any(t.strip() for t in out) else "no-text-layer"


def page_texts(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, page_no, page_text, problem) of every page of PDF files; a file without a page that can be read has a row of page 0. Null files have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, data in zip(batch[key], batch["_data"], strict=True):
                texts, problem = pages(bytes(data))
                rows += [(k, n, t, problem) for n, t in enumerate(texts, 1)] or [(k, 0, None, problem)]
            yield pd.DataFrame(rows, columns=[key, "page_no", "page_text", "problem"])

    given = files.where(F.col(content).isNotNull()).select(key, F.col(content).alias("_data"))
    return spread(given).mapInPandas(run, f"`{key}` {files.schema[key].dataType.simpleString()}, page_no int, page_text string, problem string")


def written(texts: list[str]) -> bytes:
    """A PDF file with a page a text: two bytes a UTF-16 unit, and a table that says so."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 4 0 R >>"}
    table = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange"
    objects[4] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(table), table)
    kids = []
    for text in texts:
        lines = b" T*\n".join(b"<%s> Tj" % line.encode("utf-16-be", "surrogatepass").hex().encode() for line in text.split("\n"))
        body = zlib.compress(b"BT /F1 12 Tf 72 720 Td 14 TL\n" + lines + b"\nET")
        number = 5 + 2 * len(kids)
        objects[number] = b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (number + 1)
        objects[number + 1] = b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(body), body)
        kids.append(b"%d 0 R" % number)
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(kids))
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in sorted(objects.items())) + b"trailer << /Root 1 0 R >>\n%%EOF\n"
