"""Edits of texts as pure functions, and over tables: all or nothing."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomfield.operators.source import comment_spans
from loomfield.session import spread


def _plain(text: str) -> str:
    return unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n"))


def _ends(text: str) -> str:
    crlf = text.count("\r\n")
    return "\r\n" if crlf and crlf * 2 >= text.count("\n") else "\r" if "\r" in text and "\n" not in text else "\n"


def unescaped(text: str) -> str:
    r"""A text whose \n, \t, \r and \\ are written out, read as what they stand for."""
    return re.sub(r"\\([ntr\\])", lambda m: {"n": "\n", "t": "\t", "r": "\r", "\\": "\\"}[m[1]], text)


def indentation_match(text: str, search: str) -> tuple[int, int] | None:
    """(start, end) of the only block of lines that equals the search but for tabs and spaces around its lines."""
    lines, wanted = text.split("\n"), [x.strip(" \t") for x in search.strip("\n").split("\n")]
    if not any(wanted):
        return None
    bare = [x.strip(" \t") for x in lines]
    hits = [n for n in range(len(lines) - len(wanted) + 1) if bare[n : n + len(wanted)] == wanted]
    if len(hits) != 1:
        return None
    start = sum(len(x) + 1 for x in lines[: hits[0]])
    return start, start + sum(len(x) + 1 for x in lines[hits[0] : hits[0] + len(wanted)]) - 1


def apply_edit(text: str, search: str, replace: str) -> tuple[bool, str, str]:
    """(ok, code, text): the only match of a search replaced; line ends stay those of the text.

    Where there is no match, the search is tried with its escapes read, and then by lines but for their indentation.
    """
    ends, body, s, r = _ends(text), _plain(text), _plain(search), _plain(replace)
    if not s:
        return False, "empty-search", text
    n = body.count(s)
    if n == 0 and "\\" in s and body.count(unescaped(s)) == 1:
        s, r, n = unescaped(s), unescaped(r), 1
    if n > 1:
        return False, "ambiguous", text
    if n == 1:
        out = body.replace(s, r, 1)
    elif place := indentation_match(body, s):
        out = body[: place[0]] + r.strip("\n") + body[place[1] :]
    else:
        return False, "not-found", text
    return True, "", out.replace("\n", ends) if ends != "\n" else out


def line_delta(old: str, search: str, replace: str) -> tuple[int, int, int] | None:
    """(first line, removed, added) of an edit; None if the search does not occur."""
    at = old.find(search)
    if at < 0:
        return None
    count = lambda t: 0 if not t else t.count("\n") + (not t.endswith("\n"))
    return old.count("\n", 0, at) + 1, count(search), count(replace)


def replace_range(text: str, start: int, end: int, content: str) -> tuple[bool, str, str]:
    """(ok, code, text): lines start..end replaced; out of bounds is refused; line ends stay."""
    ends = _ends(text)
    lines = _plain(text).split("\n")
    total = len(lines) - (lines[-1] == "" and len(lines) > 1)
    if not 1 <= start <= end <= total:
        return False, "out-of-bounds", text
    new = _plain(content).removesuffix("\n").split("\n") if content else []
    out = "\n".join(lines[: start - 1] + new + lines[end:])
    return True, "", out.replace("\n", ends) if ends != "\n" else out


def blast_radius(text: str, start: int, end: int, replacement: str) -> tuple[bool, float, float]:
    """(too large, share removed, share replaced): a text of more than 200 characters that shrinks by over half or is replaced by over 0.9."""
    size = max(1, len(text))
    shrink, replaced = max(0, end - start - len(replacement)) / size, (end - start) / size
    return size > 200 and (shrink > 0.5 or replaced > 0.9), shrink, replaced


def rename(text: str, old: str, new: str, language: str) -> tuple[str, int]:
    """(text, times): a whole word renamed outside of comments and string literals."""
    word = re.compile(rf"(?<![A-Za-z0-9_$]){re.escape(old)}(?![A-Za-z0-9_$])")
    out, at, n = [], 0, 0
    for start, end, _ in [*comment_spans(text, language), (len(text), len(text), "")]:
        part, k = word.subn(lambda _: new, text[at:start])
        out += [part, text[start:end]]
        at, n = end, n + k
    return "".join(out), n


def append_member(text: str, name: str, member: str) -> str | None:
    """The text with a member added at the end of an enum's braces or of a union of literals; None if there is no such type or the member is
    there already."""
    m = re.search(rf"\benum\s+(?:class\s+)?{re.escape(name)}\b[^{{]*\{{([^}}]*)\}}", text)
    if m:
        body = m[1]
        if re.search(rf"(?<![\w]){re.escape(re.split(r'[\s=,]', member)[0])}(?![\w])", body):
            return None
        last = body.rstrip()
        tail = body[len(last) :]
        indent = (re.search(r"\n([ \t]*)\S[^\n]*\Z", last) or [None, " "])[1]
        comma = "" if last.endswith(",") or not last.strip() else ","
        glue = "\n" + indent if "\n" in body else " "
        return text[: m.start(1)] + last + comma + glue + member + ("," if last.endswith(",") else "") + tail + text[m.end(1) :]
    m = re.search(rf"\btype\s+{re.escape(name)}\b[^=]*=\s*([^;]*?)\s*;", text)
    if not m or re.search(rf"(?<![\w\"']){re.escape(member)}(?![\w\"'])", m[1]):
        return None
    glue = "\n" + re.search(r"\n([ \t]*)\|", m[1])[1] + "| " if re.search(r"\n[ \t]*\|", m[1]) else " | "
    return text[: m.end(1)] + glue + member + text[m.end(1) :]


def duplicate_branches(text: str) -> list[tuple[int, int]]:
    """(line, line) of each else-if whose filled body equals that of the branch right before it, lines trimmed."""
    heads = re.compile(r"^(\s*)(?:\}\s*)?(?:else\s+)?if\s*\(.*\)\s*\{\s*$")
    lines = text.split("\n")
    found, last = [], None
    for n, line in enumerate(lines):
        m = heads.match(line)
        if not m:
            continue
        indent, body = m[1], []
        for inner in lines[n + 1 :]:
            if inner.startswith(indent + "}") and not inner[len(indent) + 1 : len(indent) + 2].strip("; elsif{("):
                break
            body.append(inner.strip())
        bare = [b for b in body if b]
        if last and re.match(r"^\s*\}?\s*else\s+if", line) and bare and bare == last[1]:
            found.append((last[0], n + 1))
        last = (n + 1, bare)
    return found


def nearest_line(text: str, search: str, context: int = 3) -> tuple[int, int, str]:
    """(line, lines present, excerpt): the first line that equals the search's first one but for white space, else 1; how many of the search's lines
    the text has; and what stands around."""
    squeeze = lambda x: re.sub(r"\s+", " ", x).strip()
    lines, wanted = text.split("\n"), [w for x in search.split("\n") if (w := squeeze(x))]
    bare = [squeeze(x) for x in lines]
    at = next((n for n, x in enumerate(bare) if wanted and x == wanted[0]), 0)
    present = len({*wanted} & {*bare})
    return at + 1, present, "\n".join(lines[max(0, at - context) : at + context + 1])


def of_each(texts: DataFrame, keys: list[str], text: str, fn: Callable[[str], tuple], out: str) -> DataFrame:
    """(keys, out): what a pure function of this module gives for each text; null texts are left out. ``out``: its columns, as DDL."""
    kinds = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)
    names = StructType.fromDDL(out).fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = pd.DataFrame([fn(t) for t in batch["_text"]], columns=names)
            yield pd.concat([batch[keys].reset_index(drop=True), made], axis=1)

    return spread(texts.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text"))).mapInPandas(run, f"{kinds}, {out}")


def edited(texts: DataFrame, edits: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """(key, ok, code, content) of each text with edits (key, edit_no, search, replace), applied in order; a text whose edit fails stays.

    Edits of a text are few and are put beside it, so a text is read once.
    """
    own = edits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("edit_no", "search", "replace"))).alias("_edits"))  # what is asked for one text
    joined = texts.select(key, F.col(text).alias("_text")).join(own, key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, body, steps in zip(batch[key], batch["_text"], batch["_edits"], strict=True):
                ok, code, out = body is not None, "" if body is not None else "no-text", body
                for s in steps if ok else ():
                    ok, code, out = apply_edit(out, s["search"], s["replace"])
                    if not ok:
                        out = body
                        break
                rows.append((k, ok, code, out))
            yield pd.DataFrame(rows, columns=[key, "ok", "code", "content"])

    return joined.mapInPandas(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, ok boolean, code string, content string")


def all_or_nothing(results: DataFrame, target: str) -> bool:
    """Writes edited texts as a new version, unless any edit failed; whether it did. A target that exists is refused by Spark."""
    if results.where("not ok").limit(1).count():
        return False
    results.select([c for c in results.columns if c not in ("ok", "code")]).write.mode("errorifexists").parquet(target)
    return True
