"""What source text holds: comments, bindings, imports, routes, and the text without its comments."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions import text as tx
from loomfield.session import spread

HASHED = frozenset(("python", "ruby", "shell", "yaml", "toml"))
NESTED = frozenset(("rust", "kotlin", "swift"))

_SLASH_SCAN = re.compile(r"""(?P<string>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?)|(?P<line>//[^\n]*)|(?P<open>/\*)""", re.S)
#: Rust: a single quote begins a character of one place or an escape, or else a lifetime, which is no literal.
_RUST_SCAN = re.compile(r"""(?P<string>"(?:[^"\\]|\\.)*"?|'(?:\\[^']+|[^'\\\n])')|(?P<line>//[^\n]*)|(?P<open>/\*)""", re.S)
_HASH_SCAN = re.compile(r"""(?P<doc>\"{3}(?:.*?)(?:\"{3}|\Z)|'{3}(?:.*?)(?:'{3}|\Z))|(?P<string>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)|(?P<line>\#[^\n]*)""", re.S)


def comment_spans(text: str, language: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of comments, doc strings and string literals; kinds comment, doc and string. Comments nest where
    the language lets them; what is left open goes to the end."""
    out = []
    if language in HASHED:
        for m in _HASH_SCAN.finditer(text):
            kind = {"line": "comment", "doc": "doc", "string": "string"}[m.lastgroup]
            if kind == "doc" and text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip():
                kind = "string"
            out.append((*m.span(), kind))
        return out
    at, scan = 0, _RUST_SCAN if language == "rust" else _SLASH_SCAN
    while m := scan.search(text, at):
        if m.lastgroup == "open":
            depth, end = 1, m.end()
            while depth:
                close, again = text.find("*/", end), text.find("/*", end) if language in NESTED else -1
                if close < 0:
                    end = len(text)
                    break
                if 0 <= again < close:
                    depth, end = depth + 1, again + 2
                else:
                    depth, end = depth - 1, close + 2
            out.append((m.start(), end, "comment"))
            at = end
        else:
            out.append((*m.span(), "comment" if m.lastgroup == "line" else "string"))
            at = m.end()
    return out


_REST = re.compile(r"[^\n]")


def lexed(text: str, language: str) -> str:
    """The text with comments blanked and literals turned into a pair of brackets around s, all lines and places kept: what is left is code,
    and a literal over several lines is inside of a bracket."""
    parts, at = [], 0
    for start, end, kind in comment_spans(text, language):
        parts.append(text[at:start])
        part = text[start:end]
        if kind == "comment":
            parts.append(_REST.sub(" ", part))
        else:
            parts.append(f"[{_REST.sub('s', part[1:-1])}]" if end - start > 1 else "s")
        at = end
    return "".join([*parts, text[at:]])


def without_comments(text: str, language: str) -> str:
    """The text with comments blanked; line breaks stay, so lines keep their numbers."""
    parts, at = [], 0
    for start, end, kind in comment_spans(text, language):
        if kind != "string":
            parts += [text[at:start], re.sub(r"[^\n]", " ", text[start:end])]
            at = end
    return "".join([*parts, text[at:]])


def elided(text: str, language: str) -> str:
    """The text with comments and doc strings of several lines replaced by a mark of their line range."""
    parts, at = [], 0
    for start, end, kind in comment_spans(text, language):
        if kind == "string" or "\n" not in text[start:end]:
            continue
        first = text.count("\n", 0, start) + 1
        mark = f"[lines {first}-{first + text.count(chr(10), start, end)} elided]"
        parts += [text[at:start], f"# {mark}" if language in HASHED else f"/* {mark} */"]
        at = end
    return "".join([*parts, text[at:]])


def shown_lines(displayed: str, first: int, last: int) -> list[tuple[int, int]]:
    """The line ranges of a file that a text with elided comments shows: the inverse of ``elided``."""
    spans, number = [], first
    for line in displayed.split("\n"):
        m = re.search(r"\[lines (\d+)-(\d+) elided\]", line)
        if m:
            number = int(m[2]) + 1
            continue
        if spans and spans[-1][1] == number - 1:
            spans[-1] = (spans[-1][0], number)
        else:
            spans.append((number, number))
        number += 1
    return [(a, min(b, last)) for a, b in spans if a <= last]


def line_kinds(text: str, language: str) -> list[str]:
    """comment, blank or code for each line; a line is a comment if nothing but comment and space is on it."""
    bare = without_comments(text, language).split("\n")
    return ["blank" if not a.strip() else "comment" if not b.strip() else "code" for a, b in zip(text.split("\n"), bare, strict=True)]


def _mapped(df: DataFrame, keys: list[str], text: str, lang: str, fn, out: str, columns: list[str]) -> DataFrame:
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, at = [], []
            for k, (t, g) in enumerate(zip(batch["_text"], batch["_lang"], strict=True)):
                made = fn(t, g)
                rows += made
                at += [k] * len(made)
            own = batch[keys].iloc[at].reset_index(drop=True)
            yield pd.concat([own, pd.DataFrame(rows, columns=columns)], axis=1)

    given = df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text"), F.coalesce(F.col(lang), F.lit("")).alias("_lang"))
    return spread(given).mapInPandas(run, f"{kinds}, {out}")


def kinds_of_lines(df: DataFrame, keys: list[str], text: str, lang: str) -> DataFrame:
    """(keys, code_lines, comment_lines, blank_lines) of each text."""

    def count(t: str, g: str) -> list[tuple[int, int, int]]:
        k = line_kinds(t, g)
        return [(k.count("code"), k.count("comment"), k.count("blank"))]

    return _mapped(df, keys, text, lang, count, "code_lines int, comment_lines int, blank_lines int", ["code_lines", "comment_lines", "blank_lines"])


def stripped(df: DataFrame, keys: list[str], text: str, lang: str) -> DataFrame:
    """(keys, bare_text): each text with its comments blanked."""
    return _mapped(df, keys, text, lang, lambda t, g: [(without_comments(t, g),)], "bare_text string", ["bare_text"])


def segments(df: DataFrame, keys: list[str], text: str, lang: str) -> DataFrame:
    """(keys, line, col_start, col_end, kind): comments, doc strings and literals by line, columns from 0, ends exclusive."""

    def cut(t: str, g: str) -> list[tuple[int, int, int, str]]:
        rows = []
        for start, end, kind in comment_spans(t, g):
            line, at = t.count("\n", 0, start) + 1, start
            for part in t[start:end].split("\n"):
                column = at - (t.rfind("\n", 0, at) + 1)
                if part:
                    rows.append((line, column, column + len(part), kind))
                line, at = line + 1, at + len(part) + 1
        return rows

    return _mapped(df, keys, text, lang, cut, "line int, col_start int, col_end int, kind string", ["line", "col_start", "col_end", "kind"])


def bindings(lines: DataFrame, key: str) -> DataFrame:
    """(key, line, name, value): what lines assign: ``name = value``, ``name: value``, in code and comments, and table rows of two
    cells. Of a name given twice in a file the first counts."""
    bare = F.regexp_replace("text", r"^\s*(?://+|#+|/?\*+|--)\s*", "")
    assign = r"^\s*(?:(?:export|const|let|var|val|final|static|public|private)\s+)*([A-Za-z_][\w.-]*)[\"']?\s*(?::=|=|:)\s*[\"'`]?([^\"'`;,{}()\[\]=]+?)[\"'`]?\s*[;,]?\s*\z"
    row = r"^\s*\|\s*`?([A-Za-z_][\w.-]*)`?\s*\|\s*`?([^|`]+?)`?\s*\|\s*\z"
    name = F.coalesce(F.nullif(F.regexp_extract(bare, row, 1), F.lit("")), F.nullif(F.regexp_extract(bare, assign, 1), F.lit("")))
    value = F.coalesce(F.nullif(F.regexp_extract(bare, row, 2), F.lit("")), F.nullif(F.regexp_extract(bare, assign, 2), F.lit("")))
    found = lines.select(key, "line", F.lower(name).alias("name"), F.trim(value).alias("value")).where("name is not null and value is not null and value <> ''")
    first = found.groupBy(key, "name").agg(F.min_by(F.struct("line", "value"), "line").alias("b"))
    return first.select(key, F.col("b.line").alias("line"), "name", F.col("b.value").alias("value"))


def conflicts(bound: DataFrame, key: str, group: str, most: int = 3) -> DataFrame:
    """(name, values, places): names that different groups of files bind to different values, with one place of each value.

    Bindings are reduced to one row a name, value and group before names are looked at, and no pairs are formed.
    """
    once = bound.groupBy("name", "value", group).agg(F.min(F.struct(F.col(key), F.col("line"))).alias("_place"))
    values = once.groupBy("name", "value").agg(F.min("_place").alias("_place"), F.min(group).alias("_lo"), F.max(group).alias("_hi"))
    by = values.groupBy("name").agg(F.count("*").alias("values"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    clash = by.where((F.col("values") > 1) & (F.col("_lo") != F.col("_hi"))).select("name", "values")
    w = Window.partitionBy("name").orderBy("value")
    firsts = values.join(clash, "name").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return firsts.groupBy("name").agg(F.first("values").alias("values"), F.array_sort(F.collect_list("value")).alias("examples"))


IMPORT = r"^\s*(?:import\b.*?[\"']([^\"']+)[\"']|(?:const|let|var)\s.*?\brequire\(\s*[\"']([^\"']+)[\"']\s*\)|from\s+([\w.]+)\s+import\b|import\s+(?:static\s+)?([\w.*]+)|using\s+(?:static\s+)?([\w.]+)\s*;|use\s+([\w:]+)|#include\s+[\"<]([^\">]+)[\">]|require\s+[\"']([^\"']+)[\"'])"


def imports(lines: DataFrame, key: str, first_lines: int = 60, most: int = 12) -> DataFrame:
    """(key, line, imported): what the first lines of a file import, at most so many."""
    groups = [F.nullif(F.regexp_extract("text", IMPORT, n), F.lit("")) for n in range(1, 9)]
    found = lines.where(F.col("line") <= first_lines).select(key, "line", F.coalesce(*groups).alias("imported")).where("imported is not null")
    w = Window.partitionBy(key).orderBy("line")
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


# Words by which frameworks name methods of requests, and ones that stand for any.
METHODS = frozenset("get post put delete patch head options".split())
ANY_METHOD = frozenset("use all any route request handle handlefunc match".split())
_PATH = r"""\(\s*(?:(?:value|path|name)\s*[=:]\s*)?[\[{]?\s*["'`](?P<path>[^"'`]*)["'`]"""
_VERB = r"(?P<verb>get|post|put|delete|patch|head|options|all|any|use|route|match)"
#: How a declaration of a route begins, by framework, with the confidence in it: what calls it, the verb, and the path in quotes.
ROUTES = (
    ("mark", re.compile(rf"@(?:\w+\.)?(?i:{_VERB}|(?P<request>request))(?:Mapping)?{_PATH}"), 0.9),
    ("mark", re.compile(rf"\[(?:Http)?(?i:{_VERB}){_PATH}"), 0.9),
    ("call", re.compile(rf"(?i)\b(?:app|router|server|api|fastify|blueprint|bp|mux|r|e|g|engine)\.{_VERB}(?:func)?{_PATH}"), 0.9),
    ("call", re.compile(rf"\.(?P<verb>Handle|HandleFunc|GET|POST|PUT|DELETE|PATCH|Get|Post|Put|Delete|Patch){_PATH}"), 0.8),
    ("call", re.compile(rf"(?:\bRoute::|\$(?:app|router)->)(?i:{_VERB}){_PATH}"), 0.9),
    ("block", re.compile(rf"^\s*{_VERB}(?:\s*{_PATH}|\s+[\"'](?P<bare>[^\"']*)[\"'])"), 0.7),
    ("inner", re.compile(r"^\s*(?P<verb>get|post|put|delete|patch|head|options)\s*\{(?P<path>)"), 0.7),
)
CALLBACK = re.compile(r"^\s*,\s*(?:[\w.]+\s*,\s*)*(?:async\s+)?(?:function\s+(?P<named>[A-Za-z_$][\w$]*)|(?P<name>[A-Za-z_$][\w$.:]*)\s*[,)]|function\b|\(|\w+\s*=>|func\b)")
DECLARED = re.compile(r"\b(?:(?:async\s+)?(?:def|func|fun|function)\s+|(?:[\w<>\[\],.?]+\s+)+)(?P<name>[A-Za-z_]\w*)\s*\(")


def routes_of(text: str, language: str = "") -> list[tuple[int, str, str, str, str, float]]:
    """(line, method, route, handler, snippet, confidence) of the HTTP routes that a text declares.

    The path of a block or class of routes goes before those inside of it. The handler is what a call is given by name, or the
    function declared after a mark (annotation, attribute, decorator); '' for one without a name. The snippet is the line.
    Comments are left out, by the literals and comments of the language; without one, by those of languages with braces.
    """
    kept = without_comments(text, language or "typescript").split("\n")
    bare = lexed(text, language or "typescript").split("\n")
    out: list[tuple[int, str, str, str, str, float]] = []
    scopes: list[tuple[int, str]] = []  # depth at which a prefix was opened, prefix
    depth, waiting = 0, ""
    for number, line in enumerate(kept, 1):
        m = kind = None
        for kind, rule, sure in ROUTES:
            if (m := rule.search(line)) and (kind != "inner" or scopes):  # a bare verb is a route only inside of one
                break
            m = None
        opens, closes = bare[number - 1].count("{"), bare[number - 1].count("}")
        own_prefix = ""
        if m:
            verb = (m["verb"] or "request").lower()
            path = next((p for p in (m["path"], m["bare"] if kind == "block" else None) if p is not None), "")
            rest = line[m.end() :]
            nested = verb in ("route", "request") and (kind == "block" and "{" in rest or kind == "mark" and _on_type(kept, number))
            if nested:
                own_prefix = path
            else:
                route = "".join(f"/{p.strip('/')}" for p in [*(p for _, p in scopes), path] if p.strip("/")) or "/"
                method = "ANY" if verb in ANY_METHOD else verb.upper()
                out.append((number, method, route.partition("?")[0], _handler(kind, rest, kept, number), line.strip(), sure))
        if own_prefix and kind == "mark":
            waiting = own_prefix
        if opens:
            for _ in range(opens):
                depth += 1
                prefix = own_prefix if kind == "block" and own_prefix else waiting
                if prefix:
                    scopes.append((depth, prefix))
                    own_prefix = waiting = ""
        for _ in range(closes):
            if scopes and scopes[-1][0] == depth:
                scopes.pop()
            depth -= 1
    return out


def _on_type(lines: list[str], number: int) -> bool:
    """Whether what follows a mark is the declaration of a type."""
    for line in lines[number:]:
        if line.strip() and not line.lstrip().startswith(("@", "[")):
            return re.search(r"\b(?:class|interface|object|record)\b", line) is not None
    return False


def _handler(kind: str, rest: str, lines: list[str], number: int) -> str:
    if kind == "mark":
        for line in lines[number:]:
            if line.strip() and not line.lstrip().startswith(("@", "[")):
                m = DECLARED.search(line)
                return m["name"] if m else ""
        return ""
    m = CALLBACK.match(rest)
    return (m["named"] or m["name"] or "") if m else ""


def routes(files: DataFrame, keys: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """(keys, line, method, route, handler, snippet, confidence): the HTTP routes that texts declare. Null texts have none."""
    names = ["line", "method", "route", "handler", "snippet", "confidence"]
    return _mapped(files, keys, text, lang, routes_of, "line int, method string, route string, handler string, snippet string, confidence double", names)


def css_properties(lines: DataFrame, key: str) -> DataFrame:
    """(key, line, property, value) of custom properties declared in style sheets."""
    pattern = r"(--[A-Za-z_][\w-]*)\s*:\s*([^;}]+)"
    found = lines.select(key, "line", F.regexp_extract("text", pattern, 1).alias("property"), F.trim(F.regexp_extract("text", pattern, 2)).alias("value"))
    return found.where("property <> ''")
