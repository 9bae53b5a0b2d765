"""Symbols of source files: names, kinds, how far they go, what they are declared in, and their documentation.

A file is lexed first, so that comments and literals cannot be taken for code. The tokens of each line that does not begin inside of
parentheses are then read as the head of a declaration by a small grammar: modifiers, then a word that announces a
type, a function or a value, or a type followed by a name and a parameter list. A symbol goes as far as the brackets
opened since its head stay open, or, where blocks are told by indentation, as far as lines are indented more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.functions import paths
from loomfield.operators.source import lexed
from loomfield.session import spread

# Words of the languages.
MODIFIERS = frozenset(
    "abstract async companion const constexpr data declare default explicit export extern final friend infix inline inner internal native noexcept open operator override partial private protected pub public readonly sealed static strictfp suspend synchronized tailrec unsafe virtual".split()
)
TYPES = {"class": "class", "struct": "class", "record": "class", "object": "class", "union": "class", "module": "class", "interface": "interface", "trait": "interface", "protocol": "interface", "enum": "enum", "type": "type", "typealias": "type"} | {"namespace": "namespace"}
FUNCTIONS = frozenset("function func fn fun def sub".split())
VALUES = {"const": "const", "let": "let", "var": "var", "val": "const", "static": "const"}
#: Words that begin statements, so that what stands before a parenthesis after them is no declared name.
STATEMENTS = frozenset("assert await break case catch continue delete do else elif elsif except finally for foreach goto if import in instanceof new package return sizeof switch throw try typeof unless until using while with yield require".split())
MORE_STATEMENTS = {"go": "go defer select range", "rust": "match loop use unsafe", "kotlin": "when", "csharp": "lock fixed checked", "php": "echo print use", "ruby": "when raise puts print and or not"}
#: Which of these words a language has; others it has not would be plain names there.
TYPE_WORDS = {
    "typescript": "class interface enum type namespace module", "javascript": "class", "python": "class", "go": "type", "rust": "struct enum trait union type", "java": "class interface enum record",
    "kotlin": "class interface object enum typealias", "csharp": "class interface struct enum record namespace", "cpp": "class struct union enum namespace", "c": "struct union enum", "php": "class interface trait enum", "ruby": "class module",
}
FUNCTION_WORDS = {"typescript": "function", "javascript": "function", "python": "def", "go": "func", "rust": "fn", "kotlin": "fun", "php": "function", "ruby": "def"}
VALUE_WORDS = {"typescript": "const let var", "javascript": "const let var", "go": "const var", "rust": "const static", "kotlin": "const val var", "php": "const"}
#: Languages that declare functions by a type, a name and parameters.
TYPED = frozenset(("java", "csharp", "cpp", "c"))
#: Languages whose methods stand in their type by name alone.
BARE = frozenset(("typescript", "javascript", "java", "csharp", "cpp"))
INDENTED = frozenset(("python",))
SAME = {"typescriptreact": "typescript", "javascriptreact": "javascript", "vue": "typescript", "jsp": "java"}

TOKEN = re.compile(r"[A-Za-z_$][\w$]*|::|=>|->|:=|[^\s\w]|\d[\w.]*")
NAME = re.compile(r"[A-Za-z_$][\w$]*\Z")
CLOSING = {"(": ")", "[": "]", "<": ">", "{": "}"}


def _past(tokens: list[str], at: int) -> int:
    """The place behind the bracket that opens at ``at``; the end if it is left open."""
    close, depth = CLOSING[tokens[at]], 0
    for k in range(at, len(tokens)):
        depth += (tokens[k] == tokens[at]) - (tokens[k] == close)
        if not depth:
            return k + 1
    return len(tokens)


def _modifiers(tokens: list[str], values: frozenset[str]) -> int:
    """How many tokens annotations and modifiers take up."""
    at = 0
    while at < len(tokens):
        word = tokens[at]
        if word == "@" and at + 1 < len(tokens):
            at += 2
            while tokens[at : at + 1] == ["."]:
                at += 2
            at = _past(tokens, at) if tokens[at : at + 1] == ["("] else at
        elif word == "#" and tokens[at + 1 : at + 2] == ["["]:
            at = _past(tokens, at + 1)
        elif word == "[":
            at = _past(tokens, at)
        elif word == "template" and tokens[at + 1 : at + 2] == ["<"]:
            at = _past(tokens, at + 1)
        elif word in MODIFIERS and not (word in values and tokens[at + 1 : at + 2] and NAME.match(tokens[at + 1]) and tokens[at + 2 : at + 3] and tokens[at + 2] in "=:<"):
            at += 1
            if word == "pub" and tokens[at : at + 1] == ["("]:
                at = _past(tokens, at)
        else:
            break
    return at


def head(line: str, language: str, inside: bool, top: bool) -> tuple[str, str] | None:
    """(name, kind) of what a lexed line declares, or None. ``inside``: right in the body of a type; ``top``: outside of all bodies.

    Kinds: function, method, class, interface, type, enum, const, let, var; and scope, the body of a type declared elsewhere.
    """
    tokens = TOKEN.findall(line)
    words = lambda table: frozenset(table.get(language, "").split())
    values, never = words(VALUE_WORDS), STATEMENTS | words(MORE_STATEMENTS)
    at = _modifiers(tokens, values)
    rest = tokens[at:]
    if len(rest) < 2:
        return None
    word, name, after = rest[0], rest[1], rest[2] if len(rest) > 2 else ""
    own = "method" if inside else "function"
    if language == "rust" and word == "impl":
        k = _past(rest, 1) if name == "<" else 1
        owner = rest[rest.index("for") + 1 :] if "for" in rest else rest[k:]
        return (owner[0], "scope") if owner and NAME.match(owner[0]) else None
    if word in words(TYPE_WORDS):
        if name in ("class", "struct") and NAME.match(after):  # enum class
            name, after = after, rest[3] if len(rest) > 3 else ""
        if not NAME.match(name) or name in never:
            return None
        if word == "type":
            kind = {"struct": "class", "interface": "interface"}.get(after, "type") if language == "go" else "type"
            return (name, kind) if language == "go" and after not in ("", "=", "(", ".") or after in ("=", "<") else None
        if after in ("", "{", ":", "<", "(", ";", ".", "::", ",", "final", "extends", "implements", "permits", "where", "private", "internal") and not (after == "(" and language in ("javascript", "typescript")) and not (after in (".", "::", ",") and language not in ("csharp", "ruby", "cpp")):
            return name, TYPES[word]
    if word in words(FUNCTION_WORDS):
        k, receiver = 1, False
        while k < len(rest) and rest[k] in ("*", "&"):
            k += 1
        if k < len(rest) and rest[k] == "(" and language == "go":
            k, receiver = _past(rest, k), True
        if k < len(rest) and rest[k] == "<":
            k = _past(rest, k)
        while k + 2 < len(rest) and rest[k + 1] == ".":
            k, receiver = k + 2, language != "ruby" or inside
        if k < len(rest) and NAME.match(rest[k]):
            mark = rest[k + 1] if k + 1 < len(rest) else ""
            end = mark if language == "ruby" and mark in ("?", "!") and not re.search(rf"{re.escape(rest[k])}\s", line) else ""
            if language == "ruby" or mark in ("(", "<", "["):
                return rest[k] + end, "method" if receiver else own
        return None
    if word in values or tokens[at - 1 : at] and tokens[at - 1] in values:
        word, place = (word, 1) if word in values else (tokens[at - 1], 0)
        place += rest[place] in ("mut", "val", "var")
        name, value = rest[place], rest[place + 1 :]
        if not NAME.match(name) or name in never or not ("=" in value or ":" in value[:1]):
            return None
        made = value[value.index("=") + 1 :] if "=" in value else []
        if "function" in made[:2] or "=>" in made:
            return name, "function"
        return (name, VALUES[word]) if top else None
    if language in TYPED and (found := _typed(tokens, at, never, inside)):
        return found
    if word in ("get", "set") and NAME.match(name):  # accessors
        rest, word, name = rest[1:], name, after
    if inside and language in BARE and NAME.match(word if word != "~" else name) and word not in never and "(" in rest[1:3]:
        tail = rest[_past(rest, rest.index("(")) :]
        if "{" in tail or not tail and language in ("csharp", "cpp") or tail[-1:] == [";"] and language in ("typescript", "cpp"):
            return word if word != "~" else name, "method"
    return None


def _typed(tokens: list[str], at: int, never: frozenset[str], inside: bool) -> tuple[str, str] | None:
    """A type, a name and parameters, and behind these what can only follow a declaration."""
    if "(" not in tokens[at:]:
        return None
    k = tokens.index("(", at)
    made = tokens[at : k - 1] if k > at else []
    name = tokens[k - 1] if k > at else ""
    qualified = bool(made) and made[-1] == "::"
    if not made or not NAME.match(name) or name in never or made[0] in never or not (NAME.match(made[0]) or made[0] == "~"):
        return None
    if any(not NAME.match(t) and t not in "<>,.?&*:[]~" and t != "::" or t in never for t in made) or made[-1] in (".", "?", ",", "<"):
        return None
    tail = tokens[_past(tokens, k) :]
    if not tail or tail[0] in ("{", ":", "const", "noexcept", "override", "final", "throws", "where", "->"):
        return name, "method" if inside or qualified else "function"
    if tail[0] in (";", "=>", "=") and (inside or at):
        return name, "method" if inside or qualified else "function"
    return None


COMMENT_MARKS = re.compile(r"^\s*(?:/\*+!?|\*+/|///?!?|\*(?!/)|#+(?!\[))?\s?|\s*\*+/\s*$")


def _documentation(raw: list[str], bare: list[str], depths: list[int], at: int, language: str) -> str | None:
    """The comment lines right above a line, annotations aside, without their marks; in Python the string that begins the body."""
    if language in INDENTED:
        base, k = depths[at - 1] if at else 0, at
        while k < len(bare) and depths[k] > base:
            k += 1
        k = next((n for n in range(k + 1, len(bare)) if bare[n].strip()), len(bare))
        if k < len(bare) and bare[k].lstrip().startswith("[s"):
            end = next((n for n in range(k, len(bare)) if depths[n] <= base), len(bare) - 1)
            text = "\n".join(x.strip() for x in raw[k : end + 1])
            return re.sub(r"\A[rRuUbB]*(?:\"{3}|'{3}|\"|')\s*|\s*(?:\"{3}|'{3}|\"|')\Z", "", text).strip() or None
    k = at - 1
    while k >= 0 and bare[k].strip()[:1] in ("@", "[", "#") and bare[k].strip()[-1:] not in ("{", ";"):
        k -= 1
    found = []
    while k >= 0 and raw[k].strip() and not bare[k].strip():
        found.append(COMMENT_MARKS.sub("", raw[k]).strip())
        k -= 1
    return "\n".join(x for x in reversed(found) if x) or None


def _ends(bare: list[str], depths: list[int], language: str, at: int) -> int:
    """The last line, from 1, of a declaration whose head is line ``at``, from 0. ``depths``: open brackets behind each line."""
    base = depths[at - 1] if at else 0
    total = len(bare)
    if language in INDENTED:
        indent = len(bare[at]) - len(bare[at].lstrip())
        last, k = at, at
        while k < total:
            open_before = depths[k - 1] > base if k else False
            if k > at and bare[k].strip() and not open_before and len(bare[k]) - len(bare[k].lstrip()) <= indent:
                break
            last = k if bare[k].strip() else last
            k += 1
        return last + 1
    if language == "ruby":
        if re.search(r"\bend\s*\Z", bare[at]):
            return at + 1
        indent = len(bare[at]) - len(bare[at].lstrip())
        for k in range(at + 1, total):
            if bare[k].strip() and len(bare[k]) - len(bare[k].lstrip()) <= indent:
                return k + 1 if re.match(r"\s*end\b", bare[k]) else k
        return total
    opened = False
    for k in range(at, total):
        opened = opened or "{" in bare[k]
        if depths[k] <= base:
            follows = next((x for x in bare[k + 1 :] if x.strip()), "") if not opened else ""
            if not follows.lstrip().startswith("{"):
                return k + 1
    return total


def extract(text: str, language: str) -> list[tuple[str, str, int, int, str, str | None, str | None]]:
    """(name, kind, line, end line, signature, enclosing, doc) of each declaration, one a line at most, by line.

    ``signature`` is the head's line; ``enclosing`` the name of the innermost declaration around it; ``doc`` the comment right above.
    All line ends count; a declaration that the text leaves open goes to its end.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    language = SAME.get(language, language)
    bare = lexed(text, language).split("\n")
    raw = text.split("\n")
    depths, starts, stack, depth = [], [], [], 0
    for line in bare:
        starts.append(stack[-1] if stack else "")
        for c in re.findall(r"[(){}\[\]]", line):
            if c in "({[":
                stack.append(c)
                depth += 1
            else:
                depth -= 1
                if stack:
                    stack.pop()
        depths.append(depth)
    out: list[tuple[str, str, int, int, str, str | None, str | None]] = []
    open_: list[tuple[str, str, int, int]] = []  # name, kind, last line, depth within
    for at, line in enumerate(bare):
        if starts[at] in ("(", "[") or not line.strip():
            continue
        while open_ and open_[-1][2] <= at:
            open_.pop()
        before = depths[at - 1] if at else 0
        around = open_[-1] if open_ else None
        by_indent = language in INDENTED or language == "ruby"
        inside = bool(around) and around[1] in ("class", "interface", "enum", "scope") and (by_indent or before == around[3])
        found = head(line, language, inside, not open_ and before == 0 and line[:1] not in " \t")
        if not found:
            continue
        name, kind = found
        end = _ends(bare, depths, language, at)
        if kind != "scope":
            out.append((name, "class" if kind == "namespace" else kind, at + 1, end, raw[at].strip(), around[0] if around else None, _documentation(raw, bare, depths, at, language)))
        if end > at + 1:
            open_.append((name, kind, end, before + 1))
    return out


def kind_of(signature: Column) -> Column:
    """class, type, const or function, as the first word of a signature that announces a declaration tells; parameters and values have no say."""
    words = F.split(F.regexp_extract(signature, r"^[^(={]*", 0), r"[^A-Za-z0-9_$]+")
    said = F.filter(words, lambda w: w.isin("class", "struct", "interface", "enum", "trait", "record", "object", "module", "union", "namespace", "type", "typealias", "const", "let", "var", "val", "function", "func", "fn", "fun", "def"))
    first = F.get(said, F.lit(0))
    made = signature.rlike(r"=>|\bfunction\b")
    return F.when(first.isin("type", "typealias"), F.when(signature.rlike(r"\b(?:struct|interface)\b"), "class").otherwise("type")).when(first.isin("const", "let", "var", "val") & ~made, "const").when(first.isin("const", "let", "var", "val", "function", "func", "fn", "fun", "def"), "function").when(first.isNotNull(), "class").otherwise("function")


def symbols(files: DataFrame, path: str = "path", content: str = "content", language: Column | None = None) -> DataFrame:
    """(path, name, kind, line, end_line, signature, enclosing, doc, position): every declaration; position orders them within a file.

    Null and empty content gives none. One pass without a shuffle.
    """
    lang = language if language is not None else F.coalesce(paths.language(F.regexp_replace(path, r"@\d+\z", "")), F.lit("default"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, n, *s) for p, t, g in zip(batch["path"], batch["_text"], batch["_lang"], strict=True) for n, s in enumerate(extract(t, g))]
            yield pd.DataFrame(rows, columns=["path", "position", "name", "kind", "line", "end_line", "signature", "enclosing", "doc"])

    given = files.where(F.col(content).isNotNull()).select(F.col(path).alias("path"), F.col(content).alias("_text"), lang.alias("_lang"))
    return spread(given).mapInPandas(run, "path string, position bigint, name string, kind string, line bigint, end_line bigint, signature string, enclosing string, doc string")


def chunks(files: DataFrame, path: str = "path", content: str = "content", size: int = 1600) -> DataFrame:
    """(path, chunk_no, byte_start, byte_end, tokens, chunk_id): a text in slices of ``size`` bytes. An empty text has none."""
    n = F.octet_length(content)
    at = files.where(n > 0).select(F.col(path).alias("path"), n.cast("bigint").alias("_n"), F.posexplode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1, F.lit(size).cast("bigint"))).alias("chunk_no", "byte_start"))
    cut = at.withColumn("byte_end", F.least(F.col("byte_start") + size, F.col("_n")))
    tokens = F.greatest(F.lit(1).cast("bigint"), F.ceil((F.col("byte_end") - F.col("byte_start")) / 4).cast("bigint"))
    return cut.select("path", (F.col("chunk_no") + 1).alias("chunk_no"), "byte_start", "byte_end", tokens.alias("tokens"), F.sha2(F.concat_ws("\0", "path", F.col("byte_start").cast("string"), F.col("byte_end").cast("string"), F.lit("text")), 256).alias("chunk_id"))


def line_offsets(lines: DataFrame) -> DataFrame:
    """(path, line, byte_start): where each line begins, with one byte for each line end."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select("path", "line", F.coalesce(F.sum(F.octet_length("text") + 1).over(w), F.lit(0)).alias("byte_start"))
