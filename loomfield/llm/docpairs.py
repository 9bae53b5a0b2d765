"""Functions paired with their documentation (problem 5).

Lines are read once; a run of comment lines, with decorators or annotations after it, makes the next line a candidate. The
candidate's tokens become a string of token classes, which a generalised LL parser with a graph-structured stack
reads by a small grammar of function heads for the language's family. The grammar recovers from errors: what stands in
brackets and between the parameters and the body may be anything balanced, heads may stop where the window stops, and
everything outside of heads is never parsed, so broken files give their whole functions. As heads of the same shape have
the same class string, each shape is parsed once in each worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.llm.gll import Grammar, Parse
from loomfield.session import spread

FAMILY = {"py": "py", "python": "py", "rb": "rb", "ruby": "rb"} | dict.fromkeys("ts tsx js jsx mjs cjs javascript typescript java cs csharp cpp cc cxx c h hpp go rs rust kt kotlin swift scala php dart m".split(), "c")
FAMILY |= dict.fromkeys("sh bash zsh shell pl pm perl r ex exs elixir jl julia".split(), "sh") | dict.fromkeys("lua sql plsql pgsql hs elm".split(), "lua")
#: What holds no functions: text, markup, data and settings.
NO_CODE = frozenset("md mdx markdown txt text rst json jsonl yaml yml toml xml html htm css scss less csv tsv ini cfg conf properties env lock log svg".split())
EXTENSION = re.compile(r"\.(\w+)\Z")

# Token classes, one character each.
KEYWORDS = (
    dict.fromkeys("function func fn fun def".split(), "f")
    | dict.fromkeys("export default async static public private protected internal final abstract override virtual inline extern unsafe suspend open synchronized native constexpr friend explicit readonly sealed partial pub move operator get set local mutating tailrec infix data".split(), "k")
    | dict.fromkeys("const let var val auto".split(), "c")
    | dict.fromkeys("if else for while switch case return throw new catch do try import package using use require await yield match loop when with in elsif unless until begin end class interface struct enum namespace module trait impl type object goto delete typeof raise except finally pass break continue from assert del global lambda and or not".split(), "x")
)
TOKEN = re.compile(r"""\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<name>[^\W\d][\w$]*[?!]?(?![\w(])|[^\W\d][\w$]*|[$~][\w$]+)|(?P<number>\d[\w.]*)|(?P<string>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?)|(?P<sign>=>|->|::|[^\w\s])""", re.S)
BRACKETS = {"(": ")", "[": "]", "{": "}"}
SIGNS = {"=>": "a", "->": "r", "::": "."}

_BALANCED = {
    "Inside": [(), ("Piece", "Inside")],
    "Piece": [('"^()[]{}$"',), ('"("', "Inside", '")"'), ('"["', "Inside", '"]"'), ('"{"', "Inside", '"}"')],
    "List": [('"("', "Inside", '")"')],
    "Open": [("List",), ('"("', "Inside")],
}
#: Heads of languages with braces. Type and name are both names: which is which is left to the parser.
BRACES: Grammar = _BALANCED | {
    "Head": [
        ("Mods", '"f"', "Receiver", "Name", "Generic", "Open", "Tail", "Body"),
        ("Mods", '"f"', "Star", "Name", "Generic", "Open", "Tail", "Body"),
        ("Mods", "Type", "Name", "Generic", "List", "Tail", '"{a"'),
        ("Mods", "Star", "Name", "Generic", "List", "Tail", '"{"'),
        ("Mods", '"c"', "Name", "Annotation", '"="', "Mods", "Value"),
        ("Mods", "Name", '":="', "Mods", '"f"', "Star", "List", "Tail", '"{$"'),
    ],
    "Value": [('"f"', "Star", "Maybe", "Generic", "List", "Tail", '"{$"'), ("Generic", "List", "Tail", '"a$"'), ('"n"', '"a"')],
    "Maybe": [(), ('"n"',)],
    "Annotation": [(), ('":"', "Type"), ('":"', "List", '"a"', "Type")],
    "Mods": [(), ('"kc"', "Mods"), ('"k"', "List", "Mods"), ('"n"', '"s"', "Mods")],
    "Receiver": [(), ("List",), ("Type", '"."')],
    "Star": [(), ('"*"',)],
    "Name": [('"n~"',), ('"kf"',)],
    "Generic": [(), ('"<"', "Angles", '">"')],
    "Angles": [(), ('"^<>(){}$"', "Angles"), ('"<"', "Angles", '">"', "Angles"), ('"("', "Inside", '")"', "Angles")],
    "Type": [("Simple",), ("Type", '"."', "Simple"), ("Type", '"*&?"'), ("Type", '"["', "Inside", '"]"'), ('"c"', "Type"), ("Type", '"."')],
    "Simple": [('"n"', "Generic")],
    "Tail": [(), ("More", "Tail")],
    "More": [('"nkc:.<>,*&?r|fsd~@"',), ("List",), ('"["', "Inside", '"]"')],
    "Body": [('"{"',), ('"="',), ('"a"',), ('"$"',)],
}
INDENT: Grammar = _BALANCED | {
    "Head": [("Mods", '"f"', "Name", "Generic", "Open", "Tail", '":$"')],
    "Mods": [(), ('"k"', "Mods")],
    "Name": [('"nkcfx"',)],
    "Generic": [(), ('"["', "Inside", '"]"')],
    "Tail": [(), ('"r"', "Shape")],
    "Shape": [('"ns.|"',), ('"ns.|"', "Shape"), ('"["', "Inside", '"]"'), ('"["', "Inside", '"]"', "Shape")],
}
RUBY: Grammar = _BALANCED | {
    "Head": [("Mods", '"f"', "Owner", "Name"), ("Mods", '"f"', "Owner", "Name", "List")],
    "Mods": [(), ('"kn"', "Mods")],
    "Owner": [(), ('"nkx"', '"."')],
    "Name": [('"nkcx"',)],
}
#: Languages that announce functions by a word or a shell's empty brackets, and close them by a word, a brace, or not at all.
SCRIPTS: Grammar = _BALANCED | {
    "Head": [("Mods", '"f"', "Owner", "Name"), ("Mods", '"f"', "Owner", "Name", "List"), ("Mods", '"f"', "Owner", "Name", '"{"'), ("Mods", '"f"', "Owner", "Name", "List", '"{"'), ("Name", "List", '"{"'), ("Name", "Arrow", '"f"', "List")],
    "Mods": [(), ('"kn"', "Mods")],
    "Owner": [(), ('"n"', '".:"', "Owner")],
    "Name": [('"nkcx"',)],
    "Arrow": [('"="',), ('"<"', '"o"')],
}
GRAMMARS = {"c": BRACES, "py": INDENT, "rb": RUBY, "sh": SCRIPTS, "lua": SCRIPTS}
#: Words of single families beside those of all.
OWN_KEYWORDS = {"sh": dict.fromkeys("sub defp defmacro".split(), "f"), "lua": dict.fromkeys("procedure PROCEDURE FUNCTION".split(), "f")}
#: How comment lines begin in each family.
LINE_COMMENT = {"c": "//", "py": "#", "rb": "#", "sh": "#", "lua": "--"}

#: How a line goes on that belongs to the head whose parameters ended on the line before.
GOES_ON = re.compile(r"[{\-=:,.?&|)]|(?:where|throws|noexcept|const|override|final|requires)\b|/[/*]|\Z")


@lru_cache(maxsize=50_000)
def named_at(family: str, classes: str) -> int:
    """Which token is the name of the function whose head these classes begin with; -1 if they are none."""
    found = Parse(GRAMMARS[family], "Head", classes).find("Name")
    return found[0] if found else -1


def head(text: str, at: int, family: str) -> tuple[str, int] | None:
    """(name, where the head ends) of the function whose head begins at ``at``, or None.

    What stands in brackets is checked for its balance here and left out of the classes, so heads of any length have short ones.
    """
    classes: list[str] = []
    spans: list[tuple[int, int]] = []
    opened: list[str] = []
    ended = True
    own = OWN_KEYWORDS.get(family, {})
    by_line = family in ("rb", "sh", "lua")
    for m in TOKEN.finditer(text, at):
        kind = m.lastgroup
        if kind is None:
            if by_line and not opened and "\n" in m.group() and classes:
                ended = False
                break
            if family == "c" and not opened and classes and classes[-1] == ")" and "\n" in m.group() and not GOES_ON.match(text, m.end()):
                ended = False
                break
            continue
        word = m.group()
        if family != "c" and not opened and (word == "#" or family == "lua" and word == "-" and text[m.end() : m.end() + 1] == "-"):
            ended = False
            break
        if opened:
            if word in BRACKETS:
                opened.append(word)
            elif word in ")]}":
                if BRACKETS[opened.pop()] != word:
                    return None
                if not opened:
                    classes.append(word)
                    spans.append(m.span())
            continue
        if kind == "name":
            c = own.get(word) or KEYWORDS.get(word, "n")
        elif kind == "number":
            c = "d"
        elif kind == "string":
            c = "s"
        else:
            c = SIGNS.get(word, word if word in "()[]{}<>.,:;=*&?|~@" else "o")
        if c == ";":
            ended = False
            break
        classes.append(c)
        spans.append(m.span())
        if c == "{" or family == "py" and c == ":" or c == "a":
            ended = False
            break
        if c in "([":
            opened.append(c)
        if len(classes) == 1 and c in "x})]s;d":
            return None
    if not classes:
        return None
    shape = "".join(classes) + ("$" if ended else "")
    name = named_at(family, shape)
    return (text[slice(*spans[name])], spans[-1][1]) if name >= 0 else None


MARKS = re.compile(r"^\s*(?:/\*+!?|\*+/|///?!?|//|\*+(?!/)|#+(?!\[)|--|;+|<!--)?\s?|\s*(?:\*+/|-->)\s*$")
BARE = re.compile(r"^[\s*/#=~_+.\-–—!<>]*$")
# How documentation tags and the switches of tools begin.
TAG = re.compile(r"(?i)^\s*(?:[@\\][a-z][\w-]*\b|:(?:param|parameter|arg|argument|key|keyword|type|raises?|returns?|rtype|yields?|var|ivar|cvar|meta|class|func|ref)\b[^:]*:|</?(?:param|returns?|remarks|value|exception|typeparam|see|seealso|inheritdoc|example|code)\b|(?:args|arguments|parameters|params|returns|raises|yields|throws|example|examples|usage)\s*:\s*$|-\s*(?:parameter|returns)\b)")
XML = re.compile(r"</?(?:summary|para|c|b|i|p|br|em|strong|list|item|description)\b[^>]*>")
SWITCH = re.compile(r"(?i)^\s*(?:eslint|tslint|jshint|jslint|prettier|rubocop|pylint|flake8|noqa|nolint|mypy|type:\s*ignore|pyright|pragma|clang-format|clang-tidy|cspell|istanbul|c8 ignore|v8 ignore|nosonar|nosec|noinspection|suppress|checkstyle|spotless|stylelint|ktlint|detekt|resharper|rustfmt|clippy|go:|\+build|biome|deno-|ts-|@ts-|fmt:|isort|yapf|black|coverage|sonar|region|endregion|#?end ?region|shellcheck|swiftlint|standard|coding[:=]|vim:|frozen_string_literal|sourcemappingurl|global\s+\w+\s*$|jsx\b)")
CODE = re.compile(
    r"""(?x) ^\s*(?: [\])}{;]+ [\s\])};,]* $
    | .* [;{] \s* $
    | (?:const|let|var|val|auto|final|static|int|string|bool|float|double|char|String|List<\w+>)\s+[\w$*&]+\s*(?::\s*[\w<>\[\]]+\s*)?:?= .*
    | [\w$.\[\]"'*]+ \s* (?:[-+*/|&]|:)?= (?![=>]?\s*$) .*
    | (?:return|await|yield|raise|throw|import|from|include|require|use|using|package|goto|del|assert)\b .* [\w)\]"'] \s* $ (?<=[)\]"';]) .*
    | (?:if|for|while|elif|switch|catch|unless|until)\b .* [:{)] \s* $
    | (?:else|try|finally|end|begin|pass|break|continue)\s*:?\s* $
    | (?:def|func|fn|fun|function|class)\s+\w+\s*[(:{] .*
    | @?[\w$]+(?:(?:\.|::|->)[\w$?!]+)* \s* \( .* \) \s* [;,.]? \s* $
    )"""
)
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
SPACELESS = re.compile("[฀-໿က-႟ក-៿぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff]")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|[^\W\d_]+")
QUOTE = re.compile(r"""\s*[rRuUbB]{0,2}(\"{3}|'{3}|"|')""")

WORDS, CHARACTERS = 4, 8


def prose(lines: list[str], name: str) -> str:
    """What remains of documentation lines without marks, tag lines, tool switches and disabled code."""
    kept = []
    tag_indent = None
    for line in lines:
        bare = MARKS.sub("", line).rstrip()
        indent = len(bare) - len(bare.lstrip())
        body = XML.sub(" ", bare).strip()
        if TAG.match(body):
            tag_indent = indent
            continue
        if not body or BARE.match(body):
            tag_indent = None
            continue
        if tag_indent is not None and indent > tag_indent:  # a tag goes on
            continue
        tag_indent = None
        if SWITCH.match(body) or CODE.match(body):
            continue
        kept.append(body)
    return "\n".join(kept)


def earnest(text: str, name: str) -> bool:
    """At least four words, or eight characters of a script without spaces, beside the words of the function's name."""
    own = {p.lower() for p in PARTS.findall(name)}
    spaceless = len(SPACELESS.findall(text))
    if spaceless >= CHARACTERS:
        return True
    words = [w for w in WORD.findall(SPACELESS.sub(" ", text)) if w.lower() not in own]
    return len(words) >= WORDS


def family_of(lang: str | None, path: str | None, code: str) -> str | None:
    """The family of a language name, else of the file's extension; of a language that is in no family, and of none, by the code's looks.

    None for what holds no functions.
    """
    for name in (lang, m[1] if path and (m := EXTENSION.search(path)) else None):
        if name and name.lower() in NO_CODE:
            return None
        if name and (known := FAMILY.get(name.lower())):
            return known
    if not lang and path and not EXTENSION.search(path):
        return None
    if re.search(r"(?m)^\s*(?:async )?def \w+\(.*\).*:\s*$", code):
        return "py"
    if re.search(r"(?m)^\s*def [\w.]+", code) and re.search(r"(?m)^\s*end\s*$", code):
        return "rb"
    if re.search(r"(?m)^\s*--", code) and re.search(r"(?m)^\s*(?:local\s+)?function\b", code):
        return "lua"
    if re.search(r"(?m)^\s*#(?!include|define|if|endif|pragma)", code) and not re.search(r"(?m)^\s*(?://|/\*)", code):
        return "sh"
    return "c"


ANNOTATION = re.compile(r"\s*(?:@[\w.]+(?:\s*\(.*\)?)?|#!?\[.*\]?|\[[A-Z][\w.]*(?:\(.*\))?(?:,\s*[\w.]+(?:\(.*\))?)*\]|template\s*<.*>|extern \"C\")\s*$")


def pairs(code: str, lang: str | None, path: str | None = None) -> list[tuple[str, str, int]]:
    """(name, documentation, line of the head from 1) of each documented function, earnest or not."""
    family = family_of(lang, path, code)
    if family is None:
        return []
    mark = LINE_COMMENT[family]
    hashes = family != "c"
    out: list[tuple[str, str, int]] = []
    block: list[str] = []
    in_block = False
    at = 0
    lines = code.split("\n")
    holding = 0  # bracket depth of an annotation over several lines
    for number, raw in enumerate(lines, 1):
        start, at = at, at + len(raw) + 1
        line = raw.strip()
        if in_block:
            block.append(raw)
            in_block = "*/" not in line
            if not in_block and line.split("*/", 1)[1].strip():
                block = []
            continue
        if holding > 0 and block:
            holding += line.count("(") - line.count(")")
            continue
        if not line:
            block = []
            continue
        if not hashes and line.startswith("/*"):
            in_block = "*/" not in line[2:]
            if not in_block and line.split("*/", 1)[1].strip() and not line.endswith("*/"):
                block = []
                continue
            block.append(raw)
            continue
        if line.startswith(mark):
            block.append(raw)
            continue
        if not hashes and not out and not block and number > 0 and line.endswith("*/") and all(x.strip()[:1] == "*" or not x.strip() or k == 0 for k, x in enumerate(lines[:number])):
            block = lines[:number]  # the window begins inside a comment
            continue
        if (block or family == "py") and ANNOTATION.match(raw) and line[0] in "@[#te":
            holding = max(0, line.count("(") - line.count(")")) if line[0] == "@" else 0
            continue
        if family == "py":
            if "def " in line and (line.startswith("def ") or line.startswith("async ")):
                found = head(code, start, family)
                if found:
                    text = prose(block, found[0]) if block else ""
                    string = QUOTE.match(code, found[1])
                    if string and "\n" in code[found[1] : string.end()]:
                        close = code.find(string[1], string.end())
                        body = code[string.end() : close if close >= 0 else len(code)]
                        text = "\n".join(x for x in (text, prose(body.split("\n"), found[0])) if x)
                    if text:
                        out.append((found[0], text, number))
            block = []
            continue
        if block:
            found = head(code, start, family)
            if found and (text := prose(block, found[0])):
                out.append((found[0], text, number))
            block = []
    return out


GATE = r"""(?m)^[ \t]*(?://|/\*|\*|#|--)|\"{3}|'{3}|:\s*\n\s*[rRuU]?["']"""


def documented(windows: DataFrame, keys: list[str], code: str = "code", lang: str = "code_lang", path: str = "file_path", body: bool = False) -> DataFrame:
    """(keys, func_name, line_no, doc_text, doc_hash[, func_text]) of each function with earnest documentation.

    Rows of null or empty code give none; a null language is told by the path. A name that occurs twice in a window gives
    two rows. Nulls in the keys are kept. ``doc_hash`` is the digest of the description with its names and numbers blanked,
    for ``without_templates``. ``func_text``: the window from the head to the function's end. One pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.filter(pc.fill_null(pc.match_substring_regex(batch["_code"], GATE), False))
            at, names, numbers, docs, digests, bodies = [], [], [], [], [], []
            columns = (batch[c].to_pylist() for c in ("_code", "_lang", "_path"))
            for k, (text, language, place) in enumerate(zip(*columns, strict=True)):
                for name, doc, number in pairs(text, language, place):
                    if earnest(doc, name):
                        at.append(k)
                        names.append(name)
                        numbers.append(number)
                        docs.append(doc)
                        digests.append(blake2b(template(doc, name).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest())
                        bodies.append(function_text(text, number, family_of(language, place, text)) if body else "")
            own = batch.select(keys).take(pa.array(at, pa.int64()))
            more = [pa.array(names, pa.string()), pa.array(numbers, pa.int32()), pa.array(docs, pa.string()), pa.array(digests, pa.string())]
            labels = [*keys, "func_name", "line_no", "doc_text", "doc_hash"]
            if body:
                more.append(pa.array(bodies, pa.string()))
                labels.append("func_text")
            yield pa.RecordBatch.from_arrays([*own.columns, *more], names=labels)

    schema = ", ".join(f"`{k}` {windows.schema[k].dataType.simpleString()}" for k in keys)
    given = windows.select(*keys, F.col(code).alias("_code"), F.col(lang).alias("_lang"), F.col(path).alias("_path")).where("length(_code) > 0")
    return spread(given).mapInArrow(run, f"{schema}, func_name string, line_no int, doc_text string, doc_hash string" + ", func_text string" * body)


def template(doc: str, name: str) -> str:
    """A description without what varies between uses of a template: the function's own words, numbers and case."""
    own = {p.lower() for p in PARTS.findall(name)}
    return " ".join("_" if w.lower() in own or w.isdigit() else w.lower() for w in re.findall(r"\w+", doc))


def without_templates(found: DataFrame, most: int, group: str = "doc_hash") -> DataFrame:
    """The rows whose description template occurs at most ``most`` times in all of ``found``.

    Counted over the whole corpus, with partial sums before the shuffle; the repeated hashes, not the rows, are joined.
    """
    repeated = found.groupBy(group).count().where(F.col("count") > most).select(group)
    return found.join(repeated, group, "left_anti")


def function_text(code: str, number: int, family: str | None) -> str:
    """The function from its head's line on to the end of its body, or as far as the window goes."""
    lines = code.split("\n")
    rest = lines[number - 1 :]
    if family == "c":
        text, depth, opened = "\n".join(rest), 0, False
        for m in re.finditer(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|//[^\n]*|/\*.*?\*/|[{}]", text, re.S):
            if m.group() in "{}":
                depth += 1 if m.group() == "{" else -1
                opened = opened or depth > 0
                if opened and depth <= 0:
                    return text[: m.end()]
        return text
    first = len(rest[0]) - len(rest[0].lstrip())
    out = [rest[0]]
    for line in rest[1:]:
        indent = len(line) - len(line.lstrip())
        if line.strip() and indent <= first and not line.lstrip().startswith((")", "]")):
            if family in ("rb", "sh", "lua") and line.strip() in ("end", "}"):
                out.append(line)
            break
        out.append(line)
    return "\n".join(out).rstrip()
