"""Marked-up documents: headings, sections, steps, HTML to markdown."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions import text as tx
from loomfield.session import spread

FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
UNDERLINE = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")


def headings_of(text: str) -> list[dict]:
    """level, text, line, end_line, path and style of each heading, fenced code and front matter left out.

    A section ends before the next heading of the same or a higher level; its path is the texts of the open headings.
    """
    lines = re.split(r"\r\n|\r|\n", text)
    total = len(lines) - (1 if lines and not lines[-1] and len(lines) > 1 else 0)
    found: list[dict] = []
    fence = ""
    at = 0
    if lines and lines[0].strip() == "---":
        end = next((n for n in range(1, len(lines)) if lines[n].strip() in ("---", "...")), None)
        at = end + 1 if end else 0
    while at < len(lines):
        line = lines[at]
        m = FENCE.match(line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
        elif m:
            fence = m[1]
        elif h := ATX.match(line):
            found.append({"level": len(h[1]), "text": (h[2] or "").strip(), "line": at + 1, "style": "atx"})
        elif line.strip() and at + 1 < len(lines) and (u := UNDERLINE.match(lines[at + 1])) and not re.match(r"^\s*(?:[-*+>]|\d+[.)])\s", line):
            found.append({"level": 1 if u[1][0] == "=" else 2, "text": line.strip(), "line": at + 1, "style": "setext"})
            at += 1
        at += 1
    stack: list[dict] = []
    for n, h in enumerate(found):
        h["end_line"] = next((x["line"] - 1 for x in found[n + 1 :] if x["level"] <= h["level"]), max(total, h["line"]))
        while stack and stack[-1]["level"] >= h["level"]:
            stack.pop()
        stack.append(h)
        h["path"] = [x["text"] for x in stack]
    return found


def headings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, heading_no, level, heading, line, end_line, path, style) of each markdown heading; null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, n, h["level"], h["text"], h["line"], h["end_line"], h["path"], h["style"]) for k, t in zip(batch[key], batch["_text"], strict=True) for n, h in enumerate(headings_of(t), 1)]
            yield pd.DataFrame(rows, columns=[key, "heading_no", "level", "heading", "line", "end_line", "path", "style"])

    given = docs.where(F.col(text).rlike(r"(?m)^ {0,3}(?:#{1,6}(?:\s|$)|=+\s*$|-+\s*$)")).select(key, F.col(text).alias("_text"))
    return spread(given).mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, heading_no int, level int, heading string, line int, end_line int, path array<string>, style string")


def section_ends(marks: DataFrame, key: str, total: str) -> DataFrame:
    """Adds ``end_line`` to headings (key, line, level): the line before the next one of the same or a higher level, else ``total``.

    Headings have six levels, so the next peer is the least of six running minima of what follows.
    """
    after = Window.partitionBy(key).orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    nexts = [F.when(F.col("level") >= n, F.min(F.when(F.col("level") == n, F.col("line"))).over(after)) for n in range(1, 7)]
    return marks.withColumn("end_line", F.coalesce(F.least(*nexts) - 1, F.col(total)))


def normalized_label(label: str | None) -> str:
    """NFKC, small letters, without marks of emphasis and links; letters and digits only."""
    text = unicodedata.normalize("NFKC", label or "").lower()
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    return re.sub(r"[\W_]+", " ", re.sub(r"[`*_~]", "", text)).strip()


def likeness(a: Column, b: Column) -> Column:
    """1 for equal labels; the shorter's share of the longer if one holds the other; else the words' Jaccard index."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    held = (F.instr(a, b) > 0) | (F.instr(b, a) > 0)
    union = F.size(F.array_union(x, y))
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(held, shorter / longer).otherwise(F.size(F.array_intersect(x, y)) / union)


def select_sections(marks: DataFrame, key: str, query: str, least: float = 0.72) -> DataFrame:
    """(key, heading_no, how, score): a document's heading for a title: the same, else one that begins with its number, else one
    that holds it, else the most alike; none if the best ones are within 0.001 of each other."""
    label = F.pandas_udf(lambda s: s.map(normalized_label), "string")
    wanted = normalized_label(query)
    rows = marks.withColumn("_label", label("heading"))
    score = likeness(F.col("_label"), F.lit(wanted))
    how = F.when(F.col("_label") == wanted, 3).when(F.col("_label").rlike(rf"^\d+(?: \d+)* {re.escape(wanted)}\z"), 2).when(F.instr("_label", wanted) > 0, 1).when(score >= least, 0)
    rated = rows.withColumn("_how", how).withColumn("_score", F.when(how > 0, 1.0).otherwise(score)).where("_how is not null")
    w = Window.partitionBy(key).orderBy(F.desc("_how"), F.desc("_score"), "heading_no")
    best = rated.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead(F.struct("_how", "_score")).over(w)).where("_n = 1")
    tie = (F.col("_next._how") == F.col("_how")) & (F.abs(F.col("_next._score") - F.col("_score")) <= 0.001)
    names = F.element_at(F.create_map(*[F.lit(x) for pair in ((3, "exact"), (2, "numbered"), (1, "substring"), (0, "fuzzy")) for x in pair]), F.col("_how"))
    return best.where(~F.coalesce(tie, F.lit(False))).select(key, "heading_no", names.alias("how"), F.round("_score", 6).alias("score"))


def heading_index(marks: DataFrame, key: str, entries: int, cap: int, focus: tuple[int, int] | None = None) -> DataFrame:
    """The headings of each document that fit an index of so many entries and bytes, in document order.

    First come headings in the focus, then those of the lowest level, of the next, and the rest; then the nearest to the focus.
    """
    lowest = F.min("level").over(Window.partitionBy(key))
    a, b = focus or (0, -1)
    inside = (F.col("line") <= b) & (F.col("end_line") >= a)
    away = F.when(inside, 0).otherwise(F.least(F.abs(F.col("line") - a), F.abs(F.col("line") - b))) if focus else F.lit(0)
    rank = F.when(inside if focus else F.lit(False), 0).when(F.col("level") == lowest, 1).when(F.col("level") == lowest + 1, 2).otherwise(3)
    w = Window.partitionBy(key).orderBy("_rank", "_away", "line")
    rows = marks.withColumn("_rank", rank).withColumn("_away", away).withColumn("_size", F.octet_length(F.to_json(F.struct("level", "heading", "line", "end_line"))) + 1)
    fitted = rows.withColumn("_n", F.row_number().over(w)).withColumn("_sum", F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return fitted.where((F.col("_n") <= entries) & (F.col("_sum") <= cap)).select(key, "level", "heading", "line", "end_line")


def html_to_markdown(html: Column) -> Column:
    """Headings, emphasis, lists, breaks, paragraphs and table rows as markdown; other tags dropped; six entities decoded."""
    out = html
    for n in range(1, 5):
        out = F.regexp_replace(out, rf"(?is)<h{n}[^>]*>(.*?)</h{n}>", "\n" + "#" * n + " $1\n")
    for tags, mark in (("strong|b", r"**"), ("em|i", r"*")):
        out = F.regexp_replace(out, rf"(?is)<(?:{tags})(?:\s[^>]*)?>(.*?)</(?:{tags})>", f"{mark}$1{mark}")
    out = F.regexp_replace(out, r"(?is)<li[^>]*>(.*?)</li>", "- $1\n")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?is)<p[^>]*>(.*?)</p>", "$1\n\n")
    out = F.regexp_replace(out, r"(?is)</t[dh]>\s*<t[dh][^>]*>", " | ")
    out = F.regexp_replace(out, r"(?is)<tr[^>]*>\s*<t[dh][^>]*>(.*?)</t[dh]>\s*</tr>", "| $1 |\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+\z", "")


def steps(docs: DataFrame, key: str, text: str, longest: int = 200) -> DataFrame:
    """(key, line, step): numbered lines, lines that say Step or Procedure, and short bullets, without their marks."""
    lines = docs.select(key, F.posexplode(tx.lines(F.col(text), tx.ANY_LINE_END)).alias("_at", "_line"))
    numbered = F.regexp_extract("_line", r"^\s*\d+[.)]\s+(.*\S)", 1)
    said = F.regexp_extract("_line", r"(?i)^\s*(?:[-*+•]\s+)?(?:step\s+\d+|procedure)\s*[:.]\s*(.*\S)", 1)
    bullet = F.regexp_extract("_line", r"^\s*[-*+•]\s+(.*\S)", 1)
    step = F.coalesce(F.nullif(said, F.lit("")), F.nullif(numbered, F.lit("")), F.when(F.length(bullet) <= longest, F.nullif(bullet, F.lit(""))))
    return lines.withColumn("step", F.regexp_replace(step, r"\\([\\`*_{}\[\]()#+\-.!])", "$1")).where("step is not null").select(key, (F.col("_at") + 1).alias("line"), "step")


def pages_with(pages: DataFrame, text: str, query: str) -> DataFrame:
    """The pages that hold any word of a query longer than two characters; all pages if it has none."""
    words = [w for w in re.split(r"\s+", query.lower()) if len(w) > 2]
    if not words:
        return pages
    hit = F.lit(False)
    for w in words:
        hit = hit | (F.locate(w, F.lower(text)) > 0)
    return pages.where(hit)


def page_numbers(selectors: list[str], most: int = 500) -> list[int]:
    """The pages that selectors like 3 or 5-7 name, in order, at most ``most``; what can't be read is left out."""
    out: list[int] = []
    for s in selectors:
        if m := re.fullmatch(r"\s*(\d+)(?:\s*-\s*(\d+))?\s*", s):
            a, b = int(m[1]), int(m[2] or m[1])
            out += [n for n in range(a, min(b, a + most) + 1) if n > 0 and n not in out]
    return out[:most]


def cut_at_break(text: Column, cap: int) -> Column:
    """A text within ``cap`` bytes, cut at the last blank line if that is within its last fifth."""
    head = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, cap).cast("string"))
    whole = F.when(F.octet_length(text) <= cap, text).otherwise(F.regexp_replace(head, "\ufffd\\z", ""))
    blank = F.length(whole) - F.length(F.substring_index(whole, "\n\n", -1)) - 2
    return F.when(F.octet_length(text) <= cap, text).when(blank >= F.length(whole) * 0.8, F.substring(whole, F.lit(1), blank.cast("int"))).otherwise(whole)
