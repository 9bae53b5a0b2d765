"""Column functions on text: lines, tokens, identifiers, digests, snippets. All of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ANY_LINE_END = r"\r\n|\r|\n"
SEARCH_LINE_END = r"\r?\n"
IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*"
#: What counts as white space around text, beyond what trim() takes.
SPACE = r"[\s ﻿ -     　]"


def lines(text: Column, ends: str = SEARCH_LINE_END) -> Column:
    """The lines of a text, with the empty one after a final line end; null for null."""
    return F.split(text, ends, -1)


def line_count(text: Column) -> Column:
    """Lines of a text, a final line end not counted; 0 for null, empty and a lone line end."""
    body = F.regexp_replace(text, r"(?:\r\n|\r|\n)\z", "")
    return F.when(text.isNull() | (F.length(body) == 0) & (F.length(text) <= 2) & ~text.rlike(r"\n.*\n"), 0).otherwise(F.size(F.split(body, ANY_LINE_END, -1)))


def tokens_by_bytes(text: Column) -> Column:
    """A token for every four bytes begun."""
    return F.ceil(F.octet_length(text) / 4).cast("bigint")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def body_tokens(line: Column, end_line: Column) -> Column:
    """An estimate of the tokens of a body by its lines, at least 1."""
    return F.greatest(F.lit(1).cast("bigint"), (end_line - line + 1) * 8)


def tokens_by_words(text: Column) -> Column:
    """1.33 tokens a word, rounded up."""
    return F.ceil(word_count(text) * F.lit(1.33)).cast("bigint")


def identifiers(text: Column, most: int | None = 32) -> Column:
    """The first distinct identifiers, sorted; all of them without ``most``."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({IDENTIFIER})"), F.lit(1)))
    return F.array_sort(F.slice(found, 1, most) if most else found)


def identifier_parts(name: Column) -> Column:
    """Lower-cased parts of a camel-case, snake-case or kebab-case name."""
    parts = F.split(name, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[_\-\s.]+")
    return F.transform(F.filter(parts, lambda p: p != ""), F.lower)


def whole_word(word: str) -> str:
    """A pattern for a word with ASCII boundaries, which hold beside letters of other scripts."""
    return rf"(?<![A-Za-z0-9_]){re.escape(word)}(?![A-Za-z0-9_])"


def escaped(literal: str) -> str:
    """A pattern for a literal, in Java's and Python's dialect alike."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-#&~\s])", r"\\\1", literal)


def strip(text: Column) -> Column:
    """The text without white space of any kind around it."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def digest(text: Column, size: int | None = None) -> Column:
    """SHA-256 in hex, or its first ``size`` digits."""
    full = F.sha2(text, 256)
    return F.substring(full, 1, size) if size else full


def opaque_id(salt: str, namespace: str, value: Column) -> Column:
    """24 hex digits that tell a value apart without giving it away."""
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}\0{namespace}\0"), value), 256), 1, 24)


def snippet(line: Column, start: Column, width: int = 80, context: int = 20) -> Column:
    """``width`` characters of a line around a match at ``start`` (from 1), with an ellipsis on each side that is cut."""
    bare = strip(line)
    lead = F.length(line) - F.length(F.regexp_replace(line, rf"^{SPACE}+", ""))
    at = F.greatest(F.lit(1), start - lead)
    first = F.when(F.length(bare) <= width, 1).otherwise(F.greatest(F.lit(1), F.least(at - context, F.length(bare) - width + 1)))
    body = F.substring(bare, first, F.lit(width))
    return F.concat(F.when(first > 1, "…").otherwise(""), body, F.when(first + width - 1 < F.length(bare), "…").otherwise(""))


def compressed(text: Column) -> Column:
    """Line feeds only, no space at line ends, runs of blank lines as one."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t]+(?=\n|\z)", "")
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def line_of_offset(text: Column, offset: Column) -> Column:
    """The line, from 1, on which the character at an offset (from 0) stands."""
    return F.length(F.regexp_replace(F.substring(text, F.lit(1), offset.cast("int")), r"[^\n]", "")) + 1


def column_letters(number: Column) -> Column:
    """A spreadsheet column's letters: 1 is A, 27 is AA; null below 1."""
    digits = F.aggregate(
        F.sequence(F.lit(1), F.lit(7)),
        F.struct(F.lit("").alias("s"), number.cast("bigint").alias("n")),
        lambda acc, _: F.when(acc.n > 0, F.struct(F.concat(F.char((acc.n - 1) % 26 + 65), acc.s).alias("s"), ((acc.n - 1) / 26).cast("bigint").alias("n"))).otherwise(acc),
    ).s
    return F.when(number >= 1, digits)


def column_number(letters: Column) -> Column:
    """The number of a spreadsheet column; null where there is none."""
    upper = F.upper(letters)
    value = F.aggregate(F.filter(F.split(upper, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda acc, c: acc * 26 + F.ascii(c) - 64)
    return F.when(upper.rlike(r"^[A-Z]+\z"), value)


def endpoint(raw: Column) -> Column:
    """A route's path: no scheme, host or query, one leading slash, no doubled or trailing ones; null if nothing is left."""
    path = F.regexp_replace(F.trim(raw), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.regexp_replace(path, r"[?#].*\z", "")
    path = F.regexp_replace(F.concat(F.lit("/"), path), r"/{2,}", "/")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, r"/\z", "")).otherwise(path)
    return F.when(F.length(F.trim(raw)) > 0, path)


def rounded_half_up(number: Column) -> Column:
    return F.floor(number + 0.5)


def nonnegative_integer(number: Column) -> Column:
    """A count: half rounded up, below zero and no number as 0."""
    safe = F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), 0.0).otherwise(number)
    return F.greatest(F.lit(0), rounded_half_up(safe)).cast("bigint")


def clamped(value: Column, fallback: float, ceiling: float, least: float = 0) -> Column:
    """A caller's number within limits; the fallback for null, NaN and what is too small."""
    return F.when(value.isNull() | F.isnan(value.cast("double")) | (value < least), F.lit(fallback)).otherwise(F.least(value, F.lit(ceiling)))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is not positive."""
    return F.when(whole > 0, part / whole)


def parent(path: Column) -> Column:
    """The folder of a path; '.' for a file at the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(F.lit("."))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ancestors(path: Column) -> Column:
    """Every folder above a path, from the top one down; empty for a file at the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))
