"""Scans of source trees: which files count, which are left out and why.

Files are read with Spark's binaryFile reader, which lists and reads in parallel and leaves contents unread unless they are
asked for. Ignore rules are compiled once on the driver; each file's path is matched where it is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.functions import paths

MOST_BYTES = 1_000_000
# Files of text that are kept though their language has no parser.
TEXT_EXTENSIONS = ("md", "json", "yaml", "yml", "toml", "txt", "css")
DEFAULT_IGNORES = ("node_modules/", ".git/", "dist/", "build/", "out/", "coverage/", "target/", ".next/", "__pycache__/", "*.min.js", "*.lock", "*.map")


def translated(pattern: str) -> tuple[str, bool, bool] | None:
    """(regular expression, negated, folders only) of one line of gitignore grammar; None for comments and blank lines."""
    line = pattern.rstrip("\n").rstrip("\r")
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    line = line[1:] if line.startswith("\\") and line[1:2] in ("#", "!") else line
    folders = line.endswith("/")
    line = line.rstrip("/") if folders else line
    anchored = "/" in line
    line = line.lstrip("/")
    out, at = [], 0
    while at < len(line):
        if line.startswith("**/", at):
            out.append("(?:[^/]+/)*")
            at += 3
        elif line.startswith("/**", at) and at + 3 == len(line):
            out.append("/.+")
            at += 3
        elif line[at] == "*":
            out.append("[^/]*")
            at += 2 if line.startswith("**", at) else 1
        elif line[at] == "?":
            out.append("[^/]")
            at += 1
        elif line[at] == "[" and "]" in line[at + 1 :]:
            end = line.index("]", at + 2 if line[at + 1] in "!]" else at + 1)
            body = line[at + 1 : end]
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            at = end + 1
        elif line[at] == "\\" and at + 1 < len(line):
            out.append(re.escape(line[at + 1]))
            at += 2
        else:
            out.append(re.escape(line[at]))
            at += 1
    return ("" if anchored else "(?:.*/)?") + "".join(out), negated, folders


class Matcher:
    """Layers of ignore rules: the last rule that matches counts, but what a protected layer ignores stays ignored."""

    def __init__(self, rules: Iterable[str], protected: Iterable[str] = ()):
        self.rules = [(re.compile(t[0] + r"\Z"), t[1], t[2]) for r in rules if (t := translated(r))]
        self.protected = [(re.compile(t[0] + r"\Z"), t[1], t[2]) for r in protected if (t := translated(r))]

    @staticmethod
    def _last(rules, path: str, folder: bool) -> bool | None:
        verdict = None
        for rule, negated, folders in rules:
            if (folder or not folders) and rule.match(path):
                verdict = not negated
        return verdict

    def ignored(self, path: str) -> bool:
        """Whether a file is ignored; a file below an ignored folder is, whatever re-includes it."""
        parts = path.split("/")
        for layer in (self.protected, self.rules):
            for depth in range(1, len(parts) + 1):
                verdict = self._last(layer, "/".join(parts[:depth]), depth < len(parts))
                if verdict and (depth < len(parts) or verdict):
                    return True
        return False


@lru_cache(maxsize=8)
def matcher(rules: tuple[str, ...], protected: tuple[str, ...]) -> Matcher:
    return Matcher(rules, protected)


def ignored(path: Column, rules: Iterable[str], protected: Iterable[str] = ()) -> Column:
    """Whether paths are ignored by rules, as a vectorised function; null paths are not."""
    fixed, firm = tuple(rules), tuple(protected)

    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = matcher(fixed, firm)
        for batch in batches:
            yield batch.map(lambda p: m.ignored(p) if isinstance(p, str) else False).astype(bool)

    return run(path)


def listed(spark: SparkSession, root: str, glob: str | None = None, with_content: bool = True) -> DataFrame:
    """(path, size_bytes, mtime_ms[, content]) of the files below a folder, paths relative to it.

    Spark's reader lists neither empty files nor those whose name begins with a dot or an underscore.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    bare = re.sub(r"^\w+:(?://)?", "", root).rstrip("/")
    rel = F.regexp_replace(F.col("path"), r"^\w+:(?://[^/]*)?" + re.escape(bare).replace(r"\-", "-") + "/", "")
    columns = [rel.alias("path"), F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") / 1000).alias("mtime_ms")]
    return files.select(*columns, *(["content"] if with_content else []))


def is_text(content: Column) -> Column:
    """Valid UTF-8 without a NUL byte."""
    text = content.cast("string")
    return F.is_valid_utf8(text) & (F.locate("\0", text) == 0)


def classified(files: DataFrame, rules: Iterable[str] = DEFAULT_IGNORES, protected: Iterable[str] = (".git/",), secret: str | None = r"(?i)(?:^|/)(?:\.env(?:\.|\z)|id_rsa|[^/]*\.(?:pem|key|p12|pfx)\z)", full: bool = False, gitignore: Iterable[str] = (), tool: Iterable[str] = ()) -> DataFrame:
    """Adds language and ``omission``: why a file is left out, null for one that is kept.

    In order: symlinks (if there is a column is_link), ignored (the rules that always hold), gitignored, tool-ignored, secrets, oversize,
    changed (content of another size than was listed, so read while it was written), non_text. ``full`` keeps what rules ignore, but not what
    the protected layer does. What counts as a secret's path is a parameter.
    """
    path = F.col("path")
    lang = paths.language(path)
    known = F.coalesce(lang.isNotNull() | paths.extension(path).isin(*TEXT_EXTENSIONS), F.lit(False))
    why = F.when(F.coalesce(F.col("is_link"), F.lit(False)), "symlinks") if "is_link" in files.columns else F.when(F.lit(False), "")
    why = why.when(ignored(path, [] if full else list(rules), list(protected)), "ignored")
    for layer, name in ((list(gitignore), "gitignored"), (list(tool), "tool-ignored")):
        if layer and not full:
            why = why.when(ignored(path, layer), name)
    if secret:
        why = why.when(path.rlike(secret), "secrets")
    why = why.when(F.col("size_bytes") > MOST_BYTES, "oversize")
    if "content" in files.columns:
        why = why.when(F.length("content") != F.col("size_bytes"), "changed")
    why = why.when(~known, "non_text")
    if "content" in files.columns:
        why = why.when(~is_text(F.col("content")), "non_text")
    return files.withColumn("language", lang).withColumn("text_only", lang.isNull() & known).withColumn("omission", why)


def sources(files: DataFrame, **options) -> DataFrame:
    """The kept files of a listing, by path in byte order."""
    return classified(files, **options).where("omission is null").drop("omission").orderBy("path")


def omissions(files: DataFrame, **options) -> DataFrame:
    """(omission, files): how many files each reason leaves out."""
    return classified(files, **options).where("omission is not null").groupBy("omission").agg(F.count("*").alias("files"))


def source_only(path: Column, scope: str | None = None) -> Column:
    """Whether a path is source and not build output, unless the scope asked for is itself among it."""
    return F.lit(True) if scope and re.search(r"(?:^|/)(?:dist|build|out|target|coverage|node_modules)(?:/|$)", scope) else ~(paths.is_build_output(path) | paths.is_noise(path))


def lifted(path: Column, rules: Iterable[str], firm: Iterable[str], scope: str) -> Column:
    """Whether a path is ignored when a scope inside an ignored folder was asked for: only firm rules hold there."""
    inside = paths.under(path, scope)
    return F.when(inside, ignored(path, list(firm))).otherwise(ignored(path, [*rules, *firm]))
