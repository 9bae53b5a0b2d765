"""Search over lines of files: literal and pattern filters, grouping, roll-ups, paging and byte budgets.

All operators take a table of files (path, content) or of lines (path, line, text) and stay in the JVM. A line table is an
explosion of the files and carries no more than its own text, so that scans, filters and counts need no shuffle; only
operators that group by file or order rows shuffle, after the filter.
"""

from __future__ import annotations

import base64
import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions import text as tx


def line_table(files: DataFrame, path: str = "path", content: str = "content", ends: str = tx.SEARCH_LINE_END) -> DataFrame:
    """(path, line, text): every line of every file, from 1. Null content has no lines, an empty one has one empty line."""
    split = files.select(F.col(path).alias("path"), F.posexplode(tx.lines(F.col(content), ends)).alias("_at", "text"))
    return split.select("path", (F.col("_at") + 1).alias("line"), "text")


def safe_pattern(pattern: str) -> bool:
    """Whether a caller's pattern cannot blow up: short, without look-around, back references or nested repetition."""
    if len(pattern) > 256 or re.search(r"\\[1-9]|\\k<|\(\?[=!<]", pattern):
        return False
    bare = re.sub(r"\\.|\[(?:\\.|[^\]])*\]", "x", pattern)
    if len(re.findall(r"[*+?]|\{\d", bare)) > 16 or re.search(r"\([^()]*(?:[*+}]|\|)[^()]*\)[*+{]", bare):
        return False
    depth = 0
    for c in bare:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return False
    if depth:
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def _at_most(items: list[str], most: int, what: str) -> list[str]:
    """The items, once each; more than so many are refused instead of left out in silence."""
    items = list(dict.fromkeys(items))
    if not 0 < len(items) <= most:
        raise ValueError(f"between 1 and {most} {what}")
    return items


def matching(lines: DataFrame, query: str, regex: bool = False, ignore_case: bool | None = None) -> DataFrame:
    """(path, line, text, start): lines with a match, once each, with the first one's place (from 1).

    Without ``ignore_case``, a query of one word ignores case and any other doesn't. An unsafe pattern is refused.
    """
    if regex and not safe_pattern(query):
        raise ValueError("unsafe pattern")
    if ignore_case is None:
        ignore_case = not regex and not re.search(r"\s", query)
    if regex:
        pattern = ("(?i)" if ignore_case else "") + f"({query})"
        hit = F.regexp_instr("text", F.lit(pattern))
    else:
        hit = F.locate(query.lower(), F.lower("text")) if ignore_case else F.locate(query, F.col("text"))
    return lines.withColumn("start", hit).where("start > 0")


def grouped(matches: DataFrame) -> DataFrame:
    """(path, line, snippet, n): the distinct matching lines of each file with a snippet, a row a line, and how many the file has.

    Rows, not lists: a file may hold a third of all matches.
    """
    rows = matches.dropDuplicates(["path", "line"]).select("path", "line", tx.snippet(F.col("text"), F.col("start")).alias("snippet"))
    return rows.join(rows.groupBy("path").agg(F.count("*").alias("n")), "path")


def inventory(matches: DataFrame) -> DataFrame:
    """(path, matches) of each file with a match."""
    return matches.groupBy("path").agg(F.countDistinct("line").alias("matches"))


def by_folder(counts: DataFrame) -> DataFrame:
    """(dir, files, matches) of the folders right above files with matches; '.' for the root."""
    return counts.groupBy(tx.parent(F.col("path")).alias("dir")).agg(F.count("*").alias("files"), F.sum("matches").alias("matches"))


def all_or_any(lines: DataFrame, terms: list[str]) -> DataFrame:
    """(path, terms_found, lines_found, mode): files with all terms that occur anywhere, or, if none has, with any.

    Terms ignore case; there may be twelve. One pass over the lines: a flag for each term, summed up by file.
    """
    terms = _at_most([t.lower() for t in terms if t], 12, "terms")
    flags = [F.locate(t, F.lower("text")) > 0 for t in terms]
    any_flag = flags[0]
    for f in flags[1:]:
        any_flag = any_flag | f
    by = lines.where(any_flag).groupBy("path").agg(*[F.max(f.cast("int")).alias(f"t{k}") for k, f in enumerate(flags)], F.count("*").alias("lines_found"))
    counted = by.select("path", "lines_found", sum((F.col(f"t{k}") for k in range(len(terms))), F.lit(0)).alias("terms_found"), *[f"t{k}" for k in range(len(terms))])
    overall = counted.agg(*[F.max(f"t{k}").alias(f"o{k}") for k in range(len(terms))], F.lit(1).alias("_one"))
    occurring = overall.select(sum((F.coalesce(F.col(f"o{k}"), F.lit(0)) for k in range(len(terms))), F.lit(0)).alias("_occurring")).scalar()
    full = F.col("terms_found") == occurring
    some = counted.agg(F.coalesce(F.max(full.cast("int")), F.lit(0)).alias("_some")).scalar()
    out = counted.where((some == 0) | full)
    return out.select("path", F.col("terms_found").cast("int").alias("terms_found"), "lines_found", F.when(some == 1, "all").otherwise("any").alias("mode"))


def union_of(lines: DataFrame, queries: list[str]) -> DataFrame:
    """(path, line, text, start) of lines with any of up to five literals, each once, with its first match's place; more are refused."""
    queries = _at_most(queries, 5, "queries")
    places = [F.locate(q, F.col("text")) for q in queries]
    first = F.array_min(F.filter(F.array(*places), lambda p: p > 0))
    return lines.withColumn("start", first).where("start is not null")


def absence(files: DataFrame, lines: DataFrame, terms: list[str]) -> DataFrame:
    """(term, scanned_files): terms of up to twelve that no line has, with how many files say so; more are refused."""
    terms = _at_most(terms, 12, "terms")
    seen = lines.agg(*[F.max((F.locate(t.lower(), F.lower("text")) > 0).cast("int")).alias(f"t{k}") for k, t in enumerate(terms)])
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.coalesce(F.col(f"t{k}"), F.lit(0)).alias("found")) for k, t in enumerate(terms)])
    scanned = files.agg(F.count("*").alias("scanned_files")).scalar()
    return seen.select(F.explode(pairs).alias("p")).where("p.found = 0").select("p.term", scanned.alias("scanned_files"))


def references(lines: DataFrame, symbol: str, languages: Column | None = None) -> DataFrame:
    """(path, line, text, in_comment): lines with a whole word, outside of string literals.

    A line counts if the word occurs outside of quotes on it. ``languages``: the column that tells what a comment is.
    """
    from loomfield.functions import paths

    if not re.fullmatch(r"[A-Za-z_$][\w$]*", symbol):
        return lines.select("path", "line", "text", F.lit(False).alias("in_comment")).where("false")
    word = tx.whole_word(symbol)
    unquoted = F.regexp_replace("text", r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", "''")
    lang = languages if languages is not None else paths.language(F.col("path"))
    comment = paths.looks_like_comment(F.col("text"), lang)
    hit = F.when(comment, F.col("text").rlike(word)).otherwise(unquoted.rlike(word))
    return lines.where(F.col("text").contains(symbol)).where(hit).select("path", "line", "text", F.coalesce(comment, F.lit(False)).alias("in_comment"))


def cursor(path: str, line: int) -> str:
    """An opaque mark of the last row served."""
    return base64.urlsafe_b64encode(json.dumps({"v": 1, "p": path, "l": line}, separators=(",", ":")).encode()).decode().rstrip("=")


def read_cursor(mark: str) -> tuple[str, int] | None:
    """What a mark says; None if it is none of ours."""
    try:
        value = json.loads(base64.urlsafe_b64decode(mark + "=" * (-len(mark) % 4)))
        return (value["p"], value["l"]) if value["v"] == 1 and isinstance(value["p"], str) and isinstance(value["l"], int) else None
    except (ValueError, KeyError, TypeError):
        return None


def page(rows: DataFrame, after: str | tuple[str, int] | None, size: int) -> DataFrame:
    """The next ``size`` rows by path and line after a mark: a bounded top-k, not a sort of everything."""
    place = read_cursor(after) if isinstance(after, str) else after
    if place:
        rows = rows.where(F.struct("path", "line") > F.struct(F.lit(place[0]).alias("path"), F.lit(place[1]).alias("line")))
    return rows.orderBy("path", "line").limit(size)


def within_bytes(rows: DataFrame, order: list[str], cap: int, columns: list[str] | None = None) -> DataFrame:
    """The first rows whose JSON forms, with separators, stay within a number of bytes, with the running sum.

    A response of ``cap`` bytes holds at most ``cap`` rows; so only that many are ordered and summed up.
    """
    size = F.octet_length(F.to_json(F.struct(*(columns or rows.columns)))) + 1
    head = rows.withColumn("_size", size).orderBy(*order).limit(cap)
    running = F.sum("_size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return head.withColumn("running_bytes", running).where(F.col("running_bytes") <= cap).drop("_size")


def line_ranges(hits: DataFrame, most: int | None = None) -> DataFrame:
    """(path, start, end, label): runs of consecutive lines of a file; the first ``most`` ones."""
    w = Window.partitionBy("path").orderBy("line")
    islands = hits.select("path", "line").distinct().withColumn("_island", F.col("line") - F.row_number().over(w))
    runs = islands.groupBy("path", "_island").agg(F.min("line").alias("start"), F.max("line").alias("end")).drop("_island")
    if most:
        runs = runs.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("start"))).where(F.col("_n") <= most).drop("_n")
    return runs.withColumn("label", F.when(F.col("start") == F.col("end"), F.concat(F.lit("L"), "start")).otherwise(F.concat(F.lit("L"), "start", F.lit("-"), "end")))


def densest(hits: DataFrame, span: int = 40, pad: int = 4) -> DataFrame:
    """(path, first_line, last_line, hits): the largest group of a file's hits within ``span`` lines; the first of equals."""
    w = Window.partitionBy("path").orderBy("line").rangeBetween(0, span)
    counted = hits.select("path", F.col("line").cast("bigint").alias("line")).distinct().select("path", "line", F.count("*").over(w).alias("n"), F.max("line").over(w).alias("last"))
    best = counted.groupBy("path").agg(F.max_by(F.struct("line", "last", "n"), F.struct(F.col("n"), -F.col("line"))).alias("b"))
    return best.select("path", F.greatest(F.lit(1), F.col("b.line") - pad).alias("first_line"), (F.col("b.last") + pad).alias("last_line"), F.col("b.n").alias("hits"))


def fit_round_robin(groups: DataFrame, cap: int, widest: int = 8) -> DataFrame:
    """(path, line): one line of each file while the sum fits, then a further line of each, pass by pass, skipping what does not fit.

    ``groups``: path, line, bytes, of which at most ``cap`` rows can fit: the pass number is the line's rank in its file,
    and only the first ``cap`` rows in order of passes are looked at, on one node.
    """
    w = Window.partitionBy("path").orderBy("line")
    ranked = groups.withColumn("_pass", F.row_number().over(w)).where(F.col("_pass") <= widest)
    head = ranked.orderBy("_pass", "path").limit(cap)

    def greedy(pdf):
        pdf = pdf.sort_values(["_pass", "path"])
        used, dropped, keep = 0, set(), []
        for path, size, number in zip(pdf["path"], pdf["bytes"], pdf["_pass"], strict=True):
            fits = path not in dropped and used + size <= cap
            if not fits and number == 1:  # a file without a foothold gets no line
                dropped.add(path)
            used += size * fits
            keep.append(fits)
        return pdf[keep][["path", "line"]]

    kinds = {f.name: f.dataType.simpleString() for f in groups.schema}
    return head.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(greedy, f"path {kinds['path']}, line {kinds['line']}")  # at most cap rows


def evidence_windows(lines: DataFrame, terms: dict[str, float], radius: int = 12, least: float = 3.0) -> DataFrame:
    """(path, line, score, margin): the best window of 2 x radius + 1 lines of each file, by weighted terms.

    A term counts once a window, times min(3, 1 + ln((N + 1) / (df + 1))) of its rarity among the file's lines. ``margin``
    is how far it leads over the best window that does not overlap it; null without one. Earlier windows win ties. All terms of a file come from one pass; windows
    are running maxima over its lines.
    """
    names = list(terms)
    low = F.lower("text")
    hits = [F.when(F.locate(t.lower(), low) > 0, 1).otherwise(0).alias(f"h{k}") for k, t in enumerate(names)]
    flagged = lines.select("path", "line", *hits)
    df = flagged.groupBy("path").agg(F.count("*").alias("_n"), *[F.sum(f"h{k}").alias(f"d{k}") for k in range(len(names))])
    some = sum((F.col(f"d{k}") for k in range(len(names))), F.lit(0)) > 0
    joined = flagged.join(df.where(some), "path")
    w = Window.partitionBy("path").orderBy("line").rowsBetween(-radius, radius)
    score = F.lit(0.0)
    for k, t in enumerate(names):
        rarity = F.least(F.lit(3.0), 1 + F.log((F.col("_n") + 1) / (F.col(f"d{k}") + 1)))
        score = score + F.max(f"h{k}").over(w) * F.lit(float(terms[t])) * rarity
    scored = joined.select("path", "line", score.alias("score"))
    best = scored.groupBy("path").agg(F.max_by(F.struct("line", "score"), F.struct(F.col("score"), -F.col("line"))).alias("b")).select("path", F.col("b.line").alias("line"), F.col("b.score").alias("score"))
    apart = scored.withColumnRenamed("line", "_l").withColumnRenamed("score", "_s").join(best, "path").where(F.abs(F.col("_l") - F.col("line")) > 2 * radius)
    second = apart.groupBy("path").agg(F.max("_s").alias("_second"))
    return best.where(F.col("score") >= least).join(second, "path", "left").select("path", "line", F.round("score", 3).alias("score"), F.round(F.col("score") - F.col("_second"), 3).alias("margin"))


def did_you_mean(paths: DataFrame, probes: list[str], most: int = 5) -> DataFrame:
    """(path, hits): the paths whose name has most of the probes in it, ties by path in reading order."""
    name = F.lower(tx.basename(F.col("path")))
    hits = sum((F.when(F.locate(p.lower(), name) > 0, 1).otherwise(0) for p in probes), F.lit(0))
    return paths.select("path").distinct().withColumn("hits", hits).where("hits > 0").orderBy(F.desc("hits"), F.collate(F.col("path"), "UNICODE"), "path").limit(most)
