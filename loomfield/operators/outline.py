"""Outlines of files and repositories: signatures without bodies, roles, overviews, and what belongs around a symbol."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions import paths
from loomfield.functions import text as tx
from loomfield.operators import intervals
from loomfield.operators import symbols as sy
from loomfield.session import spread


def bare_outline(text: str, language: str, profile: str = "full") -> str:
    """A file without the bodies of its functions. Profiles: full (imports, types and signatures), class-map (types only), symbol-map (names and
    lines), doc-map (names with the first line of their documentation)."""
    found = sy.extract(text, language)
    lines = re.split(r"\r\n|\r|\n", text)
    if profile == "symbol-map":
        return "\n".join(f"{s[0]} L{s[2]}-{s[3]}" for s in found)
    if profile == "doc-map":
        return "\n".join(f"{s[0]} L{s[2]}-{s[3]}" + (f": {s[6].splitlines()[0]}" if s[6] else "") for s in found)
    out = []
    if profile == "full":
        out += [x.rstrip() for x in lines[:60] if re.match(r"\s*(?:import\b|from\s+\S+\s+import|using\s|use\s|#include|require\b|package\s)", x)][:12]
    for _, kind, a, b, signature, *_ in found:
        holds = kind in ("class", "interface", "enum")
        if profile == "class-map" and not holds:
            continue
        indent = re.match(r"\s*", lines[a - 1])[0]
        body = "" if holds or b <= a else " ... }" if signature.endswith("{") else " ..."
        out.append(f"{indent}{signature}{body}")
    return "\n".join(out)


def outlines(files: DataFrame, path: str = "path", content: str = "content", profile: str = "full") -> DataFrame:
    """(path, outline, kept): each file's outline and how large it is against the file; null content has none."""
    lang = F.coalesce(paths.language(F.regexp_replace(path, r"@\d+\z", "")), F.lit("default"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [bare_outline(t, g, profile) for t, g in zip(batch["_text"], batch["_lang"], strict=True)]
            yield pd.DataFrame({"path": batch["path"], "outline": made, "kept": [len(m) / max(1, len(t)) for m, t in zip(made, batch["_text"], strict=True)]})

    given = files.where(F.col(content).isNotNull()).select(F.col(path).alias("path"), F.col(content).alias("_text"), lang.alias("_lang"))
    return spread(given).mapInPandas(run, "path string, outline string, kept double")


def compact(ranked: DataFrame, cap: int = 800, least: int = 10) -> DataFrame:
    """The files (path, rank, tokens) of an outline within a number of tokens: the lowest ranks go first, but the ``least`` highest stay.

    A file counts a token at least, so no more than the first ``cap``, or ``least``, files can stay, and only these are put in order by one task.
    """
    w = Window.orderBy(F.desc("rank"), "path")
    numbered = ranked.orderBy(F.desc("rank"), "path").limit(max(cap, least)).withColumn("_n", F.row_number().over(w)).withColumn("_sum", F.sum(F.greatest("tokens", F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where((F.col("_n") <= least) | (F.col("_sum") <= cap)).drop("_n", "_sum")


def roles(files: DataFrame, path: str = "path", content: str = "content", width: int = 72) -> DataFrame:
    """(path, role): a line that says what a file is: its first heading or comment of some words, else its first declaration."""
    text = F.col(content)
    heading = F.when(paths.is_markdown(F.col(path)), F.regexp_extract(text, r"(?m)^#{1,3}\s+(\S.*)$", 1))
    comment = F.regexp_extract(text, r"^(?:#!.*\n)?\s*(?:/\*\*?\s*\n?\s*\*?|//+|#|\"\"\")\s*([^\n*\"]*[^\s\n*\"][^\n*\"]*)", 1)
    declared = F.regexp_extract(text, r"(?m)^\s*((?:export\s+|public\s+|pub\s+)?(?:abstract\s+)?(?:class|interface|function|def|func|fn|fun|struct|enum|type|const)\s+\w+)", 1)
    said = F.when(F.size(F.split(F.trim(comment), r"\s+")) >= 3, F.trim(comment))
    best = F.coalesce(F.nullif(F.trim(heading), F.lit("")), said, F.nullif(F.trim(declared), F.lit("")))
    return files.where(text.isNotNull()).select(F.col(path).alias("path"), F.when(F.length(best) > width, F.concat(F.substring(best, 1, width - 1), F.lit("…"))).otherwise(best).alias("role")).where("role is not null")


def chunks_of_symbols(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, name, chunk_ids): each symbol with the ids of the chunks named after it; a chunk's name may end in # and a number."""
    base = F.substring_index("chunk_name", "#", 1)
    by = chunks.groupBy("path", base.alias("name")).agg(F.array_sort(F.collect_list("chunk_id")).alias("_ids"))  # as long as a symbol
    return symbols.select("path", "name").distinct().join(by, ["path", "name"], "left").select("path", "name", F.coalesce("_ids", F.array().cast("array<string>")).alias("chunk_ids"))


def symbol_chunks(symbols: DataFrame, line_tokens: int = 8, most: int = 400) -> DataFrame:
    """(path, chunk_name, chunk_id, line_start, line_end): a chunk a symbol, or several of at most so many tokens, numbered; ``line_tokens`` is what
    a line counts."""
    each = max(1, most // line_tokens)
    parts = F.sequence(F.lit(0), F.floor((F.col("end_line") - F.col("line")) / each).cast("int"))
    cut = symbols.select("path", "name", "line", "end_line", F.posexplode(parts).alias("_n", "_k"), F.size(parts).alias("_of"))
    a = F.col("line") + F.col("_k") * each
    b = F.least(a + each - 1, F.col("end_line"))
    name = F.when(F.col("_of") > 1, F.concat("name", F.lit("#"), F.col("_n") + 1)).otherwise(F.col("name"))
    return cut.select("path", name.alias("chunk_name"), F.sha2(F.concat_ws("\0", "path", a.cast("string"), b.cast("string"), name), 256).alias("chunk_id"), a.alias("line_start"), b.alias("line_end"))


def sibling_stems(lines: DataFrame, hits: DataFrame, query: str) -> DataFrame:
    """(path, line, text): further lines of files already hit that have the query's stem, what stands before its last dash or underscore, in any
    case; nothing without a stem."""
    from loomfield.operators.retrieval import stem

    part = stem(query)
    if not part:
        return lines.where("false")
    near = lines.where(F.locate(part.lower(), F.lower("text")) > 0).join(hits.select("path").distinct(), "path", "left_semi")
    return near.join(hits.select("path", "line"), ["path", "line"], "left_anti").select("path", "line", "text")


def fullest_window(lines: DataFrame, terms: list[str], span: int = 140) -> DataFrame:
    """(path, line, last_line, hits): the window of so many lines with most hits of any term in each file, the earliest of equals."""
    low = F.lower("text")
    n = sum((F.locate(t.lower(), low).cast("boolean").cast("int") for t in terms), F.lit(0))
    hits = lines.select("path", F.col("line").cast("bigint").alias("line"), n.alias("n")).where("n > 0")
    w = Window.partitionBy("path").orderBy("line").rangeBetween(0, span - 1)
    summed = hits.select("path", "line", F.sum("n").over(w).alias("hits"))
    best = summed.groupBy("path").agg(F.max_by(F.struct("line", "hits"), F.struct(F.col("hits"), -F.col("line"))).alias("b"))
    return best.select("path", F.col("b.line").alias("line"), (F.col("b.line") + span - 1).alias("last_line"), F.col("b.hits").alias("hits"))


def symbol_with_context(lines: DataFrame, symbols: DataFrame, name: str | DataFrame) -> DataFrame:
    """(path, part, line, text): for each declaration of a name, or of any in a table of names, its own lines, its file's imports whose last word it uses, and the signatures of the
    declarations beside it."""
    asked = symbols.sparkSession.createDataFrame([(name,)], "name string") if isinstance(name, str) else name.select("name")
    own = symbols.join(asked, "name", "left_semi").select("path", F.col("line").alias("_a"), F.col("end_line").alias("_b"))
    inside = lines.join(own, "path").where((F.col("line") >= F.col("_a")) & (F.col("line") <= F.col("_b"))).select("path", F.lit("body").alias("part"), "line", "text")
    used = inside.select("path", F.explode(F.regexp_extract_all("text", F.lit(f"({tx.IDENTIFIER})"), F.lit(1))).alias("_w")).distinct()
    imported = lines.join(own.select("path").distinct(), "path", "left_semi").where(F.col("line") <= 60).where(F.col("text").rlike(r"^\s*(?:import\b|from\s|using\s|use\s|const .*require\()"))
    bound = imported.select("path", "line", "text", F.explode(F.regexp_extract_all("text", F.lit(f"({tx.IDENTIFIER})"), F.lit(1))).alias("_w"))
    kept = bound.join(used, ["path", "_w"], "left_semi").select("path", F.lit("import").alias("part"), "line", "text").distinct()
    beside = symbols.join(asked, "name", "left_anti").join(own.select("path").distinct(), "path", "left_semi").select("path", F.lit("sibling").alias("part"), "line", F.col("signature").alias("text"))
    return inside.unionByName(kept).unionByName(beside)


def retracted(served: DataFrame, carried: DataFrame) -> DataFrame:
    """(keys, start, end): of spans served (request_id, path, start, end) those that a response (request_id, path, start, end) carried, cut to what it carried;
    what no response carried is taken back."""
    both = intervals.overlaps(served.distinct(), carried.distinct(), ["request_id", "path"])
    return both.select("request_id", "path", F.greatest("a_start", "b_start").alias("start"), F.least("a_end", "b_end").alias("end")).distinct()


def packages(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(root, name, version, main, commands): packages by their package.json, commands the sorted names of its scripts, at most ten."""
    found = files.where(tx.basename(F.col(path)) == "package.json").select(F.col(path).alias("_path"), F.col(content).alias("_json")).where(F.try_parse_json("_json").isNotNull())
    names = F.slice(F.array_sort(F.coalesce(F.json_object_keys(F.get_json_object("_json", "$.scripts")), F.array().cast("array<string>"))), 1, 10)
    get = lambda key: F.get_json_object("_json", f"$.{key}")
    return found.select(tx.parent(F.col("_path")).alias("root"), get("name").alias("name"), get("version").alias("version"), get("main").alias("main"), names.alias("commands"))


def entry_points(files: DataFrame, path: str = "path", most: int = 10) -> DataFrame:
    """(path, score): files that programs begin with: 6 index, 5 main and app, 4 server, worker, cli and bin, 3 extension; 2 more in a folder of that kind."""
    stem = F.lower(F.regexp_replace(tx.basename(F.col(path)), r"\..*\z", ""))
    score = F.when(stem == "index", 6).when(stem.isin("main", "app"), 5).when(stem.isin("server", "worker", "cli", "bin"), 4).when(stem == "extension", 3).otherwise(0)
    more = F.when(F.lower(path).rlike(r"(?:^|/)(?:server|worker|bin|cli)/"), 2).otherwise(0)
    rated = files.select(F.col(path).alias("path"), score.alias("_s"), (score + more).alias("score")).where("_s > 0").drop("_s").distinct()
    return rated.orderBy(F.desc("score"), "path").limit(most)


def unique_target(texts: DataFrame, search: str, path: str = "path", content: str = "content") -> DataFrame:
    """(path): the only text that has a search exactly once; none if there are more or none."""
    n = F.size(F.split(F.col(content), re.escape(search).replace("\\ ", " "), -1)) - 1
    hits = texts.where(F.col(content).contains(search)).select(F.col(path).alias("path"), n.alias("_n"))
    total = hits.agg(F.sum("_n").alias("_all")).scalar()
    return hits.where(total == 1).select("path")


def write_trace(events: DataFrame, target: str, clock: str = "seq") -> None:
    """Appends events as JSON lines in the order of their logical clock within each file."""
    events.sortWithinPartitions(clock).write.mode("append").json(target)
