"""Reference graphs between files and the ranks of files in them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions import paths
from loomfield.functions import text as tx
from loomfield.operators.products import shared_words
from loomfield.session import checkpointed

#: A source has at most so many targets.
EDGE_CAP = 50
#: Symbols and links that one task can rank in memory: some hundred megabytes.
SMALL = 2_000_000


def targets(symbols: DataFrame, tokens: DataFrame, cap: int = EDGE_CAP) -> DataFrame:
    """(src_path, dst_path, name, times): the symbols of other files whose names a file's text has as words.

    ``symbols``: path, name, position (the order in which names are first seen); ``tokens``: path, token, distinct. Names are
    looked up by equality of tokens, not by a scan of every text for every name. A file takes its first ``cap`` targets,
    by the names' first-seen order and then the definitions'. So of a name only the first ``cap`` + 1 definitions can count
    (one may be the file's own), and only the names before the cap is full are expanded: a name that a third of all files
    define never meets the files that use it in full. ``times``: how often the target file defines the name.
    """
    defined = symbols.groupBy("path", "name").agg(F.count("*").alias("times"), F.min("position").alias("position"))
    order = Window.partitionBy("name").orderBy("position", "path")
    kept = defined.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= cap + 1)
    names = kept.groupBy("name").agg(F.min("position").alias("_seen"), F.count("*").alias("_n"))
    w = Window.partitionBy("path").orderBy("_seen", "name")
    hits = tokens.select("path", F.col("token").alias("name")).join(names, "name")
    full = F.coalesce(F.sum(F.col("_n") - 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    early = hits.withColumn("_before", full).where(F.col("_before") < cap).select(F.col("path").alias("src_path"), "name", "_seen")
    pairs = early.join(kept.select(F.col("path").alias("dst_path"), "name", "times", "_k"), "name").where("src_path <> dst_path")
    ranked = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("src_path").orderBy("_seen", "name", "_k")))
    return ranked.where(F.col("_r") <= cap).select("src_path", "dst_path", "name", "times")


def lexical_edges(symbols: DataFrame, tokens: DataFrame, cap: int = EDGE_CAP) -> DataFrame:
    """(src, dst, weight): from each symbol, as path:name, to its file's targets but for those of its own name."""
    sources = symbols.select(F.col("path").alias("src_path"), F.col("name").alias("src_name")).distinct()
    edges = sources.join(targets(symbols, tokens, cap), "src_path").where(F.col("src_name") != F.col("name"))
    return edges.select(F.concat("src_path", F.lit(":"), "src_name").alias("src"), F.concat("dst_path", F.lit(":"), "name").alias("dst"), F.col("times").cast("double").alias("weight"))


def file_edges(symbols: DataFrame, tokens: DataFrame) -> DataFrame:
    """(src, dst, weight) between files: how many of the names that one declares the other has as words. All edges, without a cap.

    ``symbols``: path, name; ``tokens``: path, and token or tokens, an array of them. Repeated rows count once. No edge is shuffled: see ``shared_words``.
    """
    words = F.col("tokens") if "tokens" in tokens.columns else F.array("token")
    used = tokens.select("path", F.array_compact(words).alias("words"))
    defined = checkpointed(symbols.where("path is not null and name is not null").groupBy("path").agg(F.collect_set("name").alias("words")))
    return shared_words(used, defined, defined.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0])


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, iterations: int = 20, every: int = 5) -> DataFrame:
    """(id, rank): personalised PageRank with a fixed number of rounds.

    ``nodes``: id, preference (null counts 1). The start and the jump are the preference, not normalised; what dangling
    nodes hold is not handed on. Shares of edges are computed once and kept dealt out by source, so that a round shuffles
    only ranks and what sources hand on, added up by target; the lineage is cut with a reliable checkpoint every few rounds,
    and a lost part of what is kept is made again from one.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("_all"))
    shares = checkpointed(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_all")).alias("share"))).repartition("src").persist(StorageLevel.DISK_ONLY)
    base = checkpointed(nodes.groupBy("id").agg(F.max(F.coalesce("preference", F.lit(1.0))).cast("double").alias("preference"))).repartition("id").persist(StorageLevel.DISK_ONLY)
    ranks = base.select("id", F.col("preference").alias("rank"))
    for n in range(1, iterations + 1):
        given = shares.join(ranks, shares["src"] == ranks["id"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("_in"))
        ranks = base.join(given, base["id"] == given["dst"], "left").select("id", ((1 - damping) * F.col("preference") + damping * F.coalesce("_in", F.lit(0.0))).alias("rank"))
        if n % every == 0 or n == iterations:
            ranks = checkpointed(ranks)
    shares.unpersist()
    base.unpersist()
    return ranks


def _ranks_in_one_task(base: DataFrame, links: DataFrame, damping: float, iterations: int) -> DataFrame:
    """(id, rank) by rounds over arrays; for graphs whose size has been checked."""

    def run(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.drop_duplicates("id").sort_values("id", ignore_index=True)
        ids, preference, weight = nodes["id"].to_numpy(), nodes["preference"].to_numpy(), nodes["weight"].to_numpy()
        files, file_of = np.unique(nodes["file"].to_numpy(), return_inverse=True)

        def places(of: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(of, values), max(0, len(of) - 1))
            return at, of[at] == values if len(of) else np.zeros(len(values), dtype=bool)

        (source, known), (target, there), (twin, own) = places(files, edges["file"].to_numpy()), places(ids, edges["dst"].to_numpy()), places(ids, edges["twin"].to_numpy())
        times, known, own = edges["times"].to_numpy(), known & there, own & there
        rank = preference.copy()
        for _ in range(iterations):
            gives = np.divide(rank, weight, out=np.zeros_like(rank), where=weight > 0)
            whole = np.bincount(file_of, gives, len(files))
            got = np.bincount(target[known], times[known] * whole[source[known]], len(ids)) - np.bincount(target[own], times[own] * gives[twin[own]], len(ids))
            rank = (1 - damping) * preference + damping * got
        return pd.DataFrame({"id": ids, "rank": rank})

    one = F.lit(1).alias("_one")
    nodes, edges = base.select(one, "id", "file", "preference", "weight"), links.select(one, "file", "twin", "dst", "times")
    return nodes.groupBy("_one").cogroup(edges.groupBy("_one")).applyInPandas(run, "id bigint, rank double")


def symbol_ranks(symbols: DataFrame, tokens: DataFrame, preferences: DataFrame | None = None, damping: float = 0.85, iterations: int = 20, cap: int = EDGE_CAP, every: int = 5, small: int = SMALL) -> DataFrame:
    """(path, rank): the largest rank of each file's symbols, as ``pagerank`` over ``lexical_edges`` gives it, without making these edges.

    All symbols of a file have the targets of the file, but for those of their own name. So what a target gets from a file is
    the sum over the file's symbols, less what the symbol of the target's name would give: a round needs a row a file and
    target, not a row a symbol and target. Symbols are numbered by 64-bit hashes of path and name. ``preferences``: path,
    preference; 1 without. A graph of at most ``small`` symbols and links, which are counted, is ranked by one task in memory, a larger
    one by rounds of joins; both add up the same sums.
    """
    node = lambda path, name: F.xxhash64(F.col(path), F.col(name))
    own = symbols.select("path", "name").distinct()
    given = own.join(preferences.groupBy("path").agg(F.max("preference").alias("preference")), "path", "left") if preferences is not None else own.withColumn("preference", F.lit(1.0))
    reach = targets(symbols, tokens, cap).withColumn("times", F.col("times").cast("double"))
    links = checkpointed(reach.select(F.xxhash64("src_path").alias("file"), node("src_path", "name").alias("twin"), node("dst_path", "name").alias("dst"), "times"))
    by_file = links.groupBy("file").agg(F.sum("times").alias("_all"))
    by_twin = links.groupBy("twin").agg(F.sum("times").alias("_same"))
    base = given.select(node("path", "name").alias("id"), F.xxhash64("path").alias("file"), "path", F.coalesce("preference", F.lit(1.0)).cast("double").alias("preference"))
    weight = F.coalesce("_all", F.lit(0.0)) - F.coalesce("_same", F.lit(0.0))
    base = base.join(by_file, "file", "left").join(by_twin.withColumnRenamed("twin", "id"), "id", "left").select("id", "file", "path", "preference", weight.alias("weight"))
    base = checkpointed(base)
    kept = base.select("id", "file", "preference", "weight").repartition("id").persist(StorageLevel.DISK_ONLY)
    dealt = links.repartition("file").persist(StorageLevel.DISK_ONLY)
    # what a symbol would give to targets of its own name is taken back; few files declare a name that they have as a target
    own_links = checkpointed(links.join(base.where("weight > 0").select(F.col("id").alias("twin")), "twin", "left_semi").select("twin", "dst", "times"))
    if base.count() + links.count() <= small:  # both are written, so counting them is cheap
        ranks = _ranks_in_one_task(base, links, damping, iterations)
        kept.unpersist()
        dealt.unpersist()
        return base.join(ranks, "id").groupBy("path").agg(F.max("rank").alias("rank"))
    ranks = kept.select("id", F.col("preference").alias("rank"))
    held: list[DataFrame] = []
    for n in range(1, iterations + 1):
        # used twice in a round, so it is kept on the executors' disks: a row a symbol; a lost part is made again from the last checkpoint
        gives = kept.join(ranks, "id").where("weight > 0").select("id", "file", (F.col("rank") / F.col("weight")).alias("gives")).persist(StorageLevel.DISK_ONLY)
        held.append(gives)
        whole = gives.groupBy("file").agg(F.sum("gives").alias("_sum"))
        flows = dealt.join(whole, "file").select("dst", (F.col("times") * F.col("_sum")).alias("_in"))
        back = own_links.join(gives.select(F.col("id").alias("twin"), "gives"), "twin").select("dst", (-F.col("times") * F.col("gives")).alias("_in"))
        got = flows.unionByName(back).groupBy(F.col("dst").alias("id")).agg(F.sum("_in").alias("_in"))  # added up in one shuffle
        ranks = kept.join(got, "id", "left").select("id", ((1 - damping) * F.col("preference") + damping * F.coalesce("_in", F.lit(0.0))).alias("rank"))
        if n % every == 0 or n == iterations:
            ranks = checkpointed(ranks)
            for one in held:
                one.unpersist()
            held.clear()
    kept.unpersist()
    dealt.unpersist()
    return base.join(ranks, "id").groupBy("path").agg(F.max("rank").alias("rank"))


def file_scores(ranks: DataFrame, files: DataFrame, top: int | None = 40) -> DataFrame:
    """(path, score, place): each file's largest rank, 1 without any, brought to 0..1; the best ``top`` files.

    If all ranks are equal, so are the scores: 1. Scores equal to nine digits tie, as sums of floating numbers differ beyond by the order of adding; ties by path. ``ranks``: rank, and either path or a node's id, whose path is what stands
    before its first colon.
    """
    by = F.substring_index("id", ":", 1) if "id" in ranks.columns else F.col("path")
    best = ranks.groupBy(by.alias("path")).agg(F.max("rank").alias("_rank"))
    all_files = files.select("path").distinct().join(best, "path", "left").withColumn("_rank", F.coalesce("_rank", F.lit(1.0)))
    low, high = (all_files.agg(f("_rank").alias("_x")).scalar() for f in (F.min, F.max))
    scored = all_files.select("path", F.round(F.when(high == low, 1.0).otherwise((F.col("_rank") - low) / (high - low)), 9).alias("score"))
    if not top:
        return scored
    best_files = scored.orderBy(F.desc("score"), "path").limit(top)
    return best_files.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "path")))  # at most top rows


def count_scores(symbols: DataFrame) -> DataFrame:
    """(path, score): a file's number of symbols, by the largest."""
    counted = symbols.groupBy("path").agg(F.count("*").alias("_n"))
    most = counted.agg(F.max("_n").alias("_most")).scalar()
    return counted.select("path", (F.col("_n") / most).alias("score"))


def definition_references(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """(name, definition, reference_file, n_files): each name with the file that defines it last, a row a file that uses it, and how many do.

    ``defs``: path, name, position; ``refs``: path, name. Uses in a file that defines the name itself don't count, and names
    without a use drop out. Rows, not lists: a name may be used by a third of all files.
    """
    local = defs.select("path", "name").distinct()
    used = refs.select("path", "name").distinct().join(local, ["path", "name"], "left_anti")
    last = defs.groupBy("name").agg(F.max_by("path", "position").alias("definition"))
    counted = last.join(used.groupBy("name").agg(F.count("*").alias("n_files")), "name")
    return counted.join(used.select("name", F.col("path").alias("reference_file")), "name").select("name", "definition", "reference_file", "n_files")


def imports(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """(path, imported): the distinct other files that define names which a file uses and does not define."""
    local = defs.select("path", "name").distinct()
    used = refs.select("path", "name").distinct().join(local, ["path", "name"], "left_anti")
    return used.join(local.withColumnRenamed("path", "imported"), "name").where("path <> imported").select("path", "imported").distinct()


def reused_edges(previous: DataFrame, fresh: DataFrame, old_files: DataFrame, new_files: DataFrame) -> DataFrame:
    """Edges of unchanged files (same path and mtime_ms) from before, of all others anew; ``src_path`` tells an edge's file."""
    kept = new_files.select("path", "mtime_ms").intersect(old_files.select("path", "mtime_ms")).select(F.col("path").alias("src_path"))
    return previous.join(kept, "src_path", "left_semi").unionByName(fresh.join(kept, "src_path", "left_anti"))


def symbol_search(symbols: DataFrame, query: str, scores: DataFrame | None = None, recent: DataFrame | None = None, scope: str | None = None, limit: int = 20) -> DataFrame:
    """(path, line, name, score, total): the best symbols for a query.

    ``symbols``: path, line, name. The weights: 4 the name itself, 2 a part of it, 2 the share of the query's words among its parts,
    1.5 a substring, 1.5 the share among the path's parts, 0.5 the file's score, 1 recently changed, 1 the scope in the path,
    -1 a test, -2 build output. One row a file without a scope. Ties by path and line. Each row is scored on its own; only the first
    ``limit`` rows are ordered.
    """
    if not 1 <= limit <= 50:
        raise ValueError("a limit between 1 and 50")
    q = query.lower()
    words = [w for w in q.replace("_", " ").split() if w]
    name = F.lower("name")
    parts = tx.identifier_parts(F.col("name"))
    exact, camel, sub = (name == q).cast("int"), F.array_contains(parts, q).cast("int"), F.lit(1) if not q else (F.locate(q, name) > 0).cast("int")
    share = lambda tokens: sum((F.array_contains(tokens, w).cast("double") for w in words), F.lit(0.0)) / max(1, len(words))
    by_name = F.when((F.lit(len(words)) == 1) & (camel == 1), 0.0).otherwise(share(parts))
    path = F.col("path")
    stem = F.regexp_replace(tx.basename(path), r"\.[^.]*\z", "")
    path_parts = F.concat(F.filter(F.split(F.lower(path), r"[/._]"), lambda p: p != ""), tx.identifier_parts(stem))
    by_path = share(path_parts)
    rows = symbols.select("path", "line", "name")
    if scores is not None:
        most = scores.agg(F.max("score").alias("_most")).scalar()
        rows = rows.join(scores.select("path", F.col("score").alias("_file")), "path", "left")
        rank = F.coalesce(F.when(most > 0, F.col("_file") / most), F.lit(0.0))
    else:
        rank = F.lit(0.0)
    if recent is not None:
        rows = rows.join(recent.select("path", F.lit(1).alias("_recent")).distinct(), "path", "left")
        fresh = F.coalesce("_recent", F.lit(0))
    else:
        fresh = F.lit(0)
    hint = F.locate(scope, path).cast("boolean").cast("int") if scope else F.lit(0)
    noise = F.lit(0) if scope else paths.is_noise(path).cast("int")
    gate = (exact + camel + sub > 0) | (by_name > 0) | (by_path > 0) if q.strip() else F.lit(bool(scope))
    score = 4.0 * exact + 2.0 * camel + 2.0 * by_name + 1.5 * sub + 1.5 * by_path + 0.5 * rank + 1.0 * fresh + 1.0 * hint - 1.0 * paths.is_test(path).cast("int") - 2.0 * noise
    scored = rows.where(paths.under(path, scope) if scope else F.lit(True)).where(gate).select("path", "line", "name", F.round(score, 6).alias("score"))
    if not scope:
        best = scored.groupBy("path").agg(F.max_by(F.struct("line", "name", "score"), F.struct(F.col("score"), -F.col("line"), "name")).alias("b"))
        scored = best.select("path", "b.line", "b.name", "b.score")
    total = scored.agg(F.count("*").alias("total")).scalar()
    return scored.orderBy(F.desc("score"), "path", "line", "name").limit(limit).select("*", total.alias("total"))
