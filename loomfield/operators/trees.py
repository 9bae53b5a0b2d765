"""Folders: counts, module maps, digests, roots and the mass of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions import text as tx
from loomfield.session import checkpointed


def tree_counts(files: DataFrame, path: str = "path", depth: int | None = None) -> DataFrame:
    """(dir, depth, files): how many files are below each folder at any depth, down to ``depth`` folders."""
    up = files.select(F.posexplode(tx.ancestors(F.col(path))).alias("_at", "dir"))
    counted = up.groupBy("dir", (F.col("_at") + 1).alias("depth")).agg(F.count("*").alias("files"))
    return counted.where(F.col("depth") <= depth) if depth else counted


def module_map(files: DataFrame, path: str = "path") -> DataFrame:
    """(dir, child, children): the distinct direct children of each folder, '.' for the root, a row a child, and how many there are.

    Rows, not lists: a folder may hold a third of all files.
    """
    parts = F.split(F.col(path), "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.when(i == 1, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), i - 1), "/")).alias("dir"), F.element_at(parts, i).alias("child")))
    pairs = files.where(F.col(path).isNotNull()).select(F.explode(steps).alias("s")).select("s.dir", "s.child").distinct()
    return pairs.join(pairs.groupBy("dir").agg(F.count("*").alias("children")), "dir")


def folder_digests(files: DataFrame, path: str = "path", content_hash: str = "hash") -> DataFrame:
    """(dir, digest, entries): SHA-256 of each folder's sorted lines of name, tab and hash, bottom-up; '.' is the root.

    The lines of a folder are collected, so this is for trees whose folders have a bounded number of entries; where a folder may
    hold a third of all files, use a hash that is a sum of entries instead. One aggregation a level of depth.
    """
    clean = files.where(F.col(path).isNotNull() & F.col(content_hash).isNotNull()).select(F.col(path).alias("_path"), F.col(content_hash).alias("_hash"))
    entries = clean.select(tx.parent(F.col("_path")).alias("_dir"), tx.basename(F.col("_path")).alias("_name"), "_hash", F.size(F.split("_path", "/")).alias("_depth"))
    entries = checkpointed(entries)
    deepest = entries.agg(F.max("_depth")).first()[0] or 0
    levels, below = [], None
    for depth in range(deepest, 0, -1):
        here = entries.where(F.col("_depth") == depth).select("_dir", "_name", "_hash")
        if below is not None:
            here = here.unionByName(below.select(tx.parent(F.col("dir")).alias("_dir"), tx.basename(F.col("dir")).alias("_name"), F.col("digest").alias("_hash")))
        line = F.concat("_name", F.lit("\t"), "_hash", F.lit("\n"))
        below = here.groupBy(F.col("_dir").alias("dir")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_name", line.alias("_line")))), lambda s: s["_line"]), ""), 256).alias("digest"), F.count("*").alias("entries"))
        levels.append(below)
    if not levels:
        return clean.select(F.col("_path").alias("dir"), F.col("_hash").alias("digest"), F.lit(0).cast("bigint").alias("entries"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def stale(before: DataFrame, now: DataFrame) -> DataFrame:
    """(stale): whether the root's digest is another than before, or there was none: one row, so that what is fresh need not be written."""
    root = lambda df, name: df.where("dir = '.'").agg(F.max("digest").alias(name))
    both = root(before, "_a").unionByName(root(now, "_b"), allowMissingColumns=True).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return both.select((~F.col("_a").eqNullSafe(F.col("_b")) | F.col("_a").isNull()).alias("stale"))


def roots_of(files: DataFrame, markers: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """Each path with the longest marker folder above it; null without one. An equi-join on ancestors, no prefix scan."""
    paths = files.select(path).distinct()
    up = paths.select(path, F.explode(tx.ancestors(F.col(path))).alias("_dir"))
    marked = up.join(markers.select(F.col(root).alias("_dir")).distinct(), "_dir", "left_semi")
    best = marked.groupBy(path).agg(F.max_by("_dir", F.length("_dir")).alias(root))
    return paths.join(best, path, "left")


def dominant(items: DataFrame, root: str, weight: Column | None = None, order: str | None = None) -> DataFrame:
    """(root, weight): the root with the largest sum of weights, the first seen of equals; nothing for an empty table."""
    w = weight if weight is not None else F.lit(1.0)
    by = items.groupBy(root).agg(F.sum(w).alias("weight"), F.min(order if order else root).alias("_first"))
    return by.orderBy(F.desc("weight"), "_first").limit(1).select(root, "weight")


def cluster_root(items: DataFrame, path: str = "path", score: str = "score", top: int = 8, share: float = 0.6, least_depth: int = 2) -> DataFrame:
    """(dir, depth, mass): the deepest folder, at least two down, that holds the share of the score of the top items."""
    best = items.orderBy(F.desc(score), path).limit(top)
    total = best.agg(F.sum(score).alias("_total")).scalar()
    up = best.select(score, F.posexplode(tx.ancestors(F.col(path))).alias("_at", "dir"))
    mass = up.groupBy("dir", (F.col("_at") + 1).alias("depth")).agg(F.sum(score).alias("_mass"))
    held = mass.select("dir", "depth", (F.col("_mass") / total).alias("_m")).withColumn("mass", F.round("_m", 6)).select("dir", "depth", "mass", "_m")
    return held.where((F.col("_m") >= share) & (F.col("depth") >= least_depth)).orderBy(F.desc("depth"), F.desc("_m"), "dir").limit(1).drop("_m")


def coverage(items: DataFrame, label: str, required: list[str]) -> DataFrame:
    """(label, covered) of the required labels."""
    spark = items.sparkSession
    wanted = spark.createDataFrame([(x,) for x in required], "label string")
    present = items.select(F.col(label).alias("label")).distinct().withColumn("_in", F.lit(True))
    return wanted.join(present, "label", "left").select("label", F.coalesce("_in", F.lit(False)).alias("covered"))


def basename_frequency(files: DataFrame, path: str = "path") -> DataFrame:
    """(token, files): in how many files' names each part occurs, and the joined name itself."""
    stem = F.regexp_replace(tx.basename(F.col(path)), r"\.[^.]*\z", "")
    tokens = F.array_distinct(F.array_append(tx.identifier_parts(stem), F.lower(stem)))
    return files.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("files"))


def snapshot_actions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, action): what a rebuild does with each file, from two tables of path, size_bytes, mtime_ms, hash, valid.

    reuse: same size and time, or the same hash, and its symbols still found (``valid`` of the new side); reparse: else;
    add and drop: on one side only. One full outer join by path.
    """
    a = old.select("path", *[F.col(c).alias(f"_{c}") for c in ("size_bytes", "mtime_ms", "hash")], F.lit(True).alias("_old"))
    b = new.select("path", "size_bytes", "mtime_ms", "hash", "valid", F.lit(True).alias("_new"))
    same = (F.col("size_bytes") == F.col("_size_bytes")) & (F.col("mtime_ms") == F.col("_mtime_ms"))
    action = (
        F.when(F.col("_old").isNull(), "add")
        .when(F.col("_new").isNull(), "drop")
        .when(F.coalesce(F.col("valid"), F.lit(False)) & F.coalesce(same, F.lit(False)), "reuse-stat")
        .when(F.coalesce(F.col("valid"), F.lit(False)) & F.coalesce(F.col("hash") == F.col("_hash"), F.lit(False)), "reuse-hash")
        .otherwise("reparse")
    )
    return a.join(b, "path", "full").select("path", action.alias("action"))


def first_by_priority(candidates: DataFrame, keys: list[str], priority: str) -> DataFrame:
    """One row of each key, of the lowest priority number."""
    w = Window.partitionBy(*keys).orderBy(priority)
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
