"""Line ranges as intervals: union, complement, overlap and containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parsed(df: DataFrame, text: str, start: str = "start", end: str = "end") -> DataFrame:
    """Adds the bounds of ranges written ``a-b``, ``a,b`` or ``a``, with or without an L; null bounds where there are none."""
    bare = F.regexp_replace(F.col(text), r"[Ll\s]", "")
    first = F.regexp_extract(bare, r"^(\d+)(?:[-,](\d+))?\z", 1)
    last = F.regexp_extract(bare, r"^(\d+)(?:[-,](\d+))?\z", 2)
    a = first.try_cast("bigint")
    return df.withColumn(start, a).withColumn(end, F.coalesce(F.when(last != "", last).try_cast("bigint"), a))


def union(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end): the union of each key's spans; overlapping and adjacent ones become one.

    Spans with a null bound or an end before their start are none. Equal spans are reduced before anything is ordered.
    """
    real = spans.where((F.col(start) <= F.col(end)) & F.col(start).isNotNull()).groupBy(*keys, start).agg(F.max(end).alias(end))
    w = Window.partitionBy(*keys).orderBy(start)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = real.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + 1), 1).otherwise(0))
    islands = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def complement(merged: DataFrame, keys: list[str], total: str, start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end): what of 1..total the merged spans of each key leave. ``total``: a column, equal within a key."""
    w = Window.partitionBy(*keys).orderBy(start)
    gaps = merged.select(*keys, (F.col(end) + 1).alias("_a"), (F.coalesce(F.lead(start).over(w), F.col(total) + 1) - 1).alias("_b"), F.col(total).alias("_t"))
    first = merged.groupBy(*keys).agg((F.min(start) - 1).alias("_b"), F.first(total).alias("_t")).select(*keys, F.lit(1).cast("bigint").alias("_a"), "_b", "_t")
    both = gaps.unionByName(first).withColumn("_b", F.least("_b", "_t"))
    return both.where(F.col("_a") <= F.col("_b")).select(*keys, F.col("_a").alias(start), F.col("_b").alias(end))


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], block: int = 64) -> DataFrame:
    """(keys, a_start, a_end, b_start, b_end): pairs of spans of a key that share a line.

    Spans are laid on blocks of lines and joined by (key, block), so that a key with very many spans is spread over its
    blocks; a pair is given for the first block that both touch, so once.
    """

    def laid(df: DataFrame, name: str) -> DataFrame:
        cells = F.sequence(F.floor(F.col("start") / block), F.floor(F.col("end") / block))
        real = df.where("start <= end")
        return real.select(*keys, F.col("start").alias(f"{name}_start"), F.col("end").alias(f"{name}_end"), F.explode(cells).alias("_block"))

    joined = laid(a, "a").join(laid(b, "b"), [*keys, "_block"])
    hit = (F.col("a_start") <= F.col("b_end")) & (F.col("a_end") >= F.col("b_start"))
    once = F.col("_block") == F.floor(F.greatest("a_start", "b_start") / block)
    return joined.where(hit & once).drop("_block")


def overlap_counts(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end, overlapping): with how many distinct spans of its key each one shares a line, itself included; no pair is made.

    A span misses those that end before it starts and those that start after it ends; both are running counts over the places of
    starts and ends, of which a key has as many as lines, however many spans it has.
    """
    real = spans.where(F.col(start) <= F.col(end)).select(*keys, start, end).distinct().withColumn("_n", F.lit(1).cast("bigint"))
    begin = real.groupBy(*keys, F.col(start).alias("_at")).agg(F.sum("_n").alias("_b"), F.lit(0).cast("bigint").alias("_e"))
    close = real.groupBy(*keys, (F.col(end) + 1).alias("_at")).agg(F.lit(0).cast("bigint").alias("_b"), F.sum("_n").alias("_e"))
    places = begin.unionByName(close).groupBy(*keys, "_at").agg(F.sum("_b").alias("_b"), F.sum("_e").alias("_e"))
    w = Window.partitionBy(*keys).orderBy("_at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    counted = places.select(*keys, "_at", F.coalesce(F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_begun"), F.sum("_e").over(upto).alias("_ended"))
    starts = real.withColumn("_at", F.col(start)).join(counted.select(*keys, "_at", "_ended"), [*keys, "_at"]).drop("_at")
    both = starts.withColumn("_at", F.col(end) + 1).join(counted.select(*keys, "_at", "_begun"), [*keys, "_at"])
    return both.select(*keys, start, end, (F.col("_begun") - F.col("_ended")).alias("overlapping"))


def containing(points: DataFrame, spans: DataFrame, keys: list[str], point: str = "line", label: str = "label", block: int = 64) -> DataFrame:
    """Each distinct point with the label of the innermost span that holds it, the latest start and then the earliest end; null without one.

    Spans are laid on blocks and joined with the points by (key, block), so that neither a long text nor a span over all
    of it is one task's work.
    """
    cells = F.sequence(F.floor(F.col("start") / block), F.floor(F.col("end") / block))
    laid = spans.where("start <= end").select(*keys, "start", "end", F.col(label).alias("_label"), F.explode(cells).alias("_block"))
    asked = points.select(*keys, point).distinct()
    held = asked.withColumn("_block", F.floor(F.col(point) / block)).join(laid, [*keys, "_block"]).where(F.col(point).between(F.col("start"), F.col("end")))
    inner = held.groupBy(*keys, point).agg(F.max_by("_label", F.struct("start", -F.col("end"))).alias(label))
    return asked.join(inner, [*keys, point], "left")
