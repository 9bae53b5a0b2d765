"""Mixing sources to target shares (problem 8) by pivotal dependent rounding.

Every row of a source is to be repeated the same, in general fractional, number of times. The whole part is certain; the
fraction is a probability, and pairs of rows exchange probability at random, with what either holds in tokens unchanged
and each row's expectation kept, until one of both is decided. One row at most stays open in a group of rows; the open
rows of the groups meet in the next level of a reduction tree until one is left a source. A reserve of short texts is rounded
last, so that the tokens drawn of a source differ from its target by less than one short text, if it has enough of them.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.session import checkpointed

#: Rows that one task rounds at once.
GROUP = 20_000
#: The reserve has about so many times the tokens of the longest text of its source, in texts of at most a SHORT-th of that, but no more rows than a group.
RESERVE, SHORT = 4, 16


def draw(seed: int, a: object, b: object) -> float:
    """A uniform number that depends on nothing but the seed and the two rows."""
    import xxhash

    return xxhash.xxh64_intdigest(f"{a}|{b}", seed=seed) / 2.0**64


def _pivot(ids: list, sizes: list[float], out: list[float], order: list[int], seed: int) -> int | None:
    """Round out[i] for i in order by exchanging mass between pairs; the index of the one left open, if any."""
    eps = 1e-9
    held = None
    for i in order:
        p = out[i]
        if p <= eps or p >= 1 - eps:
            out[i] = 0.0 if p <= eps else 1.0
            continue
        if held is None:
            held = i
            continue
        j, n_i, n_j = held, sizes[i], sizes[held]
        m_i, m_j = out[i] * n_i, out[j] * n_j
        to_i, to_j = min(n_i - m_i, m_j), min(n_j - m_j, m_i)
        if draw(seed, ids[j], ids[i]) * (to_i + to_j) < to_j:
            m_i, m_j = m_i + to_i, m_j - to_i
        else:
            m_i, m_j = m_i - to_j, m_j + to_j
        held = None
        for k, m, n in ((i, m_i, n_i), (j, m_j, n_j)):
            q = m / n
            if q <= eps or q >= 1 - eps:
                out[k] = 0.0 if q <= eps else 1.0
            else:
                out[k], held = q, k
    return held


def rounded(ids: list, sizes: list[float], shares: list[float], seed: int, last: bool = False, reserve: list[bool] | None = None) -> list[float]:
    """The shares after pivotal rounding: all 0 or 1 but for one; that one too if ``last``.

    The last open row may be a long text, and drawing it or not would miss the target by much of it. So the rows of the
    reserve, short texts, are rounded after it: what it draws too much or too little, zero on average, is first taken from
    or given to them in proportion.
    """
    out = list(shares)
    reserve = reserve or [False] * len(out)
    held = _pivot(ids, sizes, out, [i for i, r in enumerate(reserve) if not r], seed)
    if not last:
        return out
    spare = [i for i, r in enumerate(reserve) if r]
    if held is not None:
        drawn = 1.0 if draw(seed, ids[held], "last") < out[held] else 0.0
        excess = (drawn - out[held]) * sizes[held]
        out[held] = drawn
        room = sum(out[i] * sizes[i] if excess > 0 else (1 - out[i]) * sizes[i] for i in spare)
        part = min(1.0, abs(excess) / room) if room > 0 else 0.0
        for i in spare:
            out[i] = out[i] * (1 - part) if excess > 0 else out[i] + (1 - out[i]) * part
    held = _pivot(ids, sizes, out, sorted(spare, key=lambda i: -sizes[i]), seed)
    if held is not None:
        out[held] = 1.0 if draw(seed, ids[held], "end") < out[held] else 0.0
    return out


def rates(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Copies of each row by source. Without a total, the largest total at which every share is met exactly.

    Sources without tokens or share are left out, and the other shares scaled up; with a given total, a source that
    cannot supply its share gives all it may.
    """
    live = {s: t for s, t in targets.items() if t[0] > 0 and t[1] > 0 and tokens.get(s, 0) > 0}
    scale = sum(share for share, _ in live.values())
    if not live:
        return {}
    if total is None:
        total = min(cap * tokens[s] * scale / share for s, (share, cap) in live.items())
    return {s: min(float(cap), total * share / scale / tokens[s]) for s, (share, cap) in live.items()}


def mixed(counted: DataFrame, targets: dict[str, tuple[float, int]], key: str = "doc_id", source: str = "source", size: str = "n_tokens", total: float | None = None, seed: int = 8, group: int = GROUP) -> DataFrame:
    """(key, source, size, repeats) of the rows drawn, repeats at least 1.

    ``targets``: share and most repeats of each source, a parameter of a few entries. Rows of other or null sources, of
    null keys and of size 0 or null are not drawn. Rows of equal keys are rounded as rows of their own. The table is
    checkpointed, since its sums are needed before its rows.
    """
    rows = checkpointed(counted.select(key, source, size).where(F.col(source).isin(list(targets)) & (F.col(size) > 0) & F.col(key).isNotNull()))
    sums = {r[0]: (r[1], r[2], r[3]) for r in rows.groupBy(source).agg(F.sum(size), F.count("*"), F.max(size)).collect()}  # a row a target
    rate = rates({s: x[0] for s, x in sums.items()}, targets, total)
    spark = counted.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    if not rate:
        return spark.createDataFrame([], f"`{key}` {kind}, `{source}` string, `{size}` bigint, repeats int")

    def of(number: dict[str, float]):
        return F.coalesce(*[F.when(F.col(source) == s, F.lit(x)) for s, x in number.items()])

    whole = {s: math.floor(c + 1e-9) for s, c in rate.items()}
    groups = {s: max(1, -(-sums[s][1] // group)) for s in rate}
    short = {s: max(1, sums[s][2] // SHORT) for s in rate}
    brief = rows.where(F.col(source).isin(list(rate)) & (F.col(size) <= of(short))).groupBy(source).agg(F.sum(size), F.count("*")).collect()  # a row a target
    kept = {r[0]: min(1.0, RESERVE * sums[r[0]][2] / r[1], group / r[2]) for r in brief}  # so it is a group's work
    rows = rows.where(F.col(source).isin(list(rate))).withColumn("whole", of(whole).cast("int"))
    rows = rows.withColumn("share", of({s: max(0.0, rate[s] - whole[s]) for s in rate}).cast("double"))
    chance = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    spare = (F.col(size) <= of(short)) & (chance < of({s: kept.get(s, 0.0) for s in rate}))
    rows = rows.withColumn("spare", spare).withColumn("part", F.when(spare, 0).otherwise(F.pmod(F.xxhash64(key), of(groups).cast("bigint"))))
    schema = f"`{key}` {kind}, `{source}` string, `{size}` bigint, whole int, share double, spare boolean, part bigint"

    def level(df: DataFrame, last: bool) -> DataFrame:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values([key, size], ignore_index=True)
            ids, sizes = pdf[key].tolist(), pdf[size].astype(float).tolist()
            return pdf.assign(share=rounded(ids, sizes, pdf["share"].tolist(), seed, last, pdf["spare"].tolist()))

        return df.select(key, source, size, "whole", "share", "spare", "part").groupBy(source, "part").applyInPandas(run, schema)

    widest = max(groups.values())
    reserve, open_rows = rows.where("spare"), rows.where("not spare")
    undecided = (F.col("share") > 0) & (F.col("share") < 1)
    done: list[DataFrame] = []
    while widest > 1:
        out = level(open_rows, last=False)
        out = out if done else checkpointed(out)
        done.append(out.where(~undecided))
        open_rows = out.where(undecided).withColumn("part", F.floor(F.col("part") / group).cast("bigint"))
        widest = -(-widest // group)
    result = level(open_rows.unionByName(reserve), last=True)
    for more in done:
        result = result.unionByName(more)
    repeats = (F.col("whole") + F.col("share")).cast("int")
    return result.select(key, source, size, repeats.alias("repeats")).where("repeats > 0")


def shares(drawn: DataFrame, targets: DataFrame, source: str = "source", size: str = "n_tokens") -> DataFrame:
    """The share of all drawn tokens that each source of ``targets`` (source_name, target_share, max_repeats) really has."""
    by = drawn.groupBy(source).agg(F.sum(F.col(size) * F.col("repeats")).alias("drawn_tokens"), F.sum("repeats").alias("drawn_docs"), F.max("repeats").alias("most_repeats"))
    all_tokens = by.agg(F.sum("drawn_tokens").alias("_all")).scalar()
    joined = targets.join(by, F.col("source_name") == F.col(source), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    actual = F.coalesce(F.col("drawn_tokens") / all_tokens, F.lit(0.0))
    return joined.select("source_name", "target_share", "max_repeats", zero("drawn_docs"), zero("most_repeats"), zero("drawn_tokens"), actual.alias("actual_share"), F.abs(actual - F.col("target_share")).alias("off_by"))
