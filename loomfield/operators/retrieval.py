"""Compound retrieval: candidates with scores from several sources, decisions over them, and parts of files within budgets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions import paths
from loomfield.functions import text as tx
from loomfield.operators import intervals
from loomfield.session import checkpointed, running_sums

STOP_WORDS = frozenset("the a an and or of to in on for with from by is are be this that it as at how what where when which who does do not".split())


def query_terms(query: str, most: int = 12) -> list[str]:
    """Quoted phrases, words, and the parts of compound names of a query, the most distinctive first: longer ones, and names of mixed
    case or in capitals before plain words; no stop words."""
    phrases = re.findall(r"[\"“']([^\"”']{3,})[\"”']", query)
    words = [w for w in re.findall(r"[A-Za-z_$][\w$.-]*", query) if w.lower() not in STOP_WORDS and len(w) > 1]
    parts = [p for w in words for p in re.split(r"(?<=[a-z0-9])(?=[A-Z])|[_\-.]+", w) if len(p) > 2 and p.lower() not in STOP_WORDS]
    rank = lambda t: -(len(t) + 4 * (bool(re.search(r"[a-z][A-Z]|_", t))) + 3 * (t.isupper()))
    return list(dict.fromkeys([*phrases, *sorted(dict.fromkeys(words), key=rank), *sorted(dict.fromkeys(parts), key=rank)]))[:most]


def variants(token: str) -> list[str]:
    """Spellings of a name: as it is, small, capitalised, in kebab and snake case, and as options."""
    parts = [p for p in re.split(r"(?<=[a-z0-9])(?=[A-Z])|[_\-\s]+", token) if p]
    kebab, snake = "-".join(p.lower() for p in parts), "_".join(p.lower() for p in parts)
    return list(dict.fromkeys([token, token.lower(), token[:1].upper() + token[1:], kebab, snake, f"-{kebab}", f"--{kebab}"]))


def probes(name: str, most: int = 6) -> list[str]:
    """Runs of a compound name's parts, longest first, joined as in the name."""
    parts = [p for p in re.split(r"(?<=[a-z0-9])(?=[A-Z])|[_\-\s]+", name) if p]
    glue = "_" if "_" in name else "-" if "-" in name else ""
    out = [glue.join(parts[a : a + n]) for n in range(len(parts) - 1, 0, -1) for a in range(len(parts) - n + 1)]
    return [p for p in dict.fromkeys(out) if len(p) > 2][:most]


def stem(query: str) -> str | None:
    """What stands before the last dash or underscore, of three characters at least."""
    m = re.match(r"^(.*)[-_][^-_]+$", query)
    return m[1] if m and len(m[1]) >= 3 else None


def nearest_key(word: str, keys: list[str], most: int = 2) -> str | None:
    """The key within so many insertions, deletions, changes or swaps; the first of the nearest."""

    def distance(a: str, b: str) -> int:
        before, row = None, list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            older, before = before, row
            row = [i]
            for j, y in enumerate(b, 1):
                d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
                if older is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    d = min(d, older[j - 2] + 1)
                row.append(d)
        return row[-1]

    rated = [(distance(word, k), n, k) for n, k in enumerate(keys)]
    return min(rated)[2] if rated and min(rated)[0] <= most else None


def penalised(score: Column, path: Column, scope: str | None = None, comment_only: Column | None = None) -> Column:
    """A candidate's score less 0.3 for tests and 0.5 for build output, and by whether it lies in the scope."""
    out = score - F.when(paths.is_test(path), 0.3).otherwise(0.0) - F.when(paths.is_noise(path) | paths.is_build_output(path), 0.5).otherwise(0.0)
    if scope:
        out = out + F.when(paths.under(path, scope), 1.1).otherwise(-0.25)
    return out - F.when(comment_only, 1.3).otherwise(0.0) if comment_only is not None else out


def located(symbols: DataFrame, lines: DataFrame, files: DataFrame, query: str, scope: str | None = None, most: int = 6) -> DataFrame:
    """(path, line, kind, score): where a query most likely leads, the best place of each file, after penalties.

    Sources, of which a place that several name counts for the first: declared names (2 the same, 0.8 a part), texts (up to 1.2 for the
    first two terms), names of files (1.25 to 1.7), other spellings of compound terms (0.7), names that begin like them
    (0.55), whole words (0.5), and folders (0.3 each). symbols: path, line, name; lines: path, line, text; files: path. Each source is one
    filtered scan; only hits are shuffled.
    """
    terms = query_terms(query)
    if not terms:
        return files.select("path", F.lit(1).cast("bigint").alias("line"), F.lit("").alias("kind"), F.lit(0.0).alias("score")).where("false")
    low = list(dict.fromkeys(t.lower() for t in terms))
    name, text, path = F.lower("name"), F.lower("text"), F.col("path")
    has = lambda where, words: sum((F.locate(t, where).cast("boolean").cast("int") for t in words), F.lit(0))
    compound = [[p.lower() for p in re.split(r"(?<=[a-z0-9])(?=[A-Z])|[_\-]+", t) if p] for t in terms]
    compound = [c for c in compound if len(c) > 1]
    spelled = sorted({glue.join(c) for c in compound for glue in ("-", "_")} - set(low[:2]))
    word = r"(?i)(?<![\w$])(?:" + "|".join(re.escape(t) for t in low) + r")(?![\w$])"
    folders = F.flatten(F.transform(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), tx.identifier_parts))
    parts = tx.identifier_parts(F.regexp_replace(tx.basename(path), r"\.[^.]*\z", ""))
    count = lambda held: sum((F.array_contains(held, t).cast("int") for t in low), F.lit(0))
    n = count(parts)
    by_line, first = F.col("line").cast("bigint"), F.lit(1).cast("bigint")
    sources = [
        (symbols, by_line, F.when(name.isin(low), 2.0).when(has(name, low) > 0, 0.8), "symbol"),
        (lines, by_line, F.nullif(F.lit(1.2) * has(text, low[:2]) / min(2, len(low)), F.lit(0.0)), "text"),
        (files, first, F.when(n >= 3, 1.7).when(n == 2, 1.5).when(n == 1, 1.25), "filename"),
        (lines, by_line, F.when(has(text, spelled) > 0, 0.7), "variant"),
        (symbols, by_line, F.when(F.get(tx.identifier_parts(F.col("name")), F.lit(0)).isin([c[0] for c in compound]), 0.55), "family"),
        (lines, by_line, F.when(F.col("text").rlike(word), 0.5), "reference"),
        (files, first, F.nullif(F.lit(0.3) * count(folders), F.lit(0.0)), "path"),
    ]
    pool = None
    for prio, (df, line, score, kind) in enumerate(sources, 1):
        if kind in ("variant", "family") and not compound:
            continue
        found = df.select("path", line.alias("line"), score.cast("double").alias("score"), F.lit(prio).alias("_prio"), F.lit(kind).alias("kind")).where("score is not null")
        pool = found if pool is None else pool.unionByName(found)
    once = pool.groupBy("path", "line").agg(F.min_by(F.struct("kind", "score"), F.struct("_prio", -F.col("score"))).alias("b")).select("path", "line", "b.kind", penalised(F.col("b.score"), path, scope).alias("score"))
    best = once.groupBy("path").agg(F.max_by(F.struct("line", "kind", "score"), F.struct(F.col("score"), -F.col("line"))).alias("b")).select("path", "b.line", "b.kind", F.round("b.score", 6).alias("score"))
    return best.orderBy(F.desc("score"), "path", "line").limit(most)


#: What the words of a query ask for, each by its own words.
SHAPES = {
    "enum": r"(?i)(?<!\w)(?:enum|variant|union|kind|mode|status|state)s?(?!\w)|[A-Z]\w*(?:Enum|Kind|Mode|Status|State)(?!\w)",
    "path": r"[\w.-]+/[\w./-]+|(?<!\w)[\w-]+\.(?:[a-z]{1,4}|proto)(?!\w)",
    "code": r"[a-z][A-Z]|\w_\w|::|\w\(|->",
    "question": r"(?i)^(?:how|what|where|when|which|who|why|does|is|are|can)(?!\w)|\?\s*$",
    "change": r"(?i)(?<!\w)(?:add|change|fix|remove|rename|replace|update|refactor|implement)(?!\w)",
}


def query_shapes(query: Column) -> Column:
    """The shapes of a query, in the order of ``SHAPES``; null for a null query."""
    return F.when(query.isNotNull(), F.filter(F.array(*[F.when(query.rlike(p), F.lit(n)) for n, p in SHAPES.items()]), lambda s: s.isNotNull()))


def verification(edited: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(path, surface, role, why): the tests and mocks that belong to edited files, each once with its best reason.

    ``edited``: path; ``surfaces``: path, role, refs (ends of paths that it refers to). reference: a ref is the end of the path, from a folder on;
    stem: the surface's name without test, spec and mock is that of the file, in a folder of the same module. Equi-joins on names; a name
    that very many files have is split by adaptive execution.
    """
    bare = lambda c: F.regexp_replace(F.lower(F.regexp_replace(tx.basename(c), r"\..*\z", "")), r"^(?:test|mock)_|_(?:test|spec|mock)\z|(?:test|spec|mock)\z", "")
    module = lambda c: F.array_join(F.slice(F.split(c, "/"), 1, 2), "/")
    own = edited.select("path").where("path is not null").distinct()
    named = own.select("path", tx.basename(F.col("path")).alias("_name"))
    refs = surfaces.select(F.col("path").alias("surface"), "role", F.explode("refs").alias("_ref")).distinct()
    told = refs.withColumn("_name", tx.basename(F.col("_ref"))).join(named, "_name").where((F.col("path") == F.col("_ref")) | F.endswith("path", F.concat(F.lit("/"), "_ref")))
    by_name = own.select("path", bare(F.col("path")).alias("_stem"), module(F.col("path")).alias("_module"))
    beside = surfaces.select(F.col("path").alias("surface"), "role", bare(F.col("path")).alias("_stem"), module(F.col("path")).alias("_module")).distinct().where("_stem <> ''")
    alike = beside.join(by_name, ["_stem", "_module"]).where("path <> surface")
    both = told.select("path", "surface", "role", F.lit("reference").alias("why")).unionByName(alike.select("path", "surface", "role", F.lit("stem").alias("why")))
    return both.where("path <> surface").groupBy("path", "surface").agg(F.min("role").alias("role"), F.min("why").alias("why"))


def includes(directives: DataFrame, files: DataFrame) -> DataFrame:
    """(path, target, resolved): include directives (path, target) with the file that each means: the one at that place from the includer's folder,
    else the only one whose path ends so; null where there is none or several."""
    plain = F.regexp_replace(F.regexp_replace(F.concat_ws("/", tx.parent(F.col("path")), "target"), r"(?<=/)(?:\./)+|^(?:\./)+", ""), r"^\./", "")
    at = plain
    for _ in range(8):  # a step up takes a folder away; more than eight are not resolved
        at = F.regexp_replace(at, r"(?:^|(?<=/))(?!\.\./)[^/]+/\.\./", "")
    own = files.select(F.col("path").alias("resolved")).distinct()
    asked = directives.select("path", "target").where("target is not null").distinct().withColumn("_at", at).withColumn("_name", tx.basename(F.col("target")))
    near = asked.join(own.select(F.col("resolved").alias("_at"), F.lit(True).alias("_near")), "_at", "left")
    ends = near.where("_near is null").join(own.withColumn("_name", tx.basename(F.col("resolved"))), "_name").where(F.endswith("resolved", F.concat(F.lit("/"), "target")))
    only = ends.groupBy("path", "target").agg(F.count("*").alias("_n"), F.min("resolved").alias("_only"))
    return near.join(only, ["path", "target"], "left").select("path", "target", F.when(F.col("_near"), F.col("_at")).when(F.col("_n") == 1, F.col("_only")).alias("resolved"))


def decided(candidates: DataFrame, margin: float = 0.8, least: float = 0.8) -> DataFrame:
    """(hit, confidence, path): whether the best candidate counts as found: the only one, or one ahead by the margin. One row at most.

    Only the best two of the candidates are put in order by one task.
    """
    w = Window.orderBy(F.desc("score"), "path")
    ranked = candidates.orderBy(F.desc("score"), "path").limit(2).withColumn("_next", F.lead("score").over(w)).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    clear = F.col("_next").isNull() | (F.col("score") - F.col("_next") >= margin)
    return ranked.select((clear & (F.col("score") >= least)).alias("hit"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") / 2)).alias("confidence"), "path")


def one_a_surface(candidates: DataFrame, most: int = 8) -> DataFrame:
    """The best candidate of each kind of surface, by score."""
    s = candidates.withColumn("surface", paths.surface(F.col("path")))
    best = s.groupBy("surface").agg(F.max_by(F.struct("path", "line", "score"), F.struct(F.col("score"), -F.col("line"), F.col("path"))).alias("b"))
    return best.select("surface", "b.path", "b.line", "b.score").orderBy(F.desc("score"), "path").limit(most)


def related(candidates: DataFrame, most: int = 6) -> DataFrame:
    """One candidate a path: first the best of each surface, then the next ones, until there are enough. Scores within 0.001 tie."""
    step = F.floor(F.col("score") / 0.001)
    once = candidates.withColumn("_s", step).withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("_s"), "line"))).where("_n = 1")
    ranked = once.withColumn("surface", paths.surface(F.col("path"))).withColumn("_k", F.row_number().over(Window.partitionBy("surface").orderBy(F.desc("_s"), "path", "line")))
    return ranked.orderBy(F.least("_k", F.lit(2)), F.desc("_s"), "path", "line").limit(most).select("path", "line", "surface", "score")


def slices(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, start, end, text): the lines of requested ranges (path, range text), ends beyond the file cut, ranges that begin beyond it left out."""
    asked = intervals.parsed(wanted.select("path", "range"), "range").where("start is not null").distinct()
    inside = lines.join(asked, "path").where((F.col("line") >= F.col("start")) & (F.col("line") <= F.col("end")))
    by = inside.groupBy("path", "start", "end").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("_l"))  # as long as a range
    return by.select("path", "start", F.element_at("_l", -1)["line"].alias("end"), F.array_join(F.transform("_l", lambda x: x["text"]), "\n").alias("text"))


def packed(items: DataFrame, cap: int, order: str = "item_no", size: str = "tokens") -> DataFrame:
    """Adds ``fate`` to items in order: served, cap-exceeded (larger than the whole budget, the next ones go on), cap-exhausted (the first that does
    not fit what is left) and omitted (after it)."""
    over = F.col(size) > cap
    spent = running_sums(items, [F.col(order)], _sum=F.when(over, 0).otherwise(F.col(size)))
    stop = spent.agg(F.min(F.when(~over & (F.col("_sum") > cap), F.col(order))).alias("_stop")).scalar()
    return spent.withColumn("fate", F.when(F.col(order) > stop, "omitted").when(F.col(order) == stop, "cap-exhausted").when(over, "cap-exceeded").otherwise("served")).drop("_sum")


#: Slices that the driver looks at in one round of ``selected_evidence``.
ROUND = 2000


def selected_evidence(slices_: DataFrame, per_class: int = 2, per_concern: int = 2048, overall: int = 6144) -> DataFrame:
    """The slices (concern, class, order_no, bytes, served) taken in order under caps of number a class, bytes a concern and bytes in all; what does
    not fit is skipped and uses nothing up, what was served before costs nothing but counts in its class.

    ``order_no`` is unique; rows without it, or with neither bytes nor served, are not taken; null concerns and classes are groups of
    their own. Of the rows that cost something at most ``overall`` can be taken, one byte each, and only these are found one after the other: a round
    asks the cluster for the next few that can still fit anything, so each round takes its first row at least. The slices that
    cost nothing are decided where they are, by how many of their class came before.
    """
    cost = F.when(F.coalesce("served", F.lit(False)), 0).otherwise(F.col("bytes")).cast("bigint")
    group = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("concern", "class")]
    before = Window.partitionBy("_concern", "_class").orderBy("order_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = slices_.withColumns({"_cost": cost, "_concern": group[0], "_class": group[1]}).where("_cost is not null and order_no is not null")
    rows = checkpointed(rows.withColumn("_free", F.coalesce(F.count_if(F.col("_cost") == 0).over(before), F.lit(0))).where(F.col("_free") < per_class))
    paid = rows.where(F.col("_cost").between(1, min(per_concern, overall))).select("order_no", "_concern", "_class", "_cost", "_free")
    total, last, spent, taken = 0, None, {}, []
    counts: dict[tuple[str, str], int] = {}
    while total < overall:
        able = paid.where(F.col("_cost") <= overall - total)
        if last is not None:
            able = able.where(F.col("order_no") > last)
        if tight := {k: per_concern - v for k, v in spent.items() if v}:  # as many as rows taken
            left = F.create_map([F.lit(x) for pair in tight.items() for x in pair])
            able = able.where(F.col("_cost") <= F.coalesce(F.try_element_at(left, F.col("_concern")), F.lit(per_concern)))
        if counts:
            used = F.create_map([F.lit(x) for (a, b), n in counts.items() for x in (f"{a}\0{b}", n)])
            able = able.where(F.col("_free") + F.coalesce(F.try_element_at(used, F.concat_ws("\0", "_concern", "_class")), F.lit(0)) < per_class)
        head = able.orderBy("order_no").limit(ROUND).collect()
        for at, concern, kind, size, free in head:
            if total + size <= overall and spent.get(concern, 0) + size <= per_concern and free + counts.get((concern, kind), 0) < per_class:
                total, spent[concern] = total + size, spent.get(concern, 0) + size
                counts[concern, kind] = counts.get((concern, kind), 0) + 1
                taken.append((at, concern, kind))
            last = at
        if len(head) < ROUND:
            break
    kind = slices_.schema["order_no"].dataType.simpleString()
    own = slices_.sparkSession.createDataFrame(taken, f"_at {kind}, _concern string, _class string")  # at most ``overall`` rows
    free = rows.where("_cost = 0").join(own, ["_concern", "_class"], "left")
    late = free.groupBy("order_no").agg(F.count_if(F.col("_at") < F.col("order_no")).alias("_paid"))
    kept = rows.where("_cost = 0").join(late, "order_no").where(F.col("_free") + F.col("_paid") < per_class)
    bought = rows.where("_cost > 0").join(own.select(F.col("_at").alias("order_no")), "order_no", "left_semi")
    return kept.select(*slices_.columns).unionByName(bought.select(*slices_.columns))


def largest_fitting(sizes: DataFrame, key: str, order: str, size: str, cap: int) -> DataFrame:
    """(key, n): how many of each key's rows in order fit a number of bytes."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return sizes.withColumn("_sum", F.sum(size).over(w)).groupBy(key).agg(F.count_if(F.col("_sum") <= cap).alias("n"))


#: Columns, rows and characters of the steps in which a table is made smaller.
LADDER = ((24, 12, 160), (12, 8, 80), (8, 4, 64), (4, 2, 32))


def fitted_tables(cells: DataFrame, key: str, cap: int) -> DataFrame:
    """(key, step, bytes): the first step of the ladder at which a table (key, row_no, column_no, value) fits; null step if none does."""
    levels = [F.sum(F.when((F.col("column_no") <= c) & (F.col("row_no") <= r), F.octet_length(F.substring("value", 1, n)) + 3).otherwise(0)).alias(f"b{k}") for k, (c, r, n) in enumerate(LADDER)]
    by = cells.groupBy(key).agg(*levels)
    step, size = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    for k in reversed(range(len(LADDER))):
        step = F.when(F.col(f"b{k}") <= cap, k + 1).otherwise(step)
        size = F.when(F.col(f"b{k}") <= cap, F.col(f"b{k}")).otherwise(size)
    return by.select(key, step.alias("step"), size.alias("bytes"))


def small_files(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, tiny, lines, bytes, head): files of at most 8,192 bytes and 250 lines are tiny; of the others the first 500 characters."""
    n, size = tx.line_count(F.col(content)), F.octet_length(content)
    tiny = (size <= 8192) & (n <= 250)
    return files.where(F.col(content).isNotNull()).select(F.col(path).alias("path"), tiny.alias("tiny"), n.alias("lines"), size.alias("bytes"), F.when(tiny, F.col(content)).otherwise(F.substring(content, 1, 500)).alias("head"))


def digests(lines: DataFrame, symbols: DataFrame, imports: DataFrame, query: str) -> DataFrame:
    """(path, imports, names, hits): what a file imports, declares, and how many lines have the query."""
    i = imports.groupBy("path").agg(F.count("*").alias("imports"))
    s = symbols.groupBy("path").agg(F.count("*").alias("names"))
    h = lines.groupBy("path").agg(F.count_if(F.locate(query.lower(), F.lower("text")) > 0).alias("hits"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return h.join(i, "path", "left").join(s, "path", "left").select("path", zero("imports"), zero("names"), "hits")


def members(symbols: DataFrame, types: DataFrame, type_name: str, most: int = 12) -> DataFrame:
    """(path, name, line): the declarations inside the only type of a name; none if several files declare it."""
    own = types.where(F.col("name") == type_name)
    files = own.agg(F.countDistinct("path").alias("_n")).scalar()
    held = symbols.alias("s").join(own.alias("t"), F.col("s.path") == F.col("t.path")).where("s.line > t.line and s.line <= t.end_line")
    return held.select(F.col("s.path").alias("path"), F.col("s.name").alias("name"), F.col("s.line").alias("line")).where(files == 1).orderBy("path", "line").limit(most)


def section_plans(sections: DataFrame, lines: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """(key, line, end_line, score): the best section of each document: 3 for each term in its heading and at most 6 for lines with one; at least 2;
    the shorter of equals."""
    low = [t.lower() for t in terms]
    count = lambda c: sum((F.locate(t, F.lower(c)).cast("boolean").cast("int") for t in low), F.lit(0))
    hits = lines.withColumn("_h", count("text")).where("_h > 0").select(key, F.col("line").alias("_l"))
    marks = sections.select(key, "line", "end_line", "heading", count("heading").alias("_in"))
    counted = marks.join(hits, key, "left").groupBy(key, "line", "end_line", "_in").agg(F.count_if((F.col("_l") > F.col("line")) & (F.col("_l") <= F.col("end_line"))).alias("_body"))
    rated = counted.withColumn("score", 3 * F.col("_in") + F.least(F.lit(6), "_body")).where("score >= 2")
    best = rated.groupBy(key).agg(F.max_by(F.struct("line", "end_line", "score"), F.struct(F.col("score"), F.col("line") - F.col("end_line"), -F.col("line"))).alias("b"))
    return best.select(key, "b.line", "b.end_line", "b.score")


def closure(lines: DataFrame, checks: dict[str, list[str]]) -> DataFrame:
    """(check, done): checks are done if some file has all of their words."""
    words = sorted({w for ws in checks.values() for w in ws})
    by = lines.groupBy("path").agg(*[F.max((F.locate(w, F.col("text")) > 0).cast("int")).alias(f"w{n}") for n, w in enumerate(words)])
    met = by.agg(*[F.coalesce(F.max(F.least(F.lit(1), *[F.col(f"w{words.index(w)}") for w in ws])), F.lit(0)).alias(f"c{n}") for n, ws in enumerate(checks.values())])
    return met.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), (F.col(f"c{n}") == 1).alias("done")) for n, c in enumerate(checks)])).alias("x")).select("x.*")


def reachable(edges: DataFrame, start: DataFrame, most_steps: int = 16) -> DataFrame:
    """(id, steps): what can be reached along edges (src, dst) from ids, with the least number of steps. Rounds end when nothing is new."""
    seen = checkpointed(start.select("id").distinct().withColumn("steps", F.lit(0)))
    front = seen
    for n in range(1, most_steps + 1):
        nexts = edges.join(front, edges["src"] == front["id"]).select(F.col("dst").alias("id")).distinct()
        front = checkpointed(nexts.join(seen, "id", "left_anti").withColumn("steps", F.lit(n)))
        if not front.limit(1).count():
            break
        seen = checkpointed(seen.unionByName(front))
    return seen


def reachable_through(uses: DataFrame, defs: DataFrame, start: DataFrame, most_steps: int = 16) -> DataFrame:
    """(id, steps): what files (id) can be reached from files by using (path, name) what others define (path, name).

    Like ``reachable`` over all pairs of users and definers, which are never made: a step goes from files to the names that they use,
    and from names that no step has used to the files that define them.
    """
    seen = checkpointed(start.select("id").distinct().withColumn("steps", F.lit(0)))
    front, known = seen, None
    for n in range(1, most_steps + 1):
        names = uses.join(front.select(F.col("id").alias("path")), "path", "left_semi").select("name").distinct()
        names = checkpointed(names if known is None else names.join(known, "name", "left_anti"))
        known = names if known is None else known.unionByName(names)
        nexts = defs.join(names, "name", "left_semi").select(F.col("path").alias("id")).distinct()
        front = checkpointed(nexts.join(seen, "id", "left_anti").withColumn("steps", F.lit(n)))
        if not front.limit(1).count():
            break
        seen = checkpointed(seen.unionByName(front))
    return seen


def pairs_by_stem(files: DataFrame, path: str = "path") -> DataFrame:
    """(header, source): C and C++ headers with the sources of the same folder and stem."""
    rows = files.select(F.col(path).alias("path"), tx.parent(F.col(path)).alias("dir"), F.regexp_replace(tx.basename(F.col(path)), r"\.[^.]*\z", "").alias("stem"), paths.extension(F.col(path)).alias("ext")).distinct()
    heads, sources = rows.where(F.col("ext").isin("h", "hh", "hpp", "hxx")), rows.where(F.col("ext").isin("c", "cc", "cpp", "cxx"))
    return heads.select(F.col("path").alias("header"), "dir", "stem").join(sources.select(F.col("path").alias("source"), "dir", "stem"), ["dir", "stem"]).select("header", "source")
