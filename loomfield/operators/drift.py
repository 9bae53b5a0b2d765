"""Schemas that drift between files (problem 1), by tagged-union inference.

Every line gives the dotted paths of its leaves, each tagged with its type. The tagged paths of a file's lines are fused into
one schema that keeps, for each path, all types that occurred: a tagged union. A stream's files are compared one by one with
the latest readable file before. A path that is gone and one that came are the same field under another name if their names tell the
same quantity, or if what they hold is alike: the fused schema keeps a small sketch of each path's values, and how many lines have it. Types that
conflict are split into typed branches, and a canonical conversion brings all branches into the record's own types.

The record's fields and the words by which their quantities are told are parameters; the ones given here are those of usage records.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfield.session import checkpointed, lag_in_blocks, likely, spread

#: The record's fields and types.
RECORD = {"client": "string", "model": "string", "inputTokens": "bigint", "cacheWriteTokens": "bigint", "cacheReadTokens": "bigint", "outputTokens": "bigint", "totalTokens": "bigint", "requestCount": "bigint"}

_TOKENS, _TURNS = "tokens token toks tok", "requests request turns turn calls call"
#: How names tell a quantity: its field, groups of words of each of which a path has one, words that it has not, and, if given, the
#: only words of its last name. The first rule that holds counts.
USAGE = (
    ("cacheWriteTokens", ("cache cached", _TOKENS, "write writes written creation create created store stored"), "", ""),
    ("cacheReadTokens", ("cache cached", _TOKENS, "read reads hit hits cached"), "", ""),
    ("totalTokens", (_TOKENS + " usage", "total"), "cache cached", ""),
    ("inputTokens", (_TOKENS + " usage", "input prompt in"), "cache cached", ""),
    ("outputTokens", (_TOKENS + " usage", "output completion out"), "cache cached", ""),
    ("requestCount", (_TURNS,), "", _TURNS + " count number total"),
    ("client", ("client agent",), "", "client agent name id"),
    ("model", ("model llm engine",), "", "model llm engine name id"),
)
Rules = tuple[tuple[str, tuple[str, ...], str, str], ...]
# Words that name a unit. Fields of different units are never one.
UNITS = {w: unit for unit, names in {"time": "ms millis milliseconds sec secs second seconds latency elapsed duration", "size": "bytes byte kb mb", "money": "usd eur cent cents price cost", "tokens": _TOKENS, "count": _TURNS + " retries retry count"}.items() for w in names.split()}
SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
NUMERIC = re.compile(r"[+-]?\d+(?:\.\d+)?\Z")
#: So many of the lowest hashes of a path's texts are kept: equal sets keep equal ones, however large they are.
KEPT = 8
#: Numbers below this, on the average, are too small to tell fields apart by; and how far apart, in powers of two, like ones may be.
LARGE, NEAR = 6.0, 1.0


class Decimal(float):
    """A number written with a point or an exponent."""


def _refuse(name: str) -> None:
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_float=Decimal, parse_constant=_refuse)


def readable(line: str | None) -> dict | None:
    """The line's JSON object, or None if it is torn, no object, or null."""
    if not line:
        return None
    try:
        value = _DECODER.decode(line.lstrip("\ufeff"))
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def tag(value: object) -> str:
    """The type of a leaf; null for null."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "decimal"
    return "string" if isinstance(value, str) else "array"


def leaves(value: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """(dotted path, value) of the scalars and arrays of an object."""
    for key, inner in value.items():
        path = f"{prefix}.{key}" if prefix else key
        if isinstance(inner, dict):
            yield from leaves(inner, path)
        else:
            yield path, inner


@lru_cache(maxsize=64)
def _known(rules: Rules) -> tuple[str, ...]:
    return tuple(dict.fromkeys(w for _, groups, bars, last in rules for g in (*groups, bars, last) for w in g.split()))


@lru_cache(maxsize=65536)
def words(path: str, rules: Rules = USAGE) -> tuple[str, ...]:
    """The words of a path's names; words run together are cut into known ones where that explains all of it."""
    out: list[str] = []
    for part in SPLIT.findall(path):
        low = part.lower()
        cut = _cut(low, _known(rules))
        out += cut if cut else [low]
    return tuple(out)


def _cut(text: str, known: tuple[str, ...]) -> list[str] | None:
    best: list[list[str] | None] = [[]] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for word in known:
            before = best[end - len(word)] if len(word) <= end and text.endswith(word, 0, end) else None
            if before is not None and (best[end] is None or len(before) + 1 < len(best[end])):
                best[end] = [*before, word]
    return best[-1]


@lru_cache(maxsize=65536)
def quantity(path: str, rules: Rules = USAGE) -> str:
    """What a path is about: the record's field whose quantity its names tell, else its own names without spelling."""
    parts, last = set(words(path, rules)), words(path.rpartition(".")[2], rules)
    for field, groups, bars, only in rules:
        if all(parts & set(g.split()) for g in groups) and not parts & set(bars.split()) and (not only or set(last) <= set(only.split())):
            return field
    return "other:" + "".join(last)


class Sketch:
    """What a path's values in a file are like: lines, numbers and the sum of their logarithms, and the lowest hashes of texts."""

    __slots__ = ("lines", "magnitude", "numbers", "values")

    def __init__(self, lines: int = 0, numbers: int = 0, magnitude: float = 0.0, values: tuple = ()):
        self.lines, self.numbers, self.magnitude, self.values = lines, numbers, magnitude, set(values)

    def add(self, value: object) -> None:
        self.lines += 1
        if isinstance(value, bool):
            return
        if isinstance(value, str):
            if NUMERIC.match(value):
                value = float(value)
            else:
                self.values.add(_hash(value))
                if len(self.values) > 4 * KEPT:
                    self.values = set(sorted(self.values)[:KEPT])
                return
        if isinstance(value, (int, float)) and abs(value) < 1e300:
            self.numbers += 1
            self.magnitude += math.log2(1 + abs(value))

    def lowest(self) -> list[int]:
        return sorted(self.values)[:KEPT]


@lru_cache(maxsize=65536)
def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


@lru_cache(maxsize=65536)
def _shape(tagged: tuple[tuple[str, str], ...]) -> str:
    return json.dumps([("", "null"), *sorted(tagged)], ensure_ascii=False)


def schema_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(stream_id, file_no, shape, lines): the shapes of a batch's lines, a shape being all tagged paths of a line, counted by file
    before any shuffle. A line that is readable has the path '' too."""
    for batch in batches:
        fused: dict[tuple, int] = defaultdict(int)
        for stream, number, line in zip(batch["stream_id"], batch["file_no"], batch["raw_line"], strict=True):
            value = readable(line)
            if value is not None:
                fused[stream, number, tuple([(path, tag(leaf)) for path, leaf in leaves(value)])] += 1
        yield pd.DataFrame([(s, f, _shape(t), n) for (s, f, t), n in fused.items()], columns=["stream_id", "file_no", "shape", "lines"])


def _keys(lines: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    return f"stream_id {kinds['stream_id']}, file_no {kinds['file_no']}"


def branches(lines: DataFrame) -> DataFrame:
    """(stream_id, file_no, path, tag, lines): for each file and path, the typed branches of its tagged union.

    ``lines``: stream_id, file_no, raw_line. Lines that are null or not a JSON object are left out, as are lines of null
    stream or file. One shuffle, by file, of shapes and their counts; shapes are taken apart after it.
    """
    given = lines.where("stream_id is not null and file_no is not null").select("stream_id", "file_no", "raw_line")
    shapes = spread(given).mapInPandas(schema_of, f"{_keys(lines)}, shape string, lines bigint")
    dealt = shapes.repartition("stream_id", "file_no").groupBy("stream_id", "file_no", "shape").agg(F.sum("lines").alias("lines"))
    apart = dealt.select("stream_id", "file_no", F.explode(F.from_json("shape", "array<array<string>>")).alias("_t"), "lines")
    return apart.groupBy("stream_id", "file_no", F.element_at("_t", 1).alias("path"), F.element_at("_t", 2).alias("tag")).agg(F.sum("lines").alias("lines"))


def sketches(lines: DataFrame) -> DataFrame:
    """(stream_id, file_no, sketches): of each file's paths, once a path, the lines that have it and what its values are like.

    Added up in the batch, and again before and after the one shuffle, so that a row a path and file is left, however many lines.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[tuple, Sketch] = {}
            for stream, number, line in zip(batch["stream_id"], batch["file_no"], batch["raw_line"], strict=True):
                for path, leaf in leaves(readable(line) or {}):
                    if leaf is not None and not isinstance(leaf, list):
                        (seen.get((stream, number, path)) or seen.setdefault((stream, number, path), Sketch())).add(leaf)
            yield pd.DataFrame([(*key, k.lines, k.numbers, k.magnitude, k.lowest()) for key, k in seen.items()], columns=["stream_id", "file_no", "path", "lines", "numbers", "magnitude", "values"])

    found = checkpointed(lines.select("stream_id", "file_no", "raw_line").mapInPandas(run, f"{_keys(lines)}, path string, lines bigint, numbers bigint, magnitude double, values array<bigint>"))
    lowest = F.slice(F.array_sort(F.collect_set("_v")), 1, KEPT)
    texts = found.select("stream_id", "file_no", "path", F.explode("values").alias("_v")).distinct()
    first = texts.withColumn("_k", F.row_number().over(Window.partitionBy("stream_id", "file_no", "path").orderBy("_v"))).where(F.col("_k") <= KEPT)
    kept = first.groupBy("stream_id", "file_no", "path").agg(lowest.alias("values"))
    sums = found.groupBy("stream_id", "file_no", "path").agg(F.sum("lines").alias("lines"), F.sum("numbers").alias("numbers"), F.sum("magnitude").alias("magnitude"))
    each = sums.join(kept, ["stream_id", "file_no", "path"], "left")
    return each.groupBy("stream_id", "file_no").agg(F.collect_list(F.struct("path", "lines", "numbers", "magnitude", "values")).alias("sketches"))  # as wide as a schema


def union_type(tags: set[str]) -> str:
    """The type of a field from the tags of its values: numbers with and without a point are decimals together."""
    real = tags - {"null"}
    if real == {"integer", "decimal"}:
        return "decimal"
    return "|".join(sorted(real))


def compare(before: dict[str, str], now: dict[str, str], was: dict[str, Sketch] | None = None, seen: dict[str, Sketch] | None = None, rules: Rules = USAGE) -> list[tuple[str, str, str]]:
    """(change_kind, old_field, new_field) from one file's fields and types to the next one's; '' is an unknown type.

    ``was`` and ``seen``: sketches of their values. Fields go on under another name, in this order, if names tell the same quantity; if
    one name holds the other, is of the same type and no field of the record; or if their values are alike and each is the only such of the other.
    """
    gone, came = sorted(before.keys() - now.keys()), sorted(now.keys() - before.keys())
    same = {(p, p) for p in before.keys() & now.keys()}
    by: dict[str, list[str]] = defaultdict(list)
    for path in came:
        by[quantity(path, rules)].append(path)
    renamed = []
    for old in gone:
        if by.get(quantity(old, rules)):
            renamed.append((old, by[quantity(old, rules)].pop(0)))

    def left() -> tuple[list[str], list[str]]:
        olds, news = {a for a, _ in renamed}, {b for _, b in renamed}
        return [p for p in gone if p not in olds], [p for p in came if p not in news]

    for old in left()[0]:
        near = [new for new in left()[1] if _near(old, new, rules) and before[old] == now[new]]
        if len(near) == 1:
            renamed.append((old, near[0]))
    if was and seen:
        olds, news = left()
        pairs = [(a, b) for a in olds for b in news if a in was and b in seen and _alike(a, b, was, seen, rules)]
        renamed += [(a, b) for a, b in pairs if sum(x == a for x, _ in pairs) == sum(y == b for _, y in pairs) == 1]
    gone, came = left()
    out = [("renamed", old, new) for old, new in renamed]
    out += [("retyped", old, new) for old, new in sorted({*renamed, *same}) if before[old] and now[new] and before[old] != now[new]]
    out += [("removed", old, "") for old in gone]
    out += [("added", "", new) for new in came]
    return out


def _near(a: str, b: str, rules: Rules) -> bool:
    if not (quantity(a, rules).startswith("other:") and quantity(b, rules).startswith("other:")):
        return False
    x, y = set(words(a.rpartition(".")[2], rules)), set(words(b.rpartition(".")[2], rules))
    return bool(x and y) and (x < y or y < x)


def _alike(a: str, b: str, was: dict[str, Sketch], seen: dict[str, Sketch], rules: Rules) -> bool:
    """Whether two paths hold the same kind of values as often: numbers of the same size, or texts of which most recur."""
    x, y = was[a], seen[b]
    if min(x.lines, y.lines) < 2 or not 0.5 <= _share(x, was) / max(1e-9, _share(y, seen)) <= 2:
        return False
    units = [{UNITS[w] for w in words(p, rules) if w in UNITS} for p in (a, b)]
    if units[0] and units[1] and not units[0] & units[1]:
        return False
    if x.numbers * 5 >= x.lines * 4 and y.numbers * 5 >= y.lines * 4:
        p, q = x.magnitude / x.numbers, y.magnitude / y.numbers
        return min(p, q) >= LARGE and abs(p - q) <= NEAR
    common = len(x.values & y.values)
    return common >= 2 and 2 * common >= min(len(x.values), len(y.values))


def _share(one: Sketch, all_: dict[str, Sketch]) -> float:
    return one.lines / max(k.lines for k in all_.values())


def _types(fields) -> dict[str, str]:
    tags: dict[str, set[str]] = defaultdict(set)
    for field in fields:
        if field["path"]:
            tags[field["path"]].add(field["tag"])
    return {path: union_type(t) for path, t in tags.items()}


def _sketched(given) -> dict[str, Sketch]:
    return {k["path"]: Sketch(k["lines"], k["numbers"], k["magnitude"], () if k["values"] is None else k["values"]) for k in (() if given is None else given)}


CHANGE = ["stream_id", "file_no", "change_kind", "old_field", "new_field"]


def changes(lines: DataFrame, rules: Rules = USAGE) -> DataFrame:
    """(stream_id, file_no, change_kind, old_field, new_field) of each file against the latest earlier readable one.

    A stream's first readable file has no change. Late, repeated and reordered lines change nothing. Only fused schemas are
    shuffled: rows of a file's width, however many lines it has; files are compared in blocks of a stream, so that a stream
    with a third of all files is not one task's work. Where names leave both a path that is gone and one that came, the values of
    this file and the one before are looked at: lines are read again, those of other files left out by hashed numbers of the files asked for,
    and no line is shuffled.
    """
    keys = _keys(lines)
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    files = checkpointed(branches(lines).groupBy("stream_id", "file_no").agg(F.collect_list(F.struct("path", "tag")).alias("fields")))  # as wide as a schema
    paired = lag_in_blocks(files, "stream_id", "file_no", F.struct("file_no", "fields")).where("previous is not null").select("stream_id", "file_no", "fields", F.col("previous.file_no").alias("before_no"), F.col("previous.fields").alias("before"))

    def by_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for stream, number, fields, before_no, before in zip(*(batch[c] for c in ("stream_id", "file_no", "fields", "before_no", "before")), strict=True):
                found = compare(_types(before), _types(fields), rules=rules)
                unsure = {"removed", "added"} <= {c[0] for c in found}
                rows += [(stream, number, None, None, None, before_no, fields, before)] if unsure else [(stream, number, *c, None, None, None) for c in found]
            yield pd.DataFrame(rows, columns=[*CHANGE, "before_no", "fields", "before"]).astype({"before_no": "Int64"})

    def by_values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for stream, number, fields, before, was, seen in zip(*(batch[c] for c in ("stream_id", "file_no", "fields", "before", "was", "seen")), strict=True):
                rows += [(stream, number, *c) for c in compare(_types(before), _types(fields), _sketched(was), _sketched(seen), rules)]
            yield pd.DataFrame(rows, columns=CHANGE)

    told = "change_kind string, old_field string, new_field string"
    wide = "array<struct<path:string,tag:string>>"
    named = checkpointed(paired.mapInPandas(by_names, f"{keys}, {told}, before_no bigint, fields {wide}, before {wide}"))
    unsure = named.where("change_kind is null").withColumn("before_no", F.col("before_no").cast(kinds["file_no"]))
    asked = unsure.select("stream_id", "file_no").union(unsure.select("stream_id", "before_no"))
    looked = likely(lines, ["stream_id", "file_no"], asked)
    looked = checkpointed(sketches(looked))
    seen = looked.withColumnRenamed("sketches", "seen")
    was = looked.select("stream_id", F.col("file_no").alias("before_no"), F.col("sketches").alias("was"))
    again = unsure.join(seen, ["stream_id", "file_no"], "left").join(was, ["stream_id", "before_no"], "left")
    valued = again.select("stream_id", "file_no", "fields", "before", "was", "seen").mapInPandas(by_values, f"{keys}, {told}")
    return named.where("change_kind is not null").select(*CHANGE).unionByName(valued)


def canonical(value: object, kind: str) -> object:
    """A leaf in the record's type: numbers from strings and decimals, texts from one-element arrays; else None."""
    if isinstance(value, list):
        value = value[0] if len(value) == 1 else None
    if value is None:
        return None
    if kind == "string":
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if isinstance(value, bool):
        return None
    try:
        number = int(value) if isinstance(value, int) else float(value)
    except (TypeError, ValueError):
        return None
    if isinstance(number, float) and (number != number or number in (float("inf"), float("-inf")) or number != int(number)):
        return None
    number = int(number)
    return number if -(2**63) <= number < 2**63 else None


def records(lines: DataFrame, keep: list[str], record: dict[str, str] | None = None, rules: Rules = USAGE) -> DataFrame:
    """(keep, the record's fields in its types, other_fields, is_readable) of every line, in one table.

    ``record``: the fields, of type string or bigint. Branches of other types are converted; values that have no counterpart in the record's
    type, like a fraction of a token, stay in ``other_fields``, a JSON object of all that is no field of the record. Unreadable and null
    lines give a row of nulls with is_readable false.
    """
    wanted = record or RECORD

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {c: [] for c in (*wanted, "other_fields", "is_readable")}
            for line in batch["raw_line"]:
                value = readable(line)
                out["is_readable"].append(value is not None)
                own: dict[str, object] = {}
                rest = {}
                for path, leaf in leaves(value or {}):
                    field = quantity(path, rules)
                    if field in wanted and own.get(field) is None and (leaf is None or (made := canonical(leaf, wanted[field])) is not None):
                        own[field] = None if leaf is None else made
                    else:
                        rest[path] = leaf
                for field in wanted:
                    out[field].append(own.get(field))
                out["other_fields"].append(json.dumps(rest, ensure_ascii=False, sort_keys=True) if rest else None)
            frame = {c: pd.Series(v, dtype="Int64" if wanted.get(c) == "bigint" else object) for c, v in out.items()}
            yield pd.concat([batch.drop(columns="raw_line").reset_index(drop=True), pd.DataFrame(frame)], axis=1)

    schema = ", ".join(f"`{c}` {lines.schema[c].dataType.simpleString()}" for c in keep)
    fields = ", ".join(f"`{c}` {t}" for c, t in wanted.items())
    return spread(lines.select(*keep, "raw_line")).mapInPandas(run, f"{schema}, {fields}, other_fields string, is_readable boolean")
