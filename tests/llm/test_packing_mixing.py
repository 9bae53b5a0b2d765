import os
import random
from collections import Counter, defaultdict

import pytest

from loomfield.llm import mixing, packing, tokens


def filled(plan):
    fill = Counter()
    for size, _, items, first, each in plan.runs:
        for k in range(items):
            fill[first + k // each] += size
    return fill


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")
def test_tokens_of_long_texts_are_those_of_the_whole():
    encode = tokens.encoder(tokens.VOCABULARY).encode_ordinary
    for text in ("word " * 60_001, "x" * 250_001, " " * 120_000 + "y", "界" * 110_000, "don't " * 30_000):
        assert tokens.count(text) == len(encode(text))
    assert tokens.count("word " * 60_001) == 60_002 and tokens.count("") == tokens.count(None) == 0


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    random.seed(seed)
    capacity = random.choice([64, 256, 2048])
    sizes = [min(capacity, int(random.expovariate(4 / capacity)) + 1) for _ in range(random.randint(0, 2000))]
    plan = packing.Plan(Counter(sizes), packing.permitted(capacity))
    fill, count = filled(plan), Counter()
    for size, _, items, _, _ in plan.runs:
        count[size] += items
    assert count == Counter(sizes) and len(fill) == plan.containers and max(fill.values(), default=0) <= capacity
    assert {first + i: x for first, n, x in plan.closed for i in range(n)} == fill
    assert plan.containers <= packing.best_fit(sizes, capacity) * 1.02 + 2


def test_containers_are_downsized():
    plan = packing.Plan({10: 1}, packing.permitted(64))
    assert plan.containers == 1 and plan.length_of(plan.closed[0][2]) == 16


def test_packed(spark):
    random.seed(9)
    data = [(n, random.choice([1, 5, 50, 100, 101, 250, 0, None, -3]), "own") for n in range(500)] + [(7, 50, "own"), (None, 30, "own")]
    df = spark.createDataFrame(data, "doc_id long, n_tokens long, piece_no string")
    out = packing.packed(df, "doc_id", "n_tokens", 100, buckets=7).collect()
    assert len(out) == sum(max(1, -(-max(0, s or 0) // 100)) for _, s, _ in data)
    use, known = Counter(), defaultdict(set)
    for r in out:
        use[r["container_id"]] += r["piece_size"]
        known[r["container_id"]].add((r["container_size"], r["container_length"]))
    assert max(use.values()) <= 100 and all(len(k) == 1 for k in known.values())
    assert all(next(iter(known[c]))[0] == n <= next(iter(known[c]))[1] for c, n in use.items())
    pieces = defaultdict(list)
    for r in out:
        if r["doc_id"] is not None and r["doc_id"] != 7:
            pieces[r["doc_id"]].append((r["piece_no"], r["piece_start"], r["piece_size"]))
    for n, size, _ in data:
        if n is not None and n != 7:
            own = sorted(pieces[n])
            assert sum(p[2] for p in own) == max(0, size or 0) and [p[1] for p in own] == [100 * k for k in range(len(own))]
    assert packing.packed(df.limit(0), "doc_id", "n_tokens", 100).count() == 0


def test_one_size_for_all(spark):
    df = spark.range(1000).selectExpr("id as doc_id", "30L as n_tokens")
    out = packing.packed(df, "doc_id", "n_tokens", 100, buckets=16).collect()
    use = Counter(r["container_id"] for r in out)
    assert len(use) == 334 and max(use.values()) == 3


def test_rates():
    targets = {"a": (0.5, 1), "b": (0.25, 4), "c": (0.25, 2), "none": (0.0, 2), "gone": (0.1, 2)}
    rate = mixing.rates({"a": 1000, "b": 50, "c": 100}, targets)
    total = {"a": 1000 * rate["a"], "b": 50 * rate["b"], "c": 100 * rate["c"]}
    assert abs(total["a"] - 2 * total["b"]) < 1e-6 and abs(total["b"] - total["c"]) < 1e-6 and max(rate[s] / targets[s][1] for s in rate) == 1
    assert mixing.rates({}, targets) == {}


def test_rounding_keeps_mass_and_expectation():
    random.seed(1)
    sizes = [float(random.randint(1, 400)) for _ in range(60)]
    shares = [0.37] * 60  # all rows of a source have the same
    mass = sum(p * n for p, n in zip(shares, sizes, strict=True))
    reserve = [n <= 150 for n in sizes]
    mean = [0.0] * len(sizes)
    for seed in range(400):
        out = mixing.rounded(list(range(60)), sizes, shares, seed)
        assert sum(0 < x < 1 for x in out) <= 1 and abs(sum(p * n for p, n in zip(out, sizes, strict=True)) - mass) < 1e-6
        whole = mixing.rounded(list(range(60)), sizes, shares, seed, True, reserve)
        assert set(whole) <= {0.0, 1.0}
        for k, x in enumerate(whole):
            mean[k] += x / 400
    assert max(abs(m - p) for m, p in zip(mean, shares, strict=True)) < 0.13


def test_reserve_is_a_groups_work(spark):
    data = [(n, "a", 1) for n in range(3000)] + [(10_000, "a", 2000)]
    df = spark.createDataFrame(data, "doc_id long, source string, n_tokens long")
    out = mixing.mixed(df, {"a": (1.0, 2)}, total=2600.5, group=200)
    drawn = out.selectExpr("sum(n_tokens * repeats) AS t").first()["t"]
    assert abs(drawn - 2600.5) <= 2000 and out.count() == out.select("doc_id").distinct().count()


def test_mixed(spark):
    random.seed(4)
    data = [(n, random.choice(["a"] * 6 + ["b", "c"]), random.randint(1, 60), "own") for n in range(3000)]
    data += [(-1, None, 5, "own"), (-2, "zzz", 5, "own"), (-3, "a", 0, "own"), (-4, "a", None, "own"), (None, "a", 5, "own")]
    df = spark.createDataFrame(data, "doc_id long, source string, n_tokens long, repeats string")
    targets = {"a": (0.5, 1), "b": (0.3, 3), "c": (0.2, 2), "absent": (0.0, 1)}
    out = mixing.mixed(df, targets, group=100).collect()
    assert len({r["doc_id"] for r in out}) == len(out) and all(r["doc_id"] >= 0 and 1 <= r["repeats"] <= targets[r["source"]][1] for r in out)
    drawn = Counter()
    for r in out:
        drawn[r["source"]] += r["n_tokens"] * r["repeats"]
    total = sum(drawn.values())
    assert all(abs(drawn[s] / total - t[0]) < 0.005 for s, t in targets.items())
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mixed(df, targets, group=100).collect()))
    assert mixing.mixed(df.limit(0), targets).count() == 0
    table = spark.createDataFrame([(s, *t) for s, t in targets.items()], "source_name string, target_share double, max_repeats int")
    shares = {r["source_name"]: r for r in mixing.shares(spark.createDataFrame(out), table).collect()}
    assert shares["absent"]["drawn_docs"] == 0 and abs(sum(r["actual_share"] for r in shares.values()) - 1) < 1e-9
