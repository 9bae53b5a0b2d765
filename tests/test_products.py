"""Pairs of paths by shared words, in blocks."""

import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomfield.operators import graph, products


def edges(uses, definitions):
    return dict(Counter((p, q) for p, w in set(uses) for q, v in set(definitions) if w == v and p != q))


def drawn(seed, paths, words, n):
    r = random.Random(seed)
    return [(f"f{r.randrange(paths):03}", f"w{int(words * r.random() ** 2)}") for _ in range(n)]


@pytest.mark.parametrize("gathered, pairs, handed, run, step, sources", [(1 << 20, 1 << 20, 1 << 14, 10, 13, 18), (7, 5, 3, 2, 4, 18), (50, 1, 2, 1, 2, 3), (1, 100, 1, 0, 1, 2)])
def test_pairs_are_those_of_brute_force(monkeypatch, gathered, pairs, handed, run, step, sources):
    for name, value in {"GATHERED": gathered, "PAIRS": pairs, "HANDED": handed, "RUN": run, "STEP": step, "SOURCES": sources}.items():
        monkeypatch.setattr(products, name, value)
    cells, want = [], {}
    for cell in range(4):  # of the cells one has no definitions, one no uses
        uses, definitions = drawn(cell, 60, 40, 500 * (cell != 3)), drawn(cell + 10, 70, 50, 150 * (cell != 1))
        uses = [(f"{cell}{p}", w) for p, w in [*uses, ("f007", "w0"), ("f007", "none"), ("zz", "w1")] * (cell != 3)]
        definitions = [(f"{cell}{p}", w) for p, w in definitions]
        want |= edges(uses, definitions)
        cells += [(cell, 0, q, products.MARK.join(sorted({v for p, v in definitions if p == q}))) for q in sorted({p for p, _ in definitions})]
        cells += [(cell, 1, p, w) for p, w in sorted(uses)]
    schema = pa.schema([("cell", pa.int32()), ("kind", pa.int32()), ("path", pa.string()), ("text", pa.string())])
    batches = pa.Table.from_pylist([dict(zip(schema.names, c)) for c in cells], schema).to_batches(max_chunksize=37)
    got = []
    for b in products._products(iter(batches)):
        x = {k: v[0] for k, v in b.to_pydict().items()}
        assert len(x["codes"]) <= handed
        got += [(x["sources"][c >> 42], x["targets"][(c >> 32) & (1 << run) - 1], c & (1 << 32) - 1) for c in x["codes"]]
    assert len(got) == len(want) and {(s, d): w for s, d, w in got} == want


def test_edges_are_not_shuffled_and_blocks_give_each_once(spark, rows):
    uses, names = drawn(1, 80, 30, 900), drawn(2, 80, 30, 120)
    odd = [(None, "w1"), ("f001", None), ("f001", "w1"), ("f001", "w1")]
    s, t = spark.createDataFrame(names + odd, "path string, name string"), spark.createDataFrame(uses + odd, "path string, token string")
    df = graph.file_edges(s, t)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join") == 0 and plan.count("Repartition") == 1
    full = lambda x: [(p, w) for p, w in [*x, *odd] if p and w]
    want = sorted((p, q, float(n)) for (p, q), n in edges(full(uses), full(names)).items())
    assert rows(df) == want
    d = spark.createDataFrame([(q, sorted({w for p, w in full(names) if p == q})) for q in {p for p, _ in full(names)}], "path string, words array<string>")
    u = spark.createDataFrame([(p, [w]) for p, w in full(uses)], "path string, words array<string>")
    assert rows(products.shared_words(u, d, 120, held=13)) == want
    assert products.shared_words(u, d.limit(0), 0).count() == 0 and products.shared_words(u.limit(0), d, 120).count() == 0


def test_words_are_written_once_however_many_blocks_they_meet(spark):
    uses, names = [(f"f{n % 300:03}", [f"w{n % 7}", f"v{n}"]) for n in range(900)], [(f"f{n:03}", [f"w{n % 7}", f"x{n}"]) for n in range(400)]
    u, d = spark.createDataFrame([*uses, (None, ["w1"]), ("none", [])], "path string, words array<string>"), spark.createDataFrame(names, "path string, words array<string>")
    df = products.shared_words(u, d, 800, held=200)  # 4 blocks of definitions, 16 or more of uses
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Generate explode(codes" in plan  # nothing but pairs is multiplied
    assert df.count() == len({(p, q) for p, a in uses for q, b in names if a[0] == b[0] and p != q})
    files = [pq.read_table(f.removeprefix("file:")).column("path").to_pylist() for f in products.blocks(u, 8)]
    assert len(files) > 4 and sorted(p for f in files for p in f) == sorted(p for p, _ in uses)
    assert all(f == sorted(f) for f in files) and sum(len(set(f)) for f in files) == 300


def test_blocks_are_read_from_folders_of_any_name(tmp_path):
    folder = tmp_path / "a b%20\u00e9"
    folder.mkdir()
    pq.write_table(pa.table({"path": ["p"], "text": ["w"]}), folder / "x.parquet")
    file = f"file://{tmp_path}/a%20b%2520\u00e9/x.parquet"  # as Spark writes it
    assert [b.to_pylist() for b in products._read(file, 3, 1)] == [[{"cell": 3, "kind": 1, "path": "p", "text": "w"}]]
