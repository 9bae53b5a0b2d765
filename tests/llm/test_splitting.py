import random

import pytest

from loomfield.llm import splitting


def check(text, limit, overlap):
    pieces = splitting.split(text, limit, overlap)
    assert "".join(text[own:end] for _, own, end in pieces) == text
    for k, (start, own, end) in enumerate(pieces):
        assert len(text[start:end].encode()) <= limit
        if k:
            before = text[pieces[k - 1][0] : pieces[k - 1][2]]
            again = text[start:own]
            assert before.endswith(again) and (again == before or min(overlap, limit - 4) - 3 <= len(again.encode()) <= overlap)
    return pieces


@pytest.mark.parametrize("text", ["", "a", "a" * 5000, "é" * 3000, "á" * 2000, "a" + "́" * 3000, "x " * 3000, "\r\n" * 3000, "日本語。" * 900, "👩‍💻" * 500, "One. Two! Three? " * 300, "def f():\n    return 1\n\n\n" * 200])
@pytest.mark.parametrize(("limit", "overlap"), [(100, 10), (1600, 160), (17, 0), (40, 39)])
def test_invariants(text, limit, overlap):
    check(text, limit, overlap)


def test_random_texts():
    random.seed(1)
    for _ in range(60):
        text = "".join(random.choice(["word ", "Ein Satz. ", "\n", "\n\n", "# Head\n", "    code(x);\n", "界", "é", "\r\n"]) for _ in range(random.randint(0, 400)))
        check(text, random.choice([64, 200, 999]), random.choice([0, 5, 50]))


def test_limits_below_a_character():
    for limit in (1, 2, 3):
        for text in ("abcdef", "aébc", "a界b👩c"):
            pieces = splitting.split(text, limit, 2)
            parts = [text[start:end] for start, _, end in pieces]
            assert "".join(parts) == text and all(len(x.encode()) <= limit or len(x) == 1 for x in parts)


def test_natural_boundaries():
    paragraph = "This is a sentence of some words. " * 8
    text = "\n\n".join([paragraph.strip()] * 6)
    ends = [text[:end] for _, _, end in check(text, 700, 50)]
    assert all(e.endswith(".\n\n") or e == text for e in ends)
    code = "function a() {\n  x();\n  y();\n}\n\n" * 30
    assert all(code[own:].startswith("function") for _, own, _ in check(code, 300, 20))


def test_operator(spark):
    data = [(1, "k", "x" * 50, 20, 5, "own"), (2, None, "short", 20, 5, "own"), (3, "k", None, 20, 5, "own"), (4, "k", "", 20, 5, "own"), (5, "k", "y" * 50, None, 5, "own"), (6, "k", "z" * 30, 20, None, "own")]
    df = spark.createDataFrame(data, "id long, k string, text string, max_size long, overlap_size long, piece_no string")
    out = splitting.pieces(df.drop("piece_no"), ["id", "k"])
    assert {r["id"] for r in out.collect()} == {1, 6}
    first = out.where("id = 1").orderBy("piece_no").collect()
    assert first[0]["own_start"] == 0 and all(r["piece_bytes"] <= 20 for r in first) and "".join(r["piece_text"][r["own_start"] - r["piece_start"] :] for r in first) == "x" * 50
    assert splitting.pieces(df.drop("piece_no").limit(0), ["id"]).count() == 0
