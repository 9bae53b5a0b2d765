import random

import pytest

from loomfield.llm import confusables as c

SAME = [
    ("Hello world", "Неllо wоrld"), ("API", "ΑΡΙ"), ("a b", "a b"), ("a b", "a b"), ("file", "ﬁle"), ("abc 12", "ａｂｃ　１２"), ("é", "é"), ("デ", "ﾃﾞ"), ("デ", "デ"), ("word", "wo​rd﻿"), ("soft", "so­ft"), ("a-b", "a‑b"),
    ("привет мир", "пpивeт миp"), ("ё", "ё"), ("5 µm", "5 μm"), ("300 K", "300 \u212a"), ("a\nb", "a\r\nb"), ("x️", "x"), (";", ";"),
]
DIFFERENT = [("Page", "page"), ("m2", "m²"), ("cafe", "café"), ("end.", "end!"), ("'", "`"), ("テ", "デ"), ("a  b", "a b"), ("👩‍💻", "👩💻"), ("l1", "ll"), ("0", "O"), ("е", "ё"), ("", " "), ("кот", "kot"), ("ılık", "ilik"), ("α", "a"), ("I", "l"), ("rn", "m"), ("x", "ˣ"), ("ト", "卜"), ("ſ", "f"), ("б", "6")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert a != b and c.form(a) == c.form(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(a, b):
    assert c.form(a) != c.form(b)


def test_form_is_a_fixed_point_and_follows_the_skeleton():
    random.seed(7)
    alphabet = "aоcеpxiв дψΑβ é ﬁａ​1²-‑界デﾃﾞñ"
    forms: dict = {}
    for _ in range(3000):
        text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 12)))
        form = c.form(text)
        assert c.form(form) == form and c.skeleton(form) == c.skeleton(text)
        assert forms.setdefault(c.skeleton(text), form) == form


def test_spelling_and_kinds():
    assert c.form("пpивeт сор") == "привет сор" and c.form("Неllо сор") == "Hello cop"
    assert c.confusable_kind("Неllо") == "mixed" and c.confusable_kind("сор") == "whole" and c.confusable_kind("a b") == "other" and c.confusable_kind("plain") == "none" and c.confusable_kind(None) == "none"


def test_pairs_equal_brute_force(spark, rows):
    random.seed(3)
    base = ["one two", "ONE two", "m2", "m²", "", "привет"]
    changes = [lambda t: t, lambda t: t.replace("o", "о"), lambda t: t.replace(" ", " "), lambda t: t + "​", lambda t: t.replace("e", "е")]
    texts = [random.choice(changes)(random.choice(base)) for _ in range(60)]
    data = [(n, t, "own", "own") for n, t in enumerate(texts)] + [(1000, None, "own", "own"), (None, "one two", "own", "own")]
    df = spark.createDataFrame(data, "doc_id long, text string, form_hash string, id string")
    want = sorted((a, b) for a, x in enumerate(texts) for b, y in enumerate(texts) if a < b and x != y and c.form(x) == c.form(y))
    assert want and rows(c.pairs(df, "doc_id")) == want
    assert c.pairs(df.limit(0), "doc_id").count() == 0


def test_forms_keep_everyday_spelling():
    for text in ("гора и море", "Сегодня и завтра город", "שלום", "über façade", "ΑΒΓ δελτα", "データの上限で"):
        assert c.form(text) == text
    assert c.scripts(c.skeleton("сор")) == {"LATIN", "CYRILLIC"} and c.scripts(c.skeleton("город")) == {"CYRILLIC"} and not c.scripts(c.skeleton("гλ"))


def test_data_as_text(tmp_path):
    file = tmp_path / "confusables.txt"
    file.write_text("\ufeff# version\n0441 ;\t0063 ;\tMA\t# ( с → c )\n006D ;\t0072 006E ;\tMA\n\n", encoding="utf-8")
    data = c.prototypes(str(file))
    assert data == {"с": "c", "m": "rn"} and c.letters(data) == {"с": "c"} | c.STROKE
    assert len(c.prototypes(c.data_file())) > 6000


def test_classes_equal_brute_force(spark, rows):
    texts = {1: "one", 2: "оne", 5: "one", 3: "two", 4: "two", 6: "ｏne", 7: "t", 8: "τ", 9: None}
    df = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "doc_id long, text string, class_id long")
    assert rows(c.classes(df, "doc_id")) == [(1, 1, 1, 3, 4), (2, 1, 2, 3, 4), (5, 1, 1, 3, 4), (6, 1, 6, 3, 4)]
    assert c.classes(df.limit(0), "doc_id").count() == 0


def test_consistent(spark):
    df = spark.createDataFrame([("Неllо", "x"), (None, "x"), ("", "x")], "text string, form_text string")
    out = [(r["text"], r["form_text"], r["kind"]) for r in c.consistent(df, kind="kind").collect()]
    assert out == [("Неllо", "Hello", "mixed"), (None, None, "none"), ("", "", "none")]
