"""One consistent form for texts that look the same (problem 9).

The form is computed in two steps. First the *skeleton*: width variants, kinds of space, ligatures and hyphens are folded,
invisible characters dropped, styles of letters gone, accents composed, and each look-alike letter replaced by the one of its class.
Then the *spelling*: for each token the sets of scripts in which its skeleton letters can be written are intersected; a
token that only one script can spell is written in that script, one that several can spell (a whole-script confusable)
takes the script of the text's decided letters, and one that no single script can spell (mixed beyond repair) keeps the
skeleton. Which letters look alike is a table: the public confusables data of Unicode TS 39. The spelling looks at nothing but the
skeleton, and has that skeleton again, so two texts have equal forms exactly if their skeletons are equal.
"""

from __future__ import annotations

import glob
import os
import re
import struct
import unicodedata
import zipfile
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.session import checkpointed, spread

# Signs drawn alike.
SIGNS = {"‐": "-", "‑": "-", "µ": "μ", "ヘ": "へ"}
#: Letters that the public data puts with one from which a dot, a stroke or a bowl tells them apart in upright type: they stay as they are.
APART = "ıȷɩɪιƖǀſαβγσг"
#: And one that it puts with the dotted letter, though it is drawn as a plain stroke.
STROKE = {"ӏ": "l"}
#: Where the letters of alphabets in everyday use lie.
EVERYDAY = ((0xC0, 0xFF), (0x391, 0x3C9), (0x400, 0x45F), (0x531, 0x588), (0x5D0, 0x5EA), (0x620, 0x64A), (0x13A0, 0x13F5))
#: Scripts of syllables and ideographs, whose signs are looked at one by one.
WRITTEN = frozenset(("CJK", "IDEOGRAPHIC", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "HALFWIDTH", "BOPOMOFO", "HANGUL", "YI", "KANGXI"))
#: Scripts in which tokens are spelled, in the order in which one is taken where nothing decides.
SPELLED = ("CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "HEBREW", "ARABIC")


@lru_cache(maxsize=65536)
def script_of(char: str) -> str:
    """The script of a letter, by its Unicode name; empty if it has none."""
    return unicodedata.name(char, "").partition(" ")[0]


def data_file() -> str:
    """The public confusables data (Unicode TS 39) as every Spark distribution has it, in the jar of its Unicode library."""
    homes = [os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)]
    found = [x for home in homes if home for x in sorted(glob.glob(f"{home}/jars/icu4j-*.jar"))]
    if not found:
        raise FileNotFoundError("no confusables data: give the path of confusables.txt")
    return found[0]


def prototypes(path: str) -> dict[str, str]:
    """Each character with the text it is drawn like: from confusables.txt, or from the compiled table (Cfu, version 2) in a jar.

    The compiled table is a sorted list of characters, with the length of their texts in the upper eight bits, a list of
    16-bit values, and the texts: a value is a text of one unit itself, or the place of a longer one.
    """
    if not path.endswith(".jar"):
        with open(path, encoding="utf-8-sig") as lines:
            cells = [x.split("#")[0].split(";") for x in lines if ";" in x.split("#")[0]]
        text = lambda codes: "".join(chr(int(c, 16)) for c in codes.split())
        return {text(c[0]): text(c[1]) for c in cells}
    with zipfile.ZipFile(path) as jar:
        body = jar.read(next(n for n in jar.namelist() if n.endswith("/confusables.cfu")))
    body = body[struct.unpack_from(">H", body)[0] :]
    _, _, _, keys_at, keys, values_at, values, texts_at, texts, _ = struct.unpack_from(">10i", body)
    units = body[texts_at : texts_at + 2 * texts]
    out = {}
    for key, value in zip(struct.unpack_from(f">{keys}I", body, keys_at), struct.unpack_from(f">{values}H", body, values_at), strict=True):
        size = (key >> 24) + 1
        out[chr(key & 0xFFFFFF)] = chr(value) if size == 1 else units[2 * value : 2 * (value + size)].decode("utf-16-be")
    return out


def _case(char: str, like: str) -> str:
    """capital, small or neither; of a letter without case as of the one it is drawn like."""
    kind = unicodedata.category(char)
    kind = kind if kind in ("Lu", "Ll") else unicodedata.category(like)
    return kind if kind in ("Lu", "Ll") else "Lo"


def letters(data: dict[str, str]) -> dict[str, str]:
    """Each letter with the one that stands for its class: those drawn alike, capitals and small ones apart.

    An ASCII letter stands for its class, else the first everyday one of an alphabet, else the first. Digits and signs, raised letters,
    texts of several characters, kana, jamo and ideographs, and what decomposes (it is folded or composed before) are left out.
    """
    plain = lambda c: len(c) == 1 and unicodedata.category(c) in ("Lu", "Ll", "Lo") and not unicodedata.decomposition(c) and c not in APART and script_of(c) not in WRITTEN
    everyday = lambda c: (not c.isascii(), not any(a <= ord(c) <= b for a, b in EVERYDAY), c)
    classes: dict[tuple[str, str], set[str]] = {}
    for char, like in data.items():
        if len(like) == 1 and plain(char):
            own = classes.setdefault((like, _case(char, like)), set())
            own.add(char)
            if plain(like) and _case(like, like) == _case(char, like):
                own.add(like)
    out = {}
    for own in classes.values():
        first = min(own, key=everyday)
        out |= {c: first for c in own if c != first}
    return out | STROKE


TOKEN = re.compile("[^\\W\\d_](?:[^\\W\\d_]|[\u0300-\u036f])*")
JOINED = re.compile("(?<=[\u2190-\u2bff\U0001f000-\U0001faff\ufe0f])\u200d(?=[\u2190-\u2bff\U0001f000-\U0001faff])")
KEPT = "\ue000"  # stands for a joiner that does show, while the others are dropped


def _folded(char: str) -> str | None:
    """What a character counts as before look-alikes: itself, another text, or None if it is invisible."""
    code, kind = ord(char), unicodedata.category(char)
    if char == KEPT:
        return "\u200d"
    if kind == "Cf" and not 0x600 <= code <= 0x6DD or code == 0x34F or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
        return None
    if code in (0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F):
        return None
    if kind == "Zs" or char in "\t\v\f\x1f":
        return " "
    if kind in ("Zl", "Zp") or char == "\x85":
        return "\n"
    tag, _, shown = unicodedata.decomposition(char).partition(" ")
    ligature = 0xFB00 <= code <= 0xFB06 or code in range(0x1C4, 0x1CD) or code in (0x132, 0x133)
    if tag in ("<wide>", "<narrow>", "<font>") or tag == "<compat>" and ligature:
        text = "".join(chr(int(x, 16)) for x in shown.split())
        return "".join(_folded(x) or "" for x in text) if text != char else text
    return char


class Look:
    """The look-alike letters of a table: their classes, and how scripts spell the letters that stand for them."""

    def __init__(self, like: dict[str, str]):
        self.like = {ord(a): b for a, b in (like | SIGNS).items()}
        back: dict[str, dict[str, str]] = {}
        for own, first in sorted(like.items(), reverse=True):  # the lowest, which is the everyday letter, counts
            if script_of(own) in SPELLED and script_of(own) != script_of(first) and any(a <= ord(own) <= b for a, b in EVERYDAY):
                back.setdefault(script_of(own), {})[first] = own
        self.back = {s: back[s] for s in SPELLED if s in back}
        self.ways: dict[str, frozenset[str]] = {}
        self.forms: dict[tuple[str, str], str] = {}
        self.tokens: dict[str, frozenset[str]] = {}


@lru_cache(maxsize=4)
def look(path: str | None = None) -> Look:
    return Look(letters(prototypes(path or data_file())))


@lru_cache(maxsize=1)
def folding() -> dict[int, str | None]:
    """The folding of width, ligatures, styles, spaces and invisible characters, built by rule from the Unicode data of this Python."""
    ends = [*range(0x80, 0x10000), *range(0x1D400, 0x1D800), *range(0x1EE00, 0x1EF00), *range(0x1FBF0, 0x1FBFA), *range(0xE0000, 0xE0200), *range(0x1D173, 0x1D17B)]
    fold = {c: to for c in ends if not 0xD800 <= c < 0xE000 and (to := _folded(chr(c))) != chr(c)}
    return fold | {9: " ", 11: " ", 12: " ", 0x1F: " "}


def _replaced(text: str, table: dict[int, str | None]) -> str:
    """Like str.translate, for texts with few of the table's characters: one quick pass for each that occurs."""
    for char in set(text):
        if (code := ord(char)) > 0x7F and code in table or char in "\t\v\f\x1f":
            text = text.replace(char, table[code] or "")
    return text


def skeleton(text: str, looks: Look | None = None) -> str:
    """The text with every look-alike replaced by the letter that stands for its class; equal for texts that look the same."""
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    fold = folding()
    if text.isascii():
        return _replaced(text, fold) if "\t" in text or "\v" in text or "\f" in text or "\x1f" in text else text
    if "\u200d" in text:
        text = JOINED.sub(KEPT, text)
    text = _replaced(text, fold)
    like = (looks or look()).like
    if any(ord(c) in like for c in unicodedata.normalize("NFD", "".join(set(text)))):
        text = _replaced(unicodedata.normalize("NFD", text), like)
    return unicodedata.normalize("NFC", text)


def scripts(token: str, looks: Look | None = None) -> frozenset[str]:
    """The scripts in which all letters of a skeleton token can be written: the intersection of its letters' resolved script sets."""
    looks = looks or look()
    if token in looks.tokens:
        return looks.tokens[token]
    left: frozenset[str] | None = None
    for char in unicodedata.normalize("NFD", token):
        if unicodedata.combining(char):
            continue
        ways = looks.ways.get(char)
        if ways is None:
            ways = looks.ways[char] = frozenset({script_of(char), *(s for s, back in looks.back.items() if char in back)})
        left = ways if left is None else left & ways
        if not left:
            break
    if len(looks.tokens) > 200_000:  # a memory of what a worker has seen, not of the corpus
        looks.tokens.clear()
    looks.tokens[token] = out = left or frozenset()
    return out


def spelled(token: str, script: str, looks: Look | None = None) -> str:
    """A skeleton token in the letters of a script."""
    looks = looks or look()
    back = looks.back.get(script)
    if not back:
        return token
    if (known := looks.forms.get((token, script))) is None:
        if len(looks.forms) > 200_000:
            looks.forms.clear()
        known = looks.forms[token, script] = unicodedata.normalize("NFC", "".join(back.get(c, c) for c in unicodedata.normalize("NFD", token)))
    return known


def form(text: str | None, looks: Look | None = None) -> str | None:
    """The consistent form of a text; null stays null, an empty text stays empty."""
    if text is None:
        return None
    looks = looks or look()
    bare = skeleton(text, looks)
    if bare.isascii() or not any(script_of(c) in looks.back for c in set(bare)):
        return bare
    found = {t: scripts(t, looks) for t in set(TOKEN.findall(bare))}
    votes: Counter[str] = Counter()
    for t in TOKEN.findall(bare):
        if len(found[t]) == 1:
            votes[next(iter(found[t]))] += len(t)
    ranked = [*sorted(votes, key=lambda s: (-votes[s], s != "LATIN", s)), "LATIN", *SPELLED]

    def chosen(match: re.Match[str]) -> str:
        token = match.group()
        ways = found[token]
        return spelled(token, next((s for s in ranked if s in ways), "LATIN"), looks) if ways else token

    return TOKEN.sub(chosen, bare)


def confusable_kind(text: str | None, looks: Look | None = None) -> str:
    """What a text holds: ``mixed`` (a token with letters of several scripts), ``whole`` (a token that another script could
    spell as well), ``other`` (only folded characters), ``none``."""
    if not text or text.isascii():
        return "none"
    looks = looks or look()
    kind = "other" if form(text, looks) != text else "none"
    for token in set(TOKEN.findall(unicodedata.normalize("NFC", text))):
        own = {script_of(c) for c in token if not unicodedata.combining(c)}
        if len(own & {"LATIN", *looks.back}) > 1:
            return "mixed"
        if own & set(looks.back) and "LATIN" in scripts(skeleton(token, looks), looks):
            kind = "whole"
    return kind


def consistent(df: DataFrame, text: str = "text", out: str = "form_text", kind: str | None = None, path: str | None = None) -> DataFrame:
    """Adds the consistent form of a text column (and the kind of confusable it had).

    Null texts give null, empty texts an empty form. Columns of the same names are replaced. One pass, no shuffle. ``path``: the
    confusables data; it is read once, where the query is put together, and goes with the tasks as a table of letters.
    """
    like = letters(prototypes(path or data_file()))

    @F.pandas_udf("string")
    def to_form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        looks = Look(like)
        for s in batches:
            yield s.map(lambda t: form(t, looks), na_action="ignore").astype(object).where(s.notna(), None)

    @F.pandas_udf("string")
    def to_kind(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        looks = Look(like)
        for s in batches:
            yield s.map(lambda t: confusable_kind(t if isinstance(t, str) else None, looks))

    given = F.col(text)
    return df.withColumns({out: to_form(given)} | ({kind: to_kind(given)} if kind else {}))


def hashed(df: DataFrame, key: str, text: str = "text", path: str | None = None) -> DataFrame:
    """(id, form_hash, text_hash), written once: 128-bit digests of each text and of its form. Rows of null text or key are left out."""
    like = letters(prototypes(path or data_file()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import blake2b

        looks = Look(like)
        of = lambda t: blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for batch in batches:
            texts = batch["text"]
            yield pd.DataFrame({"id": batch["id"], "form_hash": [of(form(t, looks)) for t in texts], "text_hash": [of(t) for t in texts]})

    given = spread(df.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null"))
    return checkpointed(given.mapInPandas(run, f"id {df.schema[key].dataType.simpleString()}, form_hash binary, text_hash binary"))


def classes(df: DataFrame, key: str, text: str = "text", path: str | None = None) -> DataFrame:
    """(key, class_id, copy_id, n_texts, n_rows) of each row that reads like one of other characters: its class, the first row of the
    same characters, how many different texts the class has, and how many rows.

    One row a row, however large a class is: what all pairs would say, without them. Class and copies are named by their lowest key.
    Counts are added up before they are shuffled.
    """
    rows = hashed(df, key, text, path)
    copies = rows.groupBy("form_hash", "text_hash").agg(F.min("id").alias("copy_id"), F.count("*").alias("_n"))
    by = copies.groupBy("form_hash").agg(F.min("copy_id").alias("class_id"), F.count("*").alias("n_texts"), F.sum("_n").alias("n_rows")).where("n_texts > 1")
    named = copies.join(by, "form_hash").drop("_n")
    return rows.join(named, ["form_hash", "text_hash"]).select(F.col("id").alias(key), "class_id", "copy_id", "n_texts", "n_rows")


def pairs(df: DataFrame, key: str, text: str = "text", path: str | None = None) -> DataFrame:
    """(key_a, key_b), key_a < key_b, of all rows whose texts differ in characters and have the same form.

    Rows of null text or key take no part; empty texts are a text like others. Only digests are written and shuffled. Forms
    with a single text drop out before anything is paired, and pairs are formed between different texts, so that equal
    copies, however many, are never compared with each other. All pairs are what is asked for here; ``classes`` says the same in a row a row.
    """
    rows = hashed(df, key, text, path)
    several = rows.groupBy("form_hash").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi")).where("lo <> hi")
    members = rows.join(several.select("form_hash"), "form_hash", "left_semi")
    texts = members.select("form_hash", "text_hash").distinct()
    a = texts.select("form_hash", F.col("text_hash").alias("hash_a"))
    b = texts.select("form_hash", F.col("text_hash").alias("hash_b"))
    differing = a.join(b, "form_hash").where("hash_a <> hash_b").drop("form_hash")
    left = members.select(F.col("text_hash").alias("hash_a"), F.col("id").alias(f"{key}_a"))
    right = members.select(F.col("text_hash").alias("hash_b"), F.col("id").alias(f"{key}_b"))
    both = left.join(differing, "hash_a").join(right, "hash_b")
    return both.where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")
