"""Oracles in ANSI SQL for those llm queries that SQL can express on whole tables."""

from __future__ import annotations

import unicodedata

# Letters of Cyrillic and Greek that are drawn like Latin ones. A table of this module, made apart from the operator's.
LIKE_LATIN = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ԝ": "W", "Х": "X",
    "ο": "o", "ν": "v", "υ": "u", "ρ": "p", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
P2_FOUND = """
WITH lim AS (SELECT limit_name, max_size FROM size_limits)
SELECT 'pdf_pages' AS item_table, page_id AS item_id, 0 AS section_no FROM pdf_pages
WHERE strlen(page_text) > (SELECT max_size FROM lim WHERE limit_name = 'pdf_page')
UNION ALL
SELECT 'hop1_context', hop_id, 0 FROM hop1_context
WHERE strlen(code) > (SELECT max_size FROM lim WHERE limit_name = 'hop1_code')
UNION ALL
SELECT 'docx_artifacts', docx_id, CAST(no AS INTEGER) FROM (
  SELECT docx_id, unnest(sections) AS section, generate_subscripts(sections, 1) AS no FROM docx_artifacts)
WHERE strlen(section.body_text) > (SELECT max_size FROM lim WHERE limit_name = 'docx_section')
"""


def _forms() -> str:
    """CTE h (doc_id, t, f) of digests of texts and of a plainer form, which holds for Latin, Cyrillic, Greek and Japanese text: everything folded to Latin letters."""
    wide = [c for c in range(0xFF01, 0xFFE7) if unicodedata.decomposition(chr(c)).startswith(("<wide>", "<narrow>"))]
    one = {chr(c): unicodedata.normalize("NFKD", chr(c)) for c in wide}
    one = {a: b for a, b in one.items() if len(b) == 1}
    one |= {chr(c): " " for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 9)}
    one |= LIKE_LATIN | {"‐": "-", "‑": "-", "µ": "μ", "ヘ": "へ"}
    one |= dict(zip("ёЁїЇѐЀベペ", "ëËïÏèÈべぺ", strict=True))
    given, shown = "".join(one), "".join(one.values()).replace("'", "''")
    text = r"regexp_replace(text, '([\x{2190}-\x{2bff}\x{1f000}-\x{1faff}])\x{200d}', '\1' || chr(57344), 'g')"
    text = rf"regexp_replace({text}, '[\x{{ad}}\x{{34f}}\x{{61c}}\x{{180e}}\x{{200b}}-\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2060}}-\x{{206f}}\x{{fe00}}-\x{{fe0f}}\x{{feff}}]', '', 'g')"
    for ligature in (0xFB03, 0xFB04, 0xFB00, 0xFB01, 0xFB02):
        text = f"replace({text}, chr({ligature}), '{unicodedata.normalize('NFKD', chr(ligature))}')"
    text = f"replace({text}, chr(13) || chr(10), chr(10))"
    form = f"nfc_normalize(translate(nfc_normalize(translate({text}, '{given}', '{shown}')), '{given}', '{shown}'))"
    return f"""f AS (SELECT doc_id, text, {form} AS form FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL), h AS (SELECT doc_id, md5(text) AS t, md5(form) AS f FROM f)"""


def p9_found() -> str:
    return f"WITH {_forms()} SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM h a JOIN h b ON a.f = b.f AND a.t <> b.t AND a.doc_id < b.doc_id"


def p9_classes() -> str:
    return f"""WITH {_forms()}, c AS (SELECT f, min(doc_id) AS class_id, count(DISTINCT t) AS n_texts, count(*) AS n_rows FROM h GROUP BY f HAVING count(DISTINCT t) > 1)
SELECT doc_id, class_id, min(doc_id) OVER (PARTITION BY f, t) AS copy_id, n_texts, n_rows FROM h JOIN c USING (f)"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND, "p9_found": p9_found(), "p9_classes": p9_classes()}
