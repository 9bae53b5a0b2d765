"""PDF text: round trips, hand-written files, and what can't be read."""

import zlib

from loomfield.sources import pdf


def made(content: bytes, extra: bytes = b"", font: bytes = b"<< /Type /Font /BaseFont /Helvetica >>", filter_: bytes = b"") -> bytes:
    return (
        b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [ 3 0 R ] /Count 1 /Resources << /Font << /F1 5 0 R >> >> >> endobj\n"
        b"3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R >> endobj\n4 0 obj << /Length 9 " + filter_ + b" >>\nstream\n" + content + b"\nendstream endobj\n5 0 obj " + font + b" endobj\n" + extra + b"trailer << /Root 1 0 R >>"
    )


def test_operators_and_escapes():
    text = rb"BT /F1 12 Tf 72 700 Td (One \(two\) \101\n) Tj 0 -14 Td [(wi) -30 (de) -300 (gap)] TJ T* <416263> Tj (next) ' ET"
    assert pdf.pages(made(text)) == (["One (two) A\n\nwide gap\nAbc\nnext"], "")
    assert pdf.pages(made(zlib.compress(b"BT (caf\xe9) Tj ET"), filter_=b"/Filter /FlateDecode")) == (["café"], "")


def test_tables_of_fonts():
    table = b"1 begincodespacerange <00> <FF> endcodespacerange 2 beginbfchar <01> <0041> <02> <D83DDE00> endbfchar 1 beginbfrange <10> <12> <0061> endbfrange"
    extra = b"6 0 obj << /Length 9 >>\nstream\n" + table + b"\nendstream endobj\n"
    assert pdf.pages(made(b"BT /F1 1 Tf <0102101112> Tj ET", extra, b"<< /Type /Font /ToUnicode 6 0 R >>")) == (["A😀abc"], "")


def test_round_trip():
    texts = ["", "one\ntwo  three\n\nfour", "ünï 日本語 👩‍💻 (x) \\ <y>", "a\tb" * 500]
    assert pdf.pages(pdf.written(texts)) == (texts, "")


def test_what_cannot_be_read(spark, rows):
    assert pdf.pages(b"junk") == ([], "not-a-pdf") and pdf.pages(b"%PDF-1.4\n")[1] == "no-text-layer"
    assert pdf.pages(made(b"", b"trailer << /Encrypt 9 0 R >>"))[1] == "encrypted"
    assert pdf.pages(made(b"x", filter_=b"/Filter /DCTDecode"))[1] == "filter: DCTDecode" and pdf.pages(made(b"xx", filter_=b"/Filter /FlateDecode"))[1] == "torn-stream"
    assert pdf.pages(pdf.written(["x"] * 501))[1] == "too-many-pages"
    df = spark.createDataFrame([(1, pdf.written(["a", "b"]), "own"), (2, None, "own"), (3, b"", "own")], "k int, content binary, page_text string")
    assert rows(pdf.page_texts(df, "k")) == [(1, 1, "a", ""), (1, 2, "b", ""), (3, 0, None, "not-a-pdf")]
