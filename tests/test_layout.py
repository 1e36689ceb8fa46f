"""PDF pages: what stands on them, and lines, blocks, tables, headings and segments made of that."""

import base64
import zlib

import pytest
from pyspark.sql import functions as F

from sheaf.operators import documents, layout
from sheaf.sources import extract, pdf


def written(objects: dict[int, bytes], packed: dict[int, bytes] | None = None) -> bytes:
    """A file of numbered objects; `packed` ones go into an object stream."""
    out = dict(objects)
    if packed:
        places, body = [], b""
        for n, o in packed.items():
            places.append(b"%d %d" % (n, len(body)))
            body += o + b" "
        head = b" ".join(places) + b" "
        data = zlib.compress(head + body)
        out[90] = b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(packed), len(head), len(data), data)
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in out.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


def document(pages: list[bytes], more: dict[int, bytes] | None = None, resources: bytes = b"") -> bytes:
    """Pages of 600 x 800 points by their content streams, with a plain (F1) and a bold font (F2)."""
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding /FirstChar 32 /Widths [%s] >>" % (b"500 " * 224),
        4: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold >>", **(more or {}),
    }
    kids = []
    for i, c in enumerate(pages):
        data = zlib.compress(c)
        objects[100 + 2 * i] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(data), data)
        objects[101 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents [%d 0 R] >>" % (100 + 2 * i)
        kids.append(b"%d 0 R" % (101 + 2 * i))
    objects[2] = b"<< /Type /Pages /MediaBox [0 0 600 800] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> %s >> /Kids [%s] /Count %d >>" % (resources, b" ".join(kids), len(kids))
    return written(objects)


def text(x, y, size, said, font=1):
    return f"BT /F{font} {size} Tf 1 0 0 1 {x} {y} Tm ({said}) Tj ET\n".encode()


def paragraph(x, y, lines, size=10):
    return b"".join(text(x, y - 12 * i, size, line) for i, line in enumerate(lines))


def ruled(x, y, widths, heights):
    """Rules of a table whose upper left corner is at (x, y)."""
    out, right, bottom = b"", x + sum(widths), y - sum(heights)
    for i in range(len(heights) + 1):
        at = y - sum(heights[:i])
        out += f"{x} {at} m {right} {at} l S\n".encode()
    for i in range(len(widths) + 1):
        at = x + sum(widths[:i])
        out += f"{at} {y} m {at} {bottom} l S\n".encode()
    return out


def laid(spark, **files):
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    items = pdf.scan_items(df)
    found, facts = layout.elements(items)
    return items, found, facts


COLUMNS = text(60, 750, 18, "A title over both columns") + paragraph(60, 700, ["The left column is read", "from its top to its bot-", "tom before"], 10) + paragraph(60, 640, ["its second paragraph."]) + (
    paragraph(320, 700, ["the right column starts,", "which has one paragraph."]) + text(320, 640, 10, "Bold line", 2) + paragraph(320, 628, ["Body below it, at the end."]))


def test_columns_are_read_one_after_the_other(spark):
    # drawn out of order, as some writers do
    scattered = b"".join(reversed(COLUMNS.split(b"\n"))).replace(b"ETBT", b"ET\nBT")
    for content in (COLUMNS, scattered):
        _, found, _ = laid(spark, **{"a.pdf": document([content])})
        assert [(r.kind, r.level, r.text) for r in found.orderBy("ordinal").collect()] == [
            ("heading", 1, "A title over both columns"), ("paragraph", None, "The left column is read from its top to its bottom before"), ("paragraph", None, "its second paragraph."),
            ("paragraph", None, "the right column starts, which has one paragraph."), ("heading", 4, "Bold line"), ("paragraph", None, "Body below it, at the end."),
        ]


def test_ruled_tables_leave_the_text(spark):
    rows = [["Name", "Amount", "Note"], ["Pens", "12", "blue"], ["Paper", "", "two words"]]
    page = paragraph(60, 740, ["Before the table stands a sentence of prose."]) + ruled(60, 700, [100, 80, 120], [20, 20, 20])
    for i, r in enumerate(rows):
        for j, c in enumerate(r):
            x = 60 + [0, 100, 180][j] + 5
            page += b"".join(text(x + 30 * k, 700 - 20 * i - 14, 10, w) for k, w in enumerate(c.split()))
    page += b"400 300 100 50 re S\n" + text(410, 320, 10, "framed") + paragraph(60, 600, ["After it another one."])
    items, found, facts = laid(spark, **{"t.pdf": document([page])})
    got = found.orderBy("ordinal").collect()
    assert [(r.kind, r.text) for r in got] == [
        ("paragraph", "Before the table stands a sentence of prose."), ("paragraph", "After it another one."), ("paragraph", "framed"),
        ("table", "Name | Amount | Note\nPens | 12 | blue\nPaper |  | two words")]
    assert got[-1].rows == rows and (got[-1].x0, got[-1].y0, got[-1].x1, got[-1].y1) == (60.0, 100.0, 360.0, 160.0) and got[-1].id == "p1:e3"
    assert layout.summary(items, facts, found).first().asDict() == {"path": "t.pdf", "pages": 1, "ocr_pages": [], "figure_pages": [], "logical_documents": 1, "tables": 1}


TO_UNICODE = b"/CIDInit begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0041> <0002> <D83DDE00> endbfchar 1 beginbfrange <0010> <0013> <0061> endbfrange 1 beginbfrange <0020> <0021> [<00660069> <0078>] endbfrange endcmap"


def test_fonts_filters_and_packed_objects():
    fonts = {
        10: b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /DescendantFonts [11 0 R] /ToUnicode 12 0 R >>",
        11: b"<< /Type /Font /Subtype /CIDFontType2 /DW 600 /W [1 [250 750] 16 19 400] /FontDescriptor << /Type /FontDescriptor /Flags 262144 >> >>",
        12: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(TO_UNICODE), TO_UNICODE),
        13: b"<< /Type /Font /Subtype /Type1 /BaseFont /Y /Encoding << /Differences [65 /eacute /one /uni20AC 90 /germandbls] >> >>",
    }
    resources = b"<< /Font << /A 10 0 R /B 13 0 R >> >>"
    packed = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [20 0 R] /Count 1 >>", 20: b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 100 100] /Contents [21 0 R 22 0 R] /Resources " + resources + b" >>"}
    first = base64.a85encode(zlib.compress(b"BT /A 10 Tf 10 50 Td <00010010001100130020 0002> Tj ET ")) + b"~>"
    second = b"42 54 202f42 20 31 30 20 54 66 20 31 30 20 33 30 20 54 64 20 28 41 42 43 5a 29 20 54 6a 20 45 54 >"
    raw = written(fonts | {
        21: b"<< /Filter [/ASCII85Decode /FlateDecode] /Length %d >>\nstream\n%s\nendstream" % (len(first), first), 22: b"<< /Filter /ASCIIHexDecode /Length 9999 >>\nstream\n%s\nendstream" % second,
    }, packed)
    got = [(x["text"], x["bold"], x["x0"], x["x1"]) for x in pdf.items(raw) if x["what"] == "text"]
    assert got == [("Aabdfi😀", True, 10.0, 10 + 10 * (0.25 + 3 * 0.4 + 0.6 + 0.75)), ("é1€ß", False, 10.0, 30.0)]


def test_lzw_run_lengths_and_row_filters():
    # the example of the format's specification, and rows filtered by each of the five ways
    assert pdf.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert pdf.run_lengths(bytes([2, 1, 2, 3, 254, 9, 128, 7])) == bytes([1, 2, 3, 9, 9, 9])
    rows = [[1, 2, 3], [4, 6, 9], [5, 5, 5], [7, 1, 0], [9, 8, 7]]
    raw, above = b"", [0, 0, 0]
    for how, row in enumerate(rows):
        left = [0, *row[:-1]]
        corner = [0, *above[:-1]]
        guess = [[0] * 3, left, above, [(a + b) // 2 for a, b in zip(left, above, strict=True)], [min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2] for a, b, c in zip(left, above, corner, strict=True)]][how]
        raw += bytes([how, *((v - g) % 256 for v, g in zip(row, guess, strict=True))])
        above = row
    assert pdf.predicted(raw, {"Predictor": 12, "Columns": 3}) == bytes(v for r in rows for v in r)


def test_scanned_pages_pictures_and_broken_files(spark):
    image = {50: b"<< /Type /XObject /Subtype /Image /Width 40 /Height 30 /Filter /DCTDecode /Length 4 >>\nstream\n\xff\xd8\xff\xd9\nendstream"}
    resources = b"/XObject << /Im 50 0 R >>"
    scan, small = b"q 600 0 0 800 0 0 cm /Im Do Q\n", b"q 20 0 0 20 0 0 cm /Im Do Q BI /W 4 /H 4 /BPC 8 /CS /G ID \x01( EI2 abc EI\n"
    raw = document([scan, small + paragraph(60, 700, ["Only a logo, and enough text not to be taken for a scanned page."]), b""], image, resources)
    items, found, facts = laid(spark, **{"s.pdf": raw, "x.pdf": b"%PDF-1.4 nothing", "no.pdf": b"plain", "secret.pdf": raw.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R")})
    assert [(r.path, r.page, r.figures, r.scanned) for r in facts.orderBy("path", "page").collect()] == [("s.pdf", 1, 1, True), ("s.pdf", 2, 0, False), ("s.pdf", 3, 0, False)]
    assert items.where("what = 'picture'").count() == 3 and items.where("text = 'jpeg'").first().width == 40
    assert {r.path for r in items.where("error IS NOT NULL").collect()} == {"x.pdf", "no.pdf", "secret.pdf"}
    whole = extract.extract(spark.createDataFrame([("s.pdf", bytearray(document([scan], image, resources))), ("t.txt", bytearray(b"one")), ("x.pdf", bytearray(b"?"))], "path string, content binary"))
    got = {r.path: r for r in whole.collect()}
    assert got["s.pdf"].error == "needs ocr" and got["t.txt"].text == "one" and got["x.pdf"].error == "ValueError: not a PDF file" and got["x.pdf"].ordinal is None


def test_turned_pages_and_forms():
    form = {60: b"<< /Type /XObject /Subtype /Form /Matrix [1 0 0 1 5 0] /Length 43 >>\nstream\nBT /F1 10 Tf 100 200 Td (in a form) Tj ET \nendstream"}
    raw = document([b"q 1 0 0 1 10 20 cm /Fm Do Q"], form, b"/XObject << /Fm 60 0 R >> /Rotate 90")
    at = next(x for x in pdf.items(raw) if x["what"] == "text")
    assert (at["text"], at["x0"], at["y1"]) == ("in a form", 115.0, 582.0)
    turned = raw.replace(b"/Type /Pages", b"/Type /Pages /Rotate 90")
    first, at = list(pdf.items(turned))[:2]
    assert (first["x1"], first["y1"]) == (800.0, 600.0) and (at["y0"], at["x0"]) == (115.0, 218.0)


@pytest.mark.parametrize(("looks", "want"), [([], [[1, 2, 3, 4, 5]]), ([2], [[1, 2, 3, 4, 5]]), ([3], [[1, 2], [3, 4, 5]]), ([2, 3, 4], [[1, 2], [3, 4, 5]]), ([3, 4, 5], [[1, 2], [3, 4], [5]]), ([1, 4], [[1, 2, 3], [4, 5]])])
def test_segments_of_a_bundle(spark, looks, want):
    # the rule as it is told: a part ends before a page that looks like a first one, but not after a single page
    parts, part = [], []
    for n in range(1, 6):
        part.append(n)
        if n < 5 and len(part) > 1 and n + 1 in looks:
            parts.append(part)
            part = []
    assert parts + [part] == want
    pages = spark.createDataFrame([("d", n, n in looks) for n in range(1, 6)], "doc string, page int, first boolean")
    got = {}
    for r in documents.logical_segments(pages, "doc", "page", F.col("first")).collect():
        got.setdefault(r.segment, []).append(r.page)
    assert [sorted(got[k]) for k in sorted(got)] == want


def test_segments_of_pages_by_their_first_lines(spark):
    pages = [paragraph(60, 700, [f"{begin} of some length, so that it is a page."]) for begin in ("A letter", "continued", "Invoice no 7", "more", "Application form", "and the rest")]
    _, found, facts = laid(spark, **{"b.pdf": document(pages)})
    assert [r.segment for r in facts.orderBy("page").collect()] == [1, 1, 2, 2, 3, 3]
    assert {r.group for r in found.where("page > 4").collect()} == {"logical:3"}


def test_no_items(spark):
    found, facts = layout.elements(spark.createDataFrame([], pdf.ITEM))
    assert found.collect() == [] and facts.collect() == []
