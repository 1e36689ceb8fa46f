"""Pictures cut out of office and PDF files, and which of them are figures."""

import hashlib
import io
import struct
import zipfile
import zlib

import numpy as np
import pytest

from sheaf.operators import figures, layout
from sheaf.sources import extract, pdf, pictures

from .test_layout import document, paragraph

RNG = np.random.default_rng(5)


def noise(height, width):
    return RNG.integers(0, 256, (height, width, 3), dtype=np.uint8)


def filtered_png(x, kind, how, extra=b""):
    """A PNG file whose rows are all filtered one way."""
    height, width, n = x.shape
    raw, above = b"", np.zeros((width, n), np.int64)
    for row in x.astype(np.int64):
        left, corner = np.vstack([np.zeros((1, n), np.int64), row[:-1]]), np.vstack([np.zeros((1, n), np.int64), above[:-1]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        raw += bytes([how]) + ((row - [0 * row, left, above, (left + above) // 2, paeth][how]) % 256).astype(np.uint8).tobytes()
        above = row
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + b"\0\0\0\0"
    return pictures.PNG + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + extra + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


@pytest.mark.parametrize("how", range(5))
def test_pixels_survive_every_filter(how):
    x = noise(7, 5)
    assert (pictures.png_pixels(filtered_png(x, 2, how)) == x).all() and (pictures.png_pixels(pictures.png(x)) == x).all()
    gray = x[..., :1]
    assert (pictures.png_pixels(filtered_png(gray, 0, how)) == gray).all()


def test_transparent_pixels_lie_on_white_and_palettes_are_looked_up():
    x = np.array([[[10, 20, 30, 255], [10, 20, 30, 0], [0, 0, 0, 51]]], np.uint8)
    assert pictures.png_pixels(filtered_png(x, 6, 0)).tolist() == [[[10, 20, 30], [255, 255, 255], [204, 204, 204]]]
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + b"\0\0\0\0"
    palette = part(b"PLTE", bytes([1, 2, 3, 4, 5, 6])) + part(b"tRNS", bytes([255, 0]))
    assert pictures.png_pixels(filtered_png(np.array([[[0], [1]]], np.uint8), 3, 0, palette)).tolist() == [[[1, 2, 3], [255, 255, 255]]]


def test_large_pictures_are_scaled_to_means():
    x = np.zeros((4, 3000, 3), np.uint8)
    x[:, 1500:] = 200
    small = pictures.scaled(x, 1000)
    assert small.shape == (1, 1000, 3) and (small[0, :500] == 0).all() and (small[0, 500:] == 200).all()
    assert pictures.scaled(x[:, :900], 1000) is not None and pictures.scaled(x[:, :900], 1000).shape == (4, 900, 3)


def jpeg(width, height):
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xc4\x00\x03x\xff\xc2\x00\x11\x08" + struct.pack(">HH", height, width) + b"\x03" * 12 + b"\xff\xd9"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (jpeg(300, 200), ("jpeg", 300, 200)), (b"GIF89a" + struct.pack("<HH", 7, 9), ("gif", 7, 9)), (b"BM" + b"\0" * 16 + struct.pack("<ii", 8, -6) + b"\0", ("bmp", 8, 6)),
        (b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + bytes([99, 0, 0, 49, 0, 0]), ("webp", 100, 50)), (b"RIFF\0\0\0\0WEBPVP8L" + b"\0" * 5 + struct.pack("<I", 9 | 4 << 14), ("webp", 10, 5)),
        (b"RIFF\0\0\0\0WEBPVP8 " + b"\0" * 10 + struct.pack("<HH", 320, 240), ("webp", 320, 240)), (pictures.png(noise(3, 4)), ("png", 4, 3)), (b"plain text", None), (b"\xff\xd8 cut", None), (b"", None),
    ],
)
def test_sizes_from_headers(raw, want):
    assert pictures.header(raw) == want


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def relations(*targets, mode=""):
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
    return "<Relationships>" + "".join(f'<Relationship Id="r{i}" Type="{kind}{k}" Target="{t}" {mode if t.startswith("http") else ""}/>' for i, (k, t) in enumerate(targets)) + "</Relationships>"


NS = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
PIC = '<p:pic><p:blipFill><a:blip r:embed="{}"/></p:blipFill></p:pic>'


def test_figures_of_files(spark):
    big, wide, small, alpha = pictures.png(noise(200, 300)), pictures.png(noise(20, 151)), pictures.png(noise(149, 149)), jpeg(400, 400)
    docx = package({
        "word/document.xml": "<x/>", "word/media/a.png": big, "word/media/b.png": small, "word/media/c.png": wide, "word/media/d.jpg": alpha, "word/media/e.png": filtered_png(pictures.png_pixels(big), 2, 4),
        "word/_rels/document.xml.rels": relations(("image", "media/b.png"), ("image", "media/c.png"), ("styles", "styles.xml"), ("image", "/word/media/a.png"), ("image", "http://x/y.png"), ("image", "media/d.jpg"), ("image", "media/e.png"), mode='TargetMode="External"'),
    })
    slide = f"<p:sld {NS}>{PIC.format('r1')}<p:grpSp>{PIC.format('r0')}</p:grpSp>{PIC.format('missing')}</p:sld>"
    pptx = package({"ppt/slides/slide2.xml": slide, "ppt/slides/_rels/slide2.xml.rels": relations(("image", "../media/a.png"), ("image", "../media/b.jpg")), "ppt/media/a.png": big, "ppt/media/b.jpg": alpha})
    gray = RNG.integers(0, 256, (160, 170), dtype=np.uint8)
    objects = {
        50: b"<< /Subtype /Image /Width 400 /Height 400 /Filter /DCTDecode /Length %d >>\nstream\n%s\nendstream" % (len(alpha), alpha),
        51: b"<< /Subtype /Image /Width 170 /Height 160 /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(z := zlib.compress(gray.tobytes())), z),
    }
    place = lambda name, x, y, w, h: b"q %d 0 0 %d %d %d cm /%s Do Q\n" % (w, h, x, y, name)
    prose = paragraph(60, 780, ["A page with enough text not to be taken for one that was scanned."])
    pages = [prose + place(b"J", 50, 100, 400, 400) + place(b"G", 60, 110, 300, 300) + place(b"G", 0, 0, 20, 20), prose + place(b"G", 60, 110, 300, 300), place(b"J", 0, 0, 600, 800)]
    files = {"a.docx": docx, "b.pptx": pptx, "c.pdf": document(pages, objects, b"/XObject << /J 50 0 R /G 51 0 R >>"), "d.docx": b"no zip", "e.txt": b"plain"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    cut = pictures.cut_out(df)
    rows = {(r.path, r.key): r for r in cut.collect() if r.key}
    assert [k for p, k in sorted(rows) if p == "a.docx"] == ["fig0", "fig1", "fig2", "fig3", "fig4"] and rows["a.docx", "fig2"].sha == rows["a.docx", "fig4"].sha == rows["b.pptx", "s2:fig1"].sha
    assert rows["b.pptx", "s2:fig0"].locator == "slide 2" and rows["a.docx", "fig3"].sha == hashlib.sha256(alpha).hexdigest()
    assert (pictures.png_pixels(bytes(rows["c.pdf", "p2:fig0"].content))[..., 0] == gray).all()
    assert [r.path for r in cut.where("error IS NOT NULL").collect()] == ["d.docx"]
    _, facts = layout.elements(pdf.scan_items(df.where("path LIKE '%.pdf'")))
    got = {}
    for r in figures.collected(cut, facts).orderBy("path", "rank").collect():
        got.setdefault(r.path, []).append((r.key, r.area))
    # of the PDF: the gray picture lies in the other on page 1 but stands alone on page 2; page 3 is a scan
    assert got == {"a.docx": [("fig3", 160000), ("fig2", 60000), ("fig1", 3020)], "b.pptx": [("s2:fig0", 160000), ("s2:fig1", 60000)], "c.pdf": [("p1:fig0", 160000), ("p2:fig0", 27200)]}
    assert figures.collected(cut, facts, 1).count() == 3


def chart(kind, series, more="", title=""):
    c = 'xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    told = lambda tag, values: f"<c:{tag}><c:cache>" + "".join(f'<c:pt idx="{i}"><c:v>{v}</c:v></c:pt>' for i, v in enumerate(values) if v is not None) + f"</c:cache></c:{tag}>"
    made = "".join("<c:ser>" + (f'<c:tx><c:strRef><c:strCache><c:pt idx="0"><c:v>{n}</c:v></c:pt></c:strCache></c:strRef></c:tx>' if n else "") + told("cat", cats) + told("val", vals) + "</c:ser>" for n, cats, vals in series)
    head = f"<c:title><c:tx><c:rich><a:p><a:r><a:t>{title}</a:t></a:r></a:p></c:rich></c:tx></c:title>" if title else ""
    return f"<c:chartSpace {c}><c:chart>{head}<c:plotArea><c:layout/><c:{kind}>{more}{made}</c:{kind}></c:plotArea></c:chart></c:chartSpace>"


def test_charts_of_slides_say_their_series():
    bars = chart("barChart", [("2024", ["North", "South"], ["1.5", "2"]), (None, ["North", "South"], ["3", None])], '<c:barDir val="col"/><c:grouping val="clustered"/>', "Sales")
    line = chart("lineChart", [("x", ["a"], ["7"])], '<c:grouping val="standard"/><c:marker><c:symbol val="circle"/></c:marker>')
    slide = f"<p:sld {NS}><p:txBody><a:p><a:r><a:t>Title</a:t></a:r></a:p></p:txBody></p:sld>"
    deck = package({
        "ppt/slides/slide1.xml": slide, "ppt/slides/_rels/slide1.xml.rels": relations(("chart", "../charts/c1.xml"), ("chart", "/ppt/charts/c2.xml"), ("chart", "../charts/gone.xml"), ("chart", "../charts/c3.xml")),
        "ppt/charts/c1.xml": bars, "ppt/charts/c2.xml": line, "ppt/charts/c3.xml": chart("pieChart", []),
    })
    got = [(e["kind"], e["locator"], e["text"]) for e in extract.read_pptx(deck)]
    assert got == [
        ("figure", "slide 1, chart", "Chart (column clustered): Sales\ncategory | 2024 | series 2\nNorth | 1.5 | 3\nSouth | 2 | "), ("figure", "slide 1, chart", "Chart (line markers)\ncategory | x\na | 7"), ("slide", "slide 1", "Title"),
    ]
