"""Pictures cut out of DOCX, PPTX and PDF files, with their sizes from their own headers.

PNG files and unpacked PDF pictures are put on white, scaled down to a sensible size and written as plain RGB PNG, so that equal
pictures have equal bytes. JPEG and other formats are kept as they are; their size is read from the header.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pdf

MOST_SIDE = 1568
PICTURE = "path string, key string, locator string, page int, slide int, place int, format string, width int, height int, x0 double, y0 double, x1 double, y1 double, sha string, content binary, error string"
COLUMNS = [c.split()[0] for c in PICTURE.split(", ")]
PNG = b"\x89PNG\r\n\x1a\n"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def header(raw: bytes) -> tuple[str, int, int] | None:
    """(format, width, height) by a file's first bytes; None if it is none of the formats known."""
    if raw[:8] == PNG and raw[12:16] == b"IHDR":
        return "png", *struct.unpack(">II", raw[16:24])
    if raw[:6] in (b"GIF87a", b"GIF89a"):
        return "gif", *struct.unpack("<HH", raw[6:10])
    if raw[:2] == b"BM" and len(raw) > 26:
        width, height = struct.unpack("<ii", raw[18:26])
        return "bmp", width, abs(height)
    if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
        if raw[12:16] == b"VP8X":
            return "webp", 1 + int.from_bytes(raw[24:27], "little"), 1 + int.from_bytes(raw[27:30], "little")
        if raw[12:16] == b"VP8L":
            bits = int.from_bytes(raw[21:25], "little")
            return "webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        width, height = struct.unpack("<HH", raw[26:30])
        return "webp", width & 0x3FFF, height & 0x3FFF
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(raw):
            if raw[at] != 0xFF:
                at += 1
                continue
            mark = raw[at + 1]
            if mark in range(0xC0, 0xD0) and mark not in (0xC4, 0xC8, 0xCC):  # a frame's header
                height, width = struct.unpack(">HH", raw[at + 5 : at + 9])
                return "jpeg", width, height
            at += 2 if mark == 0xFF or mark == 1 or 0xD0 <= mark <= 0xD9 else 2 + int.from_bytes(raw[at + 2 : at + 4], "big")
    return None


def chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(raw):
        size = int.from_bytes(raw[at : at + 4], "big")
        yield raw[at + 4 : at + 8], raw[at + 8 : at + 8 + size]
        at += 12 + size


def png_pixels(raw: bytes) -> np.ndarray | None:
    """Pixels (height, width, 3) on white; None for kinds that aren't read here (interlaced, or of other than 8 bits a sample)."""
    parts: dict[bytes, bytes] = {}
    for name, body in chunks(raw):
        parts[name] = parts.get(name, b"") + body
    width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if depth != 8 or interlaced or samples is None:
        return None
    data = pdf.predicted(zlib.decompress(parts[b"IDAT"]), {"Predictor": 15, "Colors": samples, "Columns": width})
    x = np.frombuffer(data, np.uint8).reshape(height, width, samples)
    alpha = np.full((height, width, 1), 255, np.uint8)
    if kind == 3:
        colors = np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)
        clear = np.full(256, 255, np.uint8)
        clear[: len(parts.get(b"tRNS", b""))] = np.frombuffer(parts.get(b"tRNS", b""), np.uint8)
        alpha, x = clear[x], colors[np.minimum(x[..., 0], len(colors) - 1)]
    elif kind in (4, 6):
        alpha, x = x[..., -1:], x[..., :-1]
    x = np.broadcast_to(x, (height, width, 3)).astype(np.uint32)
    a = alpha.astype(np.uint32)
    return ((x * a + 255 * (255 - a) + 127) // 255).astype(np.uint8)


def scaled(x: np.ndarray, most: int = MOST_SIDE) -> np.ndarray:
    """Pixels scaled down, by the mean over each new pixel's own old ones, so that no side is over `most`."""
    height, width = x.shape[:2]
    if max(height, width) <= most:
        return x
    share = most / max(height, width)
    for axis, n in ((0, height), (1, width)):
        to = max(1, int(n * share))
        edges = np.arange(to) * n // to
        sums = np.add.reduceat(x.astype(np.float64), edges, axis)
        x = sums / np.diff([*edges, n]).reshape([-1 if i == axis else 1 for i in range(3)])
    return (x + 0.5).astype(np.uint8)


def png(x: np.ndarray) -> bytes:
    """Pixels (height, width, 3) as a plain PNG file."""
    height, width = x.shape[:2]
    rows = np.zeros((height, 1 + 3 * width), np.uint8)
    rows[:, 1:] = x.reshape(height, -1)
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return PNG + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes(), 6)) + part(b"IEND", b"")


def normal(raw: bytes) -> dict | None:
    """format, width, height, sha and content of a picture, PNG files brought to one form; None if it is no picture."""
    found = header(raw)
    if found is None:
        return None
    pixels = png_pixels(raw) if found[0] == "png" else None
    if pixels is not None:
        pixels = scaled(pixels)
        raw, found = png(pixels), ("png", pixels.shape[1], pixels.shape[0])
    return {"format": found[0], "width": found[1], "height": found[2], "sha": hashlib.sha256(raw).hexdigest(), "content": raw}


def related(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Relationships of a package's part: id to (kind, part), in their order; those that lead outside are left out."""
    folder, name = posixpath.split(part)
    where = f"{folder}/_rels/{name}.rels"
    if where not in z.NameToInfo:
        return {}
    place = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
    return {r.get("Id"): (r.get("Type", "").rsplit("/", 1)[-1], place(r.get("Target", ""))) for r in ET.fromstring(z.read(where)) if r.get("TargetMode") != "External"}


def of_docx(raw: bytes) -> Iterator[tuple[dict, bytes]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for kind, part in related(z, "word/document.xml").values():
            if kind == "image" and part in z.NameToInfo:
                yield {}, z.read(part)


def of_pptx(raw: bytes) -> Iterator[tuple[dict, bytes]]:
    """Pictures of each slide in the order of its shapes, those in groups too."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for number, part in slides:
            to = related(z, part)
            for shape in ET.fromstring(z.read(part)).iter("{http://schemas.openxmlformats.org/presentationml/2006/main}pic"):
                ids = [b.get(f"{RELATION}embed") for b in shape.iter("{http://schemas.openxmlformats.org/drawingml/2006/main}blip")]
                for _, target in (to[i] for i in ids if i in to):
                    if target in z.NameToInfo:
                        yield {"slide": number}, z.read(target)


def of_pdf(raw: bytes) -> Iterator[tuple[dict, bytes]]:
    """Pictures on pages, at least 5 % of the page's area; unpacked ones of gray or RGB samples become PNG files."""
    area = 1.0
    for x in pdf.items(raw, with_content=True):
        size = (x["x1"] - x["x0"]) * (x["y1"] - x["y0"])
        if x["what"] == "page":
            area = size or 1.0
        elif x["what"] == "picture" and size >= 0.05 * area and x.get("content"):
            data, width, height = x["content"], int(x["width"]), int(x["height"])
            samples = len(data) // (width * height) if width * height else 0
            if x["text"] == "raw" and samples in (1, 3):
                flat = np.frombuffer(data[: width * height * samples], np.uint8).reshape(height, width, samples)
                data = png(np.broadcast_to(flat, (height, width, 3)))
            yield {"page": x["page"], "x0": x["x0"], "y0": x["y0"], "x1": x["x1"], "y1": x["y1"]}, data


CUTTERS = {"docx": of_docx, "pptx": of_pptx, "pdf": of_pdf}


def cut_out(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """path, key, locator, page, slide, place, format, width, height, box, sha, content: one row for each picture in a file.

    `place` counts a file's pictures in their order, `key` those of a page or slide. Files of other kinds have none; one that can't
    be read gives a row with an error. Map-only, a picture at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list[dict]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=COLUMNS)
            for c in ("page", "slide", "place", "width", "height"):
                out[c] = out[c].astype("Int32")
            for c in ("key", "locator", "format", "sha", "content", "error"):
                out[c] = out[c].astype(object).where(out[c].notna(), None)
            return out

        for b in batches:
            for path, raw in zip(b["path"], b["content"], strict=True):
                counts: dict[str, int] = {}
                place = 0
                try:
                    for about, data in CUTTERS.get(path.rsplit(".", 1)[-1].lower(), lambda _: iter(()))(bytes(raw or b"")):
                        found = normal(data)
                        if found is None:
                            continue
                        page, slide = about.get("page"), about.get("slide")
                        lead = f"p{page}:" if page else f"s{slide}:" if slide else ""
                        n = counts[lead] = counts.get(lead, -1) + 1
                        locator = f"page {page}" if page else f"slide {slide}" if slide else f"figure {n + 1}"
                        yield frame([{"path": path, "key": f"{lead}fig{n}", "locator": locator, "place": place, **about, **found}])
                        place += 1
                except Exception as e:  # a broken file must not fail the others
                    yield frame([{"path": path, "error": f"{type(e).__name__}: {str(e)[:200]}"}])

    return files.select(F.col(path_col).alias("path"), F.col(content_col).alias("content")).mapInPandas(run, PICTURE)
