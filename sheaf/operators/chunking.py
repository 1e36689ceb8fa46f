"""Elements to chunks: paragraphs merged up to a target under their headings, long ones split at sentences, tables by rows."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.session import bounded_batches

TARGET, HARD_MAX, OVERLAP = 1200, 1800, 150
SHORT = 80  # a last piece below this joins the one before it
CUE_SECONDS = 120
SENTENCE = re.compile(r"(?<=[.!?।])\s+|\n+")


def cuts(target: int) -> re.Pattern:
    """Pieces of an over-long sentence: the rest if it fits, else up to the last blank in the second half of `target`, else `target` characters."""
    return re.compile(rf"\S(?:.{{0,{target - 1}}}\Z|.{{{target // 2},{max(target - 2, target // 2)}}}(?= )|.{{0,{target - 1}}})", re.DOTALL)


def sentences(text: str, target: int) -> list[str]:
    cut = cuts(target)
    return [piece.strip() for s in SENTENCE.split(text) for piece in (cut.findall(s.strip()) if len(s.strip()) > target else [s.strip()]) if piece.strip()]


def split_text(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    """Pieces of at most `target` characters, each beginning with up to `overlap` characters of whole sentences of the one before.

    Works on where each sentence ends in the joined text; what fits and what is carried over are found by bisection.
    """
    text = text.strip()
    if len(text) <= target:
        return [text] if text else []
    parts = sentences(text, target)
    ends = list(accumulate(len(p) + 1 for p in parts))
    out, start, new = [], 0, 0  # a piece begins at `start`; sentences before `new` were in a piece already
    while new < len(parts):
        base = ends[start - 1] if start else 0
        stop = max(bisect_right(ends, base + target + 1), new + 1)
        out.append(" ".join(parts[start:stop]))
        behind = ends[stop - 1] - 1 - overlap  # what is carried over begins here or later
        start, new = max(start, min(stop, bisect_left(ends, behind) + 1)) if behind > 0 else start, stop
    return out


def split_rows(rows: list, target: int = TARGET) -> Iterator[tuple[int, int, list]]:
    """(first, last, rows with header): body rows from 1 in groups whose text stays within the target; a long row stays whole, a lone header too."""
    if len(rows) == 1:
        yield 1, 1, rows
    header, group, first, size = rows[0], [], 1, 0
    base = len(" | ".join(header)) + 1
    for i, r in enumerate(rows[1:], 1):
        n = len(" | ".join(r)) + 1
        if group and base + size + n > target:
            yield first, i - 1, [header, *group]
            group, first, size = [], i, 0
        group.append(r)
        size += n
    if group:
        yield first, len(rows) - 1, [header, *group]


def placed(elements: Iterable[dict]) -> Iterator[tuple[tuple, dict]]:
    """Elements with something in them and their place: headings before them, section, sheet, slide, kind. Nothing is merged across places."""
    path: list[tuple[int, str]] = []
    for headings, e in enumerate(elements):
        text = (e.get("text") or "").strip()
        rows = [list(r) for r in e["rows"]] if e.get("rows") is not None else []
        if e["kind"] == "heading":
            if text:
                level = e.get("level") or 1
                path = [(n, t) for n, t in path if n < level] + [(level, text)]
                last = headings
        elif text or rows:
            place = (last if path else -1, " > ".join(t for _, t in path), e.get("sheet"), e.get("slide"), e["kind"])
            yield place, e | {"text": text, "rows": rows}


def table_pieces(run: list[dict], target: int, *_):
    for e in run:
        for first, last, part in split_rows(e["rows"], target) if e["rows"] else [(1, 1, [[e["text"]]])]:
            yield "\n".join(" | ".join(r) for r in part), [e], e.get("locator") or (f"rows {first}-{last}" if last > first else f"row {first}")


def whole_pieces(run: list[dict], target: int, hard_max: int, overlap: int, _):
    for e in run:
        for piece in split_text(e["text"], target, overlap) if len(e["text"]) > hard_max else [e["text"]]:
            yield piece, [e], e.get("locator")


def merged_pieces(run: list[dict], target: int, hard_max: int, overlap: int, lead: int):
    """Neighbours joined up to the target (transcripts also up to CUE_SECONDS from the first cue); one over hard_max is split by itself."""
    group: list[dict] = []
    join = lambda g: "\n\n".join(x["text"] for x in g)
    for e in [*run, None]:
        long = e is not None and e["kind"] != "transcript" and len(e["text"]) + lead > hard_max
        late = bool(group) and e is not None and e["kind"] == "transcript" and not (e.get("start_s") is not None and group[0].get("start_s") is not None and e["end_s"] - group[0]["start_s"] <= CUE_SECONDS)
        if group and (e is None or long or late or len(join([*group, e])) + lead > target):
            yield join(group), group, group[0].get("locator")
            group = []
        if long:
            yield from ((p, [e], e.get("locator")) for p in split_text(e["text"], target, overlap))
        elif e is not None:
            group.append(e)


FORMS = {"table": table_pieces, "slide": whole_pieces, "summary": whole_pieces, "figure": whole_pieces}


def build_chunks(elements: Iterable[dict], target: int = TARGET, hard_max: int = HARD_MAX, overlap: int = OVERLAP) -> list[dict]:
    """Chunks of one document's elements in order: kind, text, section, locator, elements (ordinals)."""
    out: list[dict] = []
    for place, run in groupby(placed(elements), key=lambda x: x[0]):
        _, section, _, _, kind = place
        head = f"Section: {section}\n" if section and kind not in ("slide", "summary") else ""
        form = FORMS.get(kind, merged_pieces)
        made: list[dict] = []
        for body, own, locator in form([e for _, e in run], target, hard_max, overlap, len(head)):
            ordinals = [e["ordinal"] for e in own]
            if form is merged_pieces and made and len(body) < SHORT and len(made[-1]["text"]) + 2 + len(body) <= hard_max:
                made[-1]["text"] += "\n\n" + body
                made[-1]["elements"] += ordinals
            else:
                made.append({"kind": kind, "text": head + body, "section": section or None, "locator": locator, "elements": ordinals})
        out += made
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def text_pieces(text: pd.Series) -> pd.Series:
    return pd.Series([split_text(t or "") for t in text])


# The columns of elements that chunks are made from, and what is held of either before it goes on.
FIELDS = ("ordinal", "kind", "text", "level", "locator", "sheet", "slide", "start_s", "end_s", "rows")
CHUNK = [("ordinal", pa.int32()), *((c, pa.string()) for c in ("kind", "text", "section", "locator")), ("elements", pa.list_(pa.int32()))]
SLICE_ROWS, SLICE_CHARS = 256, 1 << 20


def chunks_in_order(batches: Iterable[pa.RecordBatch], id_col: str) -> Iterator[pa.RecordBatch]:
    """Chunks of elements that come by document and ordinal, in slices: what is held is one document and a slice of chunks."""
    batches = iter(batches)
    first = next(batches, None)
    if first is None:
        return
    kind = pa.schema([(id_col, first.schema.field(id_col).type), *CHUNK])
    elements = (e for b in chain([first], batches) for i in range(0, b.num_rows, SLICE_ROWS) for e in b.slice(i, SLICE_ROWS).to_pylist())
    rows, size = [], 0
    for doc, own in groupby(elements, key=lambda e: e[id_col]):
        for i, c in enumerate(build_chunks(e for e in own if e["ordinal"] is not None)):
            rows.append(c | {id_col: doc, "ordinal": i})
            size += len(c["text"])
            if size >= SLICE_CHARS:
                yield pa.RecordBatch.from_pylist(rows, kind)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, kind)


def chunk(elements: DataFrame, id_col: str = "path") -> DataFrame:
    """Chunks of each document's elements: id, ordinal, kind, text, section, locator, elements. A document's fold is sequential;
    documents are sorted within partitions and streamed through."""
    bounded_batches(elements.sparkSession)
    needed = dict.fromkeys([id_col, *(c for c in FIELDS if c in elements.columns)])
    dealt = elements.select(*needed).repartition(id_col).sortWithinPartitions(id_col, "ordinal")
    kind = elements.schema[id_col].dataType.simpleString()
    return dealt.mapInArrow(lambda batches: chunks_in_order(batches, id_col), f"{id_col} {kind}, ordinal int, kind string, text string, section string, locator string, elements array<int>")
