"""Figures of documents: which of the pictures found on their pages are kept.

Rows are pictures with document, page, sha (of the pixels), width and height (pixels) and a box (x0, y0, x1, y1) on the page.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .documents import largest_figures
from .retrieval import top_k

LEAST_PIXELS, MOST_OVERLAP, MOST_FIGURES, MOST_SIDE = 150, 0.7, 8, 1568
BOX = ("x0", "y0", "x1", "y1")


def area(b: dict[str, Column]) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def overlap_share(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """The part of box a that lies in box b."""
    width = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    height = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((width > 0) & (height > 0) & (area(a) > 0), width * height / area(a)).otherwise(0.0)


def outside_tables(figures: DataFrame, tables: DataFrame, document: str = "doc_id", page: str = "page") -> DataFrame:
    """Figures of which no table of their page covers more than MOST_OVERLAP. Boxes meet only within a page."""
    f, t = figures.alias("f"), tables.alias("t")
    boxes = [{c: F.col(f"{x}.{c}") for c in BOX} for x in ("f", "t")]
    on = (F.col(f"f.{document}") == F.col(f"t.{document}")) & (F.col(f"f.{page}") == F.col(f"t.{page}")) & (overlap_share(*boxes) > MOST_OVERLAP)
    return f.join(t, on, "left_anti")


def not_covered(figures: DataFrame, document: str = "doc_id", page: str = "page") -> DataFrame:
    """Of pictures that lie over each other the larger: taken by falling area (ties by sha), one goes if more than MOST_OVERLAP of it
    lies in one already taken. A page is one group; it holds few pictures."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        boxes = group[list(BOX)].to_numpy(float)
        size = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
        taken: list[int] = []
        for i in sorted(range(len(group)), key=lambda i: (-size[i], group["sha"].iloc[i])):
            inner = [max(0.0, min(boxes[i, 2], boxes[j, 2]) - max(boxes[i, 0], boxes[j, 0])) * max(0.0, min(boxes[i, 3], boxes[j, 3]) - max(boxes[i, 1], boxes[j, 1])) for j in taken]
            if not any(x > MOST_OVERLAP * size[i] for x in inner):
                taken.append(i)
        return group.iloc[taken]

    return figures.groupBy(document, page).applyInPandas(run, figures.schema)


def large_enough(figures: DataFrame) -> DataFrame:
    """Those with a side of LEAST_PIXELS at least: smaller ones are icons or bullets."""
    return figures.where(F.greatest("width", "height") >= LEAST_PIXELS)


def chosen(figures: DataFrame, tables: DataFrame, document: str = "doc_id", page: str = "page", most: int = MOST_FIGURES) -> DataFrame:
    """(document, sha, area, rank): large enough pictures outside tables, the larger of those that overlap, each sha once, the largest first."""
    kept = not_covered(outside_tables(large_enough(figures), tables, document, page), document, page)
    return largest_figures(kept.withColumn("area", F.col("width") * F.col("height")), document, "sha", "area", most)


def collected(pictures: DataFrame, facts: DataFrame, most: int = MOST_FIGURES) -> DataFrame:
    """The figures of files, of `sources.pictures.cut_out` and the pages' facts of `layout.elements`: path, key, locator, sha, area, rank.

    Scanned pages have none: they are read by ocr. Of pictures that lie over each other on a page the larger stays; of equal ones
    in a file the first; the largest come first, `most` of a file.
    """
    scans = facts.where("scanned").select("path", "page")
    seen = large_enough(pictures.where("error IS NULL")).join(scans, ["path", "page"], "left_anti").drop("content")
    apart = not_covered(seen.where("page IS NOT NULL"), "path", "page").unionByName(seen.where("page IS NULL"))
    first = apart.groupBy("path", "sha").agg(F.min(F.struct("place", "key", "locator", (F.col("width") * F.col("height")).alias("area"))).alias("f"))
    return top_k(first.select("path", "f.key", "f.locator", "sha", F.col("f.area").cast("bigint").alias("area"), "f.place"), ["path"], [F.desc("area"), F.asc("place")], most).drop("place")


def shown_size(width: Column, height: Column) -> Column:
    """(width, height) after scaling down so that neither side is over MOST_SIDE."""
    scale = F.least(F.lit(1.0), MOST_SIDE / F.greatest(width, height))
    return F.struct(F.floor(width * scale).cast("int").alias("width"), F.floor(height * scale).cast("int").alias("height"))
