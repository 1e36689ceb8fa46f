"""Page layout: pieces of text with boxes become lines, blocks in reading order, tables, headings, elements.

Items are rows of `sources.pdf.scan_items`: path, page, seq, what, text, x0, y0, x1, y1 (origin above), size, bold. Every window is
of one page or of a part of one, so all steps share one exchange by page; documents meet only in counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.values import clean_lines

from .documents import heading_levels, logical_segments

PAGE = ["path", "page"]
SCANNED_CHARS, FIGURE_SHARE = 50, 0.05
HEADING_CHARS, BOLD_CHARS, BOLD_WORDS, DEEPEST = 150, 80, 12, 4
JOINT = 3.0  # points between parts of one drawing
MERGED = 2.0  # points between rules that are one
# Fixed value: lines that begin a document of its own.
FIRST_PAGE = r"(?im)^(?:document|agreement|invoice|statement|passport|visa|application|form)\b"


def cut(rows: DataFrame, by: list[str], group: str, low: str, high: str, gap: Column) -> DataFrame:
    """Divides groups where a stripe of at least `gap` is empty: `group` (text) gets the part's number from its low end appended."""
    w = Window.partitionBy(*by, group).orderBy(low)
    reached = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = rows.withColumn("cut__", F.when(F.col(low) - reached >= gap, 1).otherwise(0))
    number = F.sum("cut__").over(Window.partitionBy(*by, group).orderBy(low).rangeBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("part__", F.format_string("%05d.", number)).withColumn(group, F.concat(group, "part__")).drop("cut__", "part__")


def lines(pieces: DataFrame) -> DataFrame:
    """path, page, x0, y0, x1, y1, size, bold, text, unit: pieces of one height that follow closely are a line; unit is the page's usual size.

    A piece belongs to the row of the one before it in height if their middles are less than half a size apart; a row is parted
    where the gap is over one and a half sizes, so that columns stay apart.
    """
    middle = (F.col("y0") + F.col("y1")) / 2
    rows = pieces.withColumn("middle", middle).withColumn("unit", F.expr("percentile(size, 0.5)").over(Window.partitionBy(*PAGE)))
    down = Window.partitionBy(*PAGE).orderBy("middle", "x0", "seq")
    far = F.col("middle") - F.lag("middle").over(down) > 0.5 * F.least("size", F.lag("size").over(down))
    rows = rows.withColumn("far", F.when(far, 1).otherwise(0)).withColumn("row", F.sum("far").over(down))
    along = Window.partitionBy(*PAGE, "row").orderBy("x0", "seq")
    gap = F.col("x0") - F.max("x1").over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("gap", gap).withColumn("wide", F.when(F.col("gap") > 1.5 * F.col("size"), 1).otherwise(0)).withColumn("part", F.sum("wide").over(along))
    lead = F.when(F.col("gap") > 0.15 * F.col("size"), " ").otherwise("")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "seq", F.concat(lead, "text").alias("t")))), lambda x: x["t"]), "")  # of one line's pieces
    return rows.groupBy(*PAGE, "row", "part").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("size").alias("size"), F.bool_and("bold").alias("bold"), F.trim(said).alias("text"), F.first("unit").alias("unit"),
    ).drop("row", "part")


def blocks(rows: DataFrame) -> DataFrame:
    """path, page, place (sorts by reading order), x0, y0, x1, y1, size, bold, text of blocks of lines, by cutting a page crosswise:
    into bands at wide gaps, these into columns, and so on with narrower gaps down to paragraphs; then where size or weight change."""
    unit = F.col("unit")
    r = rows.withColumn("place", F.lit(""))
    for low, high, share in (("y0", "y1", 3.0), ("x0", "x1", 1.0), ("y0", "y1", 1.6), ("x0", "x1", 1.0), ("y0", "y1", 0.6), ("x0", "x1", 1.0), ("y0", "y1", 0.6)):
        r = cut(r, PAGE, "place", low, high, share * unit)
    w = Window.partitionBy(*PAGE, "place").orderBy("y0", "x0")
    other = (F.abs(F.col("size") - F.lag("size").over(w)) > 0.1 * unit) | (F.col("bold") != F.lag("bold").over(w))
    r = r.withColumn("other", F.when(other, 1).otherwise(0)).withColumn("style", F.sum("other").over(w))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda x: x["text"]), "\n")  # of one block's lines
    out = r.groupBy(*PAGE, F.concat("place", F.format_string("%05d", "style")).alias("place")).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("size").alias("size"), F.bool_and("bold").alias("bold"), clean_lines(said).alias("text"),
    )
    return out.where("text <> ''")


def merged(values: Column) -> Column:
    """Sorted numbers without those that follow another too closely."""
    s = F.array_sort(values)
    return F.filter(s, lambda x, i: (i == 0) | (x - F.get(s, i - 1) > MERGED))


def grids(items: DataFrame) -> DataFrame:
    """path, page, grid, xs, ys: places of the rules of drawings that part a box into two columns and two rows at least."""
    r = items.where("what = 'drawing'").withColumn("grid", F.lit(""))
    for low, high in (("y0", "y1"), ("x0", "x1")) * 2:
        r = cut(r, PAGE, "grid", low, high, F.lit(JOINT))
    sides = lambda a, b: F.when(F.col(b) - F.col(a) <= MERGED, F.array((F.col(a) + F.col(b)) / 2)).otherwise(F.array(a, b))
    across, down = F.col("x1") - F.col("x0") > MERGED, F.col("y1") - F.col("y0") > MERGED
    edges = r.withColumns({"xs": F.when(down, sides("x0", "x1")), "ys": F.when(across, sides("y0", "y1"))})
    g = edges.groupBy(*PAGE, "grid").agg(*(merged(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("xs", "ys")))  # of one drawing's rules
    return g.where((F.size("xs") >= 3) & (F.size("ys") >= 3))


def tables(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, page, grid, x0, y0, x1, y1, rows) of ruled tables with text in two rows and two columns at least, and the pieces of text in none."""
    text = items.where("what = 'text'").withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})
    inside = (F.col("cx") >= F.element_at("xs", 1)) & (F.col("cx") <= F.element_at("xs", -1)) & (F.col("cy") >= F.element_at("ys", 1)) & (F.col("cy") <= F.element_at("ys", -1))
    g = grids(items)
    met = text.join(g, PAGE).where(inside)
    cell = lambda at, c: F.size(F.filter(at, lambda x: x <= F.col(c)))
    met = met.withColumns({"column": F.least(cell("xs", "cx"), F.size("xs") - 1), "row": F.least(cell("ys", "cy"), F.size("ys") - 1)})
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.round("cy", 0).alias("y"), "x0", "seq", "text"))), lambda x: F.trim(x["text"])), " ")  # of one cell's pieces
    cells = met.groupBy(*PAGE, "grid", "xs", "ys", "row", "column").agg(clean_lines(said).alias("text"))
    by_place = F.map_from_entries(F.collect_list(F.struct(F.struct("row", "column").alias("at"), "text")))  # of one table's cells
    whole = cells.where("text <> ''").groupBy(*PAGE, "grid", "xs", "ys").agg(by_place.alias("cells"), F.array_sort(F.collect_set("row")).alias("filled"), F.max("column").alias("width"))
    rows = F.transform("filled", lambda r: F.transform(F.sequence(F.lit(1), F.col("width")), lambda c: F.coalesce(F.element_at("cells", F.struct(r.alias("row"), c.alias("column"))), F.lit(""))))
    made = whole.where((F.size("filled") >= 2) & (F.col("width") >= 2)).select(
        *PAGE, "grid", F.element_at("xs", 1).alias("x0"), F.element_at("ys", 1).alias("y0"), F.element_at("xs", -1).alias("x1"), F.element_at("ys", -1).alias("y1"), rows.alias("rows"),
    )
    found = made.select(*PAGE, *(F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")))
    within = [text[c] == found[c] for c in PAGE] + [text["cx"].between(found["t_x0"], found["t_x1"]), text["cy"].between(found["t_y0"], found["t_y1"])]
    return made, text.join(found, within, "left_anti").drop("cx", "cy")


def rendered(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")


def leveled(parts: DataFrame) -> DataFrame:
    """Blocks with `level`: of short ones without a closing mark, sizes well over the body's by rank, bold ones of the body's size the deepest."""
    own = parts.withColumn("chars", F.length("text"))
    sizes = heading_levels(own, "path", "size", "chars", deepest=DEEPEST)
    body = own.groupBy("path", "size").agg(F.sum("chars").alias("chars")).groupBy("path").agg(F.max(F.struct("chars", "size"))["size"].alias("body"))
    both = own.join(body, "path").join(sizes.withColumnRenamed("level", "by_size"), ["path", "size"], "left")
    short = (F.col("chars") <= HEADING_CHARS) & ~F.col("text").rlike(r"[.,;]$")
    bold = F.col("bold") & (F.col("size") >= F.col("body")) & (F.col("chars") <= BOLD_CHARS) & (F.size(F.split("text", " ")) <= BOLD_WORDS)
    return both.withColumn("level", F.when(short, F.coalesce("by_size", F.when(bold, F.lit(DEEPEST))))).drop("by_size", "body", "chars")


def page_facts(items: DataFrame, parts: DataFrame, found: DataFrame) -> DataFrame:
    """path, page, text, chars, figures, scanned, segment of every page; scanned ones have hardly any text but a picture of some size."""
    sheet = items.where("what = 'page'").select(*PAGE, ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))
    pictures = items.where("what = 'picture'").select(*PAGE, ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("covered"))
    figures = pictures.join(sheet, PAGE).where(F.col("covered") >= FIGURE_SHARE * F.col("area")).groupBy(*PAGE).agg(F.count("*").alias("figures"))
    said = parts.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " ").alias("text"), F.sum(F.length("text")).alias("of_text"))  # of one page's blocks
    ruled = found.groupBy(*PAGE).agg(F.sum(F.length(rendered(F.col("rows")))).alias("of_tables"))
    f = sheet.join(figures, PAGE, "left").join(said, PAGE, "left").join(ruled, PAGE, "left")
    zero = F.lit(0).cast("bigint")
    f = f.select(*PAGE, F.coalesce("text", F.lit("")).alias("text"), (F.coalesce("of_text", zero) + F.coalesce("of_tables", zero)).alias("chars"), F.coalesce("figures", zero).alias("figures"))
    f = f.withColumn("scanned", (F.col("chars") < SCANNED_CHARS) & (F.col("figures") > 0))
    return logical_segments(f, "path", "page", F.col("text").rlike(FIRST_PAGE))


def elements(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, ordinal, id, kind, text, level, page, locator, x0, y0, x1, y1, rows, group) of headings, paragraphs and tables, and the pages' facts.

    On each page blocks come in reading order, then its tables; `id` counts them by page, `ordinal` through the document;
    `group` names the logical document. Rows with an error have neither; an empty table gives no elements.
    """
    good = items.where("error IS NULL")
    found, free = tables(good)
    parts = blocks(lines(free))
    facts = page_facts(good, parts, found)
    box = ["x0", "y0", "x1", "y1"]
    none = F.lit(None)
    said = leveled(parts).select(*PAGE, F.concat(F.lit("0"), "place").alias("place"), F.when(F.col("level").isNull(), "paragraph").otherwise("heading").alias("kind"), "text", "level", *box, none.cast("array<array<string>>").alias("rows"))
    ruled = found.select(*PAGE, F.concat(F.lit("1"), "grid").alias("place"), F.lit("table").alias("kind"), rendered(F.col("rows")).alias("text"), none.cast("int").alias("level"), *box, "rows")
    every = said.unionByName(ruled).join(facts.select(*PAGE, "segment"), PAGE)
    on_page = F.row_number().over(Window.partitionBy(*PAGE).orderBy("place")) - 1
    before = facts.select("path", "page")  # ordinals: the elements of earlier pages are counted, not gathered
    counts = every.groupBy(*PAGE).agg(F.count("*").alias("n"))
    first = before.join(counts, PAGE, "left").select(*PAGE, F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    numbered = every.withColumn("position", on_page).join(first, PAGE)
    out = numbered.select(
        "path", (F.col("first") + F.col("position")).cast("int").alias("ordinal"), F.format_string("p%d:e%d", "page", "position").alias("id"), "kind", "text", "level", "page",
        F.format_string("page %d", "page").alias("locator"), *box, "rows", F.format_string("logical:%d", "segment").alias("group"),
    )
    return out, facts


def summary(items: DataFrame, facts: DataFrame, found: DataFrame) -> DataFrame:
    """path, pages, ocr_pages, figure_pages, tables, logical_documents of each document."""
    t = found.where("kind = 'table'").groupBy("path").agg(F.count("*").alias("tables"))
    listed = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.col("page"))))  # noqa: E731  page numbers of one document
    g = facts.groupBy("path").agg(F.count("*").alias("pages"), listed(F.col("scanned")).alias("ocr_pages"), listed(F.col("figures") > 0).alias("figure_pages"), F.max("segment").alias("logical_documents"))
    return g.join(t, "path", "left").withColumn("tables", F.coalesce("tables", F.lit(0)))
