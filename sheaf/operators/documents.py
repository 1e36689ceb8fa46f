"""Elements, evidence and citations of a document store: projections, orders, dedup and lookups over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import top_k


def materialized(elements: DataFrame, document: str = "doc_id", element: str = "ordinal", group: str | None = None) -> DataFrame:
    """Cached elements are numbered within their document; `id` (and `group`, where set) carry the document's id before them."""
    prefixed = lambda c: F.concat_ws(":", F.col(document).cast("string"), F.concat(F.lit("e"), F.col(c).cast("string")))
    out = elements.withColumn("id", prefixed(element))
    return out if group is None else out.withColumn(group, F.when(F.col(group).isNotNull(), F.concat_ws(":", F.col(document).cast("string"), group)))


def sparse_json(table: DataFrame, always: list[str]) -> Column:
    """A row as JSON without null, empty text, empty lists and maps; the columns of `always` stay."""
    fields = []
    for f in table.schema:
        c, kind = F.col(f.name), f.dataType.typeName()
        if f.name not in always:
            filled = F.length(c) > 0 if kind == "string" else F.size(c) > 0 if kind in ("array", "map") else c.isNotNull()
            c = F.when(filled, c)
        fields.append(c.alias(f.name))
    return F.to_json(F.struct(*fields))


def evidence_to_save(elements: DataFrame, text: str = "text", own: str = "meta", more: str = "extra") -> DataFrame:
    """Rows with text that isn't blank; their metadata is `own` overridden by `more`."""
    o, m = F.coalesce(own, F.create_map().cast("map<string,string>")), F.coalesce(more, F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(o, lambda k, _: ~F.map_contains_key(m, k)), m)
    return elements.where(F.trim(F.col(text)) != "").withColumn(own, merged).drop(more)


# Kinds of older stores, as they are called now.
LEGACY_KINDS = {"text": "paragraph", "ocr": "paragraph", "audio": "transcript", "image": "figure", "user": "paragraph", "assistant": "paragraph", "system": "summary"}


def from_evidence(evidence: DataFrame, document: str, kind: str, order: list[str]) -> DataFrame:
    """Stored evidence as elements in reading order: kind in today's words, ordinal from 0 within the document."""
    names = F.create_map(*(F.lit(x) for pair in LEGACY_KINDS.items() for x in pair))
    place = F.row_number().over(Window.partitionBy(document).orderBy(*order)) - 1
    return evidence.withColumn(kind, F.coalesce(names[F.col(kind)], F.col(kind))).withColumn("ordinal", place)


def reading_order(elements: DataFrame, document: str, page: str, slide: str, position: str) -> DataFrame:
    """`place` from 1: by page, else slide, else 0; elements of one page keep their positions' order."""
    where = F.coalesce(page, slide, F.lit(0))
    return elements.withColumn("place", F.row_number().over(Window.partitionBy(document).orderBy(where, position)))


def session_chunks(chunks: DataFrame, documents: DataFrame, key: str, session: str, created: str, ordinal: str) -> DataFrame:
    """Chunks with their document's session, ordered by session, the document's creation, its id and the chunk's number."""
    d = documents.select(key, session, created)
    return chunks.join(d, key).orderBy(session, created, key, ordinal)


def without_failed(ranked: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Ranked rows of documents that didn't fail. The ranking was cut before, so fewer than its k may be left."""
    return ranked.join(failed.select(key).distinct(), key, "left_anti")


def pending_units(wanted: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Units (pages, figures, recordings) that no cache holds yet."""
    return wanted.select(*keys).distinct().join(cached.select(*keys).distinct(), keys, "left_anti")


def without_chunks(evidence: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Documents that have evidence but no chunk."""
    return evidence.select(key).distinct().join(chunks.select(key).distinct(), key, "left_anti")


def latest_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A keyed cache after merging puts in their order: the last row of each key. Rows are compared as one struct, so the maximum is
    taken before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("r")).select(*keys, "r.*")


def packet_blocks(evidence: DataFrame, by: str, number: str, source: str, text: str, page: str | None = None) -> DataFrame:
    """The numbered blocks a model sees, of the few items that a gate let through: by, packet."""
    head = F.concat(F.lit("[EVIDENCE "), F.col(number).cast("string"), F.lit(" | "), F.col(source))
    if page:
        head = F.concat(head, F.coalesce(F.concat(F.lit(", page "), F.col(page).cast("string")), F.lit("")))
    block = F.concat(head, F.lit("]\n"), F.col(text))
    items = F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), block.alias("b"))))
    return evidence.groupBy(by).agg(F.array_join(F.transform(items, lambda x: x["b"]), "\n\n").alias("packet"))


def citation_rows(answers: DataFrame, evidence: DataFrame, by: str, cited: str, number: str) -> DataFrame:
    """The evidence an answer cites, once each, under the numbers the model saw; numbers that aren't there give no row."""
    wanted = answers.select(by, F.explode(F.array_distinct(cited)).alias(number))
    return evidence.join(wanted, [by, number])


def merged_evidence(calls: DataFrame, by: list[str], key: str, order: str) -> DataFrame:
    """Evidence of several retrieval calls, each key once: the last call's values at the first call's position."""
    rest = [c for c in calls.columns if c not in (*by, key, order)]
    g = calls.groupBy(*by, key).agg(F.min(order).alias("position"), F.max(F.struct(order, *rest)).alias("r"))
    return g.select(*by, key, "position", *(F.col("r")[c].alias(c) for c in rest))


def attributed(overlaps: DataFrame, claim: str, number: str, score: str, least: float = 0.6, slack: float = 0.05, most: int = 3) -> DataFrame:
    """Evidence an uncited claim is attributed to: all within `slack` of the best, which must reach `least`; the first `most` by number."""
    best = F.max(score).over(Window.partitionBy(claim))
    near = overlaps.withColumn("_best", best).where((F.col("_best") >= least) & (F.col(score) >= F.col("_best") - slack)).drop("_best")
    return top_k(near, [claim], [F.asc(number)], most)


def best_sources(overlaps: DataFrame, claim: str, number: str, score: str, most: int = 2) -> DataFrame:
    """The sources that share most with a claim, for repairing its citation; of equal ones the higher number."""
    return top_k(overlaps.where(F.col(score) > 0), [claim], [F.desc(score), F.desc(number)], most)


def largest_figures(figures: DataFrame, document: str, sha: str, area: str, most: int = 8) -> DataFrame:
    """Distinct figures of a document, the largest first (ties by digest)."""
    once = figures.groupBy(document, sha).agg(F.max(area).alias(area))
    return top_k(once, [document], [F.desc(area), F.asc(sha)], most)


def page_after(table: DataFrame, key: str, last, size: int = 500) -> DataFrame:
    """The next `size` rows by key after `last`: keyset pagination."""
    return table.where(F.col(key) > F.lit(last)).orderBy(key).limit(size)


def body_size(spans: DataFrame, document: str, size: str, chars: str) -> DataFrame:
    """The font size in which most characters of a document stand (ties: the larger)."""
    per = spans.groupBy(document, size).agg(F.sum(chars).alias("chars"))
    return per.groupBy(document).agg(F.max(F.struct("chars", size)).alias("m")).select(document, F.col("m")[size].alias("body"))


def mean_confidence(words: DataFrame, page: list[str], confidence: str) -> DataFrame:
    """page columns and `confidence`, the mean over a page's words that have one (a zero says that none was told)."""
    return words.groupBy(*page).agg(F.round(F.avg(F.nullif(confidence, F.lit(0.0))), 6).alias("confidence"))


def latest_first(rows: DataFrame, by: str, at: str) -> DataFrame:
    """by, updated_at and n of each group of rows, the one last active first (ties by `by`)."""
    return rows.groupBy(by).agg(F.max(at).alias("updated_at"), F.count("*").alias("n")).orderBy(F.desc("updated_at"), by)


def heading_levels(spans: DataFrame, document: str, size: str, chars: str, ratio: float = 1.15, deepest: int = 4) -> DataFrame:
    """(document, size, level): sizes of at least `ratio` times the body's, the largest is level 1, none is deeper than `deepest`."""
    sizes = spans.select(document, size).distinct().join(body_size(spans, document, size, chars), document).where(F.col(size) >= ratio * F.col("body"))
    level = F.dense_rank().over(Window.partitionBy(document).orderBy(F.desc(size)))
    return sizes.select(document, size, F.least(level, F.lit(deepest)).alias("level"))


def name_overlaps(questions: DataFrame, names: DataFrame, question: str, document: str) -> DataFrame:
    """(question, document, shared): distinct terms (column `term` of both) a question shares with a document's name, where any.

    Joined on the term, so only pairs that share one are made.
    """
    return questions.select(question, "term").distinct().join(names.select(document, "term").distinct(), "term").groupBy(question, document).agg(F.count("*").alias("shared"))


def named_documents(overlaps: DataFrame, sizes: DataFrame, question: str, document: str) -> DataFrame:
    """Documents an overview question means by name: those that share most, if that is two terms, or one term of a name of at most two.

    sizes: (document, n_terms) of the names.
    """
    best = F.max("shared").over(Window.partitionBy(question))
    o = overlaps.join(sizes, document).withColumn("_best", best)
    short = F.max(F.when((F.col("shared") == 1) & (F.col("n_terms") <= 2), 1).otherwise(0)).over(Window.partitionBy(question))
    return o.withColumn("_short", short).where((F.col("shared") == F.col("_best")) & ((F.col("_best") >= 2) | (F.col("_short") == 1))).select(question, document, "shared")


def segments(pages: DataFrame, document: str, page: str, boundary: Column) -> DataFrame:
    """Logical documents in a bundle: `segment` counts the boundaries up to a page."""
    mark = F.when(boundary, 1).otherwise(0)
    return pages.withColumn("segment", F.sum(mark).over(Window.partitionBy(document).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)))


def logical_segments(pages: DataFrame, document: str, page: str, starts: Column) -> DataFrame:
    """Logical documents in a bundle, from 1: `segment` grows at pages that look like a first page (`starts`), but each has two pages
    at least before it may end; pages are numbered from 1 without gaps.

    Of pages in a row that look so, every second one opens a segment, beginning with the first (page 1 always does). So it is
    told by a page's place in its run, and nothing has to be carried from page to page but two counts.
    """
    w = Window.partitionBy(document).orderBy(page)
    looks = F.coalesce(starts, F.lit(False)) | (F.col(page) == 1)
    runs = pages.withColumn("looks__", looks).withColumn("run__", F.col(page) - F.sum(F.when(F.col("looks__"), 1).otherwise(0)).over(w))
    place = F.row_number().over(Window.partitionBy(document, "looks__", "run__").orderBy(page))
    opens = F.when(F.col("looks__") & (place % 2 == 1), 1).otherwise(0)
    return runs.withColumn("opens__", opens).withColumn("segment", F.sum("opens__").over(w)).drop("looks__", "run__", "opens__")


def swept_jobs(jobs: DataFrame, now: Column, status: str, owner: str, until: str, attempts: str, most: int = 3) -> DataFrame:
    """Jobs to take up again: queued ones without an owner and running ones whose lease is over; `action` is retry, or fail from `most` attempts on."""
    free = (F.col(status) == "queued") & F.col(owner).isNull()
    over = (F.col(status) == "running") & (F.col(until) < now)
    return jobs.where(free | over).withColumn("action", F.when(F.col(attempts) >= most, "fail").otherwise("retry"))


def alive(rows: DataFrame, at: str, now: Column, seconds: int) -> DataFrame:
    """Rows not older than `seconds`."""
    return rows.where(F.col(at) >= now - F.make_dt_interval(secs=F.lit(seconds)))


def timed_elements(segments_: DataFrame, document: str, start: str, end: str, text: str, clock: Column) -> DataFrame:
    """Transcript segments as elements: blank ones go, the locator is the clock of the start."""
    return segments_.where(F.trim(F.col(text)) != "").select(document, start, end, F.trim(text).alias("text"), F.lit("transcript").alias("kind"), clock.alias("locator"))
