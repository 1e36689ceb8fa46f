"""Named queries over a document store: elements, evidence, citations, jobs and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sheaf.functions import text as T
from sheaf.functions import values as V
from sheaf.operators import detect, dialogue, documents, evaluation, figures, layout, lifecycle
from sheaf.session import table
from sheaf.sources import tablestore

from .retrieval import query

LINES = "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ordinal, line FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE line <> ''"


def line_elements(spark, sf_dir):
    return lifecycle.lines(table(spark, sf_dir, "documents"))


@query(f"SELECT doc_id || ':e' || ordinal AS id, length(line)::BIGINT AS n_chars FROM ({LINES})")
def materialized_elements(spark, sf_dir):
    return documents.materialized(line_elements(spark, sf_dir)).select("id", F.length("line").cast("long").alias("n_chars"))


@query("""SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || CASE WHEN o_custkey % 3 <> 0 THEN ',"page":' || o_custkey % 3 ELSE '' END || CASE WHEN o_orderstatus <> 'F' THEN ',"kind":"' || o_orderstatus || '"' ELSE '' END || '}' AS json FROM orders""")
def sparse_projection(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    o = o.select("o_orderkey", F.nullif(F.col("o_custkey") % 3, F.lit(0)).alias("page"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).otherwise("").alias("kind"), F.array().cast("array<int>").alias("boxes"))
    return o.select("o_orderkey", documents.sparse_json(o, ["o_orderkey"]).alias("json"))


@query("SELECT conv_id, turn, 'lang=' || CASE WHEN turn % 2 = 0 THEN 'late' ELSE 'early' END || ',role=' || role AS meta FROM conversations WHERE trim(text) <> ''")
def evidence_with_metadata(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    c = c.withColumn("meta", F.create_map(F.lit("lang"), F.lit("early"), F.lit("role"), F.col("role"))).withColumn("extra", F.when(F.col("turn") % 2 == 0, F.create_map(F.lit("lang"), F.lit("late"))))
    entries = F.array_sort(F.transform(F.map_entries("meta"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return documents.evidence_to_save(c).select("conv_id", "turn", F.array_join(entries, ",").alias("meta"))


@query("SELECT conv_id, turn, CASE role WHEN 'system' THEN 'summary' ELSE 'paragraph' END AS kind, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal FROM conversations")
def elements_from_evidence(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumnRenamed("role", "kind")
    return documents.from_evidence(c, "conv_id", "kind", ["turn"]).select("conv_id", "turn", "kind", F.col("ordinal").cast("long"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(nullif(l_linenumber % 3, 0), nullif(l_suppkey % 4, 0), 0), l_linenumber, l_partkey) AS place FROM lineitem")
def reading_order_of_items(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("page", F.nullif(F.col("l_linenumber") % 3, F.lit(0))).withColumn("slide", F.nullif(F.col("l_suppkey") % 4, F.lit(0))).withColumn("position", F.struct("l_linenumber", "l_partkey"))
    return documents.reading_order(li, "l_orderkey", "page", "slide", "position").select("l_orderkey", "l_linenumber", "l_partkey", F.col("place").cast("long"))


@query(f"SELECT l.doc_id, source, ordinal, length(line)::BIGINT AS n FROM ({LINES}) l JOIN documents d USING (doc_id)")
def session_chunks_in_order(spark, sf_dir):
    r = documents.session_chunks(line_elements(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id", "source", "n_chars", "ordinal")
    return r.select("doc_id", "source", F.col("ordinal").cast("long"), F.length("line").cast("long").alias("n"))


LONGEST = "SELECT source, doc_id, n_chars, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 8"


def longest(spark, sf_dir):
    from sheaf.operators.retrieval import top_k

    return top_k(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", "text"), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 8)


@query(f"SELECT source, doc_id, rank FROM ({LONGEST}) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def topk_without_failed(spark, sf_dir):
    failed = table(spark, sf_dir, "labels").where("quality = 0")
    return documents.without_failed(longest(spark, sf_dir), failed, "doc_id").select("source", "doc_id", F.col("rank").cast("long"))


@query(f"SELECT source, sha256(string_agg('[EVIDENCE ' || rank || ' | doc' || doc_id || CASE WHEN doc_id % 2 = 1 THEN ', page ' || doc_id % 7 ELSE '' END || ']' || chr(10) || left(text, 200), chr(10) || chr(10) ORDER BY rank)) AS packet FROM ({LONGEST}) GROUP BY source")
def evidence_packets(spark, sf_dir):
    e = longest(spark, sf_dir).withColumn("name", F.concat(F.lit("doc"), "doc_id")).withColumn("head", F.left("text", F.lit(200))).withColumn("page", F.when(F.col("doc_id") % 2 == 1, F.col("doc_id") % 7))
    return documents.packet_blocks(e, "source", "rank", "name", "head", "page").select("source", F.sha2("packet", 256).alias("packet"))


@query(f"SELECT source, rank AS evidence_id, doc_id FROM ({LONGEST}) WHERE rank IN (2, 5, length(source) % 8 + 1)")
def citations_of_answers(spark, sf_dir):
    e = longest(spark, sf_dir)
    answer = F.concat(F.lit("As told [EVIDENCE 5] and (EVIDENCE 2, EVIDENCE 5 | page 3), also 【evidence "), (F.length("source") % 8 + 1).cast("string"), F.lit("】 and [EVIDENCE 99]."))
    answers = e.select("source").distinct().select("source", dialogue.citation_ids(answer).alias("cited"))
    return documents.citation_rows(answers, e, "source", "cited", "rank").select("source", F.col("rank").cast("long").alias("evidence_id"), "doc_id")


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem c WHERE c.l_returnflag = 'R' AND c.l_orderkey = l.l_orderkey AND c.l_linenumber = l.l_linenumber)")
def pending_units(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return documents.pending_units(li, li.where("l_returnflag = 'R'"), ["l_orderkey", "l_linenumber"])


@query(f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM ({LINES}) WHERE length(line) >= 60)")
def documents_without_chunks(spark, sf_dir):
    chunks = line_elements(spark, sf_dir).where("length(line) >= 60")
    return documents.without_chunks(table(spark, sf_dir, "documents").where("text is not null"), chunks, "doc_id")


@query("SELECT user_id, event_type, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY ALL")
def unit_cache_merged(spark, sf_dir):
    return documents.latest_by_key(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT user_id, event_type, min(event_id) AS position, max_by(value, event_id) AS value FROM events GROUP BY ALL")
def evidence_merged_over_calls(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return documents.merged_evidence(e, ["user_id"], "event_type", "event_id")


OVERLAP = f"""
WITH q AS (SELECT item_id, unnest(list_distinct({T.sql_terms('text')})) AS term FROM benchmark),
n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id),
d AS (SELECT doc_id, unnest(list_distinct({T.sql_terms('text')})) AS term FROM documents),
o AS (SELECT item_id, doc_id, count(*) / any_value(n) AS score FROM q JOIN d USING (term) JOIN n USING (item_id) GROUP BY item_id, doc_id)"""


def overlaps(spark, sf_dir):
    """(item_id, doc_id, score): the share of a claim's terms that a document has, of those that share one."""
    from sheaf.operators.retrieval import term_rows

    q = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(T.content_terms(F.col("text")))).alias("term"))
    n = q.groupBy("item_id").agg(F.count("*").alias("n"))
    d = term_rows(table(spark, sf_dir, "documents"), "doc_id", "text").distinct()
    both = d.join(F.broadcast(q) if q.count() <= 500_000 else q, "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("m")).join(n, "item_id")
    return both.select("item_id", "doc_id", (F.col("m") / F.col("n")).alias("score"))


@query(OVERLAP + " SELECT item_id, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS place FROM (SELECT *, max(score) OVER (PARTITION BY item_id) AS best FROM o) WHERE best >= 0.6 AND score >= best - 0.05) WHERE place <= 3")
def claim_attribution(spark, sf_dir):
    return documents.attributed(overlaps(spark, sf_dir), "item_id", "doc_id", "score").select("item_id", "doc_id", F.col("rank").cast("long").alias("place"))


@query(OVERLAP + " SELECT item_id, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) AS place FROM o) WHERE place <= 2")
def claim_best_sources(spark, sf_dir):
    return documents.best_sources(overlaps(spark, sf_dir), "item_id", "doc_id", "score").select("item_id", "doc_id", F.col("rank").cast("long").alias("place"))


@query("SELECT host, sha, area, row_number() OVER (PARTITION BY host ORDER BY area DESC, sha) AS place FROM (SELECT split_part(url, '/', 3) AS host, sha256(html) AS sha, max(length(html))::BIGINT AS area FROM pages GROUP BY ALL) QUALIFY place <= 8")
def largest_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.get(F.split("url", "/"), F.lit(2)).alias("host"), F.sha2("html", 256).alias("sha"), F.length("html").cast("long").alias("area"))
    return documents.largest_figures(p, "host", "sha", "area").select("host", "sha", "area", F.col("rank").cast("long").alias("place"))


BOXES = "SELECT l_orderkey AS doc_id, l_linenumber % 3 AS page, l_partkey AS sha, l_partkey % 100 AS x0, l_suppkey AS y0, l_partkey % 100 + l_quantity AS x1, l_suppkey + 10 + l_linenumber AS y1, l_returnflag AS kind FROM lineitem"


def boxes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("page"), F.col("l_partkey").alias("sha"), (F.col("l_partkey") % 100).alias("x0"), F.col("l_suppkey").alias("y0"), (F.col("l_partkey") % 100 + F.col("l_quantity")).alias("x1"), (F.col("l_suppkey") + 10 + F.col("l_linenumber")).alias("y1"), F.col("l_returnflag").alias("kind"))


@query(f"""
WITH b AS ({BOXES})
SELECT doc_id, page, sha FROM b f WHERE kind <> 'R' AND NOT EXISTS (SELECT 1 FROM b t WHERE t.kind = 'R' AND t.doc_id = f.doc_id AND t.page = f.page
AND greatest(0, least(f.x1, t.x1) - greatest(f.x0, t.x0)) * greatest(0, least(f.y1, t.y1) - greatest(f.y0, t.y0)) > 0.7 * (f.x1 - f.x0) * (f.y1 - f.y0))""")
def figures_outside_tables(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return figures.outside_tables(b.where("kind <> 'R'"), b.where("kind = 'R'")).select("doc_id", "page", "sha")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 500")
def keyset_page(spark, sf_dir):
    return documents.page_after(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100)


@query("SELECT user_id, max(ts) AS updated_at, count(*) AS n FROM events GROUP BY user_id")
def sessions_latest_first(spark, sf_dir):
    return documents.latest_first(table(spark, sf_dir, "events"), "user_id", "ts")


SPANS = "SELECT l_orderkey, (l_quantity / 5)::BIGINT + 8 AS size, l_partkey AS chars FROM lineitem"
BODY = f"SELECT l_orderkey, arg_max(size, (chars, size)) AS body FROM (SELECT l_orderkey, size, sum(chars)::BIGINT AS chars FROM ({SPANS}) GROUP BY ALL) GROUP BY l_orderkey"


def spans(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", (F.bround(F.col("l_quantity") / 5, 0).cast("long") + 8).alias("size"), F.col("l_partkey").alias("chars"))


@query(BODY)
def body_font_sizes(spark, sf_dir):
    return documents.body_size(spans(spark, sf_dir), "l_orderkey", "size", "chars")


@query(f"SELECT l_orderkey, size, least(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY size DESC), 4) AS level FROM (SELECT DISTINCT l_orderkey, size FROM ({SPANS})) JOIN ({BODY}) USING (l_orderkey) WHERE size >= 1.15::DOUBLE * body")
def heading_levels_by_font(spark, sf_dir):
    return documents.heading_levels(spans(spark, sf_dir), "l_orderkey", "size", "chars").select("l_orderkey", "size", F.col("level").cast("long"))


NAMES = f"SELECT DISTINCT lang || '_' || source AS name, list_distinct({T.sql_terms("lang || ' ' || source || ' ' || left(text, 0) || 'report words'")}) AS t FROM documents"


@query(f"""
WITH q AS (SELECT conv_id, turn, list_distinct({T.sql_terms("text || CASE conv_id % 3 WHEN 0 THEN ' report src1' WHEN 1 THEN ' words' ELSE '' END")}) AS t FROM conversations WHERE role = 'user'),
n AS ({NAMES})
SELECT conv_id, turn, name, len(list_intersect(q.t, n.t)) AS shared FROM q, n WHERE shared > 0""")
def overview_name_overlap(spark, sf_dir):
    q, n = name_terms(spark, sf_dir)
    return documents.name_overlaps(q, n, "id", "name").select("id.conv_id", "id.turn", "name", "shared")


def name_terms(spark, sf_dir):
    more = F.when(F.col("conv_id") % 3 == 0, " report src1").when(F.col("conv_id") % 3 == 1, " words").otherwise("")
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.struct("conv_id", "turn").alias("id"), F.explode(T.content_terms(F.concat("text", more))).alias("term"))
    d = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    return q, d.select(F.concat_ws("_", "lang", "source").alias("name"), F.explode(T.content_terms(F.concat_ws(" ", "lang", "source", F.lit("report words")))).alias("term"))


@query(f"""
WITH q AS (SELECT conv_id, turn, list_distinct({T.sql_terms("text || CASE conv_id % 3 WHEN 0 THEN ' report src1' WHEN 1 THEN ' words' ELSE '' END")}) AS t FROM conversations WHERE role = 'user'),
n AS ({NAMES}),
o AS (SELECT conv_id, turn, name, len(list_intersect(q.t, n.t)) AS shared, len(n.t) AS n_terms FROM q, n WHERE shared > 0),
b AS (SELECT *, max(shared) OVER w AS best, max(CASE WHEN shared = 1 AND n_terms <= 2 THEN 1 ELSE 0 END) OVER w AS short FROM o WINDOW w AS (PARTITION BY conv_id, turn))
SELECT conv_id, turn, name, shared FROM b WHERE shared = best AND (best >= 2 OR short = 1)""")
def overview_named_documents(spark, sf_dir):
    q, n = name_terms(spark, sf_dir)
    sizes = n.distinct().groupBy("name").agg(F.count("*").alias("n_terms"))
    return documents.named_documents(documents.name_overlaps(q, n, "id", "name"), sizes, "id", "name").select("id.conv_id", "id.turn", "name", "shared")


@query("SELECT l_orderkey, round(avg(nullif(l_discount, 0)), 6) AS confidence FROM lineitem GROUP BY l_orderkey")
def mean_confidence(spark, sf_dir):
    return documents.mean_confidence(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_discount")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 >= 3 THEN 'fail' ELSE 'retry' END AS action FROM orders WHERE (o_orderstatus = 'O' AND o_custkey % 2 = 0) OR (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01')")
def swept_jobs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "running").otherwise("done").alias("status"), F.when(F.col("o_custkey") % 2 == 1, F.col("o_custkey")).alias("owner"), "o_orderdate", (F.col("o_custkey") % 5).alias("attempts"))
    return documents.swept_jobs(o, F.lit("1996-01-01").cast("timestamp_ntz"), "status", "owner", "o_orderdate", "attempts").select("o_orderkey", "action")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY")
def tokens_not_expired(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("m")).first().m
    return documents.alive(e, "ts", F.lit(now).cast("timestamp_ntz"), 5 * 86400).select("event_id")


FIRST_LINE = """CASE WHEN l_returnflag = 'R' THEN 'Invoice ' WHEN l_suppkey % 3 = 0 THEN 'application for ' ELSE 'continued, ' END || l_partkey"""


@query(rf"""
WITH RECURSIVE p AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS page, regexp_matches({FIRST_LINE}, '(?i)^(document|agreement|invoice|statement|passport|visa|application|form)\b') AS looks FROM lineitem),
r AS (SELECT l_orderkey, page, 1 AS segment, 1 AS held FROM p WHERE page = 1
UNION ALL SELECT p.l_orderkey, p.page, CASE WHEN p.looks AND r.held > 1 THEN r.segment + 1 ELSE r.segment END, CASE WHEN p.looks AND r.held > 1 THEN 1 ELSE r.held + 1 END FROM r JOIN p ON p.l_orderkey = r.l_orderkey AND p.page = r.page + 1)
SELECT l_orderkey, page::BIGINT AS page, segment::BIGINT AS segment FROM r""")
def bundle_segments(spark, sf_dir):
    """Orders as bundles: a line is a page; where its text begins like a first page a logical document may begin."""
    page = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    pages = table(spark, sf_dir, "lineitem").select("l_orderkey", page.alias("page"), F.expr(FIRST_LINE).alias("text"))
    found = documents.logical_segments(pages, "l_orderkey", "page", F.col("text").rlike(layout.FIRST_PAGE))
    return found.select("l_orderkey", F.col("page").cast("long"), F.col("segment").cast("long"))


@query("SELECT conv_id, turn, sum(CASE WHEN role = 'system' OR turn % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM conversations")
def logical_segments(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return documents.segments(c, "conv_id", "turn", (F.col("role") == "system") | (F.col("turn") % 3 == 0)).select("conv_id", "turn", F.col("segment").cast("long"))


@query("""SELECT conv_id, turn * 7.5::DOUBLE AS start_s, trim(text) AS text, CASE WHEN s < 3600 THEN printf('%02d:%02d', s // 60, s % 60) ELSE printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) END AS locator
FROM (SELECT *, floor(turn * 7.5 + conv_id * 40)::BIGINT AS s FROM conversations) WHERE trim(text) <> ''""")
def transcript_elements(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("start_s", F.col("turn") * 7.5).withColumn("end_s", F.col("turn") * 7.5 + 7)
    r = documents.timed_elements(c, "conv_id", "start_s", "end_s", "text", T.format_clock(F.col("turn") * 7.5 + F.col("conv_id") * 40))
    return r.select("conv_id", "start_s", "text", "locator")


@query("""
WITH m AS (SELECT lang, avg(quality) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY lang), b AS (SELECT avg(quality) AS rate FROM labels)
SELECT lang, round(m.rate, 4) AS rate FROM m, b WHERE m.rate < b.rate - 0.02""")
def baseline_regressions(spark, sf_dir):
    from sheaf.operators import evaluation

    l = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    overall = l.agg(F.avg("quality").alias("value"))
    new = l.groupBy(F.col("lang").alias("metric")).agg(F.avg("quality").alias("value"))
    old = new.select("metric").crossJoin(F.broadcast(overall))  # one counted row
    return evaluation.regressions(new, old).select(F.col("metric").alias("lang"), F.round("value", 4).alias("rate"))


# ---- scalar functions ---------------------------------------------------------------------------

SAME = "(a = b OR (least(length(a), length(b)) >= 4 AND left(a, least(length(a), length(b))) = left(b, least(length(a), length(b)))) OR (c >= 5 AND c >= 0.7 * least(length(a), length(b))))"


@query(f"""
WITH w AS (SELECT DISTINCT unnest({T.sql_terms("p_name || ' ' || p_type")}) AS a FROM part UNION SELECT DISTINCT unnest({T.sql_terms('c_mktsegment')}) FROM customer UNION SELECT lower(n_name) FROM nation UNION SELECT lower(n_name) || 'ing' FROM nation),
p AS (SELECT x.a, y.a AS b, len(list_filter(range(1, least(length(x.a), length(y.a)) + 1), lambda i: left(x.a, i) = left(y.a, i))) AS c FROM w x, w y)
SELECT a, b FROM p WHERE {SAME}""")
def same_terms(spark, sf_dir):
    """Names that are the same term, among those of a catalog."""
    words = lambda t, c: table(spark, sf_dir, t).select(F.explode(T.content_terms(c)).alias("a"))
    n = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("a"))
    w = words("part", F.concat_ws(" ", "p_name", "p_type")).union(words("customer", F.col("c_mktsegment"))).union(n).union(n.select(F.concat("a", F.lit("ing")))).distinct()
    return w.withColumn("k", V.term_key(F.col("a"))).join(w.select(F.col("a").alias("b"), V.term_key(F.col("a")).alias("k")), "k").where(V.same_term(F.col("a"), F.col("b"))).select("a", "b")


@query(f"SELECT p_partkey, array_to_string({T.sql_terms(r"regexp_replace(regexp_replace(p_brand || '_' || p_type || 'OfNumber7', '[_\s\-./]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')")}, ' ') AS words FROM part")
def header_words(spark, sf_dir):
    name = F.concat("p_brand", F.lit("_"), "p_type", F.lit("OfNumber7"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(V.header_words(name), " ").alias("words"))


@query("""
WITH v AS (SELECT o_orderkey, o_totalprice / CASE WHEN o_orderkey % 2 = 0 THEN 100 ELSE 1 END AS v FROM orders)
SELECT o_orderkey, CASE WHEN v = floor(v) THEN CASE WHEN abs(v) >= 10000 THEN format('{:,}', v::BIGINT) ELSE v::BIGINT::VARCHAR END ELSE regexp_replace(regexp_replace(CASE WHEN abs(v) >= 10000 THEN format('{:,.4f}', v) ELSE format('{:.4f}', v) END, '0+$', ''), '\\.$', '') END AS shown FROM v""")
def formatted_values(spark, sf_dir):
    v = F.col("o_totalprice") / F.when(F.col("o_orderkey") % 2 == 0, 100).otherwise(1)
    return table(spark, sf_dir, "orders").select("o_orderkey", V.format_value(v).alias("shown"))


@query("SELECT s, CASE WHEN s < 90 THEN s || 's' WHEN s < 5400 THEN round_even(s / 60, 0)::BIGINT || ' min' ELSE format('{:.1f} h', s / 3600) END AS wait FROM (SELECT DISTINCT o_custkey * 7 AS s FROM orders)")
def formatted_waits(spark, sf_dir):
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") * 7).alias("s")).distinct().select("s", V.format_wait(F.col("s").cast("double")).alias("wait"))


@query(r"SELECT conv_id, turn, sha256(lower(regexp_replace(text, '[\s,]', '', 'g'))) AS form, contains(lower(regexp_replace(text, '[\s,]', '', 'g')), 'theof') AND contains(lower(regexp_replace(text, '[\s,]', '', 'g')), 'and') AS both FROM conversations")
def compared_forms(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(V.compared(t), 256).alias("form"), V.contains_all(t, F.array(F.lit("The of"), F.lit("AND"))).alias("both"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(replace(text, ' und', '-' || chr(10) || 'und') || chr(173), chr(173), '', 'g'), '-\n([\p{L}\p{N}_])', '\1', 'g'), '\s+', ' ', 'g'))) AS clean FROM documents")
def cleaned_lines(spark, sf_dir):
    t = F.concat(F.replace("text", F.lit(" und"), F.lit("-\nund")), F.lit("­"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(V.clean_lines(t), 256).alias("clean"))


@query("SELECT vec_id, list_max(embedding) >= 0.35::FLOAT AS ok FROM embeddings")
def sufficient_scores(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", V.sufficient(F.col("embedding"), F.lit(0.35).cast("float")).alias("ok"))


@query("SELECT item_id, item_id % 5 + 1 <= 3 AS ok, '2,' || item_id % 5 + 1 AS cited FROM benchmark")
def citations_that_exist(spark, sf_dir):
    answer = F.concat("text", F.lit(" [EVIDENCE 2] and again (EVIDENCE 2, EVIDENCE "), (F.col("item_id") % 5 + 1).cast("string"), F.lit(" | page 4)"))
    c = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(dialogue.citation_ids(answer)).alias("c"))
    return c.select("item_id", V.refs_exist(F.col("c"), F.lit(3)).alias("ok"), F.array_join(F.transform(F.concat(F.array(F.lit(2)), F.array(F.element_at("c", -1))), lambda x: x.cast("string")), ",").alias("cited"))


@query("SELECT page_id, octet_length(encode(html)) / 16000 AS seconds FROM pages")
def estimated_durations(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", V.recording_seconds(F.col("html").cast("binary")).alias("seconds"))


@query()
def vector_point_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", V.point_id(F.concat_ws(":", "source", "doc_id")).alias("point_id"))


@query()
def clean_file_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", V.clean_filename(F.col("url")).alias("name"))


@query(f"SELECT conv_id, turn, {dialogue.sql_route('text')} AS route FROM conversations UNION ALL SELECT item_id, -1, {dialogue.sql_route('text')} FROM benchmark UNION ALL SELECT c_custkey, -2, {dialogue.sql_route(dialogue.SQL_SMALL_TALK)} FROM customer")
def route_rules(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "text")
    b = table(spark, sf_dir, "benchmark").select("item_id", F.lit(-1).cast("long"), "text")
    s = table(spark, sf_dir, "customer").select("c_custkey", F.lit(-2).cast("long"), dialogue.small_talk(F.col("c_custkey")))
    rows = c.union(b).union(s)
    return rows.select("conv_id", "turn", dialogue.route(F.col("text")).alias("route"))


# ---- questions about tables ---------------------------------------------------------------------

ASKED = (
    "What is the total o_totalprice by o_orderstatus?", "Which priority has the most orders?", "list all orders where custkey is over 70", "Who wrote the contract?",
    "How many building customers are there?", "lowest account balance per market segment", "at least 3 rows please", "show the machinery segment between 5 and 9", "कुल कितने ऑर्डर हैं?", "the best and worst orders", "Tell me about urgent things",
)
COLUMNS = [
    ("orders", "orders.csv", None, "o_totalprice", "o_totalprice", "number", None), ("orders", "orders.csv", None, "o_orderstatus", "o_orderstatus", "text", ["F", "O", "P"]),
    ("orders", "orders.csv", None, "o_orderpriority", "o_orderpriority", "text", ["1-URGENT", "2-HIGH"]), ("orders", "orders.csv", None, "o_custkey", "o_custkey", "integer", None),
    ("customer", "customer.xlsx", "Accounts", "c_acctbal", "c_acctbal", "number", None), ("customer", "customer.xlsx", "Accounts", "c_mktsegment", "c_mktsegment", "text", ["BUILDING", "MACHINERY"]),
]


def _values_sql() -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'"
    return ", ".join(f"({', '.join(text(x) for x in r[:6])}, {'NULL' if r[6] is None else str(r[6])}::VARCHAR[])" for r in COLUMNS)


def _phrases_sql(padded: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({padded}, ' {p} ')" for p in phrases) + ")"


def _words_sql(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


PARTED = lambda c: rf"regexp_replace(regexp_replace(coalesce({c}, ''), '[_\s\-./]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')"


@query(rf"""
WITH c(table_name, filename, sheet, "column", original, kind, vals) AS (VALUES {_values_sql()}),
terms AS (
  SELECT DISTINCT table_name, NULL AS col, unnest(list_concat(list_concat({T.sql_terms(PARTED('table_name'))}, {T.sql_terms(PARTED('sheet'))}), {T.sql_terms(PARTED("regexp_replace(filename, '[.][^.]*$', '')"))})) AS b FROM c
  UNION SELECT table_name, "column", unnest(list_concat({T.sql_terms(PARTED('original'))}, {T.sql_terms(PARTED('"column"'))})) FROM c
  UNION SELECT table_name, "column", unnest(CASE WHEN kind = 'text' THEN {T.sql_terms("array_to_string(vals, ' ')")} ELSE [] END) FROM c),
q AS (SELECT o_orderkey AS question_id, ({list(ASKED)})[o_orderkey % {len(ASKED)} + 1] || CASE WHEN o_custkey % 2 = 0 THEN ' ' || o_orderpriority ELSE '' END AS text FROM orders),
t AS (SELECT question_id, {T.sql_tokens('text')} AS t, {T.sql_terms('text')} AS s FROM q),
p AS (SELECT *, ' ' || array_to_string(t, ' ') || ' ' AS padded, replace(replace(' ' || array_to_string(t, ' ') || ' ', ' at least ', ' '), ' at most ', ' ') AS plain FROM t),
m AS (SELECT question_id, table_name, col FROM (SELECT question_id, table_name, col, a, b, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: left(a, i) = left(b, i))) AS c FROM (SELECT question_id, unnest(s) AS a FROM t) x JOIN terms ON left(a, 4) = left(b, 4)) WHERE {SAME}),
g AS (SELECT question_id, list_sort(list(DISTINCT table_name)) AS tables, coalesce(list_sort(list(DISTINCT table_name || '.' || col) FILTER (col IS NOT NULL)), []) AS columns FROM m GROUP BY question_id),
f AS (
  SELECT question_id, len(list_intersect(t, {_words_sql(detect.STRONG_WORDS)})) > 0 OR {_phrases_sql('padded', detect.STRONG_PHRASES)} AS strong, len(list_intersect(t, {_words_sql(detect.GROUP_WORDS)})) > 0 AS groups,
  {_phrases_sql('padded', detect.FILTER_PHRASES)} AND (len(list_filter(t, lambda w: regexp_full_match(w, '\p{{Nd}}+'))) > 0 OR {_phrases_sql('padded', ('where', 'list', 'show'))}) AS filters,
  len(list_intersect(t, {_words_sql(detect.TABLE_WORDS)})) > 0 AS of_tables, {_phrases_sql('plain', detect.LOWEST)} AS low, {_phrases_sql('plain', detect.HIGHEST)} AS high FROM p),
a AS (SELECT f.*, coalesce(tables, []) AS tables, coalesce(columns, []) AS columns FROM f LEFT JOIN g USING (question_id)),
y AS (SELECT *, (strong AND (len(tables) > 0 OR of_tables)) OR (len(columns) > 0 AND (groups OR filters)) AS analytical FROM a)
SELECT question_id, analytical, CASE WHEN analytical AND low AND NOT high THEN 'lowest' WHEN analytical AND high AND NOT low THEN 'highest' END AS ranking, array_to_string(tables, ',') AS tables, array_to_string(columns, ',') AS columns FROM y""")
def questions_about_tables(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    asked = F.element_at(F.array(*map(F.lit, ASKED)), (F.col("o_orderkey") % len(ASKED) + 1).cast("int"))
    q = o.select(F.col("o_orderkey").alias("question_id"), F.concat(asked, F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit(" "), "o_orderpriority")).otherwise("")).alias("question"))
    r = detect.analyze(q, spark.createDataFrame(COLUMNS, detect.CATALOG), other_documents=True)
    return r.select("question_id", "analytical", "ranking", F.array_join("tables", ",").alias("tables"), F.array_join("columns", ",").alias("columns"))


@query("""
WITH s AS (SELECT i + 2 AS _row, 'ORD-' || 1001 + i AS Order_ID, (DATE '2025-01-01' + i::INTEGER)::VARCHAR AS Date, (['North', 'South', 'East', 'West'])[i % 4 + 1] AS Region, (['Widget', 'Gadget', 'Gizmo'])[i % 3 + 1] AS Product, 5 + (7 * i) % 23 AS Units, ([20, 35, 50])[i % 3 + 1] AS price, (i % 9 = 0)::BIGINT AS Returned FROM (SELECT o_orderkey AS i FROM orders))
SELECT Region, sum(Units * price)::BIGINT AS revenue, sum(Returned)::BIGINT AS returned, count(*) AS n, min(Order_ID) AS first_order, max(Date) AS last_date FROM s GROUP BY Region""")
def synthetic_sales_by_region(spark, sf_dir):
    s = tablestore.synthetic_sales(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i")))
    return s.groupBy("Region").agg(F.sum("Revenue").alias("revenue"), F.sum("Returned").alias("returned"), F.count("*").alias("n"), F.min("Order_ID").alias("first_order"), F.max("Date").alias("last_date"))


@query("""
WITH s AS (SELECT (['Email', 'Search', 'Social', 'Display'])[3 * i % 4 + 1] AS Channel, 50 + 37 * i % 400 + 0.5::DOUBLE AS Spend, 20 + 11 * i % 180 AS Clicks, (5 * i % 7 < 3)::BIGINT AS Converted FROM (SELECT c_custkey AS i FROM customer))
SELECT Channel, sum(Converted)::BIGINT AS converted, avg(Clicks) AS clicks, sum(Spend) AS spend FROM s GROUP BY Channel""")
def synthetic_campaigns_by_channel(spark, sf_dir):
    s = tablestore.synthetic_campaigns(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i")))
    return s.groupBy("Channel").agg(F.sum("Converted").alias("converted"), F.avg("Clicks").alias("clicks"), F.sum("Spend").alias("spend"))


@query("""
WITH e AS (SELECT doc_id, lang, CASE WHEN toxic = 1 THEN 'skipped' WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS status, CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 END AS rank FROM labels JOIN documents USING (doc_id))
SELECT lang, round(avg(coalesce(1 / rank, 0)), 4) AS mrr FROM e WHERE status <> 'skipped' GROUP BY lang""")
def eval_mean_reciprocal_rank(spark, sf_dir):
    return evaluation.mean_reciprocal_rank(outcomes(spark, sf_dir), ["lang"])


def outcomes(spark, sf_dir):
    e = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return e.select("doc_id", "lang", F.when(F.col("toxic") == 1, "skipped").when(F.col("quality") == 1, "pass").otherwise("fail").alias("status"), F.nullif(F.col("doc_id") % 4, F.lit(0)).alias("rank"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (toxic = 0 AND quality = 1) AS pass, count(*) FILTER (toxic = 0 AND quality = 0) AS fail, count(*) FILTER (toxic = 1) AS skipped FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def eval_by_category(spark, sf_dir):
    return evaluation.pivoted(outcomes(spark, sf_dir), "lang")


@query(f"SELECT c_custkey AS id, CASE WHEN r = (['BLOCKED', 'RAG_QUERY', 'GREETING', 'TIME'])[c_custkey % 4 + 1] THEN 'pass' ELSE 'fail' END AS status FROM (SELECT c_custkey, {dialogue.sql_route(dialogue.SQL_SMALL_TALK)} AS r FROM customer)")
def eval_routing(spark, sf_dir):
    at = F.col("c_custkey") % 4
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), dialogue.small_talk(F.col("c_custkey")).alias("question"), F.when(at == 0, "blocked").when(at == 1, "rag").otherwise("intent").alias("expect"), F.when(at == 2, "GREETING").when(at == 3, "TIME").alias("intent"))
    return evaluation.judge_routing(c).select("id", "status")


@query("""
WITH g AS (SELECT l_orderkey AS id, l_linenumber, l_extendedprice AS x, l_returnflag AS f FROM lineitem),
w AS (SELECT id, l_linenumber, x + CASE WHEN id % 3 = 0 AND l_linenumber = 2 THEN 0.01 ELSE 0.004 END AS x, CASE WHEN id % 7 = 0 THEN 'R' ELSE f END AS f, id % 11 = 0 AND l_linenumber = 1 AS gone FROM g)
SELECT g.id, bool_and(abs(g.x - w.x) <= 0.005 AND g.f = w.f AND NOT gone) AS same FROM g JOIN w USING (id, l_linenumber) GROUP BY g.id""")
def eval_same_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("row"), "l_extendedprice", "l_returnflag")
    text = lambda c: c.cast("string")
    off = F.when((F.col("id") % 3 == 0) & (F.col("row") == 2), 0.01).otherwise(0.004)
    got = li.select("id", "row", F.array(text(F.col("l_extendedprice")), F.col("l_returnflag")).alias("cells"))
    want = li.where("NOT (id % 11 = 0 AND row = 1)").select("id", "row", F.array(text(F.col("l_extendedprice") + off), F.when(F.col("id") % 7 == 0, "R").otherwise(F.col("l_returnflag"))).alias("cells"))
    return evaluation.same_rows(got, want)


@query("""
SELECT c_custkey AS user_id, count(DISTINCT o_orderkey) AS n_sessions, count(l_orderkey) AS n_documents, coalesce(sum(l_linenumber), 0)::BIGINT AS n_chunks, coalesce(sum(l_partkey), 0)::BIGINT AS total_size, max(o_orderdate) AS last_active
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey""")
def owner_reports(spark, sf_dir):
    """Customers as users, their orders as sessions, an order's lines as documents with chunks and a size."""
    users, sessions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), table(spark, sf_dir, "orders")
    sessions = sessions.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("updated_at"))
    docs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("size"), F.col("l_linenumber").alias("chunks"))
    return lifecycle.owner_report(users, sessions, docs)


HINDI = "translate(text, '0123456789', '०१२३४५६७८९')"


@query(f"SELECT doc_id, len(list_distinct(n))::BIGINT AS n_numbers, (SELECT string_agg(x, ' ' ORDER BY x) FROM (SELECT DISTINCT unnest(n) AS x)) AS numbers FROM (SELECT doc_id, {T.sql_numbers(HINDI)} AS n FROM documents)")
def numbers_of_other_scripts(spark, sf_dir):
    """All documents with their digits in another script: the numbers are the same."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.numbers(F.expr(HINDI)).alias("n"))
    return d.select("doc_id", F.size("n").cast("long").alias("n_numbers"), F.when(F.size("n") > 0, F.array_join(F.array_sort("n"), " ")).alias("numbers"))
