"""Named queries over tables: guarded SQL, typing, usage windows, dialogue rules, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions.text import STOPS_SQL, sql_stem, stem
from sheaf.operators import dialogue, guard, lifecycle, tables, usage
from sheaf.session import table

from .retrieval import query
from .retrieval import ORACLES as _O
from .retrieval import QUERIES as _Q

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# Guarded queries run the same text on both sides, unless a name differs: then the second is the other engine's.
GUARDED = {
    "sum_by_group": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "avg": "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderpriority",
    "count_distinct": "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem",
    "filter_clause": "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS n FROM lineitem GROUP BY l_returnflag",
    "topn": "SELECT c_custkey, c_name, round(c_acctbal, 2) AS bal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10",
    "offset": "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 10 OFFSET 20",
    "having": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 50",
    "case": "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class, count(*) AS n FROM part GROUP BY 1",
    "cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT count(*) AS n, round(max(total), 2) AS top FROM big WHERE total > 1000",
    "exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "not_exists": "SELECT count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "in_subquery": "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "not_in": "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)",
    "scalar_subquery": "SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    "union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "union_all": "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem",
    "agg_window": "SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders",
    "inner_join": "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "left_join": "SELECT c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "right_join": "SELECT p_brand, count(l_orderkey) AS n FROM lineitem RIGHT JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
    "full_join": "SELECT count(c_custkey) AS c, count(s_suppkey) AS s, count(*) AS n FROM customer FULL JOIN supplier ON c_custkey = s_suppkey",
    "cross_join": "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey < 2",
    "using_join": "SELECT a.c_custkey, b.c_name FROM customer a JOIN customer b USING (c_custkey) WHERE a.c_acctbal > 9000",
    "between_like": "SELECT p_partkey, p_type FROM part WHERE p_size BETWEEN 5 AND 9 AND p_type LIKE '%A%'",
    "functions": "SELECT c_custkey, length(c_name) AS l, lower(substr(c_name, 1, 4)) AS head, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, abs(round(c_acctbal)) AS bal FROM customer",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "min_max": "SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderkey) AS first FROM orders",
    "revenue_by_region": "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "total": ("SELECT l_returnflag, round(total(l_tax), 4) AS t FROM lineitem WHERE l_quantity > 49 GROUP BY l_returnflag", "SELECT l_returnflag, round(sum(l_tax), 4) AS t FROM lineitem WHERE l_quantity > 49 GROUP BY l_returnflag"),
    "iif": ("SELECT o_orderkey, iif(o_totalprice > 100000, 'high', 'low') AS class FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'low' END AS class FROM orders"),
    "total_window": ("SELECT o_orderkey, round(total(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS t FROM orders", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS t FROM orders"),
    "like_any_case": ("SELECT p_partkey FROM part WHERE p_type LIKE '%a%' AND like('%E%', p_type)", "SELECT p_partkey FROM part WHERE p_type ILIKE '%a%' AND p_type ILIKE '%E%'"),
    "glob": ("SELECT p_partkey FROM part WHERE p_brand GLOB '*[1-3]?' OR glob('*5', p_brand)", "SELECT p_partkey FROM part WHERE p_brand GLOB '*[1-3]?' OR p_brand GLOB '*5'"),
    "dates": ("SELECT o_orderkey, date(o_orderdate) AS d, strftime('%Y/%m', o_orderdate) AS m, strftime('%H:%M', o_orderdate) AS t, round(julianday(o_orderdate), 4) AS j FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y/%m') AS m, strftime(o_orderdate, '%H:%M') AS t, round(epoch(o_orderdate) / 86400 + 2440587.5, 4) AS j FROM orders"),
    "typeof": ("SELECT c_custkey, typeof(c_custkey) AS a, typeof(c_acctbal) AS b, typeof(c_name) AS c, typeof(nullif(c_custkey, 1)) AS d FROM customer", "SELECT c_custkey, 'integer' AS a, 'real' AS b, 'text' AS c, CASE WHEN c_custkey = 1 THEN 'null' ELSE 'integer' END AS d FROM customer"),
    "group_concat": ("SELECT n_regionkey, length(group_concat(n_name, '; ')) AS l FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, length(string_agg(n_name, '; ')) AS l FROM nation GROUP BY n_regionkey"),
    "substr_zero": ("SELECT n_nationkey, substr(n_name, 0, 3) AS a, substr(n_name, 2) AS b, substr(n_name, -2) AS c FROM nation", "SELECT n_nationkey, left(n_name, 2) AS a, substr(n_name, 2) AS b, right(n_name, 2) AS c FROM nation"),
    "log": ("SELECT p_partkey, round(log(p_retailprice), 6) AS l, round(ln(p_retailprice), 6) AS n FROM part", "SELECT p_partkey, round(log10(p_retailprice), 6) AS l, round(ln(p_retailprice), 6) AS n FROM part"),
    "power": "SELECT n_nationkey, round(sqrt(n_nationkey), 6) AS r, power(n_nationkey, 2) AS p, mod(n_nationkey, 7) AS m FROM nation",
}


def _guarded(sql: str):
    def run(spark, sf_dir):
        return guard.run_select(spark, {t: table(spark, sf_dir, t) for t in STAR}, sql).frame

    return run


for _name, _sql in GUARDED.items():
    _own, _other = _sql if isinstance(_sql, tuple) else (_sql, _sql)
    _Q[f"guarded_{_name}"] = _guarded(_own)
    _O[f"guarded_{_name}"] = _other


@query("""
WITH c AS (SELECT l_orderkey::VARCHAR AS a, l_quantity::BIGINT::VARCHAR AS b, l_returnflag AS c, strftime(l_shipdate, '%Y-%m-%d') AS d, CASE WHEN l_linenumber = 1 THEN 'n/a' ELSE l_linenumber::VARCHAR END AS e, CASE WHEN l_tax > 0.04 THEN 'TRUE' ELSE 'false' END AS f FROM lineitem)
SELECT 'a' AS "column", 'integer' AS kind, 0::BIGINT AS nulls, count(*) AS n_rows FROM c
UNION ALL SELECT 'b', 'integer', 0, count(*) FROM c UNION ALL SELECT 'c', 'text', 0, count(*) FROM c UNION ALL SELECT 'd', 'date', 0, count(*) FROM c
UNION ALL SELECT 'e', 'integer', count(*) FILTER (e = 'n/a'), count(*) FROM c UNION ALL SELECT 'f', 'boolean', 0, count(*) FROM c""")
def infer_column_types(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    cells = li.select(
        F.col("l_orderkey").cast("string").alias("a"), F.col("l_quantity").cast("long").cast("string").alias("b"), F.col("l_returnflag").alias("c"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("d"), F.when(F.col("l_linenumber") == 1, "n/a").otherwise(F.col("l_linenumber").cast("string")).alias("e"),
        F.when(F.col("l_tax") > 0.04, "TRUE").otherwise("false").alias("f"),
    )
    return tables.column_kinds(cells, list("abcdef"))


@query("""
WITH v AS (SELECT o_orderkey AS r, unnest(['o_orderstatus', 'o_orderpriority']) AS "column", unnest([o_orderstatus, o_orderpriority]) AS value FROM orders),
n AS (SELECT "column", value, count(*) AS n, min(r) AS f FROM v GROUP BY ALL)
SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, f) AS place FROM n WHERE (SELECT count(*) FROM n m WHERE m."column" = n."column") <= 12""")
def low_cardinality_values(spark, sf_dir):
    return tables.top_values(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"], order="o_orderkey").select("column", "value", "n", F.col("place").cast("long"))


@query("SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) - count(o_totalprice) AS nulls, count(DISTINCT o_custkey) AS customers FROM orders")
def column_profile(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.count_if(F.col("o_totalprice").isNull()).alias("nulls"), F.count_distinct("o_custkey").alias("customers"))


@query("SELECT p_partkey, round(p_retailprice, 2) AS price FROM part")
def parse_numbers(spark, sf_dir):
    cells = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" $"), F.format_number("p_retailprice", 2)).alias("cell"))
    return cells.select("p_partkey", F.round(tables.parse_number(F.col("cell")), 2).alias("price"))


for _w, _s in usage.SIZES.items():

    def _usage(spark, sf_dir, w=_w):
        return usage.quota_usage(table(spark, sf_dir, "events"), w, ["event_type"])

    _Q[f"quota_{_w}_usage"] = _usage
    _O[f"quota_{_w}_usage"] = f"SELECT event_type, floor(epoch(ts) / {_s})::BIGINT AS bucket, count(*) AS used FROM events GROUP BY ALL"


@query("""
WITH n AS (SELECT TIMESTAMP '2024-01-15 12:30:30' AS t)
SELECT user_id, least(5 - count(*) FILTER (floor(epoch(ts) / 3600) = floor(epoch(t) / 3600)), 40 - count(*) FILTER (floor(epoch(ts) / 86400) = floor(epoch(t) / 86400)))::BIGINT AS remaining FROM events, n GROUP BY user_id""")
def quota_remaining(spark, sf_dir):
    return usage.quota_remaining(table(spark, sf_dir, "events"), {"hour": 5, "day": 40}, ["user_id"], F.lit("2024-01-15 12:30:30").cast("timestamp"))


@query()
def rate_limit_admissions(spark, sf_dir):
    return usage.admissions(table(spark, sf_dir, "events"), "user_id", 3, 7200)


@query("""
WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 14400000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, sid""")
def session_windows(spark, sf_dir):
    return usage.sessions(table(spark, sf_dir, "events"), "user_id", 14400)


@query("SELECT event_type, time_bucket(INTERVAL 1 hour, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    return usage.tumbling(table(spark, sf_dir, "events"), "1 hour", ["event_type"])


@query("""
WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 30 minutes, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 30 minutes, ts, TIMESTAMP '1970-01-01') - INTERVAL 30 minutes]) AS window_start FROM events)
SELECT event_type, window_start, count(*) AS n_events FROM w GROUP BY ALL""")
def sliding_windows(spark, sf_dir):
    return usage.sliding(table(spark, sf_dir, "events"), "1 hour", "30 minutes", ["event_type"])


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def usage_by_type(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_props_flatten(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""
WITH g AS (SELECT l_suppkey, l_orderkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS g, l_orderkey FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)),
r AS (SELECT l_suppkey, min(l_orderkey) AS a, max(l_orderkey) AS b FROM g GROUP BY l_suppkey, g)
SELECT l_suppkey, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY l_suppkey""")
def row_range_compress(spark, sf_dir):
    return usage.compressed(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_orderkey")


@query("SELECT p_brand, string_agg(p_partkey::VARCHAR, ' and ' ORDER BY p_partkey) AS lead, max(p_size) AS size FROM part p WHERE p_size = (SELECT max(p_size) FROM part q WHERE q.p_brand = p.p_brand) GROUP BY p_brand")
def rank_lead_ties(spark, sf_dir):
    from pyspark.sql import Window

    r = table(spark, sf_dir, "part").withColumn("r", F.rank().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size")))).where("r = 1")
    return r.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string")), " and ").alias("lead"), F.max("p_size").alias("size"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark, sf_dir):
    return usage.latest(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT d.doc_id, CASE WHEN f.first < d.doc_id THEN f.first END AS duplicate_of FROM documents d JOIN (SELECT source, text, min(doc_id) AS first FROM documents GROUP BY ALL) f ON d.source = f.source AND d.text = f.text")
def exact_dedup_by_hash(spark, sf_dir):
    return lifecycle.first_of_equal(table(spark, sf_dir, "documents"), "source").select("doc_id", "duplicate_of")


@query("SELECT DISTINCT sha256(text) AS k FROM documents WHERE lang = 'en' AND text NOT IN (SELECT text FROM documents WHERE source IN ('src1', 'src2'))")
def cache_misses(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("k", F.sha2("text", 256))
    return lifecycle.cache_misses(d.where("lang = 'en'"), d.where("source IN ('src1', 'src2')"), "k")


@query("""
WITH u AS (SELECT DISTINCT text FROM documents), c AS (SELECT DISTINCT text FROM documents WHERE source = 'src1')
SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM u) AS unique_texts, (SELECT count(*) FROM c) AS cached, (SELECT count(*) FROM u) - (SELECT count(*) FROM c) AS to_embed,
ceil(((SELECT count(*) FROM u) - (SELECT count(*) FROM c)) / 32.0)::BIGINT AS requests""")
def embedding_estimate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("k", F.sha2("text", 256))
    return lifecycle.embedding_estimate(d, d.where("source = 'src1'"), "k")


@query("SELECT source, count(*) AS n_docs, sum(n_chars)::BIGINT AS total_size FROM documents GROUP BY source")
def storage_by_owner(spark, sf_dir):
    return lifecycle.storage_report(table(spark, sf_dir, "documents"), "source", "n_chars")


@query("SELECT source, count(*) AS n_docs, sum(n_chars)::BIGINT AS total_size FROM documents GROUP BY source ORDER BY total_size DESC, source LIMIT 5")
def top_storage(spark, sf_dir):
    return lifecycle.top_owners(table(spark, sf_dir, "documents"), "source", "n_chars")


@query("SELECT source, count(*) AS n_docs FROM documents GROUP BY source HAVING count(*) > 9")
def owners_over_cap(spark, sf_dir):
    return lifecycle.over_cap(table(spark, sf_dir, "documents"), "source", 9)


@query("SELECT lang, count(*) AS n, sum(l.quality)::BIGINT AS good FROM documents d JOIN labels l USING (doc_id) GROUP BY lang")
def labelled_by_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("good"))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def documents_without_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("""
WITH e AS (SELECT CASE WHEN toxic = 1 THEN 'skipped' WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS status, d.lang FROM labels l JOIN documents d USING (doc_id))
SELECT lang, count(*) AS n, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
round(count(*) FILTER (status = 'pass') / nullif(count(*) FILTER (status <> 'skipped'), 0), 4) AS rate FROM e GROUP BY lang""")
def eval_rates(spark, sf_dir):
    e = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    e = e.select("lang", F.when(F.col("toxic") == 1, "skipped").when(F.col("quality") == 1, "pass").otherwise("fail").alias("status"))
    return usage.rates(e, "lang")


@query("SELECT list_sort(list(value))[least(count(*), 1 + floor(0.95 * count(*))::BIGINT)] AS p95 FROM events")
def eval_latency_p95(spark, sf_dir):
    return usage.p95(table(spark, sf_dir, "events"), "value")


@query("SELECT list_sort(list(value))[least(count(*), 1 + floor(0.5 * count(*))::BIGINT)] AS p50 FROM events")
def eval_latency_p50(spark, sf_dir):
    return usage.p50(table(spark, sf_dir, "events"), "value")


@query("SELECT conv_id, turn, CASE WHEN trim(lower(text)) IN ('why', 'why?') AND p IS NOT NULL THEN text || chr(10) || 'Previous document question: ' || p ELSE text END AS effective, p AS previous FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE role = 'user')")
def previous_user_turn(spark, sf_dir):
    from pyspark.sql import Window

    t = dialogue.with_previous_question(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return t.withColumn("previous", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).select("conv_id", "turn", "effective", "previous")


_BAD = " OR ".join(f"contains(lower(text), '{p}')" for p in dialogue.INJECTION)


@query(f"SELECT conv_id, turn, {_BAD} AS blocked FROM conversations")
def injection_block(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", dialogue.is_injection(F.col("text")).alias("blocked"))


@query(r"""
WITH s AS (SELECT item_id, text, list_filter(regexp_split_to_array(text, '(?i)\s+(?:and|also|plus|as well as)\s+'), lambda x: trim(x) <> '') AS p FROM benchmark),
d AS (SELECT item_id, CASE WHEN len(p) <= 1 THEN [text] ELSE list_transform(p[1:3], lambda x: trim(x, ' ?.')) END AS p FROM s)
SELECT item_id, len(p)::BIGINT AS n_parts, array_to_string(p, '|') AS parts FROM d""")
def decompose_question(spark, sf_dir):
    d = table(spark, sf_dir, "benchmark").select("item_id", dialogue.decompose(F.col("text")).alias("p"))
    return d.select("item_id", F.size("p").cast("long").alias("n_parts"), F.array_join("p", "|").alias("parts"))


@query(rf"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:%|\p{{L}}{{2,}})')) AS q FROM documents),
u AS (SELECT doc_id, lower(regexp_extract(q, '(%|\p{{L}}{{2,}})$', 1)) AS unit, replace(regexp_extract(q, '^([0-9][0-9,]*(?:\.[0-9]+)?)', 1), ',', '') AS number FROM m),
q AS (SELECT DISTINCT doc_id, {sql_stem('unit')} AS unit, CASE WHEN contains(number, '.') THEN regexp_replace(regexp_replace(number, '0+$', ''), '\.$', '') ELSE number END AS number FROM u WHERE NOT list_contains({STOPS_SQL}, unit)),
d AS (SELECT unit, count(DISTINCT doc_id) AS n_docs FROM q GROUP BY unit),
v AS (SELECT unit, number, count(*) AS in_docs, row_number() OVER (PARTITION BY unit ORDER BY number) AS place FROM q GROUP BY unit, number),
s AS (SELECT unit, count(*) AS n_values, max(in_docs) AS most, string_agg(number, ', ' ORDER BY number) FILTER (place <= 6) AS shown FROM v GROUP BY unit)
SELECT unit, n_docs, n_values, shown FROM d JOIN s USING (unit) WHERE n_docs >= 2 AND n_values > 1 AND most < n_docs""")
def numeric_conflicts(spark, sf_dir):
    return dialogue.conflicts(table(spark, sf_dir, "documents"))


@query("SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING), 2) AS running FROM lineitem")
def running_totals(spark, sf_dir):
    return lifecycle.running_total(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_quantity").select("l_orderkey", "l_linenumber", "running")


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_size)")
def rollup_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").rollup("p_brand", "p_size").agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
