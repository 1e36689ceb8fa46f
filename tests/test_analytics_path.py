"""From files to typed tables, guarded queries and computed answers."""

import csv
import io
import json
import time

import pytest
from pyspark.sql import functions as F

from sheaf.operators import answers, detect, evaluation, guard, retrieval
from sheaf.sources import extract, tablestore

from .test_operators import xlsx

SF = "/root/testdata/sf0.001"


def files(spark, content):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in content.items()], "path string, content binary")


def csv_of(df, names, order):
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow(names)
    w.writerows(tuple(r) for r in df.orderBy(order).select(*[c for c in df.columns if c != "_row"]).collect())
    return out.getvalue().encode()


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    sales, campaigns = tablestore.synthetic_sales(spark.range(60).toDF("i")), tablestore.synthetic_campaigns(spark.range(40).toDF("i"))
    rows = [tuple(map(str, r)) for r in sales.orderBy("_row").drop("_row").collect()]
    book = xlsx([(1, ["Order ID", "Date", "Region", "Product", "Units", "Revenue", "Returned"]), *((i + 2, list(r)) for i, r in enumerate(rows))])
    s = tablestore.TableStore(spark, str(tmp_path_factory.mktemp("store")))
    got = s.load("chat", {
        "d1": files(spark, {"/x/sales_q1.xlsx": book}), "d2": files(spark, {"/x/campaign_results.csv": csv_of(campaigns, ["Campaign", "Channel", "Spend", "Clicks", "Converted"], "Campaign")}),
        "d3": files(spark, {"/x/broken.xlsx": b"no zip"}),
    })
    assert got["d1"] is None and got["d2"] is None and got["d3"].startswith("BadZipFile")
    return s


def test_sheets_become_typed_tables(spark, store):
    tables = {t["table_name"]: t for t in store.session_tables("chat")}
    assert list(tables) == ["campaign_results", "sales_q1"] and store.session_tables("other") == []
    sales = tables["sales_q1"]
    assert (sales["row_count"], sales["first_row"], sales["last_row"]) == (60, 2, 61)
    assert [(c["name"], c["kind"]) for c in sales["columns"]] == [("Order_ID", "text"), ("Date", "date"), ("Region", "text"), ("Product", "text"), ("Units", "integer"), ("Revenue", "integer"), ("Returned", "integer")]
    assert sales["columns"][2]["values"] == ["North", "South", "East", "West"] and sales["columns"][4]["min"] == 5
    views = store.views("chat")
    one = lambda q: guard.fetch(spark, views, q, max_seconds=60).rows
    assert one('SELECT sum("Revenue"), sum("Returned"), avg("Units"), count(*) FILTER (WHERE "Region" = \'West\') FROM "sales_q1"') == [(32970, 7, 16.0, 15)]
    assert one('SELECT "Region", sum("Revenue") AS r FROM "sales_q1" GROUP BY "Region" ORDER BY r DESC LIMIT 1') == [("South", 8545)]
    assert one('SELECT "Channel", sum("Converted") AS n FROM "campaign_results" GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2') == [("Search", 5), ("Social", 5)]


def test_computed_answers(spark, store):
    ask = lambda question, reply, other=True: answers.try_answer(spark, store, "chat", question, lambda prompt: reply, other)
    top = ask("Which region has the highest revenue?", '```json\n{"sql": "SELECT \\"Region\\", sum(\\"Revenue\\") AS total_revenue FROM \\"sales_q1\\" GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", "label": "Revenue of 99 regions"}\n```')
    assert top.status == "computed" and top.text.startswith("South has the highest total revenue: 8545.") and "Source: sales_q1.xlsx, sheet Q1, all 60 data rows (2-61)." in top.text
    tie = ask("Which channel has the most conversions?", 'SELECT "Channel", sum("Converted") AS n FROM "campaign_results" GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5')
    assert tie.text.startswith("Search and Social are tied for the highest n: 5.")
    rows = ask("List all rows where units are more than 26", 'SELECT "_row", "Units" FROM "sales_q1" WHERE "Units" > 26 ORDER BY 1')
    assert rows.citations[0]["rows"].startswith("rows ") and rows.citations[0]["columns"] == ["Units"]
    assert ask("Sum of the revenue?", '{"sql": "DROP TABLE sales_q1"}').status == "abstained" and ask("Sum of the revenue?", '{"sql": null}') is None
    assert ask("Sum of the revenue?", '{"sql": null}', other=False).status == "abstained" and ask("Who wrote this?", "") is None
    assert answers.ranges({3, 4, 5, 9, 10, 1}) == "1, 3-5, 9-10"


def test_small_results_as_text():
    t = answers.Table(["name", "total_x", "share", "ok", "n"], ["string", "bigint", "double", "boolean", "decimal(10,2)"], [("a", 12345, 12345.5, True, 7), ("b 41", 12345, 7.0, None, None), ("c", 9999, 0.123456, False, 1)])
    assert [t.printed(i) for i in range(5)] == [["a", "b 41", "c"], ["12,345", "12,345", "9999"], ["12,345.5", "7", "0.1235"], ["1", "", "0"], ["7", "", "1"]]
    assert answers.lead("highest", "x", t) == "a and b 41 are tied for the highest total x: 12,345." and answers.lead("lowest", "x", t) == "x" and answers.lead(None, "x", t) == "x"
    assert answers.grid(t, True).endswith("c | 9999 | 0.1235 | 0 | 1\n(showing the first 3 of more than 3 result rows)")
    for label, question, kept in (("0.12 of 50", "top 50?", True), ("41 and 3 rows", "", True), ("8 things", "", False), ("", "", True)):
        assert (answers.verified_label(label, question, t) == label) is kept
    one = answers.Table(["total_revenue"], ["double"], [(1234567.0,)])
    assert answers.lead(None, "", one) == "Total revenue: 1,234,567" and answers.lead(None, "", answers.Table(["x"], ["int"], [])) == answers.lead("highest", "", answers.Table(["x"], ["int"], [(None,)])) == "No matching rows were found."


def test_what_a_query_writer_is_told(spark, store):
    columns = answers.catalog_frame(spark, store.session_tables("chat"))
    told = answers.describe_tables(columns, {"sales_q1"}, {"sales_q1": [2, "ORD-001"]})
    first, second = told.split("\n\n")
    assert first.startswith('TABLE "sales_q1"  -- file sales_q1.xlsx, sheet Q1; 60 data rows (sheet rows 2-61)\n  "_row" INTEGER  -- the row number in the original sheet\n  "Order_ID" TEXT')
    assert '"Region" TEXT  -- values: North, South, East, West' in first and first.endswith("example row: 2 | ORD-001") and second.startswith('TABLE "campaign_results"')
    assert '"Returned" INTEGER  -- flag: 1 = yes/true, 0 = no/false' in first and '"Date" TEXT  -- ' in first and "ISO date text" in first


def test_a_tables_replacement_and_removal(spark, tmp_path):
    s = tablestore.TableStore(spark, str(tmp_path / "s"))
    put = lambda d, raw: s.replace("c", d, tablestore.sheet_rows(files(spark, {"/a/Report 2024.csv": raw})))
    put("d1", b"a,b\n1,x\n")
    put("d2", b"a,b\n1,x\n2,y\n")
    put("d1", b"a,b\n5,z\n6,\n7,w\n")
    assert [(t["table_name"], t["row_count"]) for t in s.session_tables("c")] == [("report_2024", 3), ("report_2024_2", 2)]
    assert s.views("c")["report_2024"].where("b is null").count() == 1
    assert put("d3", b"only,a,header\n") == []
    s.drop("c", "d2")
    assert [t["table_name"] for t in s.session_tables("c")] == ["report_2024"]
    s.drop("c")
    assert s.views("c") == {}


def test_guarded_views_keep_their_own_plan(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    views = {"orders": orders.where("o_orderkey <= 10").select("o_orderkey", F.lit("x").alias("tag")), "made": spark.createDataFrame([(1,)], "n int")}
    assert guard.run_select(spark, views, "SELECT count(*) AS n, max(tag) AS t FROM orders").frame.first() == (orders.where("o_orderkey <= 10").count(), "x")
    assert guard.run_select(spark, views, "WITH m AS (SELECT n FROM made) SELECT m.n, orders.o_orderkey FROM m JOIN orders ON m.n = orders.o_orderkey").frame.collect() == [(1, 1)]
    with pytest.raises(guard.Rejected):
        guard.run_select(spark, views, "SELECT o_totalprice FROM orders")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("guarded_")]


def test_rows_and_time_are_bounded(spark):
    views = {"r": spark.range(1000).withColumnRenamed("id", "n")}
    got = guard.fetch(spark, views, "SELECT n FROM r ORDER BY n", 5, 60)
    assert got.truncated and [r[0] for r in got.rows] == [0, 1, 2, 3, 4] and not guard.fetch(spark, views, "SELECT n FROM r WHERE n < 5", 5, 60).truncated
    slow = spark.range(0, 10**12, 1, 8).withColumnRenamed("id", "n")
    began = time.time()
    with pytest.raises(guard.Rejected, match="too long"):
        guard.fetch(spark, {"r": slow}, "SELECT sum(sqrt(n)) AS s FROM r", max_seconds=2)
    assert time.time() - began < 40


def test_judges(spark):
    cases = spark.createDataFrame(
        [("a", "answer", ["f.txt"], ["90 days"]), ("b", "answer", ["g.txt"], ["9:30"]), ("c", "abstain", [], []), ("d", "abstain", [], []), ("e", "answer", [], ["one", "two"])],
        "id string, expect string, sources array<string>, evidence_contains array<string>",
    )
    candidates = [("a", 1, "x.txt", "90 days"), ("a", 2, "f.txt", "for 90\u00a0Days."), ("b", 1, "g.txt", "closed"), ("d", 1, "x.txt", "?"), ("e", 1, "x", "TWO,"), ("e", 2, "y", "and one")]
    c = spark.createDataFrame(candidates, "id string, rank int, source string, text string")
    got = {r.id: (r.status, r.rank) for r in evaluation.judge_retrieval(cases, c, c.drop("rank")).collect()}
    assert got == {"a": ("pass", 2), "b": ("fail", None), "c": ("pass", None), "d": ("fail", None), "e": ("pass", None)}
    outcome = spark.createDataFrame([(k, *v) for k, v in got.items()], "id string, status string, rank int")
    assert evaluation.mean_reciprocal_rank(outcome).first().mrr == 0.1
    rows = lambda data: spark.createDataFrame(data, "id string, row int, cells array<string>")
    detected = spark.createDataFrame([("a", True), ("b", False)], "id string, analytical boolean")
    sql = evaluation.judge_analytics(cases.where("id in ('a', 'b')"), detected, rows([("a", 0, ["South", "8545"]), ("b", 0, ["1"])]), rows([("a", 0, ["South", "8545.004"]), ("b", 0, ["1"])]))
    assert {r.id: (r.status, r.routed, r.sql_correct) for r in sql.collect()} == {"a": ("pass", True, True), "b": ("fail", False, True)}


def test_cases_from_json_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "x", "category": "lookup", "sources": ["a"], "gold_result": [[1, "b"]], "unknown": 5}\n{"id": "y"}\n')
    rows = {r.id: r for r in evaluation.read_cases(spark, str(tmp_path / "c.jsonl")).collect()}
    assert rows["x"].sources == ["a"] and json.loads(rows["x"].gold_result) == [[1, "b"]] and rows["y"].category is None


def test_same_term_and_detection(spark):
    pairs = [("sale", "sale"), ("conversion", "convert"), ("reg", "region"), ("regi", "region"), ("order", "ordinary"), ("", "")]
    from sheaf.functions.values import same_term

    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(same_term(F.col("a"), F.col("b"))).collect()] == [True, True, False, True, False, True]
    catalog = spark.createDataFrame([("sales_q1", "sales_q1.xlsx", "Q1", "Region", "Region", "text", ["North", "South"])], detect.CATALOG)
    q = spark.createDataFrame([(0, "total sales in the north region"), (1, "what was said about growth"), (2, "how many?"), (3, "rows where region is north")], "question_id int, question string")
    got = {r.question_id: (r.analytical, r.columns) for r in detect.analyze(q, catalog, True).collect()}
    assert got == {0: (True, ["sales_q1.Region"]), 1: (False, []), 2: (False, []), 3: (True, ["sales_q1.Region"])}
    assert {r.question_id for r in detect.analyze(q, catalog, False).where("analytical").collect()} == {0, 2, 3}
    assert not detect.analyze(q, catalog.limit(0), False).where("analytical").collect()


def test_index_replaces_and_deletes(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "gamma"), (3, "the of")], "doc_id long, text string")
    index = retrieval.build_index(docs)
    assert sorted(map(tuple, index.collect())) == [(1, "alpha", 1, 4), (1, "beta", 2, 4), (2, "gamma", 1, 2)]
    new = spark.createDataFrame([(2, "delta alpha"), (4, "beta")], "doc_id long, text string")
    now = new.union(docs.where("doc_id <> 2"))
    assert sorted(r[0] for r in retrieval.stale_documents(index, now).collect()) == [2, 4]
    after = retrieval.replace_in_index(index, new)
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, retrieval.postings(now).collect()))
    assert retrieval.stale_documents(after, now).count() == 0 and retrieval.delete_from_index(after, new).select("doc_id").distinct().count() == 1


def test_indexed_search_finds_what_the_exact_one_does(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    centres = retrieval.cells(v, sample=4096)
    exact = {(r.query_id, r.vec_id) for r in retrieval.dense(v, q).collect()}
    found = {(r.query_id, r.vec_id) for r in retrieval.dense_indexed(v, q, centres).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def pdf(lines):
    body = b"BT /F1 12 Tf 72 720 Td " + b" ".join(f"/F1 {s} Tf ({t}) Tj 0 -14 Td".encode() for s, t in lines) + b" ET"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"%%EOF"


def test_simple_pdf_and_dates_in_sheets(spark):
    raw = pdf([(20, "Price list"), (12, "The Pro plan costs \\(now\\) 29 dollars"), (12, "per user."), (15, "Terms"), (12, "None.")])
    got = extract.extract(spark.createDataFrame([("a.PDF", bytearray(raw))], "path string, content binary")).orderBy("ordinal").collect()
    assert [(e.kind, e.level, e.text) for e in got] == [
        ("heading", 1, "Price list"), ("paragraph", None, "The Pro plan costs (now) 29 dollars per user."), ("heading", 2, "Terms"), ("paragraph", None, "None.")]
    assert extract.date_text("45658") == "2025-01-01" and extract.date_text("45658.5") == "2025-01-01 12:00:00"
    style = b'<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0.00&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>'
    assert extract.dated_styles(style) == {1, 2}
    s = extract.read_tsv(b"a,x\tb\n1\t2\n")
    assert s[0]["text"] == "Table: 1 data rows, 2 columns.\nColumns: a,x (number), b (number).\nExample row: 1 | 2"
