import io
import zipfile
from collections import deque

import pytest
from pyspark.sql import functions as F

from sheaf.functions import text
from sheaf.operators import chunking, dialogue, grounding, guard, lifecycle, tables, usage
from sheaf.sources import extract


def one(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_text(spark):
    assert one(spark, ["The Logs_1 are RETAINED, for 90 days!", None, "कार्यालय"], text.tokenize) == [["the", "logs_1", "are", "retained", "for", "90", "days"], [], ["कार्यालय"]]
    assert one(spark, ["What logs were retained for 7 days in a b"], text.content_terms) == [["log", "retain", "7", "day"]]
    assert one(spark, ["glasses", "bus", "sing", "used", "ab"], text.stem) == ["glass", "bus", "sing", "used", "ab"]
    assert one(spark, ["Summarize this", "what is this document about?", "how many rows", ""], text.is_overview) == [True, True, False, False]
    assert one(spark, ["1,200.50 and 007 or 3.0"], text.numbers) == [["1200.5", "007", "3"]]


def test_lines_lose_blanks_and_no_digits(spark):
    docs = spark.createDataFrame([(1, "0 zero 0\n \n 1 one 1\u00a0\n\u3000\n\ttab 2 \n3"), (2, None)], "doc_id int, text string")
    assert [tuple(r) for r in lifecycle.lines(docs).collect()] == [(1, 0, "0 zero 0"), (1, 1, "1 one 1"), (1, 2, "\ttab 2"), (1, 3, "3")]


def test_typing(spark):
    columns = {
        "a": ["1", "0", "", None], "b": ["1.5", "2", "3", "4"], "c": ["2025-01-01", "2025-01-02 10:00", "", "n/a"], "d": ["TRUE", "false", "", "-"],
        "e": ["N/A", "-", "", None], "f": ["10", "ten", "1", "2"], "g": ["001", "002", "3", "4"], "h": ["$1,200.50", "1,234", "$5.50", ".5"], "i": ["99999999999999999999", "1", "1", "1"],
    }
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} string" for c in columns))
    kinds = {r.column: r.kind for r in tables.column_kinds(df, list(columns)).collect()}
    assert kinds == {"a": "integer", "b": "number", "c": "date", "d": "boolean", "e": "empty", "f": "text", "g": "text", "h": "number", "i": "text"}
    typed = tables.typed(df, kinds)
    assert [r.d for r in typed.collect()] == [1, 0, None, None] and [r.h for r in typed.collect()] == [1200.5, 1234.0, 5.5, 0.5]
    assert {r.kind for r in tables.column_kinds(df.limit(0), ["a"]).collect()} == {"empty"}
    assert tables.column_names(["Order ID", "order id", "", "2024", "_row"]) == ["Order_ID", "order_id_2", "column_3", "c_2024", "_row_2"]
    assert tables.table_name("Report 2024.xlsx", "Sales", True, set()) == "report_2024_sales"


BAD = [
    "", None, "DROP TABLE nation", "SELECT 1; SELECT 2", "SELECT 1 -- x", "SELECT /* x */ 1", "SELECT 'open", "INSERT INTO nation VALUES (1)", "SELECT * FROM secret", "SELECT * FROM main.nation",
    "SELECT random() FROM nation", "SELECT row_number() OVER () FROM nation", "WITH RECURSIVE t AS (SELECT 1) SELECT * FROM t", "SELECT * FROM `parquet`.`/root/testdata/x`", "SELECT \"nope\" FROM nation",
    "SELECT n_name FROM nation, secret", "SELECT current_user() FROM nation", "VALUES (1)", "EXPLAIN SELECT 1", "SELECT nope FROM nation", "SELECT " + "1," * 2000 + "1",
]


@pytest.mark.parametrize("sql", BAD)
def test_guard_refuses(spark, sql):
    with pytest.raises(guard.Rejected):
        guard.run_select(spark, {"nation": spark.read.parquet("/root/testdata/sf0.001/nation.parquet")}, sql)


def test_guard_runs_and_tells_columns(spark):
    views = {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("nation", "region")}
    r = guard.run_select(spark, views, "SELECT n_name AS \"the name\" FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA; --' OR n_nationkey < 3;", 2)
    assert r.frame.count() == 3 and r.columns_used == {"nation": {"n_name", "n_regionkey", "n_nationkey"}, "region": {"r_regionkey", "r_name"}}
    assert guard.run_select(spark, views, "SELECT count(*) AS n FROM nation").frame.first().n == 25


def test_admissions_follow_denials(spark):
    rows = [(1, k, u) for k, u in enumerate([0, 10, 20, 30, 61, 62, 71, 200])] + [(2, 100 + k, k) for k in range(5)]
    df = spark.createDataFrame(rows, "u int, event_id int, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: r.allowed for r in usage.admissions(df, "u", 2, 60).collect()}
    want = {}
    for u in (1, 2):
        hits = deque()
        for _, e, s in sorted((r for r in rows if r[0] == u), key=lambda r: r[2]):
            while hits and hits[0] <= s - 60:
                hits.popleft()
            want[e] = len(hits) < 2
            if want[e]:
                hits.append(s)
    assert got == want


def test_conflicts(spark):
    docs = spark.createDataFrame([(1, "kept 30 days, 5%"), (2, "kept 90 days, 5 %"), (3, "kept 90 days"), (4, None)], "doc_id int, text string")
    assert [(r.unit, r.n_docs, r.shown) for r in dialogue.conflicts(docs).collect()] == [("day", 3, "30, 90")]


def test_follow_up(spark):
    t = spark.createDataFrame([(1, 0, "user", "refunds?"), (1, 1, "assistant", "yes"), (1, 2, "user", "Why?"), (2, 0, "user", "why")], "c int, turn int, role string, text string")
    got = {(r.c, r.turn): r.effective for r in dialogue.with_previous_question(t, "c", "turn").collect()}
    assert got == {(1, 0): "refunds?", (1, 2): "Why?\nPrevious document question: refunds?", (2, 0): "why"}


def test_verification(spark):
    evidence = ["Logs are retained for 90 days in the archive.", "Refunds take 5 business days after approval."]
    answers = {
        1: ("Logs are retained for 90 days. [EVIDENCE 1]", "accept"), 2: ("Logs are retained for 30 days [EVIDENCE 1].", "refuse"), 3: ("Refunds take 5 business days after approval.", "accept"),
        4: ("Elephants roam the green savanna freely. [EVIDENCE 2]", "refuse"), 5: ("Logs stay 90 days. [EVIDENCE 7]", "refuse"),
        6: ("Logs are retained for 90 days [EVIDENCE 1].\nRefunds take 5 business days [EVIDENCE 2].\nLogs live in the archive retained [EVIDENCE 1].\nElephants roam the green savanna freely.", "trim"),
    }
    df = spark.createDataFrame([(i, a, evidence) for i, (a, _) in answers.items()], "answer_id int, answer string, evidence array<string>")
    assert {r.answer_id: r.decision for r in grounding.verdicts(df).collect()} == {i: d for i, (_, d) in answers.items()}


def test_split_text_is_bounded_and_overlaps():
    t = " ".join(f"Sentence number {i} says something." for i in range(200))
    pieces = chunking.split_text(t)
    assert all(len(p) <= 1200 + 150 for p in pieces) and len(pieces) > 4
    assert all(b.split(". ")[0] in a for a, b in zip(pieces, pieces[1:], strict=False))
    assert max(map(len, chunking.split_text("x" * 50_000))) <= 1200
    assert chunking.split_text(" ") == []


def test_chunks_stay_in_their_section():
    e = [{"ordinal": i, **x} for i, x in enumerate([
        {"kind": "heading", "text": "A", "level": 1}, {"kind": "paragraph", "text": "one " * 30}, {"kind": "paragraph", "text": "two " * 30},
        {"kind": "heading", "text": "B", "level": 2}, {"kind": "paragraph", "text": "three"}, {"kind": "table", "text": "h", "rows": [["h", "k"]] + [["x" * 50, str(i)] for i in range(60)]},
    ])]
    c = chunking.build_chunks(e)
    assert [x["section"] for x in c][:2] == ["A", "A > B"] and c[0]["elements"] == [1, 2] and c[0]["text"].startswith("Section: A\n")
    assert all("h | k" in x["text"] for x in c if x["kind"] == "table") and sum(x["kind"] == "table" for x in c) > 2


def xlsx(rows):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    body = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + k)}{i}" t="inlineStr"><is><t>{c}</t></is></c>' for k, c in enumerate(r)) + "</row>" for i, r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Q1" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


FILES = {
    "a.txt": b"one\n\ntwo\r\n\r\n", "b.md": b"# T\ntext\n\n| a | b |\n|---|---|\n| 1 | 2 |\n```\n# no\n```", "c.json": b'{"a": {"b": 1, "n": null}, "l": [1, "x"], "o": [{"k": true}]}',
    "d.xml": b'<r x="1"><a>t</a></r>', "e.html": b"<title>x</title><h2>H</h2><script>no</script><p>a <b>b</b></p><table><tr><th>k</th></tr><tr><td>v</td></tr></table>",
    "f.srt": b"1\n00:00:01,500 --> 00:00:02,000\n<i>hi</i>\n", "g.eml": b"From: a@b.c\nSubject: s\nContent-Type: text/plain\n\nbody\n", "h.csv": b"name;n\nx;1\ny;2\n", "i.xlsx": xlsx([(1, ["Title"]), (3, ["name", "n"]), (4, ["x", "1"])]),
    "j.json": b"{bad", "k.png": b"", "l.xyz": b"", "m.txt": "é﻿".encode("utf-16"),
}


def test_extractors(spark):
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in FILES.items()], "path string, content binary")
    got = {}
    for r in extract.extract(df).orderBy("path", "ordinal").collect():
        got.setdefault(r.path, []).append(r)
    kinds = {p: [(r.kind, r.text) for r in rows] for p, rows in got.items()}
    assert kinds["a.txt"] == [("paragraph", "one"), ("paragraph", "two")]
    assert [k for k, _ in kinds["b.md"]] == ["heading", "paragraph", "table", "paragraph"]
    assert kinds["c.json"] == [("record", "a.b: 1\nl: 1, x\no[0].k: true")] and kinds["d.xml"] == [("record", "r@x: 1\nr.a: t")]
    assert kinds["e.html"] == [("heading", "H"), ("paragraph", "a b"), ("table", "k")]
    assert kinds["f.srt"] == [("transcript", "hi")] and got["f.srt"][0].start_s == 1.5 and got["f.srt"][0].locator == "00:01"
    assert kinds["g.eml"] == [("record", "From: a@b.c\nSubject: s"), ("paragraph", "body")]
    assert got["h.csv"][-1].rows == [["name", "n"], ["x", "1"], ["y", "2"]] and got["h.csv"][-1].locator == "rows 2-3"
    assert [k for k, _ in kinds["i.xlsx"]] == ["paragraph", "summary", "table"] and got["i.xlsx"][-1].locator == "row 4"
    assert got["j.json"][0].error.startswith("JSONDecodeError") and got["k.png"][0].error == "needs ocr" and "unsupported" in got["l.xyz"][0].error
    assert chunking.chunk(extract.extract(df)).count() >= 8


def test_lifecycle(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 5)], "k int, v string, w int")
    assert sorted(map(tuple, lifecycle.upsert(old, new, "k").collect())) == [(1, "a", None), (2, "c", 5)]
    left = lifecycle.cascade_delete({"t": (old, "k")}, new, "k")["t"]
    assert [r.k for r in left.collect()] == [1]
