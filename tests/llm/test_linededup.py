import hashlib
import random

import duckdb

from sheaf.llm.linededup import LINE_SQL, dedup_lines, drop_emptied, line_report, winnow


def brute(rows, window=3, long_line=60):
    seen, gone = {}, {}
    places = []
    for d, t in rows:
        lines = [(i, x) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
        for k in range(len(lines)):
            if k + window <= len(lines):
                places.append((d, lines[k][0], tuple(x for _, x in lines[k : k + window]), [i for i, _ in lines[k : k + window]]))
            if len(lines[k][1]) >= long_line:
                places.append((d, lines[k][0], (lines[k][1],), [lines[k][0]]))
    for d, i, content, _ in places:
        seen[content] = min(seen.get(content, (d, i)), (d, i))
    for d, i, content, own in places:
        if (d, i) > seen[content]:
            gone.setdefault(d, set()).update(own)
    return gone


def test_guarantee():
    rng = random.Random(2)
    for _ in range(200):
        v = [rng.randrange(6) for _ in range(rng.randrange(0, 30))]
        w = rng.randrange(1, 6)
        want = {max((-v[k], k) for k in range(i, i + w))[1] for i in range(len(v) - w + 1)}
        assert winnow(v, w) == sorted(want)


def test_against_brute_force(spark):
    rng = random.Random(6)
    line = lambda: rng.choice(["a", "b", "c", "d", "", " \t", "L" * 70, "M" * 61, "N" * 59]) + rng.choice(["", "", "1"])
    rows = [(i, "\n".join(line() for _ in range(rng.randrange(0, 14)))) for i in range(60)] + [(70, None), (71, ""), (72, "\n\n"), (73, "x\n" * 20_000 + "y"), (74, "x\ny\r\nz")]
    docs = spark.createDataFrame([(i, t, "p") for i, t in rows] + [(71, "", "p"), (3, rows[3][1], "p"), (None, "L" * 70, "p")], "doc_id long, text string, lines string")
    gone = brute(rows)
    got = dedup_lines(docs).collect()
    assert len(got) == len(rows) + 3
    texts = dict(rows)
    for r in got:
        t = "L" * 70 if r.doc_id is None else texts[r.doc_id]
        want = t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(r.doc_id, ()))
        assert r.text == want
    assert sum(map(len, gone.values())) > 50
    kept = drop_emptied(docs)
    assert kept.columns == docs.columns
    assert dedup_lines(docs.limit(0)).count() == 0


def test_report_and_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(path)
    c = duckdb.connect()
    c.sql(f"create view documents as from '{path}'")
    want = sorted(c.sql(LINE_SQL).fetchall())
    assert sorted(map(tuple, line_report(docs).collect())) == want
    gone = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {d: n for d, _, n, _ in want if n} == {d: len(g) for d, g in gone.items()}
    assert hashlib.sha256(b"").hexdigest() == line_report(spark.createDataFrame([(1, None)], "doc_id long, text string")).first().kept_sha256
