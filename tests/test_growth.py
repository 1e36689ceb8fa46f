"""Steps whose memory or work grew faster than their input."""

import random

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from sheaf.operators import chunking, dialogue, usage
from sheaf.sources import extract


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_message_is_cut_into_tokens_once(spark):
    routed = spark.range(3).select(dialogue.route(F.concat(F.lit("what time is it "), F.col("id").cast("string"))).alias("r"))
    assert plan(routed).count("regexp_extract_all") == 1


def test_runs_of_numbers_with_repeats_and_no_aggregation(spark):
    r = random.Random(1)
    rows = [(k, r.randrange(60)) for k in range(4) for _ in range(50)] + [(9, 5), (9, 5), (9, 5), (9, 7), (9, 8), (9, 8)]
    got = usage.islands(spark.createDataFrame(rows, "k int, n int"), ["k"], "n")
    want = set()
    for k in {k for k, _ in rows}:
        own = sorted({n for x, n in rows if x == k})
        firsts, lasts = [n for n in own if n - 1 not in own], [n for n in own if n + 1 not in own]
        want |= {(k, *x) for x in zip(firsts, lasts, strict=True)}
    assert sorted(map(tuple, got.collect())) == sorted(want) and "Aggregate" not in plan(got)


def test_elements_leave_a_task_in_slices(monkeypatch):
    monkeypatch.setattr(extract, "SLICE_BYTES", 100)
    files = pd.DataFrame({"path": [f"{i}.html" for i in range(40)] + ["x.none"], "content": [b"<h1>a</h1><p>some text</p>"] * 40 + [None]})
    out = list(extract.parsed_files(iter([files[:15], files[15:]])))
    assert len(out) == 11 and max(map(len, out)) == 8
    rows = pd.concat(out)
    assert list(rows["path"]) == [p for p in files["path"][:40] for _ in range(2)] + ["x.none"] and list(rows["ordinal"][:80]) == [0, 1] * 40


def random_elements(docs):
    r = random.Random(2)
    for d in docs:
        for i in range(r.randrange(1, 40)):
            kind = r.choice(["heading", "paragraph", "paragraph", "table"])
            rows = [["k", "v"], *([str(n), "x" * r.randrange(300)] for n in range(r.randrange(1, 12)))] if kind == "table" else None
            yield {"id": d, "ordinal": i, "kind": kind, "text": f"text {d} {i} " * r.randrange(1, 60), "level": r.randrange(1, 4) if kind == "heading" else None, "rows": rows}


def chunks_by_document(elements):
    by = {}
    for e in elements:
        by.setdefault(e["id"], []).append(e)
    return {(d, i, c["kind"], c["text"], c["section"], c["locator"], tuple(c["elements"])) for d, es in by.items() for i, c in enumerate(chunking.build_chunks(sorted(es, key=lambda e: e["ordinal"])))}


def test_chunks_are_made_from_sorted_rows_in_bounded_batches(spark):
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(bound)
    elements = list(random_elements([None, *range(60)]))
    random.Random(3).shuffle(elements)
    df = spark.createDataFrame([*elements, {"id": 77, "kind": "paragraph"}], "id bigint, ordinal int, kind string, text string, level int, rows array<array<string>>")
    made = chunking.chunk(df.repartition(7), "id")
    assert spark.conf.get(bound) == "4m" and "FlatMapGroups" not in plan(made)
    got = [(r["id"], r["ordinal"], r["kind"], r["text"], r["section"], r["locator"], tuple(r["elements"])) for r in made.collect()]
    assert len(got) == len(set(got)) and set(got) == chunks_by_document(elements)
    assert chunking.chunk(df.where("id < 0"), "id").collect() == []


def test_chunks_leave_a_task_in_slices(monkeypatch):
    monkeypatch.setattr(chunking, "SLICE_ROWS", 3)
    monkeypatch.setattr(chunking, "SLICE_CHARS", 2000)
    elements = list(random_elements("abcdefgh"))
    taken = []

    def batches():
        for i in range(0, len(elements), 10):  # a document spans batches
            taken.append(i)
            yield pa.RecordBatch.from_pylist(elements[i : i + 10])

    out = chunking.chunks_in_order(batches(), "id")
    first = next(out)
    assert len(taken) * 10 < len(elements) / 2
    rows = [r for b in [first, *out] for r in b.to_pylist()]
    assert {(r["id"], r["ordinal"], r["kind"], r["text"], r["section"], r["locator"], tuple(r["elements"])) for r in rows} == chunks_by_document(elements)


def test_files_reach_their_parsers_in_bounded_batches(spark):
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(bound)
    extract.extract(spark.createDataFrame([("a.html", bytearray(b"<p>x</p>"))], "path string, content binary"), layouts=False)
    assert spark.conf.get(bound) == "4m"
