"""Queries over inputs that the given tables don't hold: several paragraphs, questions of more than three parts, large order keys."""

import random

import duckdb
from pyspark.sql import functions as F

from sheaf.operators import usage
from sheaf.plans import catalog
from sheaf.sources.extract import read_csv

TABLES = {
    "documents": ("doc_id long, text string", [(1, "one\n\ntwo\n \t\n\n three "), (2, "first\r\n\r\nsecond"), (3, "\n\nonly one\nof two lines"), (4, ""), (5, " \n\n ")]),
    "benchmark": ("item_id long, text string", [(1, "What is a and what is b also c plus d as well as e?"), (2, "Plain question?"), (3, "x AND y."), (4, "a and b and c?")]),
}


def both(spark, path, name):
    duck = duckdb.connect()
    for t, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{t}.parquet")
        duck.sql(f"create view {t} as from '{path}/{t}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(path))
    want = duck.sql(catalog.ORACLES[name])
    got = sorted(tuple(r[c] for c in want.columns) for r in df.collect())
    assert got == sorted(want.fetchall())
    return got


def test_documents_of_several_paragraphs(spark, tmp_path):
    assert both(spark, tmp_path, "paragraphs_of_documents") == [(1, 0, 3), (1, 1, 3), (1, 2, 5), (2, 0, 5), (2, 1, 6), (3, 0, 21)]


def test_questions_of_more_than_three_parts(spark, tmp_path):
    got = both(spark, tmp_path, "decompose_question")
    assert got == [(1, 3, "What is a|what is b|c"), (2, 1, "Plain question?"), (3, 2, "x|y"), (4, 3, "a|b|c")]


def test_iif_over_all_orders(spark):
    sf = "/root/testdata/sf0.001"
    assert catalog.QUERIES["guarded_iif"](spark, sf).count() == spark.read.parquet(f"{sf}/orders.parquet").count() > 500


def test_a_sheet_keeps_all_rows():
    raw = "name,amount\n" + "".join(f"row{i},{i}\n" for i in range(100_005))
    out = read_csv(raw.encode())
    assert sum(len(e["rows"]) - 1 for e in out if e.get("rows")) == 100_005
    assert any("100005" in e["text"].replace(",", "") for e in out if not e.get("rows"))  # its summary says so


def test_p95_ranks_one_range(spark):
    rng = random.Random(9)
    for values in ([rng.random() for _ in range(5000)], [1.5] * 40 + [2.5], [3.0], [float(rng.randrange(5)) for _ in range(300)]):
        rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "seconds double")
        assert usage.p95(rows).first().p95 == sorted(values)[min(len(values) - 1, int(0.95 * len(values)))]
    empty = spark.createDataFrame([], "seconds double")
    assert usage.p95(empty).first().p95 is None
    counts = usage.p95(spark.range(10_000).select(F.col("id").cast("double").alias("seconds")))._jdf.queryExecution().toString()
    assert "windowspecdefinition(part" in counts
