"""Tables that change by key, and the vector index over one."""

import random

import numpy as np
from pyspark.sql import functions as F

from sheaf.operators import retrieval
from sheaf.operators.vectorindex import VectorIndex
from sheaf.operators.versioned import VersionedTable, upsert_stream

SF = "/root/testdata/sf0.1"


def content(df):
    return sorted((r["doc"], r["n"]) for r in df.collect()) if df is not None else []


def test_random_changes_equal_a_dictionary(spark, tmp_path):
    rng, table, plain = random.Random(3), VersionedTable(spark, str(tmp_path / "t"), ["doc"]), {}
    assert table.live() is None and table.compact() == 0
    snapshots = {}
    for step in range(14):
        docs = rng.sample(range(12), rng.randrange(1, 5))
        what = rng.choice(["replace", "replace", "delete", "compact"])
        if what == "replace":
            rows = [(d, rng.randrange(100)) for d in docs for _ in range(rng.randrange(1, 4))]
            version = table.replace(spark.createDataFrame(rows, "doc int, n int"), f"b{step}")
            plain |= {d: sorted(n for x, n in rows if x == d) for d in docs}
        elif what == "delete":
            version = table.delete(spark.createDataFrame([(d,) for d in docs], "doc int"))
            plain = {d: ns for d, ns in plain.items() if d not in docs}
        else:
            version = table.compact()
        snapshots[version] = sorted((d, n) for d, ns in plain.items() for n in ns)
        assert content(table.live()) == snapshots[version]
    for version, rows in snapshots.items():  # older versions stay readable
        if version:
            assert content(table.live(version)) == rows
    assert table.vacuum(keep=1) and content(table.live()) == rows


def test_a_repeated_batch_changes_nothing_and_readers_keep_their_version(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["doc"])
    put = upsert_stream(table)
    put(spark.createDataFrame([(1, 10), (2, 20)], "doc int, n int"), 0)
    reader = table.live()
    put(spark.createDataFrame([(1, 11)], "doc int, n int"), 1)
    put(spark.createDataFrame([(1, 99)], "doc int, n int"), 0)  # run again after the second one
    assert content(reader) == [(1, 10), (2, 20)] and content(table.live()) == [(1, 11), (2, 20)]
    table.compact()
    put(spark.createDataFrame([(2, 77)], "doc int, n int"), 1)
    assert content(table.live()) == [(1, 11), (2, 20)]
    # a writer that was lost leaves a part and a manifest without a mark of success: neither counts
    spark.createDataFrame([(5, 5)], "doc int, n int").write.parquet(str(tmp_path / "t/parts/lost/rows"))
    (tmp_path / "t/manifests/000000000099").mkdir()
    assert content(table.live()) == [(1, 11), (2, 20)]
    table.replace(spark.createDataFrame([(3, 30, "new")], "doc int, n int, more string"))
    assert {(r.doc, r.more) for r in table.live().collect()} == {(1, None), (2, None), (3, "new")}


def test_exact_search_misses_nothing(spark, tmp_path):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    q = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = VectorIndex(spark, str(tmp_path / "v")).create(v, slices=2)  # coarse codes
    want = {(r.query_id, r.vec_id, r.score, r["rank"]) for r in retrieval.dense(v, q).collect()}
    got = lambda **o: {(r.query_id, r.vec_id, r.score, r["rank"]) for r in index.search(q, **o).collect()}
    assert got(candidates=10) != want and got(candidates=10, exact=True) == want
    assert got(candidates=4, probes=1, exact=True) == want  # fewer than k found at first


def test_recall_of_codes_and_equality_after_changes(spark, tmp_path):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = VectorIndex(spark, str(tmp_path / "v")).create(v.where("vec_id % 3 <> 0"))
    index.upsert(v.where("vec_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x)))  # wrong ones at first
    index.upsert(v.where("vec_id % 3 = 0"))
    index.delete(v.where("vec_id % 7 = 0"))
    assert index.move_from(v.where("vec_id % 14 = 0")) and index.rows().count() == v.where("vec_id % 7 <> 0 OR vec_id % 14 = 0").count()
    want = retrieval.dense(v.where("vec_id % 7 <> 0 OR vec_id % 14 = 0"), q).select("query_id", "vec_id", "score", "rank")
    assert index.recall(q, want, candidates=50) >= 0.9
    full = lambda: sorted(map(tuple, index.search(q, candidates=4000).collect()))
    before = full()
    assert before == sorted(map(tuple, want.collect()))
    index.compact()
    assert full() == before and index.recall(q, want, candidates=50) >= 0.9


def test_clustered_vectors_need_few_cells(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    rows = [(i, (centres[i % 40] + 0.25 * rng.normal(size=32)).tolist()) for i in range(3000)]
    v = spark.createDataFrame([*rows, (9001, None), (9002, [0.0] * 32), (9003, [1.0])], "vec_id long, embedding array<float>")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = VectorIndex(spark, str(tmp_path / "v")).create(v, slices=8)
    want = retrieval.dense(v.where("vec_id < 9000"), q)
    assert index.rows().count() == 3000 and index.recall(q, want, probes=6, candidates=100) >= 0.9
    assert index.search(q.limit(0)).count() == 0
