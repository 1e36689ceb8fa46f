import random

import corpus_pipeline
from sheaf.llm import langid

from .test_decontam import brute as overlaps
from .test_linededup import brute as repeated
from .test_neardup import brute as groups
from .test_neardup import shingles
from .test_packing import Encoder


def test_stages_against_plain_versions(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rng = random.Random(8)
    rows = [tuple(r) for r in source.collect()]
    top = max(r[0] for r in rows) + 1
    item = items.first().text
    for i, r in enumerate(rng.sample(rows, 12)):  # near copies, junk, and an item that isn't whole
        words = r[1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((top + i, " ".join(words) if i < 8 else "12 34 !!" if i < 10 else r[1][:200] + "\n" + item, r[2], r[3], 0))
    path = str(tmp_path / "t")
    docs = spark.createDataFrame(rows, source.schema)
    docs.coalesce(2).write.parquet(f"{path}/documents.parquet")
    items.write.parquet(f"{path}/benchmark.parquet")
    state, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in state.collect()}
        stage(spark, state, path).write.parquet(f"{path}/{name}")
        state = spark.read.parquet(f"{path}/{name}")
        if name == "packing":
            break
        assert state.columns == columns
        after = {r.doc_id: r.text for r in state.collect()}
        ordered = sorted(before.items())
        if name == "language_id":
            assert after == {d: t for d, t in before.items() if any(c.isalpha() for c in t or "")} and len(after) < len(before)
        elif name == "line_dedup":
            gone = repeated(ordered)
            want = {d: "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone.get(d, ())) for d, t in ordered}
            assert after == {d: t for d, t in want.items() if t.strip() or d not in gone}
        elif name == "minhash_near_dedup":
            group = groups(ordered)
            assert after == {d: t for d, t in ordered if group[d] == d} and len(after) < len(before)
        else:
            bad = {d for d, _ in overlaps(ordered, [(r.item_id, r.text) for r in items.collect()])}
            assert after == {d: t for d, t in ordered if d not in bad} and bad
    encode = Encoder()
    tokens = {}
    for r in state.collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == {d: len(encode(t)) // 4 + 1 for d, t in after.items()}


def test_run_is_the_stages_in_turn(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and set(rows.columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language_id" and len(corpus_pipeline.STAGES) == 5
    assert langid.BITS  # trained here, on a bounded sample


def test_near_duplicates_from_four_fifths_on_go(spark):
    rng = random.Random(6)
    base = [f"w{k}" for k in range(300)]
    rows, sim = [(1, " ".join(base))], {}
    for d in range(2, 42):  # each resembles only the first
        words = list(base)
        for k in rng.sample(range(10, 290), 6):
            words[k] = f"x{d}y{k}"
        rows.append((d, " ".join(words)))
        a, b = shingles(rows[0][1]), shingles(rows[-1][1])
        sim[d] = len(a & b) / len(a | b)
    assert any(0.8 <= x < 0.85 for x in sim.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["minhash_near_dedup"](spark, docs, "").collect()}
    assert kept == {1} | {d for d, x in sim.items() if x < 0.8}


def test_stages_take_nulls_repeats_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone int, bad string, removed int"
    long = " ".join(f"word{k}" for k in range(40))
    rows = [(1, long, "en", "s", 1, 1, "b", 1), (1, long, "en", "s", 1, 1, "b", 1), (None, long, None, None, None, None, None, None), (2, None, "en", "s", 1, 1, "b", 1), (3, "", "en", "s", 1, 1, "b", 1), (4, long, "en", "s", 1, 2, "c", 2)]
    docs = spark.createDataFrame(rows, schema)
    stages = dict(corpus_pipeline.STAGES)
    left = lambda name, d: sorted((str(r.doc_id), r.text) for r in stages[name](spark, d, "/root/testdata/sf0.001").select("doc_id", "text").collect())
    assert left("line_dedup", docs) == [("1", long), ("1", long), ("2", None), ("3", ""), ("None", long)]  # 4 repeats 1, and nothing is left of it
    assert left("minhash_near_dedup", docs) == [("1", long), ("1", long), ("2", None), ("3", ""), ("None", long)]
    assert len(left("benchmark_decontamination", docs)) == 6
    for name in ("line_dedup", "minhash_near_dedup", "benchmark_decontamination"):
        assert stages[name](spark, docs, "/root/testdata/sf0.001").columns == docs.columns and left(name, docs.limit(0)) == []
    assert left("language_id", docs.limit(0)) == []
    assert stages["packing"](spark, docs.limit(0), "").count() == 0 and stages["packing"](spark, docs, "").select("doc_id").count() >= 6
