import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from sheaf.llm.packing import Encoder, conversation_report, pack, pack_block, packing_report


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


ENCODER = []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "\n", "the", "é", "ß", ".", "  ", "\t", " \n", "9", "'s", " ", " ", "x1", "😀", "\x1c", "\r\n", "<|endoftext|>", "###"]), max_size=14))
def test_ids_equal_the_tokenizers_ids(parts):
    import public_tokenizers
    from tokenizers import Tokenizer

    if not ENCODER:
        t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        t.encode_special_tokens = True
        ENCODER.extend([Encoder(), t])
    text = "".join(parts)
    assert np.frombuffer(ENCODER[0](text), "<u4").tolist() == ENCODER[1].encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90), st.integers(0, 40)), max_size=40), st.tuples(st.integers(1, 32), st.integers(1, 6), st.integers(1, 32)))
def test_limits_hold_and_nothing_is_lost(items, limits):
    sizes = np.array([n for n, _ in items], dtype=np.int64)
    losses = [np.maximum(np.arange(n + 1) - p, 0) if p else None for n, p in items]
    seen, bins = {}, {}
    for d, a, n, s, o in pack_block(sizes, losses, limits, np.arange(len(items))):
        seen.setdefault(d, []).append((a, n))
        bins.setdefault(s, []).append((o, n, n if losses[d] is None else int(losses[d][a + n] - losses[d][a])))
    for d, n in enumerate(sizes):
        at = 0
        for a, k in sorted(seen[d]):
            assert a == at and k > 0
            at += k
        assert at == n
    for pieces in bins.values():
        at = 0
        for o, n, _ in sorted(pieces):
            assert o == at
            at += n
        assert at <= limits[0] and len(pieces) <= limits[1] and sum(x for *_, x in pieces) <= limits[2]
    assert sorted(bins) == list(range(len(bins)))


def test_whole_table(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.union(docs.limit(1).selectExpr("9999", "cast(null as string)", "lang", "source", "n_chars")).withColumnRenamed("source", "start")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = packing_report(docs.coalesce(2)).collect()
    total = used = 0
    for d, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        pieces = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start)
        assert sum(r.length for r in pieces) == len(ids) and {r.doc_tokens for r in pieces} == {len(ids)}
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in by.values():
        assert sum(n for _, n in p) <= 1024
        total, used = total + 1024, used + sum(n for _, n in p)
    assert used / total > 0.98
    assert pack(docs.limit(0)).count() == 0


def test_prompts_bear_no_loss(spark):
    docs = spark.createDataFrame([(1, "question here", 9), (2, "all of it", None), (1, "question here", 9)], "doc_id long, text string, at int")
    rows = pack(docs.coalesce(1), loss_from_col="at", max_loss_tokens=8).collect()
    assert sum(r.length for r in rows) > sum(r.loss_tokens for r in rows) > 0
    with pytest.raises(ValueError):
        pack(docs, max_segments=0)


def test_added_tokens_in_text(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))  # as it is, added tokens found in text
    texts = ["one <|endoftext|> two", "<|endoftext|>", "x<|endoftext|>\n<|endoftext|> y", "<|endoftext| >", "plain words here", "two  blanks <|endoftext|>"]
    assert loaded.encode(texts[0], add_special_tokens=False).ids == [505, 220, 50256, 734]
    rows = {r.doc_id: r for r in pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        ids = loaded.encode(t, add_special_tokens=False).ids + [0]
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == ids and rows[i].doc_tokens == len(ids)


def test_three_limits_bind_on_instruction_data(spark, tokenizer):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    said = {(r.conv_id, r.turn): (r.role, r.text or "") for r in turns.collect()}
    want = {}
    for (c, t), (role, text) in said.items():
        if role == "assistant":
            prompt = said[c, t - 1][1] + "\n" if (c, t - 1) in said else ""
            ids = tokenizer.encode(prompt + text, add_special_tokens=False)
            want[f"{c}:{t}"] = (len(ids.ids) + 1, sum(a >= len(prompt) for a, _ in ids.offsets) + 1)
    rows = conversation_report(turns.coalesce(1)).collect()
    got, by = {}, {}
    for r in rows:
        n, loss = got.get(r.example_id, (0, 0))
        got[r.example_id] = (n + r.length, loss + r.loss_tokens)
        by.setdefault(r.sequence_id, []).append(r)
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] for k in got)
    assert sum(got[k] == want[k] for k in got) >= 0.98 * len(got)  # a token over the prompt's end is the prompt's; offsets leave out leading blanks
    full = [(sum(r.length for r in p), len(p), sum(r.loss_tokens for r in p)) for p in by.values()]
    assert all(a <= 1024 and b <= 4 and c <= 880 for a, b, c in full)
    assert any(b == 4 for _, b, _ in full) or any(c == 880 for *_, c in full)


def test_all_three_limits_bind_and_little_is_padded(spark):
    sf = "/root/testdata/sf0.1"
    docs, turns = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "conversations"))
    for rows, loss, padding in ((packing_report(docs), 960, 0.02), (conversation_report(turns), 880, 0.02)):
        g = rows.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.count("*").alias("pieces"), F.sum("loss_tokens").alias("loss"))
        share = lambda c: F.avg(c.cast("int"))
        full, segments, bears, mean = g.agg(share(F.col("tokens") == 1024), share(F.col("pieces") == 4), share(F.col("loss") == loss), F.avg("tokens")).first()
        assert min(full, segments, bears) >= 0.05 and 1 - mean / 1024 <= padding, (full, segments, bears, mean)
