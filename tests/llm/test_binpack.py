import bisect
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.llm import binpack, configlp

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def checked(rows, docs, tokenizer, capacity=4096):
    """Holds the pieces against the tokenizer's own ids and the rules of a packing; returns the number of sequences."""
    want = []
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(doc_id, k, a, min(capacity, len(ids) - a), zlib.crc32(ids[a : a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins)


def test_documents_fill_sequences_near_the_bound(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = binpack.best_fit_report(docs.repartition(3)).collect()
    bins = checked(rows, [tuple(r) for r in docs.collect()], tokenizer)
    assert bins <= 1.02 * sum(r["length"] for r in rows) / 4096 + 1


def test_nulls_repeats_long_texts_and_clashing_columns(spark, tokenizer):
    rows = [(1, "a b", 5, "x"), (1, "a b", 5, "x"), (2, None, 5, "x"), (3, "", 5, "x"), (None, "no id", 5, "x"), (4, "word <|endoftext|> d’été İ \x1c   x́ " * 3000, 5, "x"), (5, "q" * 30_000, 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length bigint, task string")
    out = binpack.pack(docs)
    checked(out.collect(), [r[:2] for r in rows], tokenizer)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in out.collect())
    assert binpack.best_fit_report(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_a_hot_length_over_many_tasks(spark, tokenizer):
    docs = spark.range(0, 600).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'same words here', repeat('more words ', 1 + int(id % 50))) AS text")
    checked(binpack.best_fit_report(docs.repartition(7)).collect(), [tuple(r) for r in docs.collect()], tokenizer)


TEXTS = ["a", " ", "\n", "The", "é", "ß", ".", "'s", "\t", "９", "12", "́", "İ", "　", "\x85", "\x1c", "😀", "<|endoftext|>", "|>", "#", "don't", "'", "''S", "ÀB", "×", "ÿ", "_", "1st"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(TEXTS), max_size=14))
def test_ids_equal_the_tokenizers(parts):
    encode, text = binpack.word_encoder(None), "".join(parts)
    assert np.frombuffer(encode([text])[0], "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_full_cache_changes_nothing():
    import public_tokenizers

    encode, whole = binpack.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), most=3), binpack.word_encoder(None)
    for text in ("one two three", "three four five six", "one one seven", "five two " + "x" * 200):
        assert encode([text]) == whole.apart([text])
        assert all(len(x) <= 7 for x in (encode.young, encode.old))


def exact(lengths, capacity):
    """The least number of bins, by exhaustive search."""
    best = [len(lengths)]

    def go(i, room):
        if len(room) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(room)
            return
        for j in sorted(set(room)):
            if j >= lengths[i]:
                k = room.index(j)
                go(i + 1, room[:k] + [j - lengths[i]] + room[k + 1 :])
        go(i + 1, [*room, capacity - lengths[i]])

    go(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_plans_use_each_length_once_and_stay_near_the_optimum(items):
    lengths, counts = np.unique(items, return_counts=True)
    plans, bound = configlp.plan(lengths, counts, 20)
    used = {}
    for p in plans:
        assert sum(n * k for n, k in p.lengths) <= 20
        for n, k in p.lengths:
            used[n] = used.get(n, 0) + k * p.bins
    assert used == dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    least, bins = exact(sorted(items, reverse=True), 20), sum(p.bins for p in plans)
    assert bound <= least + 1e-9 and least <= bins <= least + 1
    assert sorted(range(bins)) == sorted(b for p in plans for b in range(p.first, p.first + p.bins))


@pytest.mark.parametrize(("draw", "most"), [("uniform", 1.02), ("halves", 1.02), ("thirds", 0.98), ("long tail", 1.003)])
def test_large_histograms_against_best_fit_decreasing(draw, most):
    rng = np.random.default_rng(1)
    items = {"uniform": rng.integers(1, 1025, 6000), "halves": rng.integers(480, 560, 3000), "thirds": rng.choice([300, 341, 343, 400], 4000), "long tail": np.minimum(rng.lognormal(4, 1.2, 20_000).astype(int) + 1, 1024)}[draw]
    lengths, counts = np.unique(items, return_counts=True)
    plans, bound = configlp.plan(lengths, counts, 1024)
    room = []
    for n in sorted(items.tolist(), reverse=True):
        i = bisect.bisect_left(room, n)
        bisect.insort(room, (room.pop(i) if i < len(room) else 1024) - n)
    bins = sum(p.bins for p in plans)
    assert bound <= bins <= most * len(room) + 1


def test_the_knapsack_prices_as_a_plain_one():
    lengths, values = np.array([3, 5, 7]), np.array([2.0, 4.0, 5.9])
    best = configlp.knapsack(lengths, values, 30)
    for c in range(31):
        want = max(2 * a + 4 * b + 5.9 * d for a in range(11) for b in range(7) for d in range(5) if 3 * a + 5 * b + 7 * d <= c)
        assert abs(best[c] - want) < 1e-9
