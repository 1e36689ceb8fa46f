import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.llm import spelling

SF = "/root/testdata/sf0.001"


def plain(rows, modulus=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if modulus and h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 3}
    alphabet = sorted({c for w in counts for c in w})
    out = {}
    for w, n in counts.items():
        near = {w[:i] + c + w[j:] for i in range(len(w) + 1) for c in ["", *alphabet] for j in (i, i + 1) if j <= len(w)} - {w}
        near = [x for x in near if x in counts]
        form = min(near, key=lambda x: (-counts[x], x), default=None)
        form = form if form and counts[form] >= 2 * n else None
        out[w] = (form, n, len(near), counts[form] if form else None)

    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w

    return {w: (form, root(w), n, near, form_n) for w, (form, n, near, form_n) in out.items()}


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_words_of_a_table_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = found(spelling.variant_report(docs))
    assert got == plain([(r["doc_id"], r["text"]) for r in docs.collect()]) and any(f for f, *_ in got.values())


def test_chains_ties_nulls_and_clashing_columns(spark):
    chain = [("colour", 64), ("colours", 30), ("colourss", 12), ("colourssy", 5), ("coloursy", 3)]  # the last has a tie of lengths near it
    ties = [("bbbbb", 8), ("abbbb", 8), ("cbbbb", 3), ("ÀBBBB", 3), ("ßtraße", 4), ("straße", 9), ("four", 99), ("×÷×÷×", 3)]
    text = " ".join(w for w, n in chain + ties for _ in range(n)).replace("bbbbb", "BbBbB", 2)
    rows = [(1, text, "x", 1, "r"), (1, text, "x", 1, "r"), (2, None, "x", 1, "r"), (None, "colour " * 200, "x", 1, "r"), (3, "", "x", 1, "r"), (4, "-" * 10 + "loner" * 40_000, "x", 1, "r")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, word string, n bigint, root string")
    assert found(spelling.variant_report(docs)) == plain([r[:2] for r in rows])
    every = found(spelling.variant_groups(docs, typo_modulus=None))
    assert every == plain([r[:2] for r in rows], None) and every["colourssy"][1] == "colour"


def test_empty_table_and_ratio(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.variant_report(docs).collect() == []
    with pytest.raises(ValueError):
        spelling.variant_groups(docs, ratio=1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcé", min_size=4, max_size=4), min_size=1, max_size=6, unique=True))
def test_the_neighbourhood_is_complete_and_distinct(words):
    alphabet = np.array(sorted(map(ord, "abcé")), np.uint32)
    everything = np.full(1 << 12, 255, np.uint8)  # a table that drops nothing
    got = list(spelling.neighbours(words, alphabet, everything, 15))
    assert len(got) == len(set(got))
    for j, w in enumerate(words):
        want = {w[:i] + c + w[k:] for i in range(5) for c in ["", *"abcé"] for k in (i, i + 1) if k <= 4} - {w}
        assert {x for i, x in got if i == j} == want


def test_candidates_hash_like_words():
    words = ["schön", "grune"]
    alphabet = np.array(sorted({ord(c) for w in words for c in w}), np.uint32)
    table = np.zeros(1 << 17, np.uint8)
    for known in (["schon"], ["grün"], ["grunde"]):
        for p in spelling.bits_of(spelling.hashes(known), 20):
            table[p >> np.uint64(3)] |= np.uint8(1) << (p & np.uint64(7)).astype(np.uint8)
    alphabet = np.array(sorted({*alphabet.tolist(), ord("d"), ord("ü")}), np.uint32)
    assert set(spelling.neighbours(words, alphabet, table, 20)) == {(0, "schon"), (1, "grunde")}


def test_tasks_without_words(spark):
    docs = spark.createDataFrame([(1, "colour colour colour"), (2, None), (3, "1 2 3"), (4, "")], "doc_id bigint, text string").repartitionByRange(8, "doc_id")
    assert found(spelling.variant_groups(docs, typo_modulus=None)) == {"colour": (None, "colour", 3, 0, None)}
