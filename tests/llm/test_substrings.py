import hashlib
import random
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.llm import substrings
from sheaf.llm.automaton import SuffixAutomaton

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", max_size=12), max_size=5), st.text("abcd", max_size=20))
def test_matching_statistics(sequences, text):
    a = SuffixAutomaton()
    for s in sequences:
        a.add(s)
    want = [max(n for n in range(i + 1) if n == 0 or any(text[i - n : i] in s for s in sequences)) for i in range(1, len(text) + 1)]
    assert a.statistics(text) == want
    assert len(a.next) <= 2 * sum(map(len, sequences)) + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=14), st.integers(0, 5)), max_size=6), st.text("abc", max_size=20), st.integers(1, 4))
def test_first_owners(sequences, text, window):
    a = SuffixAutomaton()
    for s, owner in sequences:
        a.add(s, owner)
    a.settle()
    want = []
    for end in range(window, len(text) + 1):
        held = [o for s, o in sequences if text[end - window : end] in s]
        if held:
            want.append((end, min(held)))
    assert list(a.firsts(text, window)) == want


def test_the_automata_decide(spark, monkeypatch):
    """Fingerprints alone would remove more: with spans of whole stretches in place of the matches, the result is wrong."""
    rng = random.Random(3)
    rows = [(d, " ".join(rng.choice("abc") for _ in range(60))) for d in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d: n for d, (_, n, _) in brute(rows, 7).items()}
    assert {r.doc_id: r.n_removed for r in substrings.repeat_report(docs, window=7).collect()} == want

    def all_of_it(contents, window):
        span = substrings.F.expr("array(struct(0 as begin, cast(length(words) / 8 as int) as end, cast(-1 as bigint) as first)) as spans")
        return contents.select("k1", "k2", span)

    monkeypatch.setattr(substrings, "match", all_of_it)
    got = {r.doc_id: r.n_removed for r in substrings.repeat_report(docs, window=7).collect()}
    assert got != want and sum(got.values()) > sum(want.values())


def brute(rows, window):
    words = {d: WORD.findall(t or "") for d, t in rows if d is not None}
    first = {}
    for d in sorted(words):
        w = words[d]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("window", [13, 6])
def test_against_brute_force(spark, monkeypatch, window):
    monkeypatch.setattr(substrings, "SHARD_WORDS", 120)
    monkeypatch.setattr(substrings, "KEY_WORDS", 120)  # all three kinds of keys
    monkeypatch.setattr(substrings, "GROUP_PLACES", 12)
    rng = random.Random(window)
    word = lambda: rng.choice("abcdefgh") + rng.choice(["", "", "é", "1"])
    passages = [[word() for _ in range(rng.randrange(5, 40))] for _ in range(12)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "x " * 30_000), (5, "x " * 12_000 + "y"), (6, "few words here")]
    for d in range(10, 80):
        t = []
        for _ in range(rng.randrange(6)):
            t += [word() for _ in range(rng.randrange(15))] + rng.choice(passages)[rng.randrange(4) : rng.randrange(10, 41)]
        rows.append((d, rng.choice([" ", "\n", "  "]).join(t)))
    rows += [(90 + i, rows[20][1]) for i in range(5)] + [(99, "few words here")]
    docs = spark.createDataFrame([(d, t, "n", 1) for d, t in rows] + [(None, rows[20][1], "n", 1), (90, rows[20][1], "n", 2)], "doc_id long, text string, version string, n_words int")
    want = brute(rows, window)
    got = substrings.repeat_report(docs, window=window).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id], r.doc_id
    assert sum(n for _, n, _ in want.values()) > 500
    assert substrings.repeat_report(docs.limit(0)).count() == 0


def test_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    c = duckdb.connect()
    c.sql(f"create view documents as from '{path}'")
    assert sorted(map(tuple, substrings.repeat_report(spark.read.parquet(path)).collect())) == sorted(c.sql(substrings.REPEAT_SQL).fetchall())
