import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.llm import neardup
from sheaf.llm.common import checkpoint_dir_set
from sheaf.llm.shingles import grams, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB \t\néZ"), max_size=30), min_size=1, max_size=5), st.integers(1, 5))
def test_hashes_stand_for_words(texts, n):
    h, s = word_hashes(texts)
    g, gs = grams(h, s, n)
    seen = {}
    for i, t in enumerate(texts):
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t))
        assert s[i + 1] - s[i] == len(w)
        want = [tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if w else []
        assert gs[i + 1] - gs[i] == len(want)
        for x, y in zip(g[gs[i] : gs[i + 1]].tolist(), want, strict=True):
            assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)


def brute(rows):
    """{doc: component} by comparing all pairs of distinct sets."""
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d, _ in sets}


def made_up():
    rng = random.Random(4)
    word = lambda: "w" + str(rng.randrange(5_000))
    rows = [(100, None), (101, ""), (102, " \n"), (103, "short one"), (104, "Short ONE"), (105, "x " * 30_000), (106, "x " * 29_000)]
    d = 200
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(30, 300))]
        for _ in range(rng.randrange(1, 12)):
            t = list(base)
            for _ in range(rng.randrange(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = word()
            rows.append((d, " ".join(t)))
            d += rng.randrange(1, 4)
    chain = [word() for _ in range(200)]  # each link holds, the ends are far apart
    for i in range(25):
        rows.append((5000 - i, " ".join(chain)))
        chain = chain[5:] + [word() for _ in range(5)]
    rng.shuffle(rows)
    return rows


def test_a_group_around_the_threshold(spark):
    """Copies of one text, most too far from each other to be linked, and close copies of some of those."""
    rng = random.Random(9)
    word = lambda: "w" + str(rng.randrange(5_000))
    base = [word() for _ in range(150)]

    def altered(text, n):
        t = list(text)
        for k in rng.sample(range(len(t)), n):
            t[k] = word()
        return t

    texts = [altered(base, rng.randrange(8)) for _ in range(160)]
    texts += [altered(t, 1) for t in texts[:40]] + [altered(t[: rng.randrange(120, 150)], 1) for t in texts[40:60]]
    rows = list(enumerate(" ".join(t) for t in texts))
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = brute(rows)
    assert got == want
    assert 20 < len(set(want.values())) < 150


def test_against_all_pairs(spark):
    rows = made_up()
    docs = spark.createDataFrame([(d, t, 1, "q") for d, t in rows] + [(None, "short one", 1, "q"), (103, "short one", 2, "q")], "doc_id long, text string, n_shingles int, sig string")
    want = brute(rows)
    got = neardup.duplicate_report(docs).collect()
    assert len(got) == len(rows) + 2
    texts = dict(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], len(shingles(texts[r.doc_id])), want[r.doc_id] == r.doc_id)
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, c in want.items() if d == c} | {None}
    assert neardup.duplicate_report(docs.limit(0)).count() == 0


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in neardup.duplicate_report(docs).collect()} == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(500 + rng.randrange(40), 500 + rng.randrange(40)) for _ in range(25)] + [(1000, x) for x in range(1001, 1400)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    got = neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == parent and len(got) == len(parent)


def test_bounds_follow_the_posterior():
    grid = np.linspace(0, 1, 200_001)
    for n, m in neardup.least_matches(0.85):
        tail = []
        for k in (m - 1, m):
            density = grid**k * (1 - grid) ** (n - k)
            tail.append(density[grid >= 0.85].sum() / density.sum())
        assert tail[0] < neardup.MISS * 1.01 and tail[1] > neardup.MISS * 0.99


def boilerplate(n, seed=8):
    """Texts of 300 words around the threshold: most have a share of a common page's words of their own, some are variants of another."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    page, rows = [word() for _ in range(300)], []
    for i in range(n):
        text = list(page) if i % 10 else list(rows[rng.randrange(len(rows))][1]) if rows else list(page)
        at = rng.randrange(250)
        text[at : at + (rng.randrange(18, 30) if i % 10 else 4)] = [word() for _ in range(rng.randrange(18, 30) if i % 10 else 4)]
        rows.append((i, text))
    return [(i, " ".join(t)) for i, t in rows]


@pytest.mark.parametrize("n", [300, 1200])
def test_shared_boilerplate_makes_few_pairs(spark, monkeypatch, n):
    rows, made = boilerplate(n), {}

    def counting(self, df, name, store=neardup.Scratch.store):
        out = store(self, df, name)
        if name in ("cross", "first"):
            made[name] = out.count()
        return out

    monkeypatch.setattr(neardup.Scratch, "store", counting)
    got = {r.doc_id: r.component_id for r in neardup.duplicate_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert len(set(got.values())) > n / 20  # many stay apart
    assert made["cross"] < 0.05 * n * (n - 1) / 2, made


def test_rounds_over_few_edges_take_few_tasks(spark):
    """The driver keeps account of every task: a round over a few edges must not deal them to all shuffle partitions again and again."""
    sc, conf = spark.sparkContext, {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    checkpoint_dir_set(spark)
    edges = [(k + 1, k) for k in range(1, 12)] + [(k, 100) for k in range(101, 160)]
    df = spark.createDataFrame(edges, "a long, b long").coalesce(1)
    last = max(sc.statusTracker().getJobIdsForGroup(), default=-1)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {(r.node, r.label) for r in neardup.components(df).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    time.sleep(1)  # the tracker follows a little later
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup() if j > last]
    stages = [sc.statusTracker().getStageInfo(s) for s in {s for j in jobs for s in j.stageIds}]
    assert got == {(k, 1) for k in range(1, 13)} | {(k, 100) for k in range(100, 160)}
    assert sum(s.numCompletedTasks for s in stages if s) < 2500
