import random
import re

from sheaf.llm.decontam import MASKS, decontaminate, find_overlaps, lossless, masks_for, may_differ

WORDS = [f"w{i}" for i in range(40)]


def brute(docs, items, window=16, share=0.75):
    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for d, t in docs:
        for i, b in items:
            w, v = norm(t), norm(b)
            if not v or d is None:
                continue
            best = None
            for g in range(-len(v) + 1, len(w)):
                low, high = max(0, -g), min(len(v), len(w) - g)
                masks = MASKS if len(v) >= 11 else ("1" * len(v),)
                hit = any(all(low <= p + k < high and w[g + p + k] == v[p + k] for k, c in enumerate(m) if c == "1") and p + len(m) <= high for m in masks for p in range(low, high - len(m) + 1))
                if not hit:
                    continue
                same = [w[g + x] == v[x] for x in range(low, high)]
                n = min(window, len(v))
                sums = [sum(same[k : k + n]) / n for k in range(len(same) - n + 1)]
                if sums and max(sums) >= share:
                    best = max(best or (-1,), (sum(same), max(sums), -g))
            if best:
                out[d, i] = best
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(0, text(30)), (1, text(12)), (2, "Short, one!"), (3, text(18)), (5, None), (6, "")]
    items.append((4, items[0][1].upper()))  # a copy but for case
    docs = [(None, items[0][1]), (1, None), (2, ""), (3, "x y short one z"), (4, text(20_000))]
    for k in range(60):
        passage = items[rng.choice([0, 1, 3])][1].split()
        for _ in range(rng.randrange(7)):
            passage[rng.randrange(len(passage))] = "other"
        cut = passage[: rng.randrange(5, 31)]
        docs.append((10 + k, text(rng.randrange(30)) + " " + " ".join(cut) + ", " + text(rng.randrange(30))))
    d = spark.createDataFrame([(i, t, 7) for i, t in docs] + [(10, docs[5][1], 8)], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): (r.matched_words, r.best_share, -r.doc_word) for r in find_overlaps(d, b).collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 20
    kept = decontaminate(d, b)
    assert kept.columns == d.columns
    bad = {k for k, _ in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs + [(10, "")] if i not in bad)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "item_id long, text string")
    assert find_overlaps(d.limit(0), b).count() == 0 and find_overlaps(d, b.limit(0)).count() == 0
    assert decontaminate(d, b.limit(0)).count() == 1


def test_planted_passages(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in find_overlaps(docs, items).collect()}
    texts = {r.item_id: r.text for r in items.collect()}
    assert got == {(r.doc_id, i) for r in docs.collect() for i, t in texts.items() if t in (r.text or "")}


def test_no_python_in_the_plan(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    plan = find_overlaps(docs, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def all_alignments(docs, items, window=16, share=0.75):
    """Every diagonal of every pair, without masks."""
    out = {}
    for d, t in docs:
        for i, b in items:
            w, v = t.split(), b.split()
            n, best = min(window, len(v)), None
            for g in range(-len(v) + 1, len(w)):
                same = [w[g + x] == v[x] for x in range(max(0, -g), min(len(v), len(w) - g))]
                sums = [sum(same[k : k + n]) / n for k in range(len(same) - n + 1)]
                if sums and max(sums) >= share:
                    best = max(best or (-1,), (sum(same), max(sums), -g))
            if best:
                out[d, i] = best
    return out


def test_no_accepted_alignment_is_missed(spark):
    rng = random.Random(5)
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 16, 40)]
    docs = []
    for n, t in items:
        passages = [[w if k % 4 != r else "other" for k, w in enumerate(t.split())] for r in range(4)]  # every fourth word replaced
        for _ in range(12):
            passages.append(t.split())
            for k in rng.sample(range(n), may_differ(min(n, 16), 0.75) + rng.randrange(2) if n > 1 else 0):
                passages[-1][k] = "other"
        docs += [(len(docs) + k, "begin here " + " ".join(p) + " and end") for k, p in enumerate(passages)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for share in (0.75, 0.6):
        got = {(r.doc_id, r.item_id): (r.matched_words, r.best_share, -r.doc_word) for r in find_overlaps(d, b, min_share=share).collect()}
        want = all_alignments(docs, items, share=share)
        assert got == want and len(want) > 100


def test_masks_are_lossless():
    for n in range(1, 17):
        assert lossless(masks_for(n, 0.75), n, may_differ(n, 0.75))
    assert all(masks_for(n, 0.75) == MASKS for n in range(11, 17))
    assert not lossless(("11101101011", "11011010111"), 16, 2)
