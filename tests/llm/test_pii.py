import hashlib
import math
import re
import time

from pyspark.sql import functions as F

from sheaf.llm import pii
from sheaf.llm.pii import find_private, private_report, sanitise

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def passes(kind, s):
    digits = re.sub("[^0-9]", "", s)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in s.split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()


def brute(text):
    return [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


CARD = "4041894974608795"
ODD = [
    None, "", "plain", "a@b.c@d.e a@b.com_x@y.z, .@-.-.- x@y x@.y é😀 foo+bar%@ex-am.ple.com.", "a@" + "b." * 5_000 + "c", "a" * 50_000 + "@", "1.2.3.4.5.6.7.8 300.1.2.3.4 001.02.3.255 256.1.1.1 1.2.3",
    CARD, f"5 {CARD}", f"{CARD[:4]} {CARD[4:8]}-{CARD[8:12]} {CARD[12:]}", f"{CARD}  7", f"{CARD} 7", "0" * 16, "0" * 19 + "-" + "1", "+1 (499) 555-6503 ++1 2345678 +12345678901234567 +1234567. +1.2.3.4.5.6.7.8)) +9 8",
    "+1 (499) 555-6503" + " " * 20_000 + "x", "9 " * 20_000, "mail me: a.b@c.de, 10.0.0.1 or +49 30 1234567 " + CARD,
]


def test_base_spans(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(None, "a@b.cd", 1), (2, "plain", 1)], "doc_id long, text string, spans int")
    rows = private_report(docs).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        want = brute(ODD[r.doc_id] if r.doc_id is not None else "a@b.cd")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), (r.doc_id, want, r.spans[:200])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in want) for x in KINDS)
    assert private_report(docs.limit(0)).count() == 0


def corpus():
    docs = [f"The weather report number {i} speaks of clouds" for i in range(60)]
    docs += [f"Case {i}: the Zanzibarian smuggler wrote to bob@evil.com about clouds" for i in range(4)]
    docs += ["clouds again, Zanzibarian clouds", "bob@evil.com alone here", "Rareword near one@once.org", docs[60], docs[61]]
    return docs


def test_terms_against_a_plain_count(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {(s.value, r.actions[s.value]) for s in r.spans if s.kind == "term"} for r in find_private(docs).collect()}
    distinct = set(texts)
    near = {}
    for t in distinct:
        for k, a, b in brute(t):
            window = re.sub(r"\S*@\S*", " ", t[:a] + " " + t[b:])
            for w in set(re.findall(r"[^\W\d_]{4,}", window)):
                near.setdefault((w, t[a:b]), set()).add(t)
    told = {}
    for (w, e), both in near.items():
        n_t, n_e, n = sum(w in re.findall(r"[^\W\d_]{4,}", t) for t in distinct), sum(e in t for t in distinct), len(distinct)
        share = math.log2(len(both) * n / (n_t * n_e)) / math.log2(n / n_e)
        if len(both) >= 3 and share >= 0.8:
            told[w] = "remove" if share >= 0.95 else "generalise"
    assert set(told) == {"Zanzibarian", "smuggler", "wrote", "about", "Case"}
    for i, t in enumerate(texts):
        assert got[i] == ({(w, a) for w, a in told.items() if w in t} if "bob@evil.com" in t else set())


def test_sanitised_text(spark):
    docs = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in sanitise(docs, find_private(docs)).collect()}
    assert clean[0] == corpus()[0] and clean[65] == "[EMAIL] alone here"
    assert "bob@" not in clean[60] and "smuggler" not in clean[60] and "clouds" in clean[60]


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    assert not re.search("PythonUDF|Pandas|ArrowEval", find_private(docs)._jdf.queryExecution().toString())


def test_terms_far_from_the_entity(spark):
    filler = lambda i: " ".join(f"{w} clouds" for w in ["over", "under", "near"] * 20) + f" number {i} "
    texts = [f"The weather report number {i} speaks of clouds over under near" for i in range(60)]
    texts += [f"From Zanzibarian. {filler(i)} sent by <bob@evil.com>" for i in range(4)]  # in the heading, the address in the signature
    texts += [f"Quixotically near al@evil.com number {i}" for i in range(2)] + [f"Quixotically {filler(i)} al@evil.com" for i in range(2)]  # near in some
    texts += [f"Seldomly {filler(i)} eve@evil.com" for i in range(2)]  # too few texts
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {s.value for s in r.spans if s.kind == "term"} for r in find_private(docs).collect()}
    assert all("Zanzibarian" in got[i] for i in range(60, 64)) and all("Quixotically" in got[i] for i in range(64, 68))
    assert not any(got[i] for i in [*range(60), 68, 69]) and not any("clouds" in g for g in got.values())
    clean = sanitise(docs, find_private(docs)).where("doc_id between 60 and 63").collect()
    assert clean and not any("Zanzibarian" in r.text or "bob@" in r.text for r in clean)


def test_rare_entities_back_off_to_domains_and_networks(spark):
    """Terms planted with 20 domains and 20 networks, each address once: all are found, and nothing of the rest."""
    texts = [f"The weather report number {i} speaks of clouds over hills and rivers" for i in range(400)]
    planted = {}
    for k in range(40):
        name = "Term" + "".join(chr(97 + int(c)) for c in str(k))
        for j in range(3 + k % 3):
            who = f"p{j}@firm{k}.example.org" if k < 20 else f"10.7.{k}.{j + 1}"
            planted[len(texts)] = name
            texts.append(f"The {name} report number {j} of clouds went to {who} over hills")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {s.value for s in r.spans if s.kind == "term"} for r in find_private(docs).collect()}
    assert all(got[i] == ({planted[i]} if i in planted else set()) for i in range(len(texts)))


def test_spans_of_many_matches_in_one_text(spark):
    n = 32_000
    text = " ".join(f"é user{i}@d{i % 7}.example.com" for i in range(n))
    df = spark.createDataFrame([(1, text), (2, ""), (3, "a@b.c")], "doc_id long, text string")
    began = time.perf_counter()
    rows = {r.doc_id: r.s for r in df.select("doc_id", pii.matches(F.col("text"), pii.EMAIL, "email").alias("s")).collect()}
    assert time.perf_counter() - began < 30  # not minutes
    assert len(rows[1]) == n and rows[2] == [] and all(text[s.start : s.end] == s.value for s in rows[1][:: 997])
    assert [(s.start, s.end) for s in rows[1]] == [m.span() for m in re.finditer(r"\S+@\S+", text)] and (rows[3][0].start, rows[3][0].end) == (0, 5)
