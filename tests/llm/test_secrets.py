import hashlib
import random
import re
import string

from sheaf.llm.secrets import find_secrets, load_vocabulary, secret_report

ODD = [
    None, "", "no secrets here at all", "token = 'abc'", 'API_KEY: "abcdef12"', "token=token : abcdef1 password=\"x.y/z+1\"",
    "é😀 secret=0123456789abcdef0123456789abcdef!", "AKIA" + "A" * 15, "AKIA" + "A1" * 8, "x" * 50_000 + " a1B2" * 3,
    "key 9fQ2xLr7TgZp4KvW1sYb and 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "id 123e4567-e89b-12d3-a456-426614174000",
]


def brute(text):
    """The base kinds straight from their patterns."""
    text, out = text or "", []
    for k, (p, ok) in enumerate((
        (re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
        (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    )):
        out += [(m.start(), k, m.end()) for m in p.finditer(text) if ok(m)]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_report_matches_patterns(spark):
    docs = spark.createDataFrame([(i, t, "zz") for i, t in enumerate(ODD)] + [(None, "token=abcdefg", "x"), (1, "", "dup")], "doc_id long, text string, spans string")
    got = secret_report(docs).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        if r.doc_id is not None and r.doc_id != 1:
            assert r.base_sha256 == hashlib.sha256(brute(ODD[r.doc_id]).encode()).hexdigest(), ODD[r.doc_id]
    assert secret_report(docs.limit(0)).count() == 0


def test_token_efficiency():
    e = load_vocabulary()
    kinds = lambda t: [k for *_, k in find_secrets(t, e, 2.2)]
    assert kinds("my 9fQ2xLr7TgZp4KvW1sYb key") == ["random"]
    assert kinds("hash 24be64439e3e49cf46b2d7c90f3602a3d0b907ff") == ["hex"]  # a digest isn't random
    assert kinds("123e4567-e89b-12d3-a456-426614174000 internationalization_of_things CamelCaseNameOfThings") == []


def test_random_letters_of_one_case():
    e = load_vocabulary()
    for key in ("kqzvxjwtrplmncbdfghsqwzx", "QZXJKVWPRTMBNDFGHLCY", "kqzvxj-wtrplm-ncbdfg-hsqwzx"):
        assert [key[a - 3 : b - 3] for a, b, k in find_secrets(f"my {key} key", e, 2.2) if k == "random"] == [key]
    for name in ("internationalization", "well-known-side-effects", "INTERNATIONAL_SETTINGS", "input/output/directories", "2024-01-15/2024-02-16", "0123-4567-8901-2345"):
        assert find_secrets(f"the {name} here", e, 2.2) == []


def test_digests_by_context():
    e = load_vocabulary()
    kinds = lambda t: [k for *_, k in find_secrets(t, e, 2.2)]
    digest = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    assert kinds(f"commit {digest}") == kinds(f"sha1: {digest}") == ["hex"]
    assert kinds(f"token = {digest}") == ["assign", "hex", "random"]
    assert kinds(f"commit token={digest}") == ["assign", "hex", "random"]
    assert kinds(f"see {digest}") == ["hex", "random"]


def test_recall_and_precision_of_planted_strings():
    """Of random strings of eight kinds at least 98% are found, of look-alikes from words at most 1% are reported."""
    e, rng = load_vocabulary(), random.Random(17)
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits,
                 "0123456789abcdef", string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters]
    words = "internal configuration handler directory service request parser message content version default network storage document record language".split()
    caught = wrong = 0
    for i in range(800):
        key = "".join(rng.choice(alphabets[i % 8]) for _ in range(rng.randrange(20, 45)))
        caught += any(k == "random" for *_, k in find_secrets(f"here is {key} for you", e, 2.2))
        parts = rng.sample(words, 3)
        name = ("_".join(parts), "-".join(parts), "/".join(parts), "".join(x.title() for x in parts), "_".join(parts).upper())[i % 5]
        wrong += bool(find_secrets(f"here is {name} for you", e, 2.2))
    assert caught >= 784 and wrong <= 8, (caught, wrong)
