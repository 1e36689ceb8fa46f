import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest

from sheaf.llm import prefixes

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n bigint, depth string, block__ int"


def plain(rows):
    """Every node by brute force, named (smallest member, depth)."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    nodes, children = {}, defaultdict(int)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = own.get(c - c % 100, [])[:h] + v[h:]
        for d in range(len(whole) + 1):
            members, ends = nodes.setdefault(tuple(whole[:d]), ([], []))
            members.append(c)
            if d == len(whole):
                ends.append(c)
    for k in nodes:
        if k:
            children[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, (members, _) in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1]) if k else 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(k), min(nodes[k[:-1]][0]) if k else -1, len(m), children[k], leaves[k], saved[k], digest(e)) for k, (m, e) in nodes.items())


def found(df):
    rows = df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in rows)


def conversations():
    """Long, short, branching and equal conversations, with nulls, ties and repeated rows."""
    rows = []
    for c in range(130):
        for t in range(2 + c % 7 if c < 120 else 23):
            text = None if t == 1 and c % 3 == 0 else f"t{t if c % 2 else t * (c % 4)}" * (t + 1)
            rows.append((c, None if t == 0 and c % 5 == 0 else t, None if c % 4 == 0 else ("user", "assistant")[t % 2], text, 7, "x", 1))
    rows += [(305, 4, "user", "same", 0, "", 0)] * 3 + [(305, 4, "assistant", "tie", 0, "", 0)]
    rows += [(c, t, "user", f"copy {t}", 0, "", 0) for c in range(700, 740) for t in range(9)]
    return rows + [(None, 0, "user", "lost", 0, "", 0), (901, 0, "", "", 0, "", 0)]


@pytest.mark.parametrize("block", [1024, 3])
def test_nodes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(prefixes, "BLOCK", block)
    rows = conversations()
    assert found(prefixes.trie_report(spark.createDataFrame(rows, SCHEMA).repartition(5))) == plain(rows)


def test_sql_says_the_same():
    rows = conversations()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    out = con.execute(f"SELECT conv_id, depth, coalesce(parent_conv_id, -1), n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM ({prefixes.TRIE_SQL})").fetchall()
    assert sorted(out) == plain(rows)


def test_a_table_of_one_turnless_conversation_and_an_empty_one(spark):
    # with h > 0 and no conversation 0 to take turns from, nothing is left of its one turn
    alone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6)
    one = [(alone, 0, "user", "gone", 0, "", 0)]
    assert found(prefixes.trie_report(spark.createDataFrame(one, SCHEMA))) == plain(one)
    assert prefixes.trie_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_many_ends_of_one_node_are_hashed_in_order(spark):
    ends = spark.range(0, 10_000, 3).selectExpr("id * 7 AS conv_id", "1L AS key1", "2L AS key2", "3L AS depth")
    got = prefixes.digests(ends.repartition(6), block=64).collect()
    ids = ",".join(str(7 * i) for i in range(0, 10_000, 3))
    assert [tuple(r) for r in got] == [(1, 2, 3, hashlib.sha256(ids.encode()).hexdigest())]


def test_paths_change_a_logarithmic_number_of_times(spark, tmp_path):
    # a comb: conversation c leaves the common chain after c turns
    rows = [(100 * c, t, "user", "chain" if t < c else f"own {c}", 0, "", 0) for c in range(1, 40) for t in range(c + 1)]
    scratch = prefixes.Scratch(spark, "test")
    lengths, said = prefixes.rebuilt(spark.createDataFrame(rows, SCHEMA), scratch)
    lengths = scratch.store(lengths, "lengths")
    nodes = prefixes.decompose(scratch.store(prefixes.prefixes(lengths, said), "prefixes"), scratch)
    assert 1 <= nodes.agg({"level": "max"}).first()[0] <= 5
    assert nodes.count() == nodes.select("path", "depth").distinct().count()
