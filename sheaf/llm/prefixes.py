"""The prefix trie of conversations, with subtree sums by heavy-path decomposition.

A node is a distinct sequence of first turns; (smallest member, depth) names it. Prefixes are known by two 64-bit sums of
scattered turn hashes, so a conversation's prefixes come from running sums. Each node's child with the most members is heavy; the
chains of heavy children are paths, and as a light child has at most half of its parent's members, a way from the root
changes paths at most log2(conversations) times. A path is read off a conversation that ends it: it is the part behind the
last light node. So paths need no iteration; sums do, a round for each number of changes, deepest first: a path's arrays get
what its light children's paths came to, are summed from the end, and its top passes the total on.

Runs of turns are handled in blocks of `BLOCK`, so neither a long conversation nor a long path is gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_counted

BLOCK = 1024
NODE = ["key1", "key2", "depth"]


def running(df: DataFrame, group: list[str], at: str, columns: dict[str, Column], backward: bool = False) -> DataFrame:
    """Running sums (from the end, if `backward`) of columns along `at` (from 0 in steps of one) within groups: sums of blocks, then within each block."""
    rows = df.withColumn("block__", F.expr(f"{at} div {BLOCK}"))
    order = F.col("block__").desc() if backward else F.col("block__").asc()
    sums = rows.groupBy(*group, "block__").agg(*(F.sum(c).alias(f"{k}__") for k, c in columns.items()))
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*group, "block__", *(F.coalesce(F.sum(f"{k}__").over(w), F.lit(0)).alias(f"{k}__") for k in columns))
    inner = Window.partitionBy(*group, "block__").orderBy(F.col(at).desc() if backward else F.col(at).asc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = rows.withColumns({k: F.sum(c).over(inner) for k, c in columns.items()}).join(before, [*group, "block__"])
    return whole.withColumns({k: F.col(k) + F.col(f"{k}__") for k in columns}).drop("block__", *(f"{k}__" for k in columns))


def ordered(turns: DataFrame) -> DataFrame:
    """conv_id, at (from 0), role, text: turns in order (null first, then by role and text), nulls of role and text empty.

    Ranks are counted within stretches of turn numbers, and stretches are summed up before them.
    """
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("stretch", F.expr(f"turn div {BLOCK}"))
    w = Window.partitionBy("conv_id").orderBy(F.col("stretch").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv_id", "stretch").agg(F.count("*").alias("n")).select("conv_id", F.col("stretch").alias("stretch_"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("first"))
    inner = Window.partitionBy("conv_id", "stretch").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    ranked = rows.withColumn("rank", F.row_number().over(inner) - 1)
    both = ranked.join(counts.withColumnRenamed("conv_id", "conv_id_"), F.col("conv_id").eqNullSafe(F.col("conv_id_")) & F.col("stretch").eqNullSafe(F.col("stretch_")))
    return both.select("conv_id", (F.col("first") + F.col("rank")).cast("bigint").alias("at"), "role", "text")


def rebuilt(turns: DataFrame, scratch: Scratch, group: int = 100, head: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n) of every conversation, and its turns' hashes (conv_id, at, hash1, hash2, chars) when rebuilt: the first h turns of the
    conversation at the group's start, then its own after its first h; h = crc32(conv_id) mod head."""
    text = F.struct("role", "text")
    said = scratch.store(ordered(turns).select("conv_id", "at", F.xxhash64(F.lit(1), text).alias("hash1"), F.xxhash64(F.lit(2), text).alias("hash2"), F.length("text").cast("bigint").alias("chars")), "turns")
    counted = scratch.store(said.groupBy("conv_id").agg(F.count("*").alias("own")), "counts")
    h = F.crc32(F.col("conv_id").cast("string")) % head
    convs = counted.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    first = counted.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = scratch.store(convs.join(first, "base", "left").withColumn("shared", F.least("h", F.coalesce("base_own", F.lit(0)))), "conversations")
    own = join_counted(said, convs, ["conv_id"], "own", F.col("at")).where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("shared")).alias("at"), "hash1", "hash2", "chars")
    heads = said.where(F.col("at") < head - 1).withColumnRenamed("conv_id", "base")
    lent = convs.where("shared > 0").select("conv_id", "base", "shared").join(heads, "base").where("at < shared").select("conv_id", "at", "hash1", "hash2", "chars")
    lengths = convs.select("conv_id", (F.col("shared") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    return lengths, own.unionByName(lent)


def prefixes(lengths: DataFrame, said: DataFrame) -> DataFrame:
    """conv_id, n, depth, key1, key2, up1, up2, chars, ends: every prefix of every conversation, the empty one (depth 0) too. Two
    sums of its turns' hashes, scattered by their places, are its key; those without the last turn are its parent's."""
    scattered = {f"sum{k}": F.xxhash64(F.lit(k), f"hash{k}", "at").cast("decimal(38,0)") for k in (1, 2)}
    sums = running(said, ["conv_id"], "at", scattered)
    key = lambda c: F.pmod(c.cast("decimal(38,0)"), F.lit((1 << 63) - 25).cast("decimal(38,0)")).cast("bigint")
    rows = sums.select(
        "conv_id", (F.col("at") + 1).alias("depth"), *(key(F.col(f"sum{k}")).alias(f"key{k}") for k in (1, 2)), *(key(F.col(f"sum{k}") - c).alias(f"up{k}") for k, c in zip((1, 2), scattered.values(), strict=True)), "chars",
    )
    zero = F.lit(0).cast("bigint")
    none = F.lit(None).cast("bigint")
    empty = lengths.select("conv_id", "n", zero.alias("depth"), zero.alias("key1"), zero.alias("key2"), none.alias("up1"), none.alias("up2"), zero.alias("chars"))
    return join_counted(rows, lengths, ["conv_id"], "n", F.col("depth")).unionByName(empty).withColumn("ends", F.col("depth") == F.col("n"))


def digests(ends: DataFrame, block: int = 4096) -> DataFrame:
    """key1, key2, depth, ends_sha256 of the decimal conv_ids, ascending and comma-joined. Blocks of ids are joined before they are
    dealt out; a node's blocks are then hashed one after the other, as the digest asks, without being held together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, digest = None, None
        for b in batches:
            out = []
            for *own, ids in b.itertuples(index=False):
                if own != node:
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest = own, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
        if node:
            yield pd.DataFrame([(*node, digest.hexdigest())], columns=[*NODE, "ends_sha256"])

    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = ends.groupBy(*NODE, F.expr(f"conv_id div {block}").alias("block")).agg(ids.alias("ids"))
    in_order = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids")
    return in_order.mapInPandas(run, "key1 bigint, key2 bigint, depth bigint, ends_sha256 string")


def decompose(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes with their heavy paths: conv_id, depth, key1, key2, parent_conv_id, n_convs, n_children, saved (the node's own), path (a
    conversation that ends it), level (light nodes above, itself included), top (the path's least depth), parent_path."""
    nodes = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("up1").alias("up1"), F.min("up2").alias("up2"), F.min("chars").alias("chars"))
    nodes = scratch.store(nodes, "nodes")
    largest = F.min(F.struct((-F.col("n_convs")).alias("less"), F.col("conv_id").alias("conv_id")))  # ties: the smaller conversation
    children = nodes.where("depth > 0").groupBy(F.col("up1").alias("key1"), F.col("up2").alias("key2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), largest.alias("heavy"))
    children = scratch.store(children, "children")
    heavy = children.select(F.col("heavy.conv_id").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.lit(False).alias("light"))
    flagged = nodes.join(children.drop("heavy"), NODE, "left").join(heavy, ["conv_id", "depth"], "left")
    flagged = scratch.store(flagged.withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("bigint")), "light": F.coalesce("light", F.lit(True))}), "flagged")
    # a conversation that ends a path runs through all of the path's nodes, behind those of the paths above
    leaves = scratch.store(flagged.where("n_children = 0").select("conv_id", (F.col("depth") + 1).alias("places")), "leaves")
    ways = join_counted(rows.select("conv_id", *NODE), leaves, ["conv_id"], "places", F.col("depth")).select(F.col("conv_id").alias("path"), *NODE, "places")
    ways = join_counted(ways, flagged, NODE, "n_convs", F.col("path"))
    ways = scratch.store(ways, "ways")
    tops = ways.where("light").groupBy("path").agg(F.max("depth").alias("top"), (F.count("*") - 1).alias("level"), F.max("places").alias("places"))
    tops = scratch.store(tops, "tops")
    on_paths = join_counted(ways.drop("places"), tops, ["path"], "places", F.col("depth")).where("depth >= top")
    saved = ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
    on_paths = scratch.store(on_paths.select("conv_id", *NODE, "up1", "up2", "n_convs", "n_children", saved, "path", "level", "top"), "on_paths")
    parents = scratch.store(
        on_paths.where("n_children > 0").select(F.col("key1").alias("up1"), F.col("key2").alias("up2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("parent_path"), F.col("n_children").alias("siblings")), "parents",
    )
    below = join_counted(on_paths.where("depth > 0"), parents, ["up1", "up2", "depth"], "siblings", F.col("conv_id"))
    root = on_paths.where("depth = 0").withColumns({"parent_conv_id": F.lit(None).cast("bigint"), "parent_path": F.lit(None).cast("bigint")})
    return below.drop("siblings").unionByName(root).drop("up1", "up2")


def subtree_sums(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """path, depth, n_leaves, saved_tokens of every node: paths of the deepest level first, each with what hangs on it."""
    deepest = nodes.agg(F.max("level")).first()[0]
    total, given = None, None
    for level in range(-1 if deepest is None else deepest, -1, -1):
        here = nodes.where(F.col("level") == level).select("path", "depth", "top", "parent_path", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("leaf"), "saved")
        if given is not None:
            here = here.join(given, ["path", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(f"{c}_below", F.lit(0)) for c in ("leaf", "saved")}).drop("leaf_below", "saved_below")
        sums = running(here, ["path"], "depth", {"n_leaves": F.col("leaf"), "saved_tokens": F.col("saved")}, backward=True)
        sums = scratch.store(sums.select("path", "depth", "top", "parent_path", "n_leaves", "saved_tokens"), f"level-{level}")
        passed = sums.where("depth = top AND depth > 0").groupBy(F.col("parent_path").alias("path"), (F.col("depth") - 1).alias("depth"))
        given = passed.agg(F.sum("n_leaves").alias("leaf_below"), F.sum("saved_tokens").alias("saved_below"))
        own = sums.select("path", "depth", "n_leaves", "saved_tokens")
        total = own if total is None else total.unionByName(own)
    return nodes.select("path", "depth", F.lit(0).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens")).limit(0) if total is None else total


def trie_report(turns: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (long), ends_sha256 (string).

    Turns of a conversation are ordered by turn (null first), then role and text; null role and text are empty; rows that repeat
    stay turns of their own; rows without conv_id belong to no conversation; other columns are ignored. An empty table has no
    nodes, not even a root. Runs jobs before it returns: what its steps share is written to the shared folder.
    """
    scratch = Scratch(turns.sparkSession, "prefixes")
    lengths, said = rebuilt(turns, scratch)
    lengths = scratch.store(lengths, "lengths")
    rows = scratch.store(prefixes(lengths, said), "prefixes")
    nodes = scratch.store(decompose(rows, scratch), "decomposed")
    sums = subtree_sums(nodes, scratch)
    ends = scratch.store(digests(rows.where("ends").select("conv_id", *NODE)), "ends")
    out = nodes.join(sums, ["path", "depth"]).join(ends, NODE, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


TRIE_SQL = """
WITH crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
  SELECT conv_id, own, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
      lambda c, d: xor(t[(xor(c, d) & 255) + 1], c >> 8)), 4294967295) % 6 AS h
  FROM (SELECT conv_id, count(*) AS own FROM turns GROUP BY conv_id), crc_table
),
based AS (SELECT c.*, least(c.h, coalesce(b.own, 0)) AS shared FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
said AS (
  SELECT c.conv_id, t.place, t.role, t.text FROM based c JOIN turns t ON t.conv_id = c.base AND t.place < c.shared
  UNION ALL
  SELECT c.conv_id, t.place - c.h + c.shared, t.role, t.text FROM based c JOIN turns t ON t.conv_id = c.conv_id AND t.place >= c.h
),
prefix AS (
  SELECT conv_id, place + 1 AS depth, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS key, length(text) AS chars FROM said
  UNION ALL SELECT conv_id, 0, [], 0 FROM convs
),
lengths AS (SELECT conv_id, max(depth) AS n FROM prefix GROUP BY conv_id),
named AS (SELECT r.*, min(conv_id) OVER (PARTITION BY key) AS node, n = depth AS ends FROM prefix r JOIN lengths USING (conv_id)),
nodes AS (
  SELECT node AS conv_id, depth, count(*) AS n_convs, any_value(chars) * (count(*) - 1) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM named GROUP BY node, depth
),
linked AS (SELECT x.*, p.node AS parent FROM nodes x LEFT JOIN named p ON p.conv_id = x.conv_id AND p.depth = x.depth - 1),
children AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n FROM linked WHERE parent IS NOT NULL GROUP BY ALL),
whole AS (SELECT l.*, coalesce(c.n, 0) AS n_children FROM linked l LEFT JOIN children c USING (conv_id, depth)),
sums AS (
  SELECT a.node AS conv_id, a.depth, count(*) FILTER (WHERE w.n_children = 0) AS n_leaves, sum(w.saved) AS saved_tokens
  FROM whole w JOIN named a ON a.conv_id = w.conv_id AND a.depth <= w.depth GROUP BY a.node, a.depth
)
SELECT conv_id::BIGINT AS conv_id, depth::BIGINT AS depth, parent::BIGINT AS parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM whole JOIN sums USING (conv_id, depth)
"""
