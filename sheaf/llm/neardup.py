"""Near-duplicates by MinHash with sequential Bayesian verification.

Signatures are banded; texts that share a band are candidates. A candidate pair's signatures are compared batch by batch, and
the pair is dropped as soon as the posterior that its similarity reaches the threshold falls below a chosen miss
probability. Survivors are verified exactly on their full shingle sets. Links make components.

Buckets can hold a third of all rows, so pairs within one are never all made. Texts with equal sets are one node. In a first
round every member of a bucket is paired with the bucket's smallest; their links give components. In the second round only
members outside a bucket's largest component are paired, and only with members of other components: what is connected
already needs no further link. Of two linked sets, most shingles stand in both; a member too many of whose shingles stand in
no other open text is linked with none, and makes no pairs. The others meet by their rarest shingles only: of two linked sets
one stands among both's (an exact prefix filter), so texts that share boilerplate and little else don't meet. Those left are
close to the threshold more often, so they are compared by longer signatures.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SALTS, HOT_SHARE, Scratch, checkpoint_dir_set, id_type, ids_and_texts, join_counted, release_driver, release_unused, slices, unused
from .shingles import grams, mix, word_hashes

BANDS, ROWS = 24, 6  # a pair of similarity 0.85 misses all bands with probability 1.2e-5
BATCH = 24  # hashes compared at once
LONG, LONG_BATCH = 512, 64  # one-byte hashes of texts in buckets that the first round leaves apart
MISS = 1e-6  # posterior below which a pair is dropped
CHUNK_CHARS = 400_000
BROADCAST_ROWS = 500_000
PARTITION_EDGES = 100_000

_RNG = np.random.default_rng(2024)
MULTIPLY = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
LONG_MULTIPLY = _RNG.integers(1, 1 << 63, LONG, dtype=np.uint64) | np.uint64(1)
LONG_ADD = _RNG.integers(0, 1 << 63, LONG, dtype=np.uint64)


def family(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of so many hashes; up to BANDS * ROWS they are the fixed ones."""
    rng, more = np.random.default_rng(2025), max(0, hashes - BANDS * ROWS)
    multiply = rng.integers(1, 1 << 63, more, dtype=np.uint64) | np.uint64(1)
    return np.concatenate([MULTIPLY, multiply])[:hashes], np.concatenate([ADD, rng.integers(0, 1 << 63, more, dtype=np.uint64)])[:hashes]


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    h, starts = grams(*word_hashes(texts), words)
    return [np.unique(h[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]


def signatures(sets: list[np.ndarray], multiply: np.ndarray = MULTIPLY, add: np.ndarray = ADD) -> np.ndarray:
    """MinHash values (sets by hashes) of sets that aren't empty."""
    out = np.empty((len(sets), len(multiply)), np.uint64)
    size = np.array([len(s) for s in sets])
    begin = 0
    while begin < len(sets):
        end = begin + max(1, int(np.searchsorted(np.cumsum(size[begin:]), 60_000, "right")))  # what a core's cache holds
        x = np.concatenate(sets[begin:end])
        first = np.cumsum(size[begin:end]) - size[begin:end]
        for k, (m, a) in enumerate(zip(multiply, add, strict=True)):
            out[begin:end, k] = np.minimum.reduceat(x * m + a, first)
        begin = end
    return out


def sketch(docs: DataFrame, words: int, id_col: str, text_col: str, n_bands: int = BANDS, n_rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, a 128-bit key of the set, the hashes of its bands, its signature. Without words: 0 and nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_unused()
        for b in batches:
            texts = b["text"].tolist()
            for part in slices(map(len, texts), CHUNK_CHARS):
                sets = shingle_sets(texts[part], words)
                some = [i for i, s in enumerate(sets) if len(s)]
                n = len(sets)
                k1, k2, bands, sig = [None] * n, [None] * n, [None] * n, [None] * n
                if some:
                    s = (signatures([sets[i] for i in some], *family(n_bands * n_rows)) >> np.uint64(32)).astype(np.uint32)
                    folded = np.zeros((len(some), n_bands), np.uint64)
                    for r in range(n_rows):
                        folded = mix(folded + s[:, r::n_rows].astype(np.uint64) + np.uint64(r + 1))
                    folded = mix(folded ^ np.arange(n_bands, dtype=np.uint64)).view(np.int64)
                    for row, i in enumerate(some):
                        x = sets[i]
                        k1[i] = int(np.add.reduce(mix(x)).view(np.int64))
                        k2[i] = int(np.bitwise_xor.reduce(mix(x + np.uint64(7))).view(np.int64))
                        bands[i], sig[i] = folded[row], s[row].tobytes()
                yield pd.DataFrame({
                    "doc_id": b["doc_id"].iloc[part].to_numpy(), "n_shingles": [len(x) for x in sets], "k1": pd.array(k1, "Int64"), "k2": pd.array(k2, "Int64"),
                    "bands": bands, "sig": sig,
                })

    schema = f"doc_id {id_type(docs, id_col)}, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>, sig binary"
    return ids_and_texts(docs, id_col, text_col).mapInPandas(run, schema)


def least_matches(threshold: float, miss: float = MISS, hashes: int = BANDS * ROWS, batch: int = BATCH) -> list[tuple[int, int]]:
    """After n hashes: the fewest matches with which the posterior of similarity >= threshold (flat prior) is at least `miss`.

    With m of n matches the posterior tail is the chance of at most m successes in n + 1 trials of that threshold.
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def prune(pairs: DataFrame, percent: int, schema: str, long: bool, hashes: int = BANDS * ROWS) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) that no batch rules out, as (a, b).

    One-byte hashes also agree by chance, once in 256 times, so the bounds for whole ones drop no pair more often than wanted.
    """
    bounds = least_matches(percent / 100, hashes=LONG, batch=LONG_BATCH) if long else least_matches(percent / 100, hashes=hashes)
    kind = np.uint8 if long else np.uint32

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_unused()
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(b[c]), kind).reshape(len(b), -1) for c in ("sig_a", "sig_b"))
                alive, found, at = np.arange(len(b)), np.zeros(len(b), np.int64), 0
                for n, m in bounds:
                    found[alive] += (x[alive, at:n] == y[alive, at:n]).sum(1)
                    alive, at = alive[found[alive] >= m], n
                yield b.iloc[alive][["a", "b"]]

    return pairs.mapInPandas(run, schema)


def exact(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, set_a, set_b) whose similarity reaches the threshold, as (a, b); row by row, so long sets don't add up."""
    m, n = F.size("set_a"), F.size("set_b")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.where(100 * F.least(m, n) >= percent * F.greatest(m, n)).where(both * (100 + percent) >= percent * (m + n)).select("a", "b")


def small(df: DataFrame) -> DataFrame:
    """A checkpointed table of ids, marked for broadcast if it has been counted and is small; else joins shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class Linker:
    """Verifies pairs of nodes of one table."""

    def __init__(self, nodes: DataFrame, docs: DataFrame, words: int, percent: int, scratch: Scratch, hashes: int = BANDS * ROWS):
        self.nodes, self.docs, self.words, self.percent, self.scratch, self.hashes, self.calls = nodes, docs, words, percent, scratch, hashes, 0
        self.pair = f"a {id_type(docs)}, b {id_type(docs)}"

    def sets(self, ids: DataFrame) -> DataFrame:
        """doc_id and set (64-bit hashes) of the documents named."""
        words = self.words

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            release_unused()
            for b in batches:
                texts = b["text"].tolist()
                for part in slices(map(len, texts), CHUNK_CHARS):
                    yield pd.DataFrame({"doc_id": b["doc_id"].iloc[part].to_numpy(), "set": [s.view(np.int64) for s in shingle_sets(texts[part], words)]})

        return self.docs.join(small(ids), "doc_id", "left_semi").mapInPandas(run, f"doc_id {id_type(self.docs)}, set array<bigint>")

    def long_signatures(self, ids: DataFrame) -> DataFrame:
        """doc_id and sig (LONG one-byte hashes) of the documents named."""
        words = self.words

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            release_unused()
            for b in batches:
                texts = b["text"].tolist()
                for part in slices(map(len, texts), CHUNK_CHARS):
                    sigs = (mix(signatures(shingle_sets(texts[part], words), LONG_MULTIPLY, LONG_ADD)) & np.uint64(255)).astype(np.uint8)
                    yield pd.DataFrame({"doc_id": b["doc_id"].iloc[part].to_numpy(), "sig": [s.tobytes() for s in sigs]})

        return self.docs.join(small(ids), "doc_id", "left_semi").mapInPandas(run, f"doc_id {id_type(self.docs)}, sig binary")

    def exploded(self, ids: DataFrame) -> DataFrame:
        """doc_id and shingle of the documents named."""
        words = self.words

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            release_unused()
            for b in batches:
                texts = b["text"].tolist()
                for part in slices(map(len, texts), CHUNK_CHARS):
                    sets = shingle_sets(texts[part], words)
                    x = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                    yield pd.DataFrame({"doc_id": np.repeat(b["doc_id"].iloc[part].to_numpy(), [len(s) for s in sets]), "shingle": x.view(np.int64)})

        return self.docs.join(small(ids), "doc_id", "left_semi").mapInPandas(run, f"doc_id {id_type(self.docs)}, shingle bigint")

    def shared(self, ids: DataFrame) -> DataFrame:
        """doc_id, n (size of its set) and n_shared (shingles that another of the documents named has too)."""
        one = self.exploded(ids).groupBy("shingle").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")).where("doc_id = last")
        lonely = one.groupBy("doc_id").agg(F.count("*").alias("lonely"))
        n = self.nodes.join(small(ids), "doc_id", "left_semi").select("doc_id", F.col("n_shingles").alias("n"))
        return n.join(lonely, "doc_id", "left").select("doc_id", "n", (F.col("n") - F.coalesce("lonely", F.lit(0))).alias("n_shared"))

    def prefixes(self, open_: DataFrame) -> DataFrame:
        """doc_id, part, n, shingle and rest: of each document (doc_id, part, n) its rarest shingles, one more than it may lack of a link's;
        rest counts the shingle and those behind it.

        Rare is what few of these documents have (ties by hash). Two linked texts share one of these: what comes behind is at most
        percent of either's shingles less one, too few for a link. Shingles that no other document has come first and are left
        out, so a text with enough of them has none at all.
        """
        rows = self.scratch.store(self.exploded(open_.select("doc_id")), "shingles")
        counted = self.scratch.store(rows.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1"), "held")
        own = join_counted(rows, counted, ["shingle"], "held", F.col("doc_id"))
        ranked = own.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("s"))  # of one document's shingles
        lacks = F.col("n") - F.expr(f"({self.percent} * n + 99) div 100") + 1
        take = F.greatest(lacks - (F.col("n") - F.size("s")), F.lit(0)).cast("int")
        whole = ranked.join(open_, "doc_id").select("doc_id", "part", "n", (F.col("n") - F.size("s")).alias("lonely"), F.posexplode(F.slice("s", 1, take)).alias("i", "x"))
        out = whole.select("doc_id", "part", (F.col("n") - F.col("lonely") - F.col("i")).alias("rest"), "n", "x.shingle")
        out = self.scratch.store(out, "prefixes")
        self.scratch.drop("shingles", "held")
        return out

    def meeting(self, prefixes: DataFrame, bands: DataFrame) -> DataFrame:
        """Pairs (a, b), a > b, of texts in different parts whose prefixes meet and who share a band.

        All that two texts have in common stands from the rarest common shingle on in both; where one has less left than a link
        takes, that shingle isn't it, or there is no link. So a pair is made in few places.
        Shingles of over 1 / HOT_SHARE of all rows (at most HOT_SHARE of them) are dealt out in parts of that size, HOT_SALTS at most.
        """
        counts = prefixes.groupBy("shingle").agg(F.count("*").alias("rows"))
        total = prefixes.count()
        parts = F.least(F.lit(HOT_SALTS), F.expr(f"(rows * {HOT_SHARE} + {total} - 1) div {max(1, total)}")).cast("int")
        hot = F.broadcast(counts.where(F.col("rows") * HOT_SHARE > total).select("shingle", parts.alias("parts")))
        marked = prefixes.join(hot, "shingle", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        salt = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
        salts = F.sequence(F.lit(0), F.col("parts") - 1)
        side = lambda x: ["shingle", "salt", *(F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "part", "n", "rest"))]
        left = marked.withColumn("salt", salt).select(*side("a"))
        right = marked.withColumn("salt", F.explode(salts)).select(*side("b"))
        near = F.least("rest_a", "rest_b") * (100 + self.percent) >= self.percent * (F.col("n_a") + F.col("n_b"))
        met = left.join(right, ["shingle", "salt"]).where(near & (F.col("part_a") != F.col("part_b")) & (F.col("doc_id_a") > F.col("doc_id_b")))
        pairs = met.select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct()
        of = lambda x: bands.select(F.col("doc_id").alias(x), F.col("bands").alias(f"bands_{x}"))
        return pairs.join(of("a"), "a").join(of("b"), "b").where(F.arrays_overlap("bands_a", "bands_b")).select("a", "b")

    def able(self, open_: DataFrame) -> DataFrame:
        """Rows (band, doc_id, part, main) of `open_`, with n and n_shared, whose text can be linked within its bucket.

        A link needs percent / (100 + percent) of both sizes' sum in common: who can't reach that with the bucket's smallest goes.
        """
        ids = self.scratch.store(open_.select("doc_id").distinct(), "open_ids")
        with_n = open_.select("band", "doc_id", "part", "main").join(self.scratch.store(self.shared(ids), "shared"), "doc_id")
        least = with_n.groupBy("band").agg(F.min("n").alias("least"))
        need = self.percent * (F.col("n") + F.greatest("least", F.col("n") * (self.percent / 100) - 1e-6))
        return with_n.join(least, "band").where(F.col("n_shared") * (100 + self.percent) >= need).drop("least")

    def links(self, pairs: DataFrame, long: DataFrame | None = None) -> DataFrame:
        """The pairs (a, b) that are linked; written. Signatures are the nodes' own, or `long` ones."""
        self.calls += 1
        store = lambda df, name: self.scratch.store(df, f"{name}{self.calls}")
        sig = self.nodes.select("doc_id", "sig") if long is None else long
        with_sig = pairs.join(sig.withColumnsRenamed({"doc_id": "a", "sig": "sig_a"}), "a").join(sig.withColumnsRenamed({"doc_id": "b", "sig": "sig_b"}), "b")
        alive = store(prune(with_sig, self.percent, self.pair, long is not None, self.hashes), "alive")
        ids = alive.select(F.col("a").alias("doc_id")).union(alive.select("b")).distinct()
        sets = store(self.sets(store(ids, "ids")), "sets")
        with_sets = alive.join(sets.withColumnsRenamed({"doc_id": "a", "set": "set_a"}), "a").join(sets.withColumnsRenamed({"doc_id": "b", "set": "set_b"}), "b")
        out = store(exact(with_sets, self.percent).distinct(), "links")
        self.scratch.drop(*(f"{n}{self.calls}" for n in ("alive", "ids", "sets")))
        return out


def components(edges: DataFrame) -> DataFrame:
    """node and label (smallest node reachable) of every node with an edge (a, b), by alternating large-star and small-star steps.

    No step has more edges than the one before, so the first count tells how many partitions the later ones need: a few edges dealt
    over all shuffle partitions would be mostly tasks, which the driver keeps account of.
    """
    pairs = lambda *ps: F.inline(F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in ps)))
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(e)
    few = max(edges.sparkSession.sparkContext.defaultParallelism, -(-before[0] // PARTITION_EDGES))
    e = e.coalesce(few)
    while True:
        both = e.select(pairs("uv", "vu"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u")
        # where v is m already, both pairs are the same
        nxt = star.select(F.col("u"), F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), "m").select(pairs("um", "vm")).distinct().coalesce(few).checkpoint()
        after = mark(nxt)
        if after == before:
            break
        e, before = nxt, after
    release_driver(edges.sparkSession)
    return e.select(F.explode(F.array("u", "v")).alias("node"), F.col("v").alias("label")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 85, n_bands: int = BANDS, n_rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links of similarity >= percent / 100).

    Null, empty and blank texts have no shingles and are linked with nothing; a text of fewer words than a shingle is one shingle.
    Rows that repeat a doc_id are one node. A row without doc_id stays out: its component is null. An empty table gives an
    empty result; other columns are ignored. A link of similarity s is no candidate with probability (1 - s ** n_rows) ** n_bands:
    a lower percent needs more bands or fewer rows.
    """
    checkpoint_dir_set(docs.sparkSession)
    own = ids_and_texts(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession)
    sketches = scratch.store(sketch(docs, words, id_col, text_col, n_bands, n_rows), "sketches")
    some = sketches.where("n_shingles > 0 and doc_id is not null")
    nodes = some.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("n_shingles", "bands", "sig"), "doc_id").alias("s")).select("k1", "k2", "doc_id", "s.n_shingles", "s.bands", "s.sig")
    nodes = scratch.store(nodes, "nodes")
    linker = Linker(nodes, own, words, percent, scratch, n_bands * n_rows)

    in_band = nodes.select("doc_id", F.explode("bands").alias("band"))
    shared = in_band.groupBy("band").agg(F.count("*").alias("n"), F.min("doc_id").alias("centre")).where("n > 1").select("band", "centre")
    members = scratch.store(in_band.join(shared, "band"), "members")
    first = members.where("doc_id <> centre").select(F.col("doc_id").alias("a"), F.col("centre").alias("b")).distinct()
    first = scratch.store(first, "first")
    links = linker.links(first)

    # what is still apart within a bucket
    labels = components(links)
    placed = members.join(labels, members["doc_id"] == labels["node"], "left").select("band", "doc_id", F.coalesce("label", "doc_id").alias("part"))
    placed = scratch.store(placed, "placed")
    parts = placed.groupBy("band", "part").agg(F.count("*").alias("n"))
    main = parts.groupBy("band").agg(F.count("*").alias("n_parts"), F.max_by("part", F.struct("n", "part")).alias("main")).where("n_parts > 1").select("band", "main")
    main = scratch.store(main, "main")
    open_ = scratch.store(placed.join(main, "band"), "open")
    open_ = scratch.store(linker.able(open_), "able")
    # at most one entry for each band
    able = scratch.store(open_.groupBy("doc_id").agg(F.first("part").alias("part"), F.first("n").alias("n"), F.collect_list("band").alias("bands")), "by_doc")
    cross = linker.meeting(linker.prefixes(able.select("doc_id", "part", "n")), able.select("doc_id", "bands")).join(first, ["a", "b"], "left_anti")
    cross = scratch.store(cross, "cross")
    ids = cross.select(F.col("a").alias("doc_id")).union(cross.select("b")).distinct()
    long = scratch.store(linker.long_signatures(scratch.store(ids, "cross_ids")), "long")
    links = links.union(linker.links(cross, long))

    same = some.join(nodes.select("k1", "k2", F.col("doc_id").alias("node")), ["k1", "k2"]).where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
    # ids that stand for one set only hang on their node; others would need its label too, so they join as links
    repeated = some.groupBy("doc_id").agg(F.count_distinct("k1", "k2").alias("n")).where("n > 1").select(F.col("doc_id").alias("a"))
    extra = same.join(repeated, "a", "left_semi")
    labels = components(links.union(extra)).checkpoint()
    named = nodes.join(labels, nodes["doc_id"] == labels["node"], "left").select("k1", "k2", F.coalesce("label", "doc_id").alias("component_id"))
    return (
        sketches.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    )


def duplicate_report(docs: DataFrame, **options) -> DataFrame:
    r = near_duplicates(docs, **options)
    return r.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """Rows of `docs`, all columns, whose document is the smallest of its component; rows without doc_id stay."""
    id_col = options.get("id_col", "doc_id")
    name = unused(docs, "gone")
    gone = near_duplicates(docs, **options).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct().checkpoint()
    return docs.join(small(gone), docs[id_col] == gone[name], "left_anti")
