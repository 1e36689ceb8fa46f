"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask names which words of a stretch count ('1') and which may differ ('0'). Hashes of the counting words are made at each
place of test items and documents and joined. A hit fixes how an item lies over a document (a diagonal); there the aligned
words are compared one by one, so substituted words cost only themselves. The masks are lossless: however the words that may
differ lie in a stretch, one mask misses them all. Where the masks given can't promise that (short items, other shares), a run
of words takes their place: of w words with k that differ, some run of (w - k) / (k + 1), rounded up, is whole.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir_set, unused

# Two masks of weight 4 that together hit 16 words of which any 4 differ, and 11 to 15 words at the same share.
MASKS = ("11101", "100111")
MOST_PATTERNS = 20_000  # masks are checked against at most so many ways in which words may differ

BROADCAST_ROWS = 500_000  # a side of at most so many (narrow) rows is broadcast, a larger one is shuffled


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def seeds(hashes: Column, mask: str, number: int) -> Column:
    """The hash at each place of a mask over an array of word hashes; empty where the mask doesn't fit."""
    ones = [i for i, c in enumerate(mask) if c == "1"]
    last = F.size(hashes) - len(mask)
    places = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.lit(number), *(F.get(hashes, i + k) for k in ones)))


def may_differ(width: int, min_share: float) -> int:
    """How many of `width` words may differ so that the share that agrees still reaches min_share."""
    return max((k for k in range(width) if (width - k) / width >= min_share), default=0)


def lossless(masks: tuple[str, ...], width: int, differ: int) -> bool:
    """Whether some mask hits a stretch of `width` words whichever `differ` of them differ; False if there are too many ways to see."""
    if comb(width, differ) > MOST_PATTERNS:
        return False
    needed = [{p + k for k, c in enumerate(m) if c == "1"} for m in masks for p in range(width - len(m) + 1)]
    return all(any(n.isdisjoint(d) for n in needed) for d in combinations(range(width), differ))


def masks_for(width: int, min_share: float, masks: tuple[str, ...] = MASKS) -> tuple[str, ...]:
    """Masks that hit every stretch of `width` words that min_share accepts: those given, or a run that is always whole."""
    k = may_differ(width, min_share)
    return tuple(masks) if lossless(masks, width, k) else ("1" * -(-(width - k) // (k + 1)),)


def seed_rows(table: DataFrame, keys: list[str], masks: dict[str, int]) -> DataFrame:
    """Keys, place and seed. The table has `word_hashes`. Only hashes are exploded, never words."""
    # each mask's number is in the hash, so one column holds them all; a place's masks stand together
    per_mask = [F.transform(seeds(F.col("word_hashes"), m, k), lambda h, i: F.struct(i.alias("place"), h.alias("seed"))) for m, k in masks.items()]
    flat = table.select(*keys, F.explode(F.concat(*per_mask)).alias("s"))
    return flat.select(*keys, F.col("s.place").alias("place"), F.col("s.seed").alias("seed"))


def small(df: DataFrame, rows: int) -> DataFrame:
    """The side marked for broadcast if it has been counted and is small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = 16, min_share: float = 0.75, masks: tuple[str, ...] = MASKS,
) -> DataFrame:
    """Contaminated pairs: doc_id, item_id, matched_words, item_words, best_share, doc_word (where the item begins, may be negative).

    A pair counts if some stretch of min(window, words of the item) aligned words agrees in at least `min_share` of them;
    its best diagonal is reported (ties: the smallest). No such pair is missed: `masks` only steer the search. Null and empty texts or items match nothing; copies of an item or of
    a document are reported each; rows that repeat a doc_id count as that document; a null doc_id matches nothing; empty
    tables give no pairs; other columns are ignored.
    """
    spark = docs.sparkSession
    checkpoint_dir_set(spark)
    items = benchmark.select(benchmark[item_col].alias("item_id"), words(benchmark[item_text_col]).alias("item")).where("item_id is not null and size(item) > 0")
    by_words = items.groupBy("item").agg(F.min("item_id").alias("key")).checkpoint()  # equal items are looked for once
    width = F.least(F.size("item"), F.lit(window))
    widths = [r[0] for r in by_words.select(width.alias("n")).distinct().orderBy("n").collect()] or [window]  # at most `window` numbers
    by_masks: dict[tuple[str, ...], list[int]] = {}
    for n in widths:
        by_masks.setdefault(masks_for(n, min_share, masks), []).append(n)
    number = {m: k for k, m in enumerate(dict.fromkeys(m for ms in by_masks for m in ms))}
    hashed = by_words.select("key", width.alias("width"), F.transform("item", lambda w: F.xxhash64(w)).alias("word_hashes"))
    # a mask's seeds belong only to the items of its widths
    item_seeds = reduce(DataFrame.union, (seed_rows(hashed.where(F.col("width").isin(ns)), ["key"], {m: number[m] for m in ms}) for ms, ns in by_masks.items()))
    item_seeds = item_seeds.distinct().checkpoint()
    own = docs.select(docs[id_col].alias("doc_id"), words(docs[text_col]).alias("words")).where("doc_id is not null")
    doc_seeds = seed_rows(own.select("doc_id", F.transform("words", lambda w: F.xxhash64(w)).alias("word_hashes")), ["doc_id"], number)
    i = small(item_seeds.withColumnRenamed("place", "item_place"), item_seeds.count())
    hits = doc_seeds.join(i, "seed").select("doc_id", "key", (F.col("place") - F.col("item_place")).alias("diagonal")).distinct().checkpoint()
    n_hits = hits.count()
    ids = hits.select("doc_id").distinct()
    touched = own.join(small(ids, n_hits), "doc_id", "left_semi") if n_hits else own.limit(0)
    pairs = touched.join(small(hits, n_hits), "doc_id").join(small(by_words, by_words.count()), "key")
    low = F.greatest(F.lit(0), -F.col("diagonal"))
    high = F.least(F.size("item"), F.size("words") - F.col("diagonal"))  # exclusive
    same = F.zip_with(F.slice("words", F.col("diagonal") + low + 1, high - low), F.slice("item", low + 1, high - low), lambda a, b: (a == b).cast("int"))
    pairs = pairs.where(high > low).select("doc_id", "key", "diagonal", F.size("item").alias("item_words"), same.alias("same"))
    wide = F.least(F.lit(window), F.col("item_words"))
    last = F.size("same") - F.col("wide")
    add = lambda a, b: a + b
    sums = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.aggregate(F.slice("same", k + 1, F.col("wide")), F.lit(0), add))
    pairs = pairs.withColumn("wide", wide).where(last >= 0)
    pairs = pairs.select("doc_id", "key", "diagonal", "item_words", F.aggregate("same", F.lit(0), add).alias("matched_words"), (F.array_max(sums) / F.col("wide")).alias("best_share"))
    best = (
        pairs.where(F.col("best_share") >= min_share)
        .groupBy("doc_id", "key")
        .agg(F.max(F.struct("matched_words", "best_share", (-F.col("diagonal")).alias("back"))).alias("b"), F.first("item_words").alias("item_words"))
        .select("doc_id", "key", F.col("b.matched_words").alias("matched_words"), "item_words", F.col("b.best_share").alias("best_share"), (-F.col("b.back")).alias("doc_word"))
    )
    names = items.join(by_words, "item").select("key", "item_id")  # every copy of an item gets its row
    return best.join(names, "key").select("doc_id", "item_id", "matched_words", "item_words", "best_share", "doc_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of `docs`, all columns, without the documents that overlap with an item."""
    id_col = options.get("id_col", "doc_id")
    name = unused(docs, "bad")
    bad = find_overlaps(docs, benchmark, **options).select(F.col("doc_id").alias(name)).distinct().checkpoint()
    return docs.join(small(bad, bad.count()), docs[id_col] == bad[name], "left_anti")
