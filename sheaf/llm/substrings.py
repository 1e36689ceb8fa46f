"""Substring dedup with suffix automata of reference shards.

Which documents need which shard is told by fingerprints: in each window of 13 words the smallest 5-word hash is its
fingerprint, so equal windows have equal ones. Only windows whose fingerprint stands in several documents are looked at, and
all windows of one fingerprint go to one shard. Fingerprints say where to look, not what repeats: the same five words stand
in many windows that differ.

A shard's stretches of text (distinct ones, each with the smallest document that has it) make a suffix automaton whose states
know the smallest document of their run of words. The stretches are streamed through it for matching statistics: where at least
13 words match, the state of the last 13 tells the first document that has them, and a document with a larger id loses them.

Shards are bounded. A document's fingerprints keep together (so stretches stay long) unless they stand at more than GROUP_PLACES
places; then each fingerprint is by itself. Where the different stretches of one key have over KEY_WORDS words, they are dealt
out window by window, after equal stretches have become one: a passage in a third of all documents is still a few stretches.

Exact copies of a text skip all that: a window of theirs always starts in the first copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .common import Scratch, bounded_batches, id_type, join_counted, release_unused, slices
from .shingles import grams, word_hashes

GRAM = 5  # words of a fingerprint
GROUP_PLACES = 4_000  # places of fingerprints that share a key
SHARD_WORDS = 40_000  # words of one automaton, besides its largest key
KEY_WORDS = 150_000  # words of a key that still go into one automaton, some 100 MB; a larger key is dealt out by windows
CHUNK_CHARS = 400_000
BROADCAST_ROWS = 500_000


def window_minima(g: np.ndarray, g_starts: np.ndarray, w_starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window (in order): its text's number, and the place (index into g) of the smallest of its `span` fingerprints, the last of equal ones."""
    text = np.repeat(np.arange(len(w_starts) - 1), np.diff(w_starts))
    at = np.arange(w_starts[-1]) - w_starts[text] + g_starts[text]
    best, place = g[at], at.copy()
    for j in range(1, span):
        x = g[at + j]
        smaller = x <= best
        best = np.where(smaller, x, best)
        place = np.where(smaller, at + j, place)
    return text, place


class Windows:
    """Word hashes of some texts with their windows and fingerprints."""

    def __init__(self, texts: list[str], window: int):
        self.words, self.starts = word_hashes(texts, lower=False)
        self.g, self.g_starts = grams(self.words, self.starts, GRAM, short=False)
        count = np.maximum(np.diff(self.starts) - window + 1, 0)
        self.w_starts = np.concatenate([[0], np.cumsum(count)])
        self.text, self.place = window_minima(self.g, self.g_starts, self.w_starts, window - GRAM + 1)


def prints(docs: DataFrame, window: int) -> DataFrame:
    """g (fingerprint), doc_id, version and at (its word), of every window; one row where neighbouring windows share it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_unused()
        for b in batches:
            texts, ids, versions = b["text"].tolist(), b["doc_id"].to_numpy(), b["version"].to_numpy()
            for part in slices(map(len, texts), CHUNK_CHARS):
                w = Windows(texts[part], window)
                chosen = np.flatnonzero(np.r_[True, w.place[1:] != w.place[:-1]]) if len(w.place) else np.zeros(0, np.int64)
                t, p = w.text[chosen], w.place[chosen]
                yield pd.DataFrame({"g": w.g[p].view(np.int64), "doc_id": ids[part][t], "version": versions[part][t], "at": (p - w.g_starts[t]).astype(np.int32)})

    return docs.select("doc_id", "version", "text").mapInPandas(run, f"g bigint, doc_id {id_type(docs)}, version bigint, at int")


def keyed(p: DataFrame) -> DataFrame:
    """Fingerprints of several documents: g, key (of its shard) and n (its places)."""
    several = p.groupBy("g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    together = F.sum("n").over(Window.partitionBy("lo"))  # at most the fingerprints of one document
    return several.select("g", F.when(together <= GROUP_PLACES, F.xxhash64("lo")).otherwise(F.xxhash64(F.lit(1), "g")).alias("key"), "n")


def stretches(docs: DataFrame, window: int) -> DataFrame:
    """key, doc_id, version, start (word) and words (hashes) of the runs of windows whose fingerprints have one key.

    `docs` has, of each document, at and keys: lists of the places and keys of its fingerprints.
    """

    def cut(w: Windows, i: int, at, keys) -> Iterator[tuple[int, int, int]]:
        """(key, first window, last window) of one text."""
        own = w.place[w.w_starts[i] : w.w_starts[i + 1]] - w.g_starts[i]
        order = np.argsort(at)
        at, keys = np.asarray(at)[order], np.asarray(keys, np.int64)[order]
        found = np.minimum(np.searchsorted(at, own), len(at) - 1)
        held = np.flatnonzero(at[found] == own)
        k = keys[found[held]]
        ends = np.flatnonzero((np.diff(held) > 1) | (k[1:] != k[:-1]))
        for a, z in zip(np.r_[0, ends + 1].tolist(), np.r_[ends, len(held) - 1].tolist(), strict=True):
            yield int(k[a]), int(held[a]), int(held[z])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_unused()
        for b in batches:
            texts = b["text"].tolist()
            for part in slices(map(len, texts), CHUNK_CHARS):
                w = Windows(texts[part], window)
                rows, out = b.iloc[part], []
                for i, (d, v, *places) in enumerate(zip(*(rows[c] for c in ("doc_id", "version", "at", "keys")), strict=True)):
                    words = w.words[w.starts[i] : w.starts[i + 1]]
                    out += [(k, d, v, a, words[a : z + window].tobytes()) for k, a, z in cut(w, i, *places)]
                yield pd.DataFrame(out, columns=["key", "doc_id", "version", "start", "words"])

    return docs.select("doc_id", "version", "text", "at", "keys").mapInPandas(run, f"key bigint, doc_id {id_type(docs)}, version bigint, start int, words binary")


def single_windows(contents: DataFrame, window: int) -> DataFrame:
    """Each window of some contents: k1 and k2 of the content, at (its first word there), key (the window's hash), words, first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_unused()
        for b in batches:
            for part in slices((len(x) for x in b["words"]), CHUNK_CHARS):
                out = []
                for k1, k2, words, first in zip(*(b[c].iloc[part] for c in ("k1", "k2", "words", "first")), strict=True):
                    x = np.frombuffer(words, np.uint64)
                    keys, _ = grams(x, np.array([0, len(x)]), window, short=False)
                    out += [(k1, k2, a, int(k), words[8 * a : 8 * (a + window)], first) for a, k in enumerate(keys.view(np.int64))]
                yield pd.DataFrame(out, columns=["k1", "k2", "at", "key", "words", "first"])

    return contents.select("k1", "k2", "words", "first").mapInPandas(run, f"k1 bigint, k2 bigint, at int, key bigint, words binary, first {id_type(contents, 'first')}")


def match(contents: DataFrame, window: int) -> DataFrame:
    """Of each content (shard, k1, k2, words, first): the spans (begin, end, first) in which at least `window` words match its shard's
    automaton, with the smallest document that has them. Neighbouring spans with one first document are one."""

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        sequences = [np.frombuffer(x, np.uint64).tolist() for x in shard["words"]]
        automaton = SuffixAutomaton()
        for words, first in zip(sequences, shard["first"], strict=True):
            automaton.add(words, first)
        automaton.settle()
        out = []
        for k1, k2, words in zip(shard["k1"], shard["k2"], sequences, strict=True):
            spans: list[list] = []
            for end, first in automaton.firsts(words, window):
                if spans and spans[-1][2] == first and end - window <= spans[-1][1]:
                    spans[-1][1] = end
                else:
                    spans.append([end - window, end, first])
            out.append((k1, k2, [dict(zip(("begin", "end", "first"), x, strict=True)) for x in spans]))
        return pd.DataFrame(out, columns=["k1", "k2", "spans"])

    return contents.groupBy("shard").applyInPandas(run, f"k1 bigint, k2 bigint, spans array<struct<begin:int,end:int,first:{id_type(contents, 'first')}>>")


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def find_repeats(docs: DataFrame, scratch: Scratch, window: int) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, version, text): spans to remove (doc_id, version, begins, ends), and the copies (doc_id, version) of earlier texts."""
    texts = docs.select("doc_id", "version", F.xxhash64(F.lit(1), "text").alias("k2"))
    first = scratch.store(texts.groupBy("version", "k2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    copies = join_counted(texts, first, ["version", "k2"], "n", F.col("doc_id")).where("doc_id > first").select("doc_id", "version").distinct()
    copies = scratch.store(copies, "copies")
    own = docs.join(small(copies, copies.count()), ["doc_id", "version"], "left_anti")

    p = prints(own, window)
    told = scratch.store(keyed(p), "keyed")
    place = F.struct("at", "key").alias("place")
    held = join_counted(p, told, ["g"], "n", F.col("doc_id")).select("doc_id", "version", place)
    held = held.groupBy("doc_id", "version").agg(F.collect_set("place").alias("p"))  # of one document
    held = held.select("doc_id", "version", F.col("p.at").alias("at"), F.col("p.key").alias("keys"))
    held = scratch.store(held, "places")
    weight = held.agg(F.coalesce(F.sum(F.size("at") + 10), F.lit(0))).first()[0]
    cut = scratch.store(stretches(own.join(small(held, weight), ["doc_id", "version"]), window), "stretches")
    scratch.drop("places", "keyed", "firsts")

    # equal stretches of a key are one content
    names = [F.xxhash64("key", "words").alias("k1"), F.xxhash64(F.lit(1), "words", "key").alias("k2")]
    contents = cut.groupBy("key", "words").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).select("key", "words", "first", "n", *names)
    contents = scratch.store(contents, "contents")
    n_words = F.sum(F.length("words") / 8)
    total = contents.agg(F.coalesce(n_words, F.lit(0))).first()[0]
    shard = F.pmod("key", F.lit(int(total // SHARD_WORDS) + 1)).alias("shard")
    large = scratch.store(contents.groupBy("key").agg(n_words.alias("w")).where(F.col("w") > KEY_WORDS).select("key"), "large")
    large = small(large, large.count())
    found = match(contents.join(large, "key", "left_anti").select(shard, "k1", "k2", "words", "first"), window)
    apart = scratch.store(single_windows(contents.join(large, "key", "left_semi"), window), "apart")
    again = apart.groupBy("key", "words").agg(F.min("first").alias("first")).select(shard, F.col("key").alias("k1"), F.xxhash64(F.lit(2), "words").alias("k2"), "words", "first")
    told = match(again, window).select(F.col("k1").alias("key"), F.col("k2").alias("w2"), "spans")
    moved = F.transform("spans", lambda x: F.struct((x["begin"] + F.col("at")).alias("begin"), (x["end"] + F.col("at")).alias("end"), x["first"].alias("first")))
    parts = apart.withColumn("w2", F.xxhash64(F.lit(2), "words")).join(told, ["key", "w2"]).groupBy("k1", "k2").agg(F.flatten(F.collect_list(moved)).alias("spans"))  # of one content
    found = scratch.store(found.unionByName(parts).join(contents.select("k1", "k2", "n"), ["k1", "k2"]), "found")
    places = cut.select("doc_id", "version", "start", *names)
    gone = join_counted(places, found, ["k1", "k2"], "n", F.struct("doc_id", "start")).select("doc_id", "version", "start", F.filter("spans", lambda x: x["first"] < F.col("doc_id")).alias("spans"))
    gone = gone.where(F.size("spans") > 0).groupBy("doc_id", "version").agg(
        F.flatten(F.collect_list(F.transform("spans", lambda x: x["begin"] + F.col("start")))).alias("begins"),
        F.flatten(F.collect_list(F.transform("spans", lambda x: x["end"] + F.col("start")))).alias("ends"),
    )  # spans of one document
    gone = scratch.store(gone, "spans")
    scratch.drop("stretches", "contents", "found", "large", "apart")
    return gone, copies


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed and text (the words kept, joined by one blank).

    A word goes if a window of `window` consecutive words covers it whose words, unchanged, also start in a document of smaller
    id; windows are judged on the input. Null and empty texts have no words; rows that repeat an id don't affect each other; a
    row without id keeps its words and is no reference; empty tables give an empty result; other columns are ignored.
    """
    if window <= GRAM:
        raise ValueError(f"a window needs over {GRAM} words")
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    named = rows.where("doc_id is not null")
    spans, copies = find_repeats(named, scratch, window)
    gone = spans.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True)
    weight = gone.agg(F.coalesce(F.sum(F.when(F.col("copy"), 1).otherwise(F.size("begins") + 1)), F.lit(0))).first()[0]
    both = rows.join(small(gone, weight), ["doc_id", "version"], "left").select("doc_id", "text", "copy", "begins", "ends")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_unused()
        for b in batches:
            for part in slices(b["text"].str.len(), CHUNK_CHARS):
                n, removed, kept = [], [], []
                rows = b.iloc[part]
                for t, copy, begins, ends in zip(rows["text"], rows["copy"], rows["begins"], rows["ends"], strict=True):
                    words = t.encode("utf-8", "surrogatepass").split()  # parts bytes at just the white space meant here
                    n.append(len(words))
                    if copy is True and len(words) >= window:
                        words = []
                    elif begins is not None and copy is False:
                        gone = np.zeros(len(words) + 1, np.int64)
                        np.add.at(gone, begins, 1)
                        np.add.at(gone, ends, -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]
                    removed.append(n[-1] - len(words))
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                yield pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "n_words": n, "n_removed": removed, "text": kept})

    return both.mapInPandas(run, f"doc_id {id_type(docs, id_col)}, n_words bigint, n_removed bigint, text string")


def repeat_report(docs: DataFrame, **options) -> DataFrame:
    return remove_repeats(docs, **options).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


REPEAT_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS i FROM d WHERE len(words) >= 13
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS content FROM w
), firsts AS (
  SELECT content, min(doc_id) AS first FROM windows GROUP BY content HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i FROM windows JOIN firsts USING (content) WHERE doc_id > first
), places AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d
), kept AS (
  SELECT p.doc_id, count(g.i) AS r, string_agg(word, ' ' ORDER BY p.i) FILTER (g.i IS NULL) AS t
  FROM places p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
