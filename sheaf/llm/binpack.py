"""Packing of tokenised documents into as few sequences as possible, without cutting any that fits one.

Documents become token ids and a closing id; longer ones are cut into pieces of the full length. How the sequences are filled is
decided on the histogram of piece lengths alone, by the configuration program of `configlp`: at most as many entries as a
sequence has places, so the driver's share doesn't grow with the table. Each piece then finds its place by its rank among the
pieces of its length: ranks come from counts by task, so no length is ever gathered in one task.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, id_type, ids_and_texts, release_unused, slices
from .configlp import Plan, plan

BLANKS = re.compile("[ \t\n\x0b\x0c\r]+")
# Blanks and characters that the normaliser at most lower-cases, one by one, and the vocabulary's pre-tokens of them.
PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^\t-\r a-zà-öø-ÿß0-9]+")
PIECE = "doc_id {id}, piece int, start bigint, length bigint, ids binary, ids_crc32 bigint, task bigint, nth bigint"
PLACED = "doc_id {id}, piece int, start bigint, length bigint, ids binary, ids_crc32 bigint, sequence_id bigint, offset bigint"


class WordEncoder:
    """Ids by a `tokenizers` file whose pre-tokens never hold a blank, whose normaliser treats what blanks part on its own, and whose
    last token of each pre-token ends with a suffix. Texts of plain Latin letters are cut into pre-tokens here, and these are
    encoded once and kept, in two generations of `most` each, so that memory is bounded; many are encoded as one text and told
    apart by the suffix. Other stretches between blanks, and those that may hold an added token, go to the library as they are."""

    LONGEST, AT_ONCE, AS_IT_IS = 48, 1000, "\0"

    def __init__(self, path: str, most: int = 450_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        suffix = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True

    def apart(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens."""
        out = []
        for i in range(0, len(words), self.AT_ONCE):
            some = words[i : i + self.AT_ONCE]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *stops], stops)] if len(stops) == len(some) else self.apart(some)  # noqa: B905
        return out

    def keys(self, text: str) -> list[str]:
        """Pre-tokens of a text, and marked stretches that the library must see as they are."""
        if PLAIN.fullmatch(text) and "<|" not in text:
            return WORDS.findall(text.lower())
        out = []
        for c in BLANKS.split(text):
            if PLAIN.fullmatch(c) and "<|" not in c:
                out += WORDS.findall(c.lower())
            else:
                out.append(self.AS_IT_IS + c)
        return out

    def learn(self, keys: list[str]) -> None:
        """Puts the ids of keys that the young generation lacks there."""
        new = []
        for k in keys:
            ids = self.old.get(k)
            if ids is None:
                new.append(k)
            else:
                self.young[k] = ids
        words = [k for k in new if k[0] != self.AS_IT_IS]
        others = [k for k in new if k[0] == self.AS_IT_IS]
        self.young.update(zip(words, self.together(words), strict=True))
        self.young.update(zip(others, self.apart([k[1:] for k in others]), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as little-endian 32-bit numbers."""
        split, young = [self.keys(t) for t in texts], self.young
        missing = set().union(*split).difference(young)
        if missing:
            self.learn(missing)
        out = [b"".join(map(young.__getitem__, ks)) for ks in split]
        for k in missing:
            if len(k) > self.LONGEST:
                del young[k]
        if len(young) > self.most:
            self.young, self.old = {}, young
        return out


@lru_cache(maxsize=1)
def word_encoder(path: str | None) -> WordEncoder:
    """One for all tasks of a process; without a path, the public word-end vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return WordEncoder(path)


def encoded(batches: Iterator[pd.DataFrame], encode: WordEncoder, most_chars: int = 1 << 19) -> Iterator[tuple[object, bytes]]:
    """(doc_id, ids) of all rows, some texts at a time."""
    for b in batches:
        for part in slices(map(len, b["text"]), most_chars):
            yield from zip(b["doc_id"][part], encode(b["text"][part].tolist()), strict=True)


def pieces_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 4096, end_id: int = 1, keep_ids: bool = True, tokenizer: str | None = None) -> DataFrame:
    """The pieces of every document; `task` and `nth` count the pieces of each length in the order of a task. Map-only."""
    end = np.array([end_id], "<u4").tobytes()
    columns = ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "task", "nth"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_unused()
        from pyspark import TaskContext

        encode, task, seen, rows = word_encoder(tokenizer), TaskContext.get().partitionId(), [0] * (max_tokens + 1), []
        size = 0
        for d, ids in encoded(batches, encode):
            ids += end
            n = len(ids) // 4
            for piece, at in enumerate(range(0, n, max_tokens)):
                k = min(max_tokens, n - at)
                own = ids[4 * at : 4 * (at + k)]
                rows.append((d, piece, at, k, own if keep_ids else None, zlib.crc32(own), task, seen[k]))
                seen[k] += 1
                size += k
            if size > 1 << 20:
                yield pd.DataFrame(rows, columns=columns)
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return ids_and_texts(docs, id_col, text_col).mapInPandas(run, PIECE.format(id=id_type(docs, id_col)))


def places(plans: list[Plan]) -> tuple[np.ndarray, ...]:
    """One row for each kind of bin and length in it, by length: (length, first rank, copies a bin, first bin, offset of the first copy)."""
    rows, used = [], {}
    for p in plans:
        offset = 0
        for n, copies in p.lengths:
            rank = used.get(n, 0)
            rows.append((n, rank, copies, p.first, offset))
            used[n] = rank + copies * p.bins
            offset += n * copies
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5


def place(table: tuple[np.ndarray, ...], length: np.ndarray, rank: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by their length and rank among those of that length."""
    lengths, first, copies, bin_, offset = table
    at = np.empty(len(length), np.int64)
    order = np.argsort(length, kind="stable")
    sizes, begin = np.unique(length[order], return_index=True)
    for n, rows in zip(sizes, np.split(order, begin[1:]), strict=True):
        lo, hi = np.searchsorted(lengths, n), np.searchsorted(lengths, n, "right")
        at[rows] = lo + np.searchsorted(first[lo:hi], rank[rows], "right") - 1
    past = rank - first[at]
    return bin_[at] + past // copies[at], offset[at] + past % copies[at] * length


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 4096, end_id: int = 1, keep_ids: bool = True, tokenizer: str | None = None, **options,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian 32-bit; null without keep_ids), ids_crc32, sequence_id, offset.

    Null text counts as empty and gives one piece with the closing id; repeated rows are packed each, with pieces of their own;
    rows without doc_id are packed like others; an empty table gives no pieces; other columns are ignored. options go to
    `configlp.solve`. Runs two jobs before it returns: the pieces are written to the shared folder, and their lengths counted.
    """
    spark, kind = docs.sparkSession, id_type(docs, id_col)
    scratch = Scratch(spark, "binpack")
    pieces = scratch.store(pieces_of(docs, id_col, text_col, max_tokens, end_id, keep_ids, tokenizer), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    counted = by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most max_tokens rows
    lengths = np.array(sorted(r["length"] for r in counted), np.int64)
    n_of = {r["length"]: r["n"] for r in counted}
    plans, _ = plan(lengths, np.array([n_of[int(n)] for n in lengths], np.int64), max_tokens, **options)
    table = spark.sparkContext.broadcast(places(plans))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                length = b["length"].to_numpy(np.int64)
                b["sequence_id"], b["offset"] = place(table.value, length, b["first"].to_numpy(np.int64) + b["nth"].to_numpy(np.int64), max_tokens)
            else:
                b["sequence_id"] = b["offset"] = np.zeros(0, np.int64)
            yield b[["doc_id", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"]]

    return pieces.join(starts, ["length", "task"]).mapInPandas(run, PLACED.format(id=kind))


def best_fit_report(docs: DataFrame, **options) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pack(docs, keep_ids=False, **options).drop("ids")
