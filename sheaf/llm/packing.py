"""Vector bin packing of tokenised documents into sequences of a fixed length.

Each document becomes its token ids and a closing id 0. Whole multiples of the sequence length are cut off as sequences of
their own; what remains is packed under three limits at once: tokens, segments and loss-bearing tokens. The next piece for
an open sequence is the one with the largest dot product of its demand and the room left, each dimension as a share of its
limit. When none fits any more, the piece of which most fits is cut to the room left and its rest goes back. Blocks of `block_items`
documents are packed on their own, so a task holds a block, whatever the table's size.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, ids_and_texts, release_unused, slices

# Plain Latin text, and what the vocabulary's pattern makes of it: a contraction, or a run of letters, digits or other
# signs with the blank before it, or white space up to the last one before a word.
PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
WORD = re.compile("'(?:[sdmt]|ll|ve|re)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9À-ÖØ-öø-ÿ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
END = np.zeros(1, "<u4").tobytes()

SCHEMA = "doc_id {id}, start bigint, length bigint, ids binary, ids_crc32 bigint, loss_tokens bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class WordIds:
    """Token ids (little-endian bytes) of words, filled as they come; a pre-token never spans two of them. Two generations of at most
    `most` each (and a batch's words): what is looked up again in the older one comes into the younger."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def unknown(self, words: set[str]) -> list[str]:
        """Words that neither generation has; those of the older one are moved."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        missing = words.difference(self.young)
        known = [w for w in missing if w in self.old]
        self.young.update((w, self.old[w]) for w in known)
        return list(missing.difference(known)) if known else list(missing)


class Encoder:
    """The ids that the `tokenizers` file gives, by its rank-file twin; plain Latin texts are cut as the vocabulary's pattern cuts
    them, so that frequent words are looked up. Texts with other characters are encoded whole. With `added`, texts that hold the string of an added token, which that library takes for the token, are encoded by the library itself."""

    def __init__(self, vocabulary: str | None = None, added: bool = False, word_cache: int = 60_000):
        import public_tokenizers
        import tiktoken

        with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain = encoding.encode_ordinary
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)  # bytes of each token
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        self.words = WordIds(word_cache)
        self.twin = public_tokenizers.path("byte_bpe_50k.json") if vocabulary is None else re.sub(r"(\.tiktoken)?$", ".json", vocabulary, count=1)
        self.added, self.library = [], None
        if added and os.path.exists(self.twin):  # a rank file alone has no added tokens
            with open(self.twin, encoding="utf-8") as f:
                whole = f.read()
            # this list alone is decoded: the vocabulary beside it would take much more
            tokens = json.JSONDecoder().raw_decode(whole, whole.index("[", whole.index('"added_tokens"')))[0]
            self.added = [t["content"] for t in tokens]
            self.lengths = np.pad(self.lengths, (0, max([0, *(t["id"] + 1 - len(self.lengths) for t in tokens)])))
            for t in tokens:
                self.lengths[t["id"]] = len(t["content"].encode())

    def whole(self, text: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.twin)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        return self.all([text])[0]

    def all(self, texts: list[str]) -> list[bytes]:
        """The same of several texts."""
        cut = [WORD.findall(t) if PLAIN.fullmatch(t) and not any(a in t for a in self.added) else None for t in texts]
        self.learn(self.words.unknown(set().union(*(c for c in cut if c))))
        ids = self.words.young.__getitem__
        return [b"".join(map(ids, c)) if c is not None else self.odd(t) for t, c in zip(texts, cut, strict=True)]

    def odd(self, text: str) -> bytes:
        return self.whole(text) if any(t in text for t in self.added) else np.array(self.plain(text), "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Encodes new words that begin with their blank as one text: the pattern splits before each, so that a word ends where as
        many bytes of tokens do. Others, and a batch for which that fails, are left to be encoded one by one."""
        some = [w for w in words if w[0] == " " and len(w) > 1]
        young = self.words.young
        if len(some) > 8:
            ids = np.array(self.plain("".join(some)), "<u4")
            ends, wanted = np.cumsum(self.lengths[ids]), np.cumsum([len(w.encode("utf-8", "surrogatepass")) for w in some])
            stops = np.searchsorted(ends, wanted) + 1
            if stops[-1] == len(ids) and (ends[stops - 1] == wanted).all():
                raw, stops = ids.tobytes(), (4 * stops).tolist()
                young.update({w: raw[a:b] for w, a, b in zip(some, [0, *stops], stops)})  # noqa: B905
        young.update({w: np.array(self.plain(w), "<u4").tobytes() for w in words if w not in young})


@lru_cache(maxsize=1)
def encoder(vocabulary: str | None, word_cache: int) -> Encoder:
    """One for all tasks of a process."""
    return Encoder(vocabulary, added=True, word_cache=word_cache)


def prompt_tokens(ids: bytes, lengths: np.ndarray, prompt_bytes: int) -> int:
    """How many tokens begin before the prompt's last byte; they bear no loss. A token has a byte at least, so they are among the
    first `prompt_bytes`."""
    n = lengths[np.frombuffer(ids[: 4 * prompt_bytes], "<u4")]
    return int(np.searchsorted(np.cumsum(n) - n, prompt_bytes))


def pack_block(sizes: np.ndarray, losses: list[np.ndarray | None], limits: tuple[int, int, int], order: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Packs documents of a block. Returns (document, start, length, sequence, offset) of each piece.

    losses: per document the cumulated loss-bearing tokens (length + 1 numbers), or None where every token bears loss.
    order: tie-break among equal pieces (a number for each document).
    """
    tokens, segments, most_loss = limits
    loss_of = lambda d, a, b: int(b - a if losses[d] is None else losses[d][b] - losses[d][a])
    out, sequence = [], 0
    rest = []  # (document, start, length) still to place
    for d, n in enumerate(sizes.tolist()):
        at = 0
        while n - at >= tokens and loss_of(d, at, at + tokens) <= most_loss:
            out.append((d, at, tokens, sequence, 0))
            sequence, at = sequence + 1, at + tokens
        while n - at > tokens:  # too many loss-bearing tokens for one sequence: shorter pieces, packed with others
            step = tokens if losses[d] is None else int(np.searchsorted(losses[d], losses[d][at] + most_loss, "right")) - 1 - at
            step = max(1, min(step, tokens, most_loss if losses[d] is None else tokens))
            rest.append((d, at, step))
            at += step
        while at < n:
            step = n - at
            while step > 1 and loss_of(d, at, at + step) > most_loss:
                step //= 2
            rest.append((d, at, step))
            at += step
    if not rest:
        return out
    doc, start, length = (np.array(c, np.int64) for c in zip(*rest, strict=True))
    loss = np.array([loss_of(d, a, a + n) for d, a, n in rest], np.int64)
    live = np.lexsort((start, order[doc], -length))  # largest first
    doc, start, length, loss = doc[live], start[live], length[live], loss[live]
    share = np.stack([length / tokens, np.full(len(length), 1 / segments), loss / max(1, most_loss)])
    behind = [0 if losses[d] is None else int(np.searchsorted(losses[d], losses[d][0], "right")) - 1 for d in doc.tolist()]  # where a document's loss-bearing tokens begin
    prompt = np.maximum(np.array(behind, np.int64) - start, 0)  # tokens of a piece before that
    open_ = np.ones(len(length), bool)
    left = len(length)
    first = 0
    while left:
        if 2 * left < len(open_):  # what is placed is dropped now and then
            doc, start, length, loss, prompt, share, open_, first = doc[open_], start[open_], length[open_], loss[open_], prompt[open_], share[:, open_], np.ones(left, bool), 0
        room_t, room_s, room_l, offset = tokens, segments, most_loss, 0
        while first < len(open_) and not open_[first]:
            first += 1
        while left and room_t and room_s:
            tail = slice(first, None)
            fit = open_[tail] & (length[tail] <= room_t) & (loss[tail] <= room_l)
            if fit.any():
                room = (room_t / tokens, room_s / segments, room_l / max(1, most_loss))
                score = share[0, tail] * room[0] + share[1, tail] * room[1] + share[2, tail] * room[2]
                i = first + int(np.argmax(np.where(fit, score, -1.0)))
                take = int(length[i])
            else:  # cut the piece of which the room left holds most: where loss is the limit, one with a long prompt
                takes = np.where(open_[tail], np.minimum(np.minimum(length[tail], room_t), prompt[tail] + room_l), 0)
                i = first + int(np.argmax(takes))
                take = int(takes[i - first])
                while take and loss_of(int(doc[i]), int(start[i]), int(start[i]) + take) > room_l:
                    take -= 1  # only where loss doesn't simply begin behind a prompt
                if not take:
                    break
            d, a, used = int(doc[i]), int(start[i]), int(take)
            out.append((d, a, used, sequence, offset))
            used_loss = loss_of(d, a, a + used)
            offset, room_t, room_s, room_l = offset + used, room_t - used, room_s - 1, room_l - used_loss
            if used == length[i]:
                open_[i] = False
                left -= 1
            else:
                start[i] += used
                length[i] -= used
                loss[i] -= used_loss
                prompt[i] = max(0, prompt[i] - used)
                share[0, i], share[2, i] = length[i] / tokens, loss[i] / max(1, most_loss)
            while first < len(open_) and not open_[first]:
                first += 1
        sequence += 1
    return out


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loss_from_col: str | None = None, max_tokens: int = 1024,
    max_segments: int = 256, max_loss_tokens: int | None = None, block_items: int = 2048, vocabulary: str | None = None, word_cache: int = 400_000, keep_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit; null without keep_ids), ids_crc32, loss_tokens, doc_tokens, sequence_id, offset.

    loss_from_col names a column with the code point at which a row's loss-bearing text begins (a prompt stands before it): tokens
    that begin there or later bear loss. Without it every token does. Null text counts as empty and gives one piece with the closing id; repeated rows are
    packed each; an empty table gives no pieces; other columns are ignored. word_cache bounds the words a Python worker keeps with
    their ids, in each of two generations (200 bytes each or so). Map-only: sequence ids hold the task's number
    above 2**33, so they are unique, and the same again if a lost task is repeated.
    """
    limits = (max_tokens, max_segments, max_tokens if max_loss_tokens is None else max_loss_tokens)
    if min(limits) < 1:
        raise ValueError("limits must be positive")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_unused()
        from pyspark import TaskContext

        encode, block = encoder(vocabulary, word_cache), []
        next_id = TaskContext.get().partitionId() << 33
        for b in batches:
            starts = b["loss_from"] if loss_from_col else [None] * len(b)
            texts = b["text"].tolist()
            encoded = (i for part in slices(map(len, texts), 1 << 19) for i in encode.all(texts[part]))
            for d, text, at, ids in zip(b["doc_id"], texts, starts, encoded, strict=True):
                prompt = 0
                if loss_from_col and at is not None and at == at and at > 0:
                    prompt = prompt_tokens(ids, encode.lengths, len(text[: int(at)].encode("utf-8", "surrogatepass")))
                block.append((d, ids + END, prompt))
                if len(block) == block_items:
                    next_id, frame = emit(block, next_id)
                    yield frame
                    block = []
        if block:
            yield emit(block, next_id)[1]

    def emit(block, next_id):
        sizes, prompts = np.array([len(i) // 4 for _, i, _ in block]), np.array([p for *_, p in block])
        losses = [np.maximum(np.arange(n + 1, dtype=np.int32) - p, 0, dtype=np.int32) if p else None for n, p in zip(sizes.tolist(), prompts.tolist(), strict=True)]
        pieces = pack_block(sizes, losses, limits, np.arange(len(block)))
        doc, start, length, sequence, offset = np.array(pieces, np.int64).T
        own = [block[d][1][4 * a : 4 * (a + n)] for d, a, n, *_ in pieces]
        bears = np.maximum(start + length - prompts[doc], 0) - np.maximum(start - prompts[doc], 0)
        out = {
            "doc_id": pd.Series([d for d, *_ in block]).to_numpy()[doc], "start": start, "length": length, "ids": own if keep_ids else None, "ids_crc32": [zlib.crc32(i) for i in own],
            "loss_tokens": bears, "doc_tokens": sizes[doc], "sequence_id": next_id + sequence, "offset": offset,
        }
        return next_id + int(sequence.max()) + 1, pd.DataFrame(out)

    rows = ids_and_texts(docs, id_col, text_col)
    if loss_from_col:
        rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), docs[loss_from_col].cast("bigint").alias("loss_from"))
    return rows.mapInPandas(run, SCHEMA.format(id=id_type(docs, id_col)))


def packing_report(docs: DataFrame, max_segments: int = 4, max_loss_tokens: int = 960, **options) -> DataFrame:
    """The pieces with a checksum in place of their ids. A text's first line, its heading, is prompt: it bears no loss."""
    text = F.col("text").cast("string")
    own = docs.select("doc_id", text.alias("text"), F.instr(text, "\n").alias("loss_from"))  # behind the first line break; 0 without one
    r = pack(own, loss_from_col="loss_from", max_segments=max_segments, max_loss_tokens=max_loss_tokens, keep_ids=False, **options)
    return r.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")


def instruction_examples(turns: DataFrame) -> DataFrame:
    """One example for each assistant turn: id (conversation:turn), text (the turn before it, a line break, the reply) and loss_from.

    A reply without a turn before it is an example without a prompt; null texts count as empty. The turn before is found by a
    join on conversation and number, so no conversation is gathered in one place.
    """
    said = F.coalesce(F.col("text").cast("string"), F.lit(""))
    replies = turns.where("role = 'assistant'").select("conv_id", "turn", said.alias("reply"))
    prompts = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.concat(said, F.lit("\n")).alias("prompt"))
    both = replies.join(prompts, ["conv_id", "turn"], "left")
    prompt = F.coalesce("prompt", F.lit(""))
    return both.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.concat(prompt, "reply").alias("text"), F.length(prompt).alias("loss_from"))


def conversation_report(turns: DataFrame, max_loss_tokens: int = 880, max_segments: int = 4, **options) -> DataFrame:
    """Packs instruction examples under three limits that all bind: of a full sequence at most 880 tokens may bear loss."""
    r = pack(instruction_examples(turns), id_col="id", loss_from_col="loss_from", max_loss_tokens=max_loss_tokens, max_segments=max_segments, **options)
    return r.select(F.col("doc_id").alias("example_id"), "start", "length", "loss_tokens", "doc_tokens", "sequence_id", "offset")
