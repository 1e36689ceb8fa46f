"""Language identification by a linear-chain conditional random field over words.

A word's emission score per language sums hashed features: affixes, character n-grams and its own form (a lexicon learned
from the sample). Learned transitions tie neighbouring words together. Forward-backward gives every word's posterior; a
document's language is the one with the largest posterior mass over its words, so code-switched text is labelled word by
word. Feature extraction and the recursions run on arrays over a whole batch of texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, id_type, ids_and_texts, release_unused, slices

BITS = 16  # log2 of the number of hashed features
MIX = np.uint32(0x9E3779B1)
CHUNK_CHARS = 300_000  # whose features are held at once, some fifty bytes a character
STEP_CHARS = 1_500_000  # whose words go through the recursions in step, some ten bytes a character

SAMPLE_DOCS = 800  # labelled rows a model is fitted on, whole texts

SCHEMA = "doc_id {id}, lang_pred string, score double, n_words bigint, words_by_lang map<string,bigint>"

_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """1 at each code point that is a letter, 2 at a combining mark, else 0; made once in a process."""
    if not _LETTERS:
        kinds = (unicodedata.category(chr(c))[0] for c in range(0x110000))
        _LETTERS.append(np.fromiter((1 if k == "L" else 2 if k == "M" else 0 for k in kinds), np.uint8, 0x110000))
    return _LETTERS[0]


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # features by languages
    transitions: np.ndarray  # from, to
    start: np.ndarray


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words (runs of letters and their marks) of many texts: code points of all words, where each begins, and each one's text number.

    The first array has one code point more than the words need (a stop), and the second one entry more.
    """
    lower = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in lower], np.int64)
    flat = np.frombuffer(" ".join(lower).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = np.concatenate([[0], letter_table()[flat], [0]]).astype(np.uint8)
    edge = np.flatnonzero((kind[1:] > 0) != (kind[:-1] > 0))
    begin, end = edge[::2], edge[1::2]
    letters = np.concatenate([[0], np.cumsum(kind[1:] == 1)])
    some = letters[end] > letters[begin]  # a run of combining marks alone is no word
    begin, end = begin[some], end[some]
    first = np.cumsum(sizes + 1) - (sizes + 1)
    text_of = np.searchsorted(first, begin, "right") - 1
    length = end - begin
    starts = np.concatenate([[0], np.cumsum(length)])
    chars = flat[np.repeat(begin - starts[:-1], length) + np.arange(starts[-1])]
    return chars.astype(np.uint32), starts, text_of


def hashed(kind: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), 0x811C9DC5 + 0x1000193 * kind & 0xFFFFFFFF, np.uint32)
    for p in parts:
        h = (h ^ p) * MIX
        h ^= h >> np.uint32(15)
    return h & np.uint32((1 << BITS) - 1)


def features(chars: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Feature groups, one after the other: (hashes at characters, number of the word of each) or (one hash for each word, None)."""
    n = len(starts) - 1
    length = np.diff(starts)
    word = np.repeat(np.arange(n), length)
    left = np.arange(len(chars)) - starts[word]
    right = length[word] - 1 - left
    yield hashed(1, chars), word
    for kind in (2, 3):  # n-grams of two and three characters
        inside = np.flatnonzero(right >= kind - 1)
        yield hashed(kind, *(chars[inside + k] for k in range(kind))), word[inside]
    del word, right
    first, last = starts[:-1], starts[1:] - 1
    for k in (2, 3):  # affixes; a short word gives what it has
        yield hashed(10 + k, *(chars[np.minimum(first + i, last)] for i in range(k))), None
        yield hashed(20 + k, *(chars[np.maximum(last - i, first)] for i in range(k))), None
    # the lexicon: the word itself, as a sum of its hashed characters by position
    mixed = (chars * MIX) ^ (left.astype(np.uint32) * np.uint32(0x85EBCA6B) + np.uint32(77))
    mixed = (mixed ^ mixed >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    form = np.add.reduceat(mixed, first, dtype=np.uint32) if n else np.zeros(0, np.uint32)
    yield hashed(30, form, length.astype(np.uint32)), None


def emissions(model_weights: np.ndarray, chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Score of each word in each language; character features count as their mean."""
    n, k = len(starts) - 1, model_weights.shape[1]
    out = np.zeros((n, k), np.float32)
    length = np.diff(starts).astype(np.float32)
    for order, (h, word) in enumerate(features(chars, starts)):
        if word is None:
            out += model_weights[h]
        elif len(h):
            scale = 1 / np.maximum(length - order, 1)
            for j in range(k):
                out[:, j] += np.bincount(word, model_weights[h, j], n).astype(np.float32) * scale
    return out


def posteriors(emit: np.ndarray, text_of: np.ndarray, model: Model) -> np.ndarray:
    """Forward-backward over each text's words, all texts in step. Rows sum to 1."""
    n, k = emit.shape
    if not n:
        return emit
    e = np.exp(emit - emit.max(1, keepdims=True))
    trans, start = np.exp(model.transitions).astype(np.float32), np.exp(model.start).astype(np.float32)
    first = np.flatnonzero(np.r_[True, text_of[1:] != text_of[:-1]])
    length = np.diff(np.r_[first, n])
    longest = np.argsort(-length, kind="stable")
    first, length = first[longest], length[longest]
    alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")  # texts with at least i words
    alpha, beta = np.empty_like(e), np.ones_like(e)
    a = e[first] * start
    alpha[first] = a = a / a.sum(1, keepdims=True)
    for i in range(1, length[0]):
        m = alive[i]
        a = (a[:m] @ trans) * e[first[:m] + i]
        a /= a.sum(1, keepdims=True)
        alpha[first[:m] + i] = a
    b = np.ones((0, k), np.float32)
    for i in range(length[0] - 1, 0, -1):
        m = alive[i]
        if len(b) < m:
            b = np.concatenate([b, np.ones((m - len(b), k), np.float32)])
        b = (b * e[first[:m] + i]) @ trans.T
        b /= b.sum(1, keepdims=True)
        beta[first[:m] + i - 1] = b
    p = alpha * beta
    return p / p.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str], sequence_words: int = 24, rounds: int = 3, rate: float = 0.5, seed: int = 7) -> Model:
    """Fits the field by stochastic gradient on the log-likelihood. Whole texts are cut into sequences; every second one is spliced
    from two, so that the transitions learn that languages switch."""
    langs = sorted(set(labels))
    k = len(langs)
    model = Model(langs, np.zeros((1 << BITS, k), np.float32), np.zeros((k, k)), np.zeros(k))
    if k < 2:
        return model
    rng = np.random.default_rng(seed)
    number = {v: i for i, v in enumerate(langs)}
    chars, starts, text_of = words_of(texts)
    y_of = np.array([number[v] for v in labels])
    bounds = np.searchsorted(text_of, np.arange(len(texts) + 1))
    spans = [(c, min(c + sequence_words, b)) for a, b in zip(bounds[:-1], bounds[1:], strict=True) for c in range(a, b, sequence_words)]
    if not spans:
        return model
    grams = list(features(chars, starts))
    length = np.diff(starts).astype(np.float32)
    by_word = [np.searchsorted(w, np.arange(len(starts))) if w is not None else None for _, w in grams]
    g_sum = np.full(model.weights.shape, 1e-6, np.float32)
    t_sum, s_sum = np.full((k, k), 1e-6), np.full(k, 1e-6)
    spans = np.array(spans)
    for _ in range(rounds):
        order = rng.permutation(len(spans))
        for at in range(0, len(order), 256):
            seqs = []
            part = order[at : at + 256]
            for i, s in enumerate(part):
                a, b = spans[s]
                if i % 2 and i + 1 < len(part) + 1:
                    c, d = spans[part[i - 1]]
                    cut = int(rng.integers(1, sequence_words))
                    seqs.append(np.r_[np.arange(a, min(a + cut, b)), np.arange(c, min(c + sequence_words - cut, d))])
                else:
                    seqs.append(np.arange(a, b))
            idx = np.concatenate(seqs)
            seq_of = np.repeat(np.arange(len(seqs)), [len(s) for s in seqs])
            y = y_of[text_of[idx]]
            emit = np.zeros((len(idx), k), np.float32)
            rows = []
            for order_, ((h, w), first) in enumerate(zip(grams, by_word, strict=True)):
                if w is None:
                    rows.append((h[idx], np.arange(len(idx)), np.ones(len(idx), np.float32)))
                else:
                    lo, hi = first[idx], first[idx + 1]
                    cnt = hi - lo
                    r = np.repeat(np.arange(len(idx)), cnt)
                    p = np.repeat(lo - (np.cumsum(cnt) - cnt), cnt) + np.arange(int(cnt.sum()))
                    rows.append((h[p], r, 1 / np.maximum(length[idx][r] - order_, 1)))
            for h, r, v in rows:
                np.add.at(emit, r, model.weights[h] * v[:, None])
            post, pair, first_post = _expected(emit, seq_of, model)
            gold = np.eye(k, dtype=np.float32)[y]
            diff = gold - post
            for h, r, v in rows:
                hs, inv = np.unique(h, return_inverse=True)
                g = np.stack([np.bincount(inv, diff[r, j] * v, len(hs)) for j in range(k)], 1).astype(np.float32)
                g_sum[hs] += g * g
                model.weights[hs] += rate * g / np.sqrt(g_sum[hs])
            same = seq_of[1:] == seq_of[:-1]
            gold_pair = np.zeros((k, k))
            np.add.at(gold_pair, (y[:-1][same], y[1:][same]), 1)
            g = gold_pair - pair
            t_sum += g * g
            model.transitions += 0.2 * g / np.sqrt(t_sum)
            heads = np.r_[True, ~same]
            g = gold[heads].sum(0) - first_post
            s_sum += g * g
            model.start += 0.05 * g / np.sqrt(s_sum)
    return model


def _expected(emit, seq_of, model):
    """Word posteriors, summed pair posteriors and summed first-word posteriors of short sequences."""
    k = emit.shape[1]
    length = np.bincount(seq_of)
    first = np.cumsum(length) - length
    width = int(length.max())
    e = np.exp(emit - emit.max(1, keepdims=True)).astype(np.float64)
    trans = np.exp(model.transitions)
    alpha, beta = np.zeros((width, len(length), k)), np.ones((width, len(length), k))
    live = np.arange(width)[:, None] < length
    e3 = np.ones((width, len(length), k))
    e3[np.arange(len(seq_of)) - first[seq_of], seq_of] = e
    alpha[0] = e3[0] * np.exp(model.start)
    alpha[0] /= alpha[0].sum(1, keepdims=True)
    for i in range(1, width):
        a = (alpha[i - 1] @ trans) * e3[i]
        alpha[i] = np.where(live[i][:, None], a / a.sum(1, keepdims=True), alpha[i - 1])
    pair = np.zeros((k, k))
    for i in range(width - 1, 0, -1):
        b = e3[i] * beta[i]
        back = b @ trans.T
        beta[i - 1] = np.where(live[i][:, None], back / back.sum(1, keepdims=True), beta[i - 1])
        q = alpha[i - 1][:, :, None] * trans * b[:, None, :]
        q /= q.sum((1, 2), keepdims=True)
        pair += q[live[i]].sum(0)
    p = alpha * beta
    p /= p.sum(2, keepdims=True)
    return p[np.arange(len(seq_of)) - first[seq_of], seq_of].astype(np.float32), pair, p[0].sum(0)


def label_words(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each word, and each word's text number."""
    emit, text_of = [np.zeros((0, len(model.langs)), np.float32)], [np.zeros(0, np.int64)]
    for part in slices(map(len, texts), CHUNK_CHARS):
        chars, starts, of = words_of(texts[part])
        emit.append(emissions(model.weights, chars, starts))
        text_of.append(of + part.start)
    text_of = np.concatenate(text_of)
    return posteriors(np.concatenate(emit), text_of, model), text_of


def training_sample(docs: DataFrame, most: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """At most `most` labelled texts, the first by a hash of the id (ties by the text's), so any layout gives the same sample."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # ids first, texts only of the chosen
    chosen = rows.select(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")).alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if chosen is None:
        return []
    got = rows.where(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")) <= chosen).select(
        F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")).alias("h"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    return [(r.t, r.l) for r in got.orderBy("h", F.xxhash64("t"), "l").limit(most).collect()]


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, **cols) -> Model:
    """Trains on a bounded sample of labelled rows; sample_docs is the bound."""
    sample = training_sample(docs, sample_docs, **cols)
    model = train([t for t, _ in sample], [v for _, v in sample])
    del sample
    release_unused()  # training takes some seventy bytes a character, which the driver would hold on to
    return model


def score_texts(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: its words, each language's share of the posterior mass, and its words by most likely language."""
    k = max(1, len(model.langs))
    count, share, by_word = np.zeros(len(texts), np.int64), np.zeros((len(texts), k)), np.zeros((len(texts), k), np.int64)
    for part in slices(map(len, texts), STEP_CHARS) if model.langs else ():
        n = part.stop - part.start
        post, text_of = label_words(texts[part], model)
        count[part] = np.bincount(text_of, minlength=n)
        share[part] = np.stack([np.bincount(text_of, post[:, j], n) for j in range(k)], 1) / np.maximum(count[part], 1)[:, None]
        by_word[part] = np.bincount(text_of * k + post.argmax(1), minlength=n * k).reshape(n, k)
    return count, np.clip(share, 0, 1), by_word


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (posterior mass of that language), n_words and the words of each language.

    Texts without a letter, empty and null ones give `und` with score 0. Ties go to the language that sorts first. Repeated
    rows give repeated rows; an empty table gives none; a model without languages predicts `und`. Map-only; the model (some
    hundred KB) travels with the task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_unused()
        for b in batches:
            count, share, by_word = score_texts(b["text"].tolist(), model)
            known = (count > 0) & bool(model.langs)
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "lang_pred": [model.langs[i] if s else "und" for i, s in zip(share.argmax(1), known, strict=True)],
                "score": np.where(known, share.max(1), 0.0), "n_words": count,
                "words_by_lang": [{model.langs[j]: int(c) for j, c in enumerate(r) if c} for r in by_word],
            })

    return ids_and_texts(docs, id_col, text_col).mapInPandas(run, SCHEMA.format(id=id_type(docs, id_col)))


def held_out(doc_id):
    """Rows that no training may see: the checksum of the id's text leaves 2 when divided by 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def language_report(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    model = fit(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(True))), sample_docs)
    p = predict(docs, model)
    return p.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "n_words")


def keep_known_languages(docs: DataFrame, model: Model, min_score: float = 0.4, text_col: str = "text") -> DataFrame:
    """Rows of `docs` (all columns) whose language is found with at least this score; rows without letters go.

    The prediction runs beside the row itself, so nothing is joined and repeated ids do no harm.
    """

    bounded_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_unused()
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col))
            for part in slices(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).tolist(), STEP_CHARS):
                rows = b.slice(part.start, part.stop - part.start)
                count, share, _ = score_texts([t or "" for t in texts.slice(part.start, len(rows)).to_pylist()], model)
                yield rows.filter(pa.array((count > 0) & (share.max(1, initial=0) >= min_score)))

    return docs.mapInArrow(run, docs.schema)
