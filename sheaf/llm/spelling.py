"""Spelling variants: words at one edit's distance, by full neighbourhood generation, grouped under their frequent forms.

Every word of the vocabulary emits all distinct deletions, replacements and insertions over the observed alphabet. Candidates are
made as hashes, many at once from sums over the word's parts; a bit table of the vocabulary's hashes, of bounded size, drops
nearly all that are no words before anything is shuffled, and a join of the rest with the vocabulary decides. What joins is near
by construction, so no distance is computed. The alphabet of the runs has at most 90 code points.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ids_and_texts, release_unused
from .shingles import PRIME, STEP, mix

LETTERS = "[A-Za-zÀ-ÿ]"
INVERSE = np.uint64(pow(int(PRIME), -1, 1 << 64))
MOST_BITS = 28  # of the bit table's size: 32 MB
WORDS_A_TASK = 20_000


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3, typo_modulus: int | None = None) -> DataFrame:
    """word, n: maximal runs of letters with A-Z lower-cased, of at least min_length code points, that occur min_count times or more.

    typo_modulus plants typing errors for tests: where the crc32 of `<doc_id>:<run>` is divisible by it, the run loses the code
    point at that number modulo its length. Null text has no words; a null doc_id counts as an empty one there; repeated rows
    count each.
    """
    shortest = min_length
    run_of = re.compile(f"{LETTERS}{{{shortest},}}")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_unused()
        total: Counter[str] = Counter()
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                runs = Counter(run_of.findall(lowered))
                if typo_modulus:
                    seed = zlib.crc32(f"{doc_id}:".encode())
                    for run, n in runs.items():
                        h = zlib.crc32(run.encode(), seed)
                        if h % typo_modulus == 0:
                            i = h % len(run)
                            run = run[:i] + run[i + 1 :]
                            if len(run) < shortest:
                                continue
                        total[run] += n
                else:
                    total.update(runs)
                if len(total) > 200_000:
                    yield pd.DataFrame({"word": list(total), "n": list(total.values())})
                    total.clear()
        if total:  # a column without values would not be one of strings
            yield pd.DataFrame({"word": list(total), "n": list(total.values())})

    rows = ids_and_texts(docs, id_col, text_col).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return rows.mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def code_points(words: list[str]) -> np.ndarray:
    """Words of one length as a table of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def values(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) * PRIME + STEP) | np.uint64(1)


def by_length(words: list[str], at_once: int) -> Iterator[list[str]]:
    """Blocks of words of one length."""
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for group in groups.values():
        for i in range(0, len(group), at_once):
            yield group[i : i + at_once]


def powers(n: int) -> np.ndarray:
    out = np.full(n, PRIME, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def finished(total: np.ndarray, length: int) -> np.ndarray:
    return mix(total + np.uint64(length * int(STEP) % (1 << 64)))


def hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words of one length."""
    v = values(code_points(words))
    return finished((v * powers(v.shape[1])).sum(1, dtype=np.uint64), v.shape[1])


def bits_of(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Three places of each hash in a table of 2**bits."""
    for k in (PRIME, STEP, INVERSE):
        yield (h * k) >> np.uint64(64 - bits)


def held(table: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Indices of the hashes whose three places are all set."""
    at = np.arange(len(h))
    for p in bits_of(h, bits):
        p = p[at] if len(at) < len(h) else p
        at = at[(table[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return at


def neighbours(words: list[str], alphabet: np.ndarray, table: np.ndarray, bits: int) -> Iterator[tuple[int, str]]:
    """(index of the word, neighbour) for words of one length: all distinct results of one edit that the table may hold."""
    points = code_points(words)
    w, n = points.shape
    v, p, a = values(points), powers(n + 1), values(alphabet)
    terms = v * p[:n]
    head = np.concatenate([np.zeros((w, 1), np.uint64), np.cumsum(terms, 1, dtype=np.uint64)], 1)
    whole = head[:, -1:]
    # one of equal neighbours in a row counts: the last for deletions, a new one stands behind its equals for insertions
    gone = finished(head[:, :-1] + (whole - head[:, 1:]) * INVERSE, n - 1)
    for k in held(table, gone.ravel(), bits):
        j, i = divmod(int(k), n)
        if i == n - 1 or points[j, i] != points[j, i + 1]:
            yield j, words[j][:i] + words[j][i + 1 :]
    other = finished(whole[:, :, None] + (a[None, None, :] - v[:, :, None]) * p[None, :n, None], n)
    for k in held(table, other.ravel(), bits):
        ji, c = divmod(int(k), len(a))
        j, i = divmod(ji, n)
        if points[j, i] != alphabet[c]:
            yield j, words[j][:i] + chr(alphabet[c]) + words[j][i + 1 :]
    more = finished((head + (whole - head) * PRIME)[:, :, None] + a[None, None, :] * p[None, :, None], n + 1)
    for k in held(table, more.ravel(), bits):
        ji, c = divmod(int(k), len(a))
        j, i = divmod(ji, n + 1)
        if i == n or points[j, i] != alphabet[c]:
            yield j, words[j][:i] + chr(alphabet[c]) + words[j][i:]


def bit_table(vocabulary: DataFrame, bits: int) -> np.ndarray:
    """The places of all words in a table of 2**bits, set by Spark's bitmap aggregate; at most 2**MOST_BITS bits reach the driver."""

    def spots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block in by_length(b["word"].tolist(), 1 << 14):
                spot = np.concatenate(list(bits_of(hashes(block), bits)))
                yield pd.DataFrame({"bucket": (spot >> np.uint64(15)).astype(np.int64), "bit": (spot & np.uint64(32767)).astype(np.int64)})

    rows = vocabulary.select("word").mapInPandas(spots, "bucket bigint, bit bigint")
    table = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map")).collect():
        table[r["bucket"] * 4096 :][:4096] = np.frombuffer(bytes(r["map"]), np.uint8)
    return table


def near_pairs(vocabulary: DataFrame, words: int) -> DataFrame:
    """word, n, near, near_n: all ordered pairs of words at one edit's distance. `vocabulary` (word, n) should be a written table of `words` rows."""
    spark = vocabulary.sparkSession
    bits = min(MOST_BITS, max(15, math.ceil(math.log2(32 * max(1, words)))))
    alphabet = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()  # at most 90 for runs of LETTERS
    letters = np.array(sorted(ord(r["c"]) for r in alphabet), np.uint32)
    table = spark.sparkContext.broadcast(bit_table(vocabulary, bits))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n_of = dict(zip(b["word"], b["n"], strict=True))
            for block in by_length(list(n_of), 256):
                if pairs := list(neighbours(block, letters, table.value, bits)):
                    own = [block[j] for j, _ in pairs]
                    yield pd.DataFrame({"word": own, "n": [n_of[w] for w in own], "near": [x for _, x in pairs]})

    dealt = vocabulary.repartition(max(1, math.ceil(words / WORDS_A_TASK)), "word")
    made = dealt.mapInPandas(emit, "word string, n bigint, near string")
    return made.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root of words with a form (word, form), by pointer doubling: a chain is at most as long as counts can double."""
    hops = scratch.store(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "hops-0")
    for k in range(1, 64):
        onward = hops.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        hops = scratch.store(hops.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), f"hops-{k}")
        scratch.drop(f"hops-{k - 1}")
        if hops.where("moved").isEmpty():
            break
    return hops.select("word", "root")


def variant_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3, ratio: float = 2, typo_modulus: int | None = None) -> DataFrame:
    """One row per word: word, form, root (string), n, n_near, form_n (long).

    A word's form is its near word of largest n (ties: the first in code-point order), if that n is at least `ratio` times (over
    1) the word's own, else null; its root is the last of the forms that follow from it, the word itself without any. Other
    columns are ignored; a table without texts gives no rows. Runs jobs before it returns: the vocabulary, the pairs and the
    forms are written to the shared folder.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1, else forms could go round in a circle")
    scratch = Scratch(docs.sparkSession, "spelling")
    vocabulary = scratch.store(word_counts(docs, id_col, text_col, min_length, min_count, typo_modulus), "vocabulary")
    pairs = near_pairs(vocabulary, vocabulary.count())
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    chosen = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    words = scratch.store(chosen, "words")
    last = roots(words.where("form IS NOT NULL"), scratch)
    return words.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_report(docs: DataFrame) -> DataFrame:
    return variant_groups(docs, typo_modulus=97)
