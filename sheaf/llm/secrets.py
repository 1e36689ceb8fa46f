"""Secret scan with a token-efficiency test.

Three pattern kinds come first (assignments, access keys, long hex runs). The method then looks at every long run of
key-like characters: under a byte-pair vocabulary, words take few tokens for their length, random strings take many. A run
whose characters per token stay under `max_ratio` is reported as kind `random`, unless it is a known identifier (UUID, number,
date-like) or a known digest: hex of a digest's length that is called one by the word before it, and isn't an assigned value.
Letters of one case are words only if their tokens say so.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import count_kind, id_type, ids_and_texts, joined

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # a run matches as a whole or not at all
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}")

# The kinds in their order, the words an assignment starts with, the hex lengths of common digests and what they are called.
KINDS = ("assign", "access", "hex", "random")
STARTS = ("passw", "secret", "token", "apikey", "api_key")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
DIGEST_WORD = re.compile(r"(?:sha-?[0-9]*|md5|blake[0-9a-z]*|digest|checksum|integrity|commit|revision|hash|etag)[^A-Za-z0-9]{1,4}$", re.IGNORECASE)
HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")

UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
NO_LETTER = re.compile(r"[^A-Za-z]+")

SCHEMA = "doc_id {id}, spans array<struct<kind:string,start:bigint,end:bigint>>"


def load_vocabulary(path: str | None = None):
    """A tiktoken encoding from a rank file (default: the public 50k byte-level vocabulary)."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def known(s: str, before: str, assigned: bool) -> bool:
    """Identifiers, and digests that the text before them calls so: they look random but are no secrets by themselves."""
    if UUID.fullmatch(s) or NO_LETTER.fullmatch(s):
        return True
    return not assigned and len(s) in DIGEST_LENGTHS and HEX_ONLY.fullmatch(s) is not None and DIGEST_WORD.search(before) is not None


def find_secrets(text: str, encoding, max_ratio: float) -> list[tuple[int, int, str]]:
    """All spans as (start, end, kind), by start and then kind as listed; offsets are code points."""
    found, values = [], []
    low = text.lower()
    if any(w in low for w in STARTS):
        matches = [m for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        found += [(m.start(), m.end(), 0) for m in matches]
        values = [m.span(2) for m in matches]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    for m in RUN.finditer(text):
        s = m[0].strip("-_+/")
        if len(s) < 16:
            continue
        at = m.start() + m[0].index(s)
        k = bisect_right(values, (at, len(text)))  # values are in order and don't overlap
        assigned = k > 0 and at < values[k - 1][1]
        if known(s, text[max(0, at - 16) : at], assigned):
            continue
        # capitals of words take more tokens than the words, random ones don't take fewer in lower case
        if all(len(s) < max_ratio * len(encoding.encode_ordinary(x)) for x in (s, s.lower())):
            found.append((at, at + len(s), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_ratio: float = 2.2, vocabulary: str | None = None) -> DataFrame:
    """One row per input row: doc_id and the spans of all kinds.

    Null and empty texts give an empty array; repeated rows are scanned each; a null doc_id stays null; an empty table gives
    an empty result; further columns of `docs` are not looked at. Map-only: no shuffle, a batch of rows in memory.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_vocabulary(vocabulary)
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for s, e, k in find_secrets(t, encoding, max_ratio)] for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "spans": spans})

    return ids_and_texts(docs, id_col, text_col).mapInPandas(scan, SCHEMA.format(id=id_type(docs, id_col)))


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """Counts and digests per document, derived from the spans."""
    found = scan_secrets(docs, **options)
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        *(count_kind(F.col("spans"), k).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
