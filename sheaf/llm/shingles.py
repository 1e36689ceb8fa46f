"""Word hashes and word shingles of many texts at once, as arrays."""

from __future__ import annotations

import numpy as np

PRIME = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)

# The white space that parts words (blank, and tab to carriage return), as bytes.
WHITE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * PRIME) | np.uint64(1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' words, in order, and where each text's words begin (one entry more than texts).

    lower: A to Z count as a to z; other letters stay.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    if lower:
        raw = [r.lower() for r in raw]
    flat = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    white = WHITE[flat]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    length = end - begin
    place = np.arange(len(flat)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(flat)]]))) if begin[0] == 0 else None
    if place is None:
        place = np.concatenate([np.zeros(begin[0], np.int64), np.arange(begin[0], len(flat)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(flat)]])))])
    top = int(length.max())
    terms = BYTES[flat]
    terms *= powers(PRIME, top)[np.minimum(place, top - 1)]
    terms[white] = 0
    h = mix(np.add.reduceat(terms, begin) + length.astype(np.uint64) * STEP)
    return h, np.searchsorted(begin, first)


def grams(hashes: np.ndarray, starts: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words within each text, and where each text's begin; with fewer words, the whole sequence is one if `short`."""
    count = np.diff(starts)
    out_n = np.maximum(count - n + 1, 0)
    if short:
        out_n = np.where((count > 0) & (count < n), 1, out_n)
    out_starts = np.concatenate([[0], np.cumsum(out_n)])
    if not out_starts[-1]:
        return np.zeros(0, np.uint64), out_starts
    at = np.repeat(starts[:-1] - out_starts[:-1], out_n) + np.arange(out_starts[-1])
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    left = np.repeat(starts[1:], out_n) - at  # words from here to the text's end
    p = powers(STEP, n)
    total = np.zeros(len(at), np.uint64)
    for j in range(n):
        w = padded[at + j] * p[j]
        total += np.where(left > j, w, np.uint64(0)) if short else w
    return mix(total + np.minimum(left, n).astype(np.uint64) * PRIME), out_starts
