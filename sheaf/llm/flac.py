"""FLAC media columns: encode 8-bit samples to FLAC, decode FLAC to PCM blocks with seekable sample offsets.

Both directions handle many frames at once. The encoder tries constant, verbatim, the fixed predictors of order 0 to 4 and a
least-squares linear predictor of order 4, and Rice-codes the residuals. The decoder reads any mono stream of 4 to 16 bits:
it finds frames by the seek table or by following them, verifies the header's CRC-8 and the frame's CRC-16, then reads
Rice residuals and runs the predictors in lockstep over all frames of a group.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_type, ids_and_texts

BLOCK = 1152  # samples in a frame
UNIT = 192  # payloads are padded to a multiple of this
RATE = 8000  # nominal, the streams hold no sound
CHUNK = 800_000  # samples handled at once

# Fixed values of the format: coefficients of its fixed predictors, sizes of its block size codes, its two CRC polynomials.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
BLOCK_CODES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
CRC8, CRC16 = 0x07, 0x8005


class FlacError(ValueError):
    """A stream that isn't FLAC, is damaged, or isn't supported."""


def crc_table(poly: int, bits: int) -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        t = np.where(t >> (bits - 1) & 1, t << 1 ^ poly, t << 1) & ((1 << bits) - 1)
    return t


T16 = crc_table(CRC16, 16)
T8_LIST = crc_table(CRC8, 8).tolist()
_REACH = [np.arange(256, dtype=np.uint32) * 0]  # grows on demand: what a byte adds to a CRC-16 when r bytes follow it


def reach(n: int) -> np.ndarray:
    """Row r, column b: the part of a CRC-16 that byte b adds if r bytes follow it (a CRC is linear)."""
    if len(_REACH[0]) < n or _REACH[0].ndim == 1:
        rows = [T16]
        for _ in range(max(n, 2048) - 1):
            rows.append((rows[-1] << 8 & 0xFFFF) ^ T16[rows[-1] >> 8])
        _REACH[0] = np.array(rows, dtype=np.uint16)
    return _REACH[0]


def crc16(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of many ranges of one buffer."""
    out = np.zeros(len(start), np.uint16)
    if not len(start):
        return out
    r = reach(int(length.max()))
    for part in np.array_split(np.arange(len(start)), max(1, int(length.sum()) // CHUNK)):
        n = length[part]
        first = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(first, n)
        terms = r[np.repeat(n, n) - 1 - within, buf[np.repeat(start[part], n) + within]]
        out[part] = np.bitwise_xor.reduceat(terms, first) if len(terms) else 0
    return out


def utf8_number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([_LEADS[len(tail)] | n]) + bytes(reversed(tail))


_LEADS = (0, 0xC0, 0xE0, 0xF0, 0xF8, 0xFC, 0xFE)


class Writer:
    """Collects numbers by the bit they end before, then lays them all out at once; numbers must not overlap."""

    def __init__(self):
        self.ends, self.values = [], []

    def put(self, at: np.ndarray, value: np.ndarray, width: int) -> None:
        self.ends.append(np.asarray(at + width, np.int64).ravel())
        self.values.append(np.asarray(value, np.int64).ravel())

    def bytes(self, size: int) -> np.ndarray:
        end, value = np.concatenate(self.ends) + 31, np.concatenate(self.values)
        word = end >> 5
        value = value << (31 - (end & 31))
        n = size // 4 + 3
        # sums of disjoint bits of 32-bit words are exact in doubles
        words = np.bincount(word, value & 0xFFFFFFFF, n) + np.bincount(word - 1, value >> 32, n)
        return words[1:].astype(">u4").view(np.uint8)[:size]


def predict_linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit coefficients (shift 6) of the least-squares predictor of order 4 of each row, and its residuals."""
    n = x.shape[1]
    f = x.astype(np.float32)
    lags = [np.einsum("ij,ij->i", f[:, : n - k], f[:, k:]) for k in range(5)]
    m = np.stack([np.stack([lags[abs(i - j)] for j in range(4)], -1) for i in range(4)], -2).astype(np.float64)
    m += np.eye(4) * (1e-3 * lags[0] + 1)[:, None, None]
    coef = np.linalg.solve(m, np.stack(lags[1:], -1).astype(np.float64)[..., None])[..., 0]
    q = np.clip(np.rint(coef * 64), -128, 127).astype(np.int32)
    wide = x.astype(np.int32)
    guess = q[:, :1] * wide[:, 3 : n - 1]
    for j in range(1, 4):
        guess += q[:, j : j + 1] * wide[:, 3 - j : n - 1 - j]
    guess >>= 6
    return q, np.subtract(wide[:, 4:], guess, out=guess)


def encode_frames(x: np.ndarray, number: np.ndarray) -> list[bytes]:
    """One FLAC frame for each row of samples; all rows have the same length, a multiple of 4 with over 4 in each quarter."""
    f, n = x.shape
    costs, found, d = [], [], x.astype(np.int16)
    for order in range(5):
        if order:
            d = np.diff(d, axis=1)
        found.append(d)
        costs.append((n - order) * np.log2(np.maximum(np.abs(d).mean(1, dtype=np.float32), 0.25)) + order * 8)
    coef, lin = predict_linear(x)
    costs.append((n - 4) * np.log2(np.maximum(np.abs(lin).mean(1, dtype=np.float32), 0.25)) + 4 * 16 + 9)
    kind = np.argmin(costs, 0)
    found.append(lin)
    order = np.minimum(kind, 4)
    folded = np.zeros((f, n), np.int32)
    for k in range(6):
        rows = np.flatnonzero(kind == k)
        if len(rows):
            r = found[k][rows].astype(np.int32)
            folded[rows, min(k, 4) :] = (r << 1) ^ (r >> 31)
    del found, lin, d
    part = n // 4
    quarters = folded.reshape(f * 4, part)
    sums = quarters.sum(1)
    count = np.where(np.arange(4) == 0, part - order[:, None], part).ravel()
    base = np.floor(np.log2(np.maximum(sums / count, 1))).astype(np.int32)
    best, cost = np.zeros(f * 4, np.int64), np.full(f * 4, 1 << 40)
    for step in (-1, 0):
        k = np.clip(base + step, 0, 14)
        c = (quarters >> k[:, None]).sum(1) + count * (k + 1)
        best, cost = np.where(c < cost, k, best), np.minimum(c, cost)
    cost = cost.reshape(f, 4)
    body = order * 8 + np.where(kind == 5, 9 + 32, 0) + 6 + 16 + cost.sum(1)
    constant = (x == x[:, :1]).all(1)
    verbatim = ~constant & (body >= 8 * n)
    rice = ~constant & ~verbatim
    body = np.where(constant, 8, np.where(verbatim, 8 * n, body))
    code = next((c for c, s in BLOCK_CODES.items() if s == n), 7)
    heads = []
    for i in number.tolist():
        h = bytes([0xFF, 0xF8, code << 4, 0x02]) + utf8_number(i) + (struct.pack(">H", n - 1) if code == 7 else b"")
        c = 0
        for b in h:
            c = T8_LIST[c ^ b]
        heads.append(h + bytes([c]))
    head = np.array([len(h) for h in heads])
    size = head + (8 + body + 7) // 8 + 2
    start = np.cumsum(size) - size
    out = Writer()
    at = (start + head) * 8
    out.put(at + 1, np.where(constant, 0, np.where(verbatim, 1, np.where(kind == 5, 32 + 3, 8 + order))), 6)
    at = at + 8
    u8 = x.view(np.uint8)
    out.put(at[constant], u8[constant, 0], 8)
    out.put(at[verbatim][:, None] + 8 * np.arange(n), u8[verbatim], 8)
    for j in range(4):
        rows = rice & (order > j)
        out.put(at[rows] + 8 * j, u8[rows, j], 8)
    at = at + 8 * order
    rows = np.flatnonzero(rice & (kind == 5))
    out.put(at[rows], np.full(len(rows), 7 << 5 | 6), 9)  # precision - 1 and shift
    for j in range(4):
        out.put(at[rows] + 9 + 8 * j, coef[rows, j] & 0xFF, 8)
    at = np.where(kind == 5, at + 9 + 32, at)
    rows = np.flatnonzero(rice)
    if len(rows):
        at, order, k4, cost = at[rows], order[rows], best.reshape(f, 4)[rows], cost[rows]
        out.put(at, np.full(len(rows), 2), 6)  # 4-bit parameters, 2 ** 2 partitions
        pos = at[:, None] + 6 + np.cumsum(4 + cost, 1) - (4 + cost)
        out.put(pos, k4, 4)
        k = k4.reshape(-1, 1).astype(np.int32)
        u = folded[rows].reshape(-1, part)
        width = (u >> k) + (1 + k)
        live = np.ones((len(rows), n), bool)
        for j in range(4):
            live[order > j, j] = False
        width *= live.reshape(width.shape)
        end = np.cumsum(width, 1, dtype=np.int32) + (pos + 4).reshape(-1, 1)
        low = (u & ((1 << k) - 1)) | (1 << k)  # the stop bit and what follows it; the zeros before are there already
        chosen = live.reshape(width.shape)
        out.put(end[chosen], low[chosen], 0)
    data = out.bytes(int(size.sum()))
    for s, h in zip(start.tolist(), heads, strict=True):
        data[s : s + len(h)] = np.frombuffer(h, np.uint8)
    c = crc16(data, start, size - 2)
    data[start + size - 2], data[start + size - 1] = c >> 8, c & 0xFF
    raw = data.tobytes()
    return [raw[s : s + z] for s, z in zip(start.tolist(), size.tolist(), strict=True)]


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads whose lengths are positive multiples of UNIT; a byte b is the sample b - 128."""
    groups: dict[int, list] = defaultdict(list)
    for d, p in enumerate(payloads):
        for i in range(0, len(p), BLOCK):
            groups[min(BLOCK, len(p) - i)].append((d, i // BLOCK))
    frames: dict[tuple[int, int], bytes] = {}
    for n, members in groups.items():
        for i in range(0, len(members), max(1, CHUNK // n)):
            part = members[i : i + max(1, CHUNK // n)]
            raw = b"".join(payloads[d][k * BLOCK : k * BLOCK + n] for d, k in part)
            x = (np.frombuffer(raw, np.uint8).astype(np.int16) - 128).astype(np.int8).reshape(len(part), n)
            frames.update(zip(part, encode_frames(x, np.array([k for _, k in part])), strict=True))
    out = []
    for d, p in enumerate(payloads):
        own = [frames[d, k] for k in range((len(p) + BLOCK - 1) // BLOCK)]
        sizes = [len(f) for f in own]
        # the digest is of the samples as signed bytes
        md5 = hashlib.md5((np.frombuffer(p, np.uint8) ^ 0x80).tobytes()).digest()
        info = struct.pack(">HH", min(BLOCK, len(p)), min(BLOCK, len(p))) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + (RATE << 44 | 7 << 36 | len(p)).to_bytes(8, "big") + md5
        at, seek = 0, []
        for k, z in enumerate(sizes):
            seek.append(struct.pack(">QQH", k * BLOCK, at, min(BLOCK, len(p) - k * BLOCK)))
            at += z
        table = b"".join(seek)
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(own))
    return out


def read_metadata(s: bytes) -> tuple[dict, int]:
    """STREAMINFO and the seek table; where the frames begin."""
    if s[:4] != b"fLaC":
        raise FlacError("no FLAC marker")
    at, last, info = 4, False, None
    seek: list[tuple[int, int]] = []
    while not last:
        if at + 4 > len(s):
            raise FlacError("cut off in its metadata")
        last, kind, n = bool(s[at] & 0x80), s[at] & 0x7F, int.from_bytes(s[at + 1 : at + 4], "big")
        block = s[at + 4 : at + 4 + n]
        if len(block) < n:
            raise FlacError("cut off in its metadata")
        if kind == 0 and n >= 34:
            v = int.from_bytes(block[10:18], "big")
            info = {"rate": v >> 44, "channels": (v >> 41 & 7) + 1, "bits": (v >> 36 & 31) + 1, "samples": v & (1 << 36) - 1, "md5": block[18:34], "block": int.from_bytes(block[2:4], "big")}
        elif kind == 3:
            seek = [(a, b) for i in range(0, n - 17, 18) for a, b in [struct.unpack(">QQ", block[i : i + 16])] if a != (1 << 64) - 1]
        at += 4 + n
    if info is None:
        raise FlacError("no STREAMINFO")
    if info["channels"] != 1 or not 4 <= info["bits"] <= 16:
        raise FlacError("only mono streams of 4 to 16 bits are read")
    return info | {"seek": seek}, at


def read_header(s: bytes, at: int, info: dict) -> tuple[int, int, int]:
    """Of the frame at a byte: its samples, its number (or first sample), the length of its header. Verifies CRC-8."""
    h = s[at : at + 17]
    if len(h) < 6 or h[0] != 0xFF or h[1] & 0xFE != 0xF8 or h[3] >> 4:
        raise FlacError(f"no mono frame at byte {at}")
    lead, n = h[4], 0
    while lead & 0x80 >> n and n < 7:
        n += 1
    number, at2 = (lead & (0x7F >> n) if n else lead), 5
    for _ in range(max(0, n - 1)):
        number, at2 = number << 6 | h[at2] & 0x3F, at2 + 1
    code, rate = h[2] >> 4, h[2] & 15
    if code in (6, 7):
        size = int.from_bytes(h[at2 : at2 + code - 5], "big") + 1
        at2 += code - 5
    elif code in BLOCK_CODES:
        size = BLOCK_CODES[code]
    else:
        size = 576 << (code - 2) if 2 <= code <= 5 else 0
    at2 += 1 if rate == 12 else 2 if rate in (13, 14) else 0
    c = 0
    for b in h[:at2]:
        c = T8_LIST[c ^ b]
    if not size or at2 >= len(h) or c != h[at2]:
        raise FlacError(f"bad header of the frame at byte {at}")
    return size, number, at2 + 1


class Bits:
    """Random reads of up to 32 bits and of unary codes, for many positions at once."""

    def __init__(self, raw: bytes):
        self.buf = np.frombuffer(raw + bytes(64), np.uint8)
        n = len(self.buf) - 7
        self.words = np.zeros(n, np.int64)  # the 56 bits from each byte on
        for i in range(7):
            self.words <<= 8
            self.words |= self.buf[i : n + i]
        ones = np.flatnonzero(np.unpackbits(self.buf)).astype(np.int32)
        gaps = np.diff(np.concatenate([[-1], ones]))
        self.next = np.repeat(ones, gaps)  # the first one bit at or behind each bit, up to the last one

    def read(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        return self.words[at >> 3] >> (56 - width - (at & 7)) & ((np.int64(1) << np.asarray(width, np.int64)) - 1)


def signed(v: np.ndarray, width) -> np.ndarray:
    return v - ((v >> (width - 1) & 1) << width)


def decode_group(bits: Bits, at: np.ndarray, sizes: np.ndarray, bps: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Samples of the subframes that start at these bits and hold `sizes` samples; and the bits where they end."""
    try:
        return _decode_group(bits, at.astype(np.int64), sizes.astype(np.int64), bps)
    except IndexError as e:
        raise FlacError("codes run beyond the data") from e


def _decode_group(bits, at, sizes, bps):
    kind = bits.read(at + 1, 6)
    if (bits.read(at, 1) | bits.read(at + 7, 1)).any():
        raise FlacError("a padding bit is set, or wasted bits, which aren't read")
    at = at + 8
    out: list = [None] * len(at)
    end = at.copy()
    for i in np.flatnonzero(kind == 0):
        out[i] = np.full(sizes[i], signed(bits.read(at[i : i + 1], bps), bps)[0], np.int32)
        end[i] = at[i] + bps
    for i in np.flatnonzero(kind == 1):
        out[i] = signed(bits.read(at[i] + bps * np.arange(sizes[i]), bps), bps).astype(np.int32)
        end[i] = at[i] + bps * sizes[i]
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not (fixed | linear | (kind <= 1)).all():
        raise FlacError("unknown subframe")
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    if (order > sizes).any():
        raise FlacError("more warm-up samples than samples")
    coded = np.flatnonzero(fixed | linear)
    if not len(coded):
        return out, end
    coded = coded[np.argsort(-sizes[coded], kind="stable")]  # so that those still running are always the first
    at, order, kind, sizes = at[coded], order[coded], kind[coded], sizes[coded]
    top, f = int(order.max()), len(coded)
    x = np.zeros((int(sizes[0]) + top, f), np.int32)  # samples by frames, after `top` rows of zeros
    for j in range(top):
        rows = order > j
        x[top + j, rows] = signed(bits.read(at[rows] + bps * j, bps), bps)
    at = at + bps * order
    coef, shift = np.zeros((top, f), np.int64), np.zeros(f, np.int64)
    for o in range(min(5, top + 1)):
        for j, c in enumerate(FIXED[o]):
            coef[j, kind - 8 == o] = c
    rows = np.flatnonzero(kind >= 32)
    some_linear = bool(len(rows))
    if some_linear:
        precision = bits.read(at[rows], 4) + 1
        shift[rows] = signed(bits.read(at[rows] + 4, 5), 5)
        if (precision > 15).any() or (shift < 0).any():
            raise FlacError("bad predictor")
        at[rows] += 9
        for j in range(int(order[rows].max())):
            on = order[rows] > j
            coef[j, rows[on]] = signed(bits.read(at[rows[on]], precision[on]), precision[on])
            at[rows[on]] += precision[on]
    if np.abs(coef).sum(0).max(initial=0) << bps < 1 << 31:  # products and sums fit 32 bits
        coef, shift = coef.astype(np.int32), shift.astype(np.int32)
    long, parts = bits.read(at, 2), 1 << bits.read(at + 2, 4)
    if (long > 1).any() or (sizes % parts).any():
        raise FlacError("bad residual")
    at = at + 6
    step = sizes // parts  # samples in a partition
    if (step < order).any():
        raise FlacError("bad residual")
    k, raw = np.zeros(f, np.int64), np.zeros(f, bool)
    steps = np.unique(step).tolist()
    running = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), "right").tolist()
    last, odd, mask, base = 0, False, None, None
    ends = np.zeros(f, np.int64)
    nxt, words = bits.next, bits.words
    for i, m in enumerate(running):
        if m != last and i:
            ends[m:last] = at[m:]
            at, k, raw, mask, base = at[:m], k[:m], raw[:m], mask[:m], base[:m]
        last = m
        if any(i % s == 0 for s in steps):
            on = i % step[:m] == 0
            width = np.where(long[:m] == 1, 5, 4)
            v = bits.read(at, width)
            esc = v == (1 << width) - 1
            k, raw, at = np.where(on, v, k), np.where(on, esc, raw), at + np.where(on, width, 0)
            if (on & esc).any():  # plain samples of a width that follows
                w = bits.read(at, 5)
                k, at = np.where(on & esc, w, k), at + np.where(on & esc, 5, 0)
            odd = bool(raw.any())
            mask, base = (np.int64(1) << k) - 1, 56 - k
        stop = nxt[at] + np.int64(1)
        low = (words[stop >> 3] >> (base - (stop & 7))) & mask
        u = ((stop - at - 1) << k) | low
        r = (u >> 1) ^ -(u & 1)
        after = stop + k
        if odd:
            r = np.where(raw, np.where(k > 0, signed(bits.read(at, k), np.maximum(k, 1)), 0), r)
            after = np.where(raw, at + k, after)
        if top:
            guess = coef[0, :m] * x[top + i - 1, :m]
            for j in range(1, top):
                guess += coef[j, :m] * x[top + i - 1 - j, :m]
            if some_linear:
                guess >>= shift[:m]
            r += guess
        if i < top:
            live = i >= order[:m]
            x[top + i, :m] = np.where(live, r, x[top + i, :m])
            at = np.where(live, after, at)
        else:
            x[top + i, :m] = r
            at = after
    ends[:last] = at
    samples = np.ascontiguousarray(x[top:].T)
    for row, i in enumerate(coded.tolist()):
        out[i] = samples[row, : sizes[row]]
    end[coded] = ends
    return out, end


def decode_streams(streams: list[bytes]) -> list[tuple[dict, list[tuple[int, np.ndarray]]] | FlacError]:
    """Of each stream: its STREAMINFO and (sample offset, samples) of its frames, or what is wrong with it."""
    out: list = []
    groups: dict[int, list] = defaultdict(list)
    for d, s in enumerate(streams):
        try:
            info, first = read_metadata(s)
            marks = [first + b for _, b in info["seek"]]
            frames, samples, at, k = [], 0, first, 0
            if not marks or marks[0] != first:
                marks = None
            while samples < info["samples"]:
                size, number, head = read_header(s, at, info)
                if marks is not None and samples != info["seek"][k][0]:
                    raise FlacError("the seek table doesn't fit the frames")
                if marks is None:  # without a seek table, a frame must be read to find the next
                    bits = Bits(s[at : at + 2 * size * info["bits"] + 64])
                    _, end = decode_group(bits, np.array([head * 8]), np.array([size]), info["bits"])
                    stop = at + (int(end[0]) + 7) // 8 + 2
                else:
                    k += 1
                    stop = marks[k] if k < len(marks) else len(s)
                    if stop <= at or (k >= len(marks) and samples + size < info["samples"]):
                        raise FlacError("the seek table doesn't fit the frames")
                frames.append((at, stop, head, size, samples))
                samples += size
                at = stop
            if at > len(s) or samples != info["samples"]:
                raise FlacError("cut off")
            for i, x in enumerate(frames):
                groups[info["bits"]].append((d, i, x))
            out.append((info, [None] * len(frames)))
        except (FlacError, IndexError) as e:
            out.append(e if isinstance(e, FlacError) else FlacError("cut off"))
    for bps, members in groups.items():
        for piece in batches_by_size([m[2][3] for m in members], lambda n: n):
            part = members[piece]
            try:
                _decode_part(streams, out, part, bps)
            except FlacError:
                for m in part:  # one damaged frame must not spoil the others
                    try:
                        _decode_part(streams, out, [m], bps)
                    except FlacError as e:
                        out[m[0]] = e
    return [x if isinstance(x, FlacError) or all(f is not None for f in x[1]) else FlacError("cut off") for x in out]


def _decode_part(streams, out, part, bps) -> None:
    raw = b"".join(streams[d][x[0] : x[1]] for d, _, x in part)
    length = np.array([x[1] - x[0] for *_, x in part])
    start = np.cumsum(length) - length
    bits = Bits(raw)
    c = crc16(bits.buf, start, length - 2)
    good = (bits.buf[start + length - 2].astype(np.uint16) << 8 | bits.buf[start + length - 1]) == c
    if not good.all():
        raise FlacError("a frame's CRC-16 is wrong")
    x, end = decode_group(bits, (start + np.array([y[2] for *_, y in part])) * 8, np.array([y[3] for *_, y in part]), bps)
    if ((end + 7) // 8 + 2 != start + length).any():
        raise FlacError("a frame's length is wrong")
    for row, (d, i, y) in zip(x, part, strict=True):
        if not isinstance(out[d], FlacError):
            out[d][1][i] = (y[4], row)


def batches_by_size(values: list, size=len) -> Iterator[slice]:
    """Slices of a list that hold about CHUNK bytes (or samples) each."""
    begin = total = 0
    for i, v in enumerate(values):
        total += size(v)
        if total >= CHUNK:
            yield slice(begin, i + 1)
            begin, total = i + 1, 0
    if begin < len(values):
        yield slice(begin, len(values))


def pad(raw: bytes) -> bytes:
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (unpadded) and media: each text's padded UTF-8 bytes as a FLAC stream.

    Null and empty texts become one unit of padding; repeated rows give repeated rows; other columns are ignored. Map-only.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            for s in batches_by_size(texts):
                raw = [t.encode("utf-8", "surrogatepass") for t in texts[s]]
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[s].to_numpy(), "n_bytes": [len(r) for r in raw], "media": encode_streams([pad(r) for r in raw])})

    return ids_and_texts(docs, id_col, text_col).mapInPandas(encode, f"doc_id {id_type(docs, id_col)}, n_bytes bigint, media binary")


def read_media(media: DataFrame, media_col: str = "media", block_samples: int = BLOCK) -> DataFrame:
    """Adds to a table with a FLAC column: pcm (unsigned bytes up to 8 bits, else little-endian 16), block_offsets (sample where each
    of its frames begins: seek by slicing there), and error (null if the stream is sound; a null stream has null in all three)."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            streams = [bytes(m) if m is not None else None for m in b[media_col]]
            for s in batches_by_size([m or b"" for m in streams]):
                part = streams[s]
                done = iter(decode_streams([m for m in part if m is not None]))
                rows = [pcm_of(next(done)) if m is not None else (None, None, None) for m in part]
                yield b.iloc[s].assign(pcm=[r[0] for r in rows], block_offsets=[r[1] for r in rows], error=[r[2] for r in rows])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema)
    return media.mapInPandas(decode, schema + ", pcm binary, block_offsets array<bigint>, error string")


def pcm_of(stream) -> tuple:
    if isinstance(stream, FlacError):
        return None, None, str(stream)
    info, frames = stream
    x = np.concatenate([f for _, f in frames]) if frames else np.zeros(0, np.int32)
    size = (info["bits"] + 7) // 8
    if any(info["md5"]) and hashlib.md5(x.astype("<i2" if size == 2 else "i1").tobytes()).digest() != info["md5"]:
        return None, None, "the MD5 of the samples is wrong"
    pcm = (x + 128).astype(np.uint8).tobytes() if size == 1 else x.astype("<i2").tobytes()
    return pcm, [at for at, _ in frames], None


def pcm_blocks(read: DataFrame, id_col: str = "doc_id", sample_bytes: int = 1) -> DataFrame:
    """One row per block: id, sample_offset, n_samples, block."""
    r = read.where("error is null").select(id_col, "pcm", "block_offsets", F.posexplode("block_offsets").alias("i", "sample_offset"))
    stop = F.coalesce(F.get("block_offsets", F.col("i") + 1), F.floor(F.length("pcm") / sample_bytes))
    r = r.select(id_col, "pcm", "sample_offset", (stop - F.col("sample_offset")).alias("n_samples"))
    block = F.substr("pcm", (F.col("sample_offset") * sample_bytes + 1).cast("int"), (F.col("n_samples") * sample_bytes).cast("int"))
    return r.select(id_col, "sample_offset", "n_samples", block.alias("block"))


def block_report(docs: DataFrame, **options) -> DataFrame:
    """Of each block of each text's media: where it begins, its samples, and its digest."""
    return pcm_blocks(read_media(to_media(docs, **options))).select("doc_id", "sample_offset", "n_samples", F.sha2("block", 256).alias("block_sha256"))


@F.pandas_udf(T.StringType())
def signal_feature(pcm: pd.Series) -> pd.Series:
    """mean:variance:crossings of the samples, as whole numbers (thousandths for the first two)."""
    out = []
    for p in pcm:
        x = np.frombuffer(p, np.uint8).astype(np.int64)
        n, s, q = len(x), int(x.sum()), int((x * x).sum())
        above = x * n >= s
        out.append(f"{1000 * s // n}:{1000 * (n * q - s * s) // (n * n)}:{int((above[1:] != above[:-1]).sum())}")
    return pd.Series(out)


def media_report(docs: DataFrame, **options) -> DataFrame:
    """Digests of what was stored and of what was read back."""
    r = read_media(to_media(docs, **options))
    # a stream that can't be read back must fail the job, not vanish from its result
    pcm = F.coalesce(F.col("pcm"), F.raise_error(F.col("error")).cast("binary"))
    r = r.select("doc_id", "n_bytes", "media", pcm.alias("pcm"))
    return r.select(
        "doc_id", "n_bytes", F.length("pcm").cast("long").alias("payload_bytes"), F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pcm, -16, 16)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), signal_feature("pcm").alias("feature"),
    )
