import hashlib
import zlib

import numpy as np
import pytest

from sheaf.llm import flac

RNG = np.random.default_rng(5)
TEXTS = [None, "", "a", "word " * 4000, "é😀ß" * 500, "".join(map(chr, RNG.integers(32, 127, 5000))), "x" * 192, "y" * 193, "a\nb" * 70_000]


def payloads():
    wave = (np.sin(np.arange(23_040) / 9) * 100 + 128).astype(np.uint8).tobytes()  # smooth: the linear predictor wins
    noise = RNG.integers(0, 256, 2304).astype(np.uint8).tobytes()  # verbatim
    return [flac.pad((t or "").encode()) for t in TEXTS] + [wave, noise, bytes(1152), bytes(range(192))]


def test_round_trip():
    p = payloads()
    for back, want in zip(flac.decode_streams(flac.encode_streams(p)), p, strict=True):
        pcm, offsets, error = flac.pcm_of(back)
        assert error is None and pcm == want and offsets == list(range(0, len(want), flac.BLOCK))


def without_seek_table(s):
    n = int.from_bytes(s[43:46], "big")  # behind marker and STREAMINFO
    return s[:4] + b"\x80" + s[5:42] + s[46 + n :]


def test_frames_are_found_without_a_seek_table():
    p = payloads()[4:6] + payloads()[9:12]
    for back, want in zip(flac.decode_streams([without_seek_table(s) for s in flac.encode_streams(p)]), p, strict=True):
        assert flac.pcm_of(back)[0] == want


@pytest.mark.parametrize("cut", ["flip", "short", "head", "junk"])
def test_damage_is_reported_and_kept_apart(cut):
    a, b = flac.encode_streams([flac.pad(b"hello there " * 400), flac.pad(b"fine " * 400)])
    bad = {"flip": a[:-40] + bytes([a[-40] ^ 4]) + a[-39:], "short": a[:-30], "head": a[:300] + b"\0\0" + a[302:], "junk": b"RIFF" + a}[cut]
    x, y = flac.decode_streams([bad, b])
    assert isinstance(x, flac.FlacError) and flac.pcm_of(y)[0] == flac.pad(b"fine " * 400)


def crc16_plain(data):
    c = 0
    for b in data:
        c ^= b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
    return c


def test_crc_of_ranges():
    buf = RNG.integers(0, 256, 9000).astype(np.uint8)
    start, length = np.array([0, 10, 500]), np.array([7, 4000, 8500])
    assert [int(c) for c in flac.crc16(buf, start, length)] == [crc16_plain(buf[s : s + n].tolist()) for s, n in zip(start, length, strict=True)]


def test_report(spark):
    docs = spark.createDataFrame([(i, t, b"z") for i, t in enumerate(TEXTS)] + [(None, "a", b""), (2, "a", b"")], "doc_id long, text string, media binary")
    rows = flac.media_report(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "a" if r.doc_id is None else TEXTS[r.doc_id] or ""
        want = flac.pad(text.encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
    assert len({tuple(r)[1:] for r in rows if r.doc_id in (None, 2)}) == 1  # equal texts, equal values
    assert flac.media_report(docs.limit(0)).count() == 0
    read = flac.read_media(flac.to_media(docs.where("doc_id = 8")))
    blocks = flac.pcm_blocks(read).orderBy("sample_offset").collect()
    assert b"".join(bytes(b.block) for b in blocks) == flac.pad(TEXTS[8].encode())
    assert all(len(b.block) == b.n_samples for b in blocks) and [b.sample_offset for b in blocks] == list(range(0, len(flac.pad(TEXTS[8].encode())), 1152))


def test_a_stream_made_elsewhere():
    """The mono example of RFC 9639 (8 bits, a linear predictor, Rice residuals): its frame checksums and the MD5 of its samples hold."""
    stream = bytes.fromhex(
        "664c6143800000221000100000001f00001f07d0007000000018f8f9e396f5cbcfc6dc807f9977906b32fff868020017e944004f6f313d1047d227cb6d090831452bdc28222280" "57a3"
    )
    (decoded,) = flac.decode_streams([stream])
    info, frames = decoded
    assert (info["rate"], info["bits"], info["samples"]) == (32000, 8, 24)
    assert frames[0][1].tolist() == [0, 79, 111, 78, 8, -61, -90, -68, -13, 42, 67, 53, 13, -27, -46, -38, -12, 14, 24, 19, 6, -4, -5, 0]
    assert flac.pcm_of(decoded)[2] is None
    (broken,) = flac.decode_streams([stream[:60] + b"\x00" + stream[61:]])
    assert flac.pcm_of(broken)[2] is not None


def test_blocks_join_to_the_samples(spark):
    docs = spark.createDataFrame([(1, "some text " * 3000), (2, ""), (3, None)], "doc_id long, text string")
    read = flac.read_media(flac.to_media(docs)).select("doc_id", "pcm", "block_offsets", "error")
    whole = {r.doc_id: bytes(r.pcm) for r in read.collect()}
    parts = {}
    for r in flac.pcm_blocks(read).collect():
        parts.setdefault(r.doc_id, []).append((r.sample_offset, bytes(r.block)))
        assert len(r.block) == r.n_samples
    assert {d: b"".join(b for _, b in sorted(p)) for d, p in parts.items()} == whole and len(parts[1]) > 1
