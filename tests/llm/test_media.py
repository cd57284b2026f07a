import struct
import zlib

import numpy as np
import pytest

from tessera.functions import png
from tessera.llm import media
from tests.llm.conftest import sentence


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
@pytest.mark.parametrize("filters", [0, 1, 2, 3, 4, "mixed"])
def test_round_trip(channels, filters):
    pixels = np.random.default_rng(1).integers(0, 256, (13, 7, channels), np.uint8)
    kinds = [k % 5 for k in range(13)] if filters == "mixed" else filters
    assert (media.decode(media.encode(pixels, kinds)) == pixels).all()


def test_broken_files():
    good = media.encode(np.zeros((3, 2, 3), np.uint8))
    flipped = bytearray(good)
    flipped[45] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        media.decode(bytes(flipped))
    for bad in (b"", good[:-5], good[:20], b"GIF89a", good[:8] + png._chunk(b"IEND", b"")):
        with pytest.raises(ValueError):
            media.decode(bad)
    short = png.SIGNATURE + png._chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 9, 8, 2, 0, 0, 0)) + png._chunk(b"IDAT", zlib.compress(b"123")) + png._chunk(b"IEND", b"")
    with pytest.raises(ValueError, match="length"):
        media.decode(short)


def test_valid_checksums_around_nonsense(spark):
    """A short header, an image without pixels, data that inflates far beyond the header: no file stops the job."""
    part = lambda head, raw: png.SIGNATURE + png._chunk(b"IHDR", head) + png._chunk(b"IDAT", raw) + png._chunk(b"IEND", b"")
    head = lambda w, h: struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    bad = [part(head(1, 1)[:12], zlib.compress(b"\0abc")), part(head(0, 0), zlib.compress(b"")), part(head(1, 1), zlib.compress(b"\0" * 50_000_000)), part(head(1, 1), zlib.compress(b"\5abc")), part(head(1, 1), zlib.compress(b"\0abc")[:-3]), part(head(0xFFFFFFFF, 0xFFFFFFFF), zlib.compress(b"\0abc")), part(head(1, 1), b"")]
    good = media.encode(np.full((2, 2, 3), 7, np.uint8))
    frame = spark.createDataFrame([(k, b) for k, b in enumerate([*bad, good])], "doc_id long, media binary")
    out = {r.doc_id: r for r in media.features(frame).collect()}
    assert [out[k].ok for k in range(len(bad) + 1)] == [False] * len(bad) + [True] and all(r.media_bytes for r in out.values())


def plain_unfilter(rows, bpp):
    out = []
    for kind, *line in rows.tolist():
        up = out[-1] if out else [0] * len(line)
        done = []
        for x, v in enumerate(line):
            a, b, c = (done[x - bpp] if x >= bpp else 0), up[x], (up[x - bpp] if x >= bpp else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            done.append((v + (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out.append(done)
    return np.array(out, np.uint8)


def test_filters_against_plain_code():
    """Images of several heights unfiltered together equal each undone byte by byte; the chosen filters vary and the bytes come back."""
    rng = np.random.default_rng(5)
    texts = [sentence(k, 3 + 40 * k).encode() for k in range(9)]
    images = [np.frombuffer(media.text_payload(t), np.uint8).reshape(-1, 64, 3) for t in texts] + [np.cumsum(rng.integers(0, 3, (30, 64, 3)), 0).astype(np.uint8)]
    files = png.encode_many(images)
    seen = set()
    for image, file, back in zip(images, files, png.decode_many(files)):
        _, n, rows = png.parse(file)
        seen |= set(rows[:, 0].tolist())
        assert (back == image).all() and (plain_unfilter(rows, n) == image.reshape(len(image), -1)).all()
    assert len(seen - {0}) >= 3


def test_hash_against_a_plain_transform():
    rng = np.random.default_rng(6)
    for shape in ((32, 32, 3), (64, 96, 3), (5, 40, 1), (1, 1, 3)):
        pixels = rng.integers(0, 256, shape, np.uint8)
        h, w = shape[:2]
        grey = np.zeros((32, 32))
        for i in range(32):
            for j in range(32):
                ys = range(i * h // 32, max(i * h // 32 + 1, (i + 1) * h // 32)) if h >= 32 else [i * h // 32]
                xs = range(j * w // 32, max(j * w // 32 + 1, (j + 1) * w // 32)) if w >= 32 else [j * w // 32]
                grey[i, j] = np.mean([np.mean(pixels[y, x].astype(float)) for y in ys for x in xs])
        k = np.arange(8)
        cos = np.cos(np.pi * np.outer(k, 2 * np.arange(32) + 1) / 64) * np.where(k == 0, np.sqrt(1 / 32), np.sqrt(2 / 32))[:, None]
        low = np.array([[sum(grey[y, x] * cos[u, y] * cos[v, x] for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]).reshape(-1)
        middle = np.median(low[1:])
        clear = np.abs(low - middle) > 1e-6
        got = np.unpackbits(np.frombuffer(bytes.fromhex(media.dct_hash(pixels)), np.uint8)).astype(bool)
        assert (got[clear] == (low > middle)[clear]).all()


def test_split_data_and_extra_chunks():
    pixels = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    raw = zlib.compress(b"".join(b"\0" + r.tobytes() for r in pixels.reshape(2, -1)))
    head = png._chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0))
    data = png.SIGNATURE + head + png._chunk(b"tEXt", b"a\0b") + png._chunk(b"IDAT", raw[:5]) + png._chunk(b"IDAT", raw[5:]) + png._chunk(b"IEND", b"")
    assert (media.decode(data) == pixels).all()


def test_hash_is_stable_under_noise_and_scale():
    y, x = np.mgrid[0:64, 0:64]
    a = np.repeat((128 + 100 * np.sin(x / 9) * np.cos(y / 7))[..., None], 3, 2).astype(np.uint8)
    b = np.clip(a.astype(int) + np.random.default_rng(2).integers(-3, 4, a.shape), 0, 255).astype(np.uint8)
    distance = lambda p, q: (int(media.dct_hash(p), 16) ^ int(media.dct_hash(q), 16)).bit_count()
    other = np.random.default_rng(3).integers(0, 256, a.shape, np.uint8)
    assert distance(a, b) <= 6 < distance(a, other)


def test_awkward_rows(spark, awkward, empty):
    coded = media.encode_texts(awkward)
    out = media.features(coded).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in awkward.collect()}
    assert len(out) == awkward.count()
    for r in out:
        t = texts[r.doc_id]
        payload = media.text_payload(t)
        assert r.ok and r.n_bytes == len(t) and r.payload_bytes == len(payload) and len(payload) % 192 == 0 < len(payload)
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and len(r.feature) == 16
    assert media.features(media.encode_texts(empty)).count() == 0
    odd = spark.createDataFrame([(1, None, "clash"), (2, b"junk", "clash")], "doc_id long, media binary, feature string")
    assert [(r.ok, r.feature, r.media_bytes) for r in media.features(odd).orderBy("doc_id").collect()] == [(False, None, None), (False, None, 4)]
