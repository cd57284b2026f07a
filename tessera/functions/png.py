"""PNG in numpy and zlib: chunks with checksum tests, and the five row filters.

8-bit grey, grey with alpha, RGB and RGBA images without interlacing are
supported.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by PNG colour type, and the reverse.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
COLOUR = {n: kind for kind, n in CHANNELS.items()}
LEVEL = 6


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def filtered(kind: int, rows: np.ndarray, up: np.ndarray, bpp: int) -> np.ndarray:
    """The bytes that filter ``kind`` leaves of whole rows, given the rows above them."""
    if kind == 0:
        return rows
    left = np.zeros_like(rows)
    left[:, bpp:] = rows[:, :-bpp]
    if kind == 1:
        return rows - left
    if kind == 2:
        return rows - up
    if kind == 3:
        return rows - ((left.astype(np.int16) + up) >> 1).astype(np.uint8)
    corner = np.zeros_like(rows)
    corner[:, bpp:] = up[:, :-bpp]
    return rows - _paeth(left.astype(np.int16), up.astype(np.int16), corner.astype(np.int16)).astype(np.uint8)


def above(rows: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The row above each row; zeros above the ``top`` rows of images that are laid one after another."""
    up = np.zeros_like(rows)
    up[1:] = rows[:-1]
    up[top] = 0
    return up


def best_filters(rows: np.ndarray, top: np.ndarray, bpp: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the filter whose bytes, taken as signed, have the least sum of magnitudes (the first of equals), and these bytes."""
    up = above(rows, top)
    kinds, least, best = np.zeros(len(rows), np.uint8), None, None
    for kind in range(5):
        found = filtered(kind, rows, up, bpp)
        cost = np.abs(found.view(np.int8).astype(np.int16)).sum(1, dtype=np.int64)
        if least is None:
            least, best = cost, found.copy()
        else:
            better = cost < least
            kinds[better], least[better], best[better] = kind, cost[better], found[better]
    return kinds, best


def _file(w: int, h: int, channels: int, data: bytes, level: int) -> bytes:
    head = struct.pack(">IIBBBBB", w, h, 8, COLOUR[channels], 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(data, level)) + _chunk(b"IEND", b"")


def encode(pixels: np.ndarray, filters: list[int] | int | None = 0, level: int = LEVEL) -> bytes:
    """A PNG of an (h, w, channels) array of 8-bit samples; ``filters``: one for all rows, one for each, or None for the best of each row."""
    return encode_many([pixels], filters, level)[0]


def encode_many(images: list[np.ndarray], filters: list[int] | int | None = None, level: int = LEVEL) -> list[bytes]:
    """PNGs of images of one width and number of channels, whose rows are filtered together."""
    if not images:
        return []
    _, w, n = images[0].shape
    heights = [len(x) for x in images]
    rows = np.concatenate(images).reshape(-1, w * n)
    ends = np.cumsum(heights)
    top = np.zeros(len(rows), bool)
    top[ends - heights] = True
    if filters is None:
        kinds, body = best_filters(rows, top, n)
    else:
        kinds, body, up = np.broadcast_to(np.asarray(filters, np.uint8), len(rows)), rows.copy(), above(rows, top)
        for kind in np.unique(kinds):
            own = kinds == kind
            body[own] = filtered(int(kind), rows[own], up[own], n)
    raw = np.concatenate([kinds[:, None], body], axis=1)
    return [_file(w, h, n, raw[e - h : e].tobytes(), level) for h, e in zip(heights, ends.tolist())]


def parse(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, channels and filtered rows (the filter's number first) of a PNG; ValueError for broken or unsupported files."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("truncated chunk")
        size = struct.unpack_from(">I", data, at)[0]
        kind, content, check = data[at + 4 : at + 8], data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(check) < 4 or zlib.crc32(kind + content) != struct.unpack(">I", check)[0]:
            raise ValueError(f"checksum of chunk {kind!r}")
        at += 12 + size
        if kind == b"IHDR":
            if len(content) != 13:
                raise ValueError("header of a wrong length")
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
    if head is None or not ended:
        raise ValueError("no header or end")
    w, h, depth, colour, method, filtering, interlace = head
    if depth != 8 or colour not in CHANNELS or method or filtering or interlace or not w or not h:
        raise ValueError("unsupported PNG")
    n = CHANNELS[colour]
    expected = h * (w * n + 1)
    inflate = zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(body), expected + 1)  # never more than the header speaks of
    except (zlib.error, OverflowError, MemoryError) as e:
        raise ValueError(f"pixel data: {e}") from e
    if len(raw) != expected or not inflate.eof:
        raise ValueError("pixel data of a wrong length")
    rows = np.frombuffer(raw, np.uint8).reshape(h, w * n + 1)
    if rows[:, 0].max() > 4:
        raise ValueError("unknown row filter")
    return w, n, rows


def decode(data: bytes) -> np.ndarray:
    """The (h, w, channels) samples of a PNG; ValueError for broken or unsupported files."""
    w, n, rows = parse(data)
    return unfilter(rows[:, 0], rows[:, 1:], n).reshape(len(rows), w, n)


def decode_many(files: list[bytes]) -> list[np.ndarray | ValueError]:
    """The samples of each file, or what is wrong with it; rows of images of one shape are unfiltered together."""
    out: list[np.ndarray | ValueError] = []
    groups: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    for i, data in enumerate(files):
        try:
            w, n, rows = parse(data)
        except ValueError as e:
            out.append(e)
        else:
            out.append(rows)
            groups.setdefault((w, n), []).append((i, rows))
    for (w, n), found in groups.items():
        heights = [len(r) for _, r in found]
        ends = np.cumsum(heights)
        top = np.zeros(int(ends[-1]), bool)
        top[ends - heights] = True
        rows = np.concatenate([r for _, r in found])
        pixels = unfilter(rows[:, 0], rows[:, 1:], n, top)
        for (i, _), h, e in zip(found, heights, ends.tolist()):
            out[i] = pixels[e - h : e].reshape(h, w, n)
    return out


def unfilter(kinds: np.ndarray, rows: np.ndarray, bpp: int, top: np.ndarray | None = None) -> np.ndarray:
    """Undo the row filters of one image, or of several laid one after another whose first rows ``top`` marks.

    A pixel needs those left of it, above it and left above it. So pixels whose
    column and row add up to the same number are independent, in all images,
    and are done together, one such diagonal after another.
    """
    if not kinds.any():
        return np.ascontiguousarray(rows)
    if kinds.max() > 4:
        raise ValueError("unknown row filter")
    if top is None:
        top = np.arange(len(rows)) == 0
    w = rows.shape[1] // bpp
    starts = np.flatnonzero(top)
    local = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    # One row of zeros before all, and one column of zeros before each row.
    out = np.zeros((len(rows) + 1, w + 1, bpp), np.int16)
    line = rows.reshape(len(rows), w, bpp)
    by = np.argsort(local, kind="stable")
    first = np.searchsorted(local[by], np.arange(local.max() + w + 1))
    for t in range(int(local.max()) + w):
        # Rows y of their images with 0 <= t - y < w.
        own = by[first[max(0, t - w + 1)] : first[t + 1] if t + 1 < len(first) else len(by)]
        x, kind = t - local[own] + 1, kinds[own][:, None]
        over = np.where(top[own], 0, own)
        left, up, corner = out[own + 1, x - 1], out[over, x], out[over, x - 1]
        guess = np.where(kind == 1, left, np.where(kind == 2, up, np.where(kind == 3, (left + up) >> 1, np.where(kind == 4, _paeth(left, up, corner), 0))))
        out[own + 1, x] = (line[own, x - 1] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(rows.shape)
