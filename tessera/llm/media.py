"""Media columns: PNG files in binary columns, decoded with numpy, and cosine-transform hashes.

The codec (``tessera.functions.png``) needs no image library: chunks are walked
by hand and their checksums tested, pixel data goes through zlib, and the five
row filters are chosen (for each row the one of the least sum of magnitudes) and
undone in numpy, for all images of a batch together.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.png import decode, decode_many, encode, encode_many
from tessera.llm import common

#: Text payloads are images of 64 RGB pixels a row.
ROW_PIXELS, ROW_BYTES = 64, 192
#: Bytes of files and texts that are handled at once; what a worker holds is some 20 times as much.
CHUNK = 2 << 20


@lru_cache(1)
def _basis(size: int = 32, low: int = 8) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(size)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * size)) * np.where(k == 0, np.sqrt(1 / size), np.sqrt(2 / size))


def _shrink(grey: np.ndarray, size: int = 32) -> np.ndarray:
    """Means over a size x size grid of areas (nearest samples where a side is shorter)."""
    for axis in (0, 1):
        n = grey.shape[axis]
        if n == size:
            continue
        if n < size:
            grey = np.take(grey, np.arange(size) * n // size, axis=axis)
        else:
            edges = np.arange(size + 1) * n // size
            sums = np.add.reduceat(grey, edges[:-1], axis=axis)
            grey = sums / np.diff(edges).reshape((-1, 1) if axis == 0 else (1, -1))
    return grey


def dct_hash(pixels: np.ndarray) -> str:
    """16 hexadecimal digits: signs of the 8 x 8 low-frequency cosine coefficients against their median (without the constant one)."""
    grey = _shrink(pixels[:, :, : 3 if pixels.shape[2] >= 3 else 1].mean(2))
    low = _basis() @ grey @ _basis().T
    bits = (low > np.median(low.reshape(-1)[1:])).reshape(-1)
    return np.packbits(bits).tobytes().hex()


def text_payload(text: bytes) -> bytes:
    """The text padded with spaces to a positive multiple of 192 bytes."""
    return text + b" " * (-len(text) % ROW_BYTES if text else ROW_BYTES)


def encode_texts(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as a PNG of 64 RGB pixels a row; null is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = common.texts(batch.column(1))
            files = [f for a, b in common.slices([len(t) for t in body], CHUNK) for f in encode_many([np.frombuffer(text_payload(t), np.uint8).reshape(-1, ROW_PIXELS, 3) for t in body[a:b]])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in body], pa.int64()), pa.array(files, pa.binary())], names=[id, "n_bytes", "media"])

    kind = df.schema[id].dataType.simpleString()
    return df.select(id, F.col(text).cast("string").alias("t")).mapInArrow(run, f"`{id}` {kind}, n_bytes bigint, media binary")


def features(df: DataFrame, media: str = "media") -> DataFrame:
    """Decode a binary column and add ``ok``, ``width``, ``height``, ``payload_bytes``, ``payload_sha256``, ``tail_crc32``, ``media_bytes``, ``media_sha256`` and ``feature``.

    Other columns stay, but for the media and those that have the new names.
    A null, broken or unsupported file gives ok = false and nulls (its own
    length and hash are still given, if it isn't null).
    """
    fields = [("ok", pa.bool_()), ("width", pa.int32()), ("height", pa.int32()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    kept = [c for c in df.columns if c not in {media, *(n for n, _ in fields)}]

    def one(data: bytes | None, pixels: np.ndarray | ValueError | None) -> tuple:
        if data is None:
            return (False, *[None] * 8)
        own = (len(data), hashlib.sha256(data).hexdigest())
        if isinstance(pixels, ValueError):
            return (False, *[None] * 5, *own, None)
        payload = pixels.tobytes()
        return (True, pixels.shape[1], pixels.shape[0], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *own, dct_hash(pixels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(len(kept)).to_pylist()
            rows = []
            for a, b in common.slices([len(x or b"") for x in files], CHUNK):
                images = iter(decode_many([x for x in files[a:b] if x is not None]))
                rows += [one(x, None if x is None else next(images)) for x in files[a:b]]
            columns = list(zip(*rows)) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(c, kind) for c, (_, kind) in zip(columns, fields))], names=[*kept, *(n for n, _ in fields)])

    sql = "ok boolean, width int, height int, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    head = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in kept)
    return df.select(*kept, media).mapInArrow(run, head + sql)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as PNG, read back, and their features."""
    docs = common.table(spark, sf_dir, "documents")
    return features(encode_texts(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
