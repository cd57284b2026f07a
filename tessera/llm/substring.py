"""Removal of repeated passages by recompression.

A text's words are parsed by rounds that name runs of equal symbols and pairs
of symbols (a pair is one whose left symbol has an even and whose right symbol
an odd hash bit in this round). Names are hashes of what they stand for, so they
are the same in every document without a dictionary. Each symbol of each round
carries the range of words that its existence depends on: wherever these words
stand, the parse has this symbol. A window of ``width`` words is anchored at the
highest, then leftmost symbol whose range it holds; equal windows hold equal
symbols, so they have equal anchors. Round 0 has the words themselves, so no
window is without an anchor.

Spark then brings equal anchors together: rows are dealt out by the anchors'
names, packed by task, with the hashes of the windows that they serve. A name
that comes once reveals that its windows come once; windows of shared names are
verified by their own hashes, and all but the first of equal windows go.
Equal windows within CHUNK bytes of a task's texts are settled before the shuffle in
the same way, so a passage that a third of all documents hold is sent once a chunk,
not once a document.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

WIDTH = 20
PAIR_ROUNDS = 5
#: Text bytes parsed at once in a task, and characters of text for each bucket of anchors.
CHUNK, BUCKET_CHARS = 1 << 20, 16_000_000
#: A row, told from all others: whether it lacks an id, its id (0 if it does), and 128 bits of its text's hash. Rows come in this order.
ROW = np.dtype([("none", "?"), ("id", "<i8"), ("high", "<u8"), ("low", "<u8")])
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_weights = np.zeros(0, np.uint64)


def _byte_weights(n: int) -> np.ndarray:
    """Fixed pseudo-random odd multipliers, one for each place in a word."""
    global _weights
    if len(_weights) < n:
        size = max(64, 1 << (n - 1).bit_length())
        _weights = common.mix(np.arange(1, size + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
    return _weights


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of all texts, and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    full = ~_SPACE[data]
    first = full.copy()
    first[1:] &= ~full[:-1]
    starts = np.flatnonzero(first)
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.r_[0, np.searchsorted(starts, ends)])
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    at = np.flatnonzero(full)
    heads = np.searchsorted(at, starts)
    place = at - np.repeat(starts, np.diff(np.r_[heads, len(at)]))
    values = (data[at].astype(np.uint64) + np.uint64(1)) * _byte_weights(int(place.max()) + 1)[place]
    return common.mix(np.add.reduceat(values, heads)), counts


def _run_round(sym: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name maximal runs. Where a run ends depends on the symbols beside it; separators (0) are never in a run."""
    head = np.r_[True, (sym[1:] != sym[:-1]) | (sym[1:] == 0)]
    starts = np.flatnonzero(head)
    last = np.r_[starts[1:], len(sym)] - 1
    length = (last - starts + 1).astype(np.uint64)
    name = sym[starts]
    name = np.where(length > 1, common.mix(name * _ODD + length), name)
    return name, lo[np.maximum(starts - 1, 0)], hi[np.minimum(last + 1, len(sym) - 1)]


def _pair_round(sym: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name the pairs of round k. A pair depends on its two symbols; a symbol left alone also on the neighbour that it didn't join."""
    bit = (common.mix(sym + np.uint64(k + 1) * np.full(1, _ODD)) & np.uint64(1)).astype(bool)
    real = sym != 0
    left, right = ~bit & real, bit & real
    joins = left[:-1] & right[1:]
    a, b = np.r_[joins, False], np.r_[False, joins]
    new_hi = np.where(a | left, np.r_[hi[1:], hi[-1:]], hi)
    new_lo = np.where(right & ~b, np.r_[lo[:1], lo[:-1]], lo)
    name = np.where(a, common.mix(sym * _ODD + np.r_[sym[1:], sym[-1:]]), sym)
    keep = ~b
    return name[keep], new_lo[keep], new_hi[keep]


def rounds(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, low, high) of each round over a sequence in which 0 separates documents."""
    at = np.arange(len(words))
    parsed = (words, at, at + 1)
    yield parsed
    parsed = _run_round(*parsed)
    yield parsed
    for k in range(PAIR_ROUNDS):
        parsed = _pair_round(*parsed, k)
        yield parsed


def anchors(words: np.ndarray, windows: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Name and place (round and position, as one number) of the anchor of each window start."""
    name, place = np.zeros(len(windows), np.uint64), np.zeros(len(windows), np.int64)
    for k, (sym, lo, hi) in enumerate(rounds(words)):
        before = np.zeros(len(words) + 1, np.int64)
        before[1:] = np.cumsum(np.bincount(lo, minlength=len(words)))
        j = before[windows]  # the first symbol whose range starts in the window
        ok = j < len(sym)
        jj = np.where(ok, j, 0)
        ok &= hi[jj] <= windows + width
        if not ok.any():
            break
        name = np.where(ok, common.mix(sym[jj] + np.uint64(k)), name)
        place = np.where(ok, jj * 64 + k, place)
    return name, place


def window_hashes(words: np.ndarray, windows: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hash of the ``width`` words from each start: a polynomial of random word hashes modulo 2^64, mixed."""
    base = 0xD6E8FEB86659FD93
    powers, inverse = np.full(len(words), base, np.uint64), np.full(len(words), pow(base, -1, 1 << 64), np.uint64)
    powers[:1] = inverse[:1] = 1
    np.cumprod(powers, out=powers)
    np.cumprod(inverse, out=inverse)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers, out=sums[1:])
    return common.mix((sums[windows + width] - sums[windows]) * inverse[windows])


def _narrow(values: np.ndarray) -> tuple[int, bytes]:
    """Numbers in two bytes each if they fit, else in four."""
    size = 2 if not len(values) or values.max() < 1 << 16 else 4
    return size, values.astype(f"<u{size}").tobytes()


def row_order(rows: np.ndarray) -> np.ndarray:
    """The order of rows: by id, null ids last, then by hash."""
    return np.lexsort((rows["low"], rows["high"], rows["id"], rows["none"]))


def _planes(rows: np.ndarray) -> bytes:
    """Rows as planes of bytes: those that are alike, as the high ones of ids, lie together and are packed well by the shuffle."""
    return np.ascontiguousarray(rows.view(np.uint8).reshape(-1, ROW.itemsize).T).tobytes()


def _rows(data: bytes, count: int, at: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, count * ROW.itemsize, at).reshape(ROW.itemsize, count)
    return np.ascontiguousarray(planes.T).reshape(-1).view(ROW)


def _pack(rows: np.ndarray, doc: np.ndarray, name: np.ndarray, start: np.ndarray, count: np.ndarray, hashes: np.ndarray) -> bytes:
    """One task's anchors of one bucket: 3 bytes of each name (the bucket has others), 6 of each window's hash."""
    used, doc = np.unique(doc, return_inverse=True)
    (d, docs), (s, starts) = _narrow(doc), _narrow(start)
    return b"".join([
        struct.pack("<IIIBB", len(used), len(doc), len(hashes), d, s), _planes(rows[used]), docs, starts, count.astype(np.uint8).tobytes(),
        np.ascontiguousarray(name.view(np.uint8).reshape(-1, 8)[:, :3]).tobytes(), np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes(),
    ])


def _unpack(data: bytes) -> list[np.ndarray]:
    """rows, doc, start, count, name, hashes."""
    n_docs, n, n_hashes, d, s = struct.unpack_from("<IIIBB", data)
    at, out = 14 + n_docs * ROW.itemsize, [_rows(data, n_docs, 14)]
    for kind, size, count in ((f"<u{d}", d, n), (f"<u{s}", s, n), ("u1", 1, n), ("", 3, n), ("", 6, n_hashes)):
        raw = np.frombuffer(data, np.uint8, size * count, at)
        at += size * count
        if kind:
            out.append(np.frombuffer(raw.tobytes(), kind).astype(np.int64 if size < 8 else kind))
        else:
            wide = np.zeros((count, 8), np.uint8)
            wide[:, :size] = raw.reshape(count, size)
            out.append(wide.view("<u8").reshape(-1))
    return out


def _pack_starts(rows: np.ndarray, doc: np.ndarray, start: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket of the document, its part of some repeated windows); ``doc`` indexes rows."""
    # The hash goes into it, so that the many rows that may lack an id are spread.
    bucket = (common.mix(rows["id"].view(np.uint64) ^ rows["low"])[doc] % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((start, doc, bucket))
    doc, start, bucket = doc[order], start[order], bucket[order]
    edges = np.flatnonzero(np.r_[True, np.diff(bucket) != 0]) if len(bucket) else []
    for x, y in zip(edges, np.r_[edges[1:], len(bucket)]) if len(bucket) else ():
        used, count = np.unique(doc[x:y], return_counts=True)
        yield int(bucket[x]), b"".join([struct.pack("<II", len(used), y - x), _planes(rows[used]), count.astype(np.uint32).tobytes(), start[x:y].astype(np.uint32).tobytes()])


def _unpack_starts(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(row, packed starts)."""
    n, total = struct.unpack_from("<II", data)
    rows, at = _rows(data, n, 8), 8 + ROW.itemsize * n
    count = np.frombuffer(data, "<u4", n, at)
    at += 4 * n
    for k, c in enumerate(count.tolist()):
        yield rows[k].tobytes(), data[at : at + 4 * c]
        at += 4 * c


def _heads(place: np.ndarray, windows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where runs of consecutive windows of one anchor begin; each is one row."""
    return np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1) | (doc[1:] != doc[:-1])])


def _parse(rows: np.ndarray, texts: list[bytes], buckets: int, width: int) -> Iterator[tuple[int, bytes | None, bytes | None]]:
    """Rows (bucket, packed anchors, None) and (bucket, None, packed starts of windows that this task knows to be repeated)."""
    order = row_order(rows)
    rows = rows[order]
    hashes, counts = word_hashes([texts[i] for i in order])
    # One separator before each document and one at the end.
    doc_of_word = np.repeat(np.arange(len(rows)), counts)
    first = np.r_[0, np.cumsum(counts)[:-1]] + np.arange(len(rows)) + 1
    words = np.zeros(len(hashes) + len(rows) + 1, np.uint64)
    at = np.arange(len(hashes)) + doc_of_word + 1
    words[at] = hashes | np.uint64(1)
    whole = np.arange(len(hashes)) + width <= np.cumsum(counts)[doc_of_word] if len(hashes) else np.zeros(0, bool)
    windows, doc = at[whole], doc_of_word[whole]
    if not len(windows):
        return
    own, start = window_hashes(words, windows, width), windows - first[doc]
    name, place = anchors(words, windows, width)
    # A name that comes once reveals that its windows come once here; those of shared names are compared.
    heads = _heads(place, windows, doc)
    order = np.argsort(name[heads], kind="stable")
    same = name[heads][order][1:] == name[heads][order][:-1]
    shared = np.zeros(len(heads), bool)
    shared[order] = np.r_[same, False] | np.r_[False, same]
    some = np.flatnonzero(np.repeat(shared, np.diff(np.r_[heads, len(windows)])))
    some = some[np.lexsort((own[some], name[some]))]
    chain = np.flatnonzero(np.r_[True, (own[some][1:] != own[some][:-1]) | (name[some][1:] != name[some][:-1])][: len(some)])
    lead = np.repeat(some[chain], np.diff(np.r_[chain, len(some)]))
    # Equal rows (same id, same text) are one document: a window isn't a repeat of itself.
    itself = (rows[doc[some]] == rows[doc[lead]]) & (start[some] == start[lead])
    repeat, drop = np.zeros(len(own), bool), np.zeros(len(own), bool)
    repeat[some], drop[some] = ~itself, some != lead
    for b, packed in _pack_starts(rows, doc[repeat], start[repeat], buckets):
        yield b, None, packed
    left = np.flatnonzero(~drop)
    windows, doc, start, own, name, place = windows[left], doc[left], start[left], own[left], name[left], place[left]
    heads = _heads(place, windows, doc)
    size = np.diff(np.r_[heads, len(windows)])
    bucket = ((name[heads] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    by_bucket = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(bucket[by_bucket]) != 0])
    for x, y in zip(edges, np.r_[edges[1:], len(by_bucket)]):
        some = by_bucket[x:y]
        h, n = heads[some], size[some]
        inside = np.repeat(h, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield int(bucket[some[0]]), _pack(rows, doc[h], name[h], start[h], n, own[inside]), None


def _repeats(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, doc, start) of the windows of one bucket that come earlier elsewhere; doc indexes rows."""
    base = np.cumsum([0, *(len(p[0]) for p in parts)])
    rows = np.concatenate([p[0] for p in parts])
    doc = np.concatenate([p[1] + b for p, b in zip(parts, base)])
    start, count, name, own = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4, 5))
    order = np.argsort(name, kind="stable")
    ranked = name[order]
    same = ranked[1:] == ranked[:-1]
    shared = np.zeros(len(name), bool)
    shared[order] = np.r_[same, False] | np.r_[False, same]
    own = own[np.repeat(shared, count)]
    name, doc, start, count = name[shared], doc[shared], start[shared], count[shared]
    start = np.repeat(start, count) + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    doc, name = np.repeat(doc, count), np.repeat(name, count)
    # Documents in their order; equal ones are one.
    by = row_order(rows)
    new = np.r_[False, rows[by][1:] != rows[by][:-1]]
    rank = np.empty(len(rows), np.int64)
    rank[by] = np.cumsum(new)
    found = rank[doc]
    order = np.lexsort((start, found, own, name))
    name, own, found, start, doc = name[order], own[order], found[order], start[order], doc[order]
    head = np.r_[True, (name[1:] != name[:-1]) | (own[1:] != own[:-1])][: len(name)]
    chain = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
    gone = (found != found[chain]) | (start != start[chain])
    return rows, doc[gone], start[gone]


def kept_words(text: bytes, starts: np.ndarray, width: int = WIDTH) -> tuple[int, list[bytes]]:
    """Number of words, and the words that no window from one of ``starts`` covers."""
    words = text.split()
    if not len(starts):
        return len(words), words
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, np.minimum(starts.astype(np.int64) + width, len(words)), -1)
    keep = np.cumsum(cover[:-1]) == 0
    return len(words), [w for w, k in zip(words, keep.tolist()) if k]


#: The columns of a row's identity, as Spark has them, and of the starts of its repeated windows.
KEYS = "none boolean, id bigint, high bigint, low bigint"
_HALVES = ("high", "low")


def identities(batch: pa.RecordBatch) -> np.ndarray:
    """The rows (``ROW``) of a batch whose first columns are ``KEYS``."""
    rows = np.empty(batch.num_rows, ROW)
    for k, c in enumerate(ROW.names):
        column = batch.column(k).to_numpy(zero_copy_only=False)
        rows[c] = column.view(np.uint64) if c in _HALVES else column
    return rows


def repeated_windows(rows: DataFrame, chars: int, width: int = WIDTH) -> DataFrame:
    """(none, id, high, low, starts): starts (packed 32-bit numbers) of windows whose words also start earlier, from the rows of ``keyed`` and their number of characters."""
    n = int(max(common.shuffle_partitions(rows.sparkSession), chars // BUCKET_CHARS + 1))
    schema = pa.schema([("bucket", pa.int32()), ("anchors", pa.binary()), ("starts", pa.binary())])
    sql = "bucket int, anchors binary, starts binary"

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, body = identities(batch), common.texts(batch.column(4))
            for a, b in common.slices([len(t) for t in body], CHUNK):
                found = list(_parse(who[a:b], body[a:b], n, width))
                if found:
                    yield batch_of(found)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            known = []
            for bucket, packed, starts in zip(*(c.to_pylist() for c in batch.columns)):
                if packed is None:
                    known.append((bucket, None, starts))
                else:
                    parts.setdefault(bucket, []).append(_unpack(packed))
            if known:
                yield batch_of(known)
        for bucket in list(parts):
            found = [(b, None, s) for b, s in _pack_starts(*_repeats(parts.pop(bucket)), n)]
            if found:
                yield batch_of(found)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts: dict[bytes, list[bytes]] = {}
        for batch in batches:
            for packed in batch.column(2).to_pylist():
                for row, s in _unpack_starts(packed):
                    starts.setdefault(row, []).append(s)
        found = [(row, b"".join(s)) for row, s in starts.items()]
        for a, b in common.slices([len(s) for _, s in found], 4 << 20):
            who = np.frombuffer(b"".join(row for row, _ in found[a:b]), ROW)
            columns = [pa.array(who[c].view(np.int64) if c in _HALVES else who[c]) for c in ROW.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([s for _, s in found[a:b]], pa.binary())], names=[*ROW.names, "starts"])

    # One bucket is one partition (dealt out by its number, not by a hash of it), first of anchors, then of documents.
    settled = rows.mapInArrow(parse, sql).repartitionById(n, "bucket").mapInArrow(settle, sql)
    return settled.repartitionById(n, "bucket").mapInArrow(gather, KEYS + ", starts binary")


def keyed(df: DataFrame, id: str, text: str) -> DataFrame:
    """(none, id, high, low, t): whether a row lacks an id, its id, and 128 bits of its text's hash, which tell apart the rows of one id and those without any."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own, half = F.col(id).cast("long"), lambda a: F.conv(F.substring("__md5", a, 16), 16, -10).cast("long")
    rows = df.select(own.isNull().alias("none"), F.coalesce(own, F.lit(0)).alias("id"), F.md5(t).alias("__md5"), t.alias("t"))
    return rows.select("none", "id", half(1).alias("high"), half(17).alias("low"), "t")


def deduplicate(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_words, n_removed, kept): each row's words that no repeated window covers, joined by one space.

    A window of ``width`` words is repeated if its words also start earlier: in
    a row of a smaller id, or in the same text further left. Null texts have no
    word. Rows of one id with different texts are ordered by a hash of the text;
    equal rows are one document and have equal results. Null ids come last, each text a document of its own.
    """
    rows = keyed(df, id, text)
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    pieces = repeated_windows(rows, chars, width)
    other = pieces.withColumnsRenamed({c: f"__{c}" for c in ROW.names})
    same = [F.col(c) == F.col(f"__{c}") for c in ROW.names]
    joined = rows.join(other, same, "left").select("none", "id", "t", "starts")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, left, kept = [], [], []
            for body, starts in zip(common.texts(batch.column(2)), batch.column(3).to_pylist()):
                n, words = kept_words(body, np.frombuffer(starts or b"", np.uint32), width)
                total.append(n), left.append(n - len(words)), kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total, pa.int64()), pa.array(left, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["none", "id", "n_words", "n_removed", "kept"])

    # Not many more partitions than the texts have megabytes, however finely the shuffle is cut.
    done = joined.mapInArrow(keep, "none boolean, id bigint, n_words bigint, n_removed bigint, kept string").coalesce(int(max(12, chars >> 22)))
    return done.select(F.when(~F.col("none"), F.col("id")).alias(id), "n_words", "n_removed", "kept")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of repeated 20-word windows."""
    kept = deduplicate(common.table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
