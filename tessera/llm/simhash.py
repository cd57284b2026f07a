"""SimHash near-duplicate detection with a tiled exact comparison.

Fingerprints are dealt into tiles by population count, each of at most
``TILE`` rows. Two tiles meet only if their population counts differ by the
radius at most, since the counts of linked fingerprints can't differ by more.
Within a pair of tiles, blocks of ``BLOCK`` fingerprints are ordered by the
population counts of their four 16-bit parts, and block pairs whose counts are
too far apart are skipped likewise; the others are compared whole, with
exclusive-or and bit counts. A pair of tiles returns links that connect what it
links (a forest), never all pairs of a group; connected components do the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.components import components

SEED = 42
TILE, BLOCK = 8192, 64
#: Links that a pair of tiles holds before it drops those that its forest doesn't need.
FOREST_ROOM = 1_000_000
#: The pipeline's stage: words a shingle, similarity, and the limits of distance (first fingerprint, both) of pairs that are tested.
WORDS, SIMILARITY, WIDE = 5, 0.8, (16, 28)
#: Texts sampled and shingles held to know common ones; signatures a bucket; rows of a list that meet in one cell.
SAMPLE, COMMON, BUCKET, LIST = 8192, 200_000, 500_000, 1024
#: Hash buckets by which rows are told that some ids can't concern.
MARKS = 1 << 18


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of each run of k words, repeats included; ASCII letters lower-cased. Fewer words: of the whole sequence; none: nothing."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[: -k])]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :])), np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is in over half the hashes; none: zero."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = sum(bits[a : a + 65536].sum(0, dtype=np.int64) for a in range(0, len(bits), 65536))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of k words."""
    return np.unique(shingle_hashes(text, k))


def fingerprints(df: DataFrame, id: str = "doc_id", text: str = "text", k: int = 4) -> DataFrame:
    """(id, fp): the 64-bit SimHash of each row's text as a signed integer; null texts have no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((simhash(shingle_hashes(t, k)) for t in common.texts(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[id, "fp"])

    kind = df.schema[id].dataType.simpleString()
    return df.select(id, F.col(text).cast("string").alias("t")).mapInArrow(run, f"`{id}` {kind}, fp bigint")


def _parts(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view("<u2").reshape(-1, 4)).astype(np.int16)


class _Tile:
    """Fingerprints ordered by their parts' population counts, with the range of the counts of each block."""

    def __init__(self, fps: np.ndarray, ids: np.ndarray, second: np.ndarray | None = None) -> None:
        counts = _parts(fps)
        order = np.lexsort(counts.T[::-1])
        self.fps, self.ids, counts = fps[order], ids[order], counts[order]
        self.second = None if second is None else second[order]
        starts = np.arange(0, len(fps), BLOCK)
        self.low, self.high = np.minimum.reduceat(counts, starts), np.maximum.reduceat(counts, starts)


def _hits(x: _Tile, y: _Tile | None, radius: int, both: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of x: its first row, the rows of y (or of x itself) near it by their counts, which pairs are linked, and the distances.

    ``both``: limit of the distance of both fingerprints together, if there are two.
    """
    other = x if y is None else y
    gap = np.maximum(other.low[None] - x.high[:, None], 0) + np.maximum(x.low[:, None] - other.high[None], 0)
    gap, columns = gap.sum(2, dtype=np.int16), np.arange(len(other.fps))
    for block in range(len(x.low)):
        near = gap[block] <= radius
        if y is None:
            near[:block] = False
        if not near.any():
            continue
        pick = columns[np.repeat(near, BLOCK)[: len(columns)]]
        a = block * BLOCK
        distance = np.bitwise_count(x.fps[a : a + BLOCK, None] ^ other.fps[pick][None])
        hit = distance <= radius
        if y is None:
            hit &= pick[None] > np.arange(a, a + len(hit))[:, None]
        if both is not None:
            i, j = np.nonzero(hit)
            total = distance[i, j] + np.bitwise_count(x.second[a + i] ^ other.second[pick[j]])
            hit[i, j], distance[i, j] = total <= both, total
        yield a, pick, hit, distance


def _forest(n: int, edges: np.ndarray) -> np.ndarray:
    """The rows of ``edges`` (i, j, distance) that Kruskal's algorithm keeps."""
    edges, parent, kept = edges[np.argsort(edges[:, 2], kind="stable")], list(range(n)), []

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    for k, (i, j, _) in enumerate(edges.tolist()):
        i, j = root(i), root(j)
        if i != j:
            parent[j] = i
            kept.append(k)
    return edges[kept]


def _links(x: _Tile, y: _Tile | None, radius: int, wide: tuple[int, int] | None = None) -> list[tuple[int, int, int]]:
    """Links (id, id, distance) that connect whatever is linked within the radius.

    With two fingerprints, ``wide`` is (limit of the first, limit of both): after
    the links of the small radius (for both together twice as much), nearest
    links first, a forest of those between what is not linked yet.
    """
    other, at = (x, 0) if y is None else (y, len(x.fps))
    n = len(x.fps) + (0 if y is None else len(y.fps))
    label, found = np.arange(n), []
    for a, pick, hit, distance in _hits(x, y, radius, None if wide is None else 2 * radius):
        for i in np.flatnonzero(hit.any(1)):
            js = pick[hit[i]]
            labels = label[js + at]
            new = labels != label[a + i]
            if not new.any():
                continue
            roots, first = np.unique(labels[new], return_index=True)
            ds = distance[i][hit[i]][new]
            found += [(int(x.ids[a + i]), int(other.ids[js[new][f]]), int(ds[f])) for f in first]
            roots = np.r_[roots, label[a + i]]
            label[np.isin(label, roots)] = roots.min()
    if wide is None:
        return found
    parts: list[np.ndarray] = []
    held = 0
    for a, pick, hit, distance in _hits(x, y, wide[0], wide[1]):
        i, j = np.nonzero(hit)
        i, j, d = a + i, pick[j] + at, distance[i, j]
        apart = label[i] != label[j]
        parts.append(np.stack([i[apart], j[apart], d[apart]], 1).astype(np.int64))
        held += len(parts[-1])
        if held > FOREST_ROOM:
            parts = [_forest(n, np.concatenate(parts))]
            held = len(parts[0])
    ids = np.r_[x.ids, other.ids] if y is not None else x.ids
    return found + [(int(ids[i]), int(ids[j]), int(d)) for i, j, d in (_forest(n, np.concatenate(parts)) if parts else ())]


def links(distinct: DataFrame, radius: int, wide: tuple[int, int] | None = None) -> DataFrame:
    """(a, b, distance): links that connect all fingerprints within the radius, from (fp, rep) rows of distinct fingerprints.

    ``wide``: see ``_links``; the rows then have a second fingerprint, fp2.
    """
    spark = distinct.sparkSession
    reach = radius if wide is None else wide[0]
    rows = distinct.withColumn("pop", F.bit_count("fp").cast("int"))
    # At most 65 classes: how many tiles each needs so that none has much more than TILE rows.
    count = {r["pop"]: -(-r["count"] // TILE) for r in rows.groupBy("pop").count().collect()}
    if not count:
        return spark.createDataFrame([], "a long, b long, distance int")
    sub = F.create_map(*(F.lit(x) for kv in count.items() for x in kv))
    tile = F.pmod(F.xxhash64("fp"), sub[F.col("pop")].cast("long")).cast("int")
    columns = ["fp", "rep"] if wide is None else ["fp", "rep", "fp2"]
    tiles = rows.groupBy("pop", tile.alias("sub")).agg(F.collect_list(F.struct(*columns)).alias("rows")).select("pop", "sub", *(F.col(f"rows.{c}").alias(c) for c in columns))
    pairs = sum(count[p] * count[q] for p in count for q in count if p <= q <= p + reach)

    # Each tile goes once to each of its pairs; a pair is a group of two rows, or of one if a tile meets itself.
    step = spark.createDataFrame([(p, count[p]) for p in sorted(count)], "q int, n int")
    a = tiles.join(F.broadcast(step), F.abs(F.col("q") - F.col("pop")) <= reach).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    own, there = F.struct(F.col("pop").alias("p"), F.col("sub").alias("s")), F.struct(F.col("q").alias("p"), F.col("j").alias("s"))
    dealt = a.select(F.least(own, there).alias("lo"), F.greatest(own, there).alias("hi"), *columns)

    def compare(key: tuple, tables: pa.Table) -> pa.Table:
        sides = []
        for i in range(tables.num_rows):
            side = {c: tables.column(c)[i].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns}
            sides.append(_Tile(side["fp"].view(np.uint64), side["rep"], None if wide is None else side["fp2"].view(np.uint64)))
        alone = key[0].as_py() == key[1].as_py()
        found = _links(sides[0], None if alone else sides[1], radius, wide) if alone or len(sides) > 1 else []
        out = list(zip(*found)) if found else [[], [], []]
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], names=["a", "b", "distance"])

    parts = max(common.shuffle_partitions(spark), min(pairs, 4 * common.shuffle_partitions(spark)))
    return dealt.repartition(parts, "lo", "hi").groupBy("lo", "hi").applyInArrow(compare, "a long, b long, distance int")


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", k: int = 4, radius: int = 4) -> DataFrame:
    """(id, fingerprint, component_id): documents linked by fingerprints that differ in ``radius`` bits at most.

    component_id is the smallest id that can be reached, the row's own
    included. Texts without a word have fingerprint zero and are linked like
    any others. Ids are integers; rows with a null id are linked too, but
    never name a component (null where all ids of a fingerprint are null). Rows
    of one id with different texts are separate rows, each in its own class.
    """
    docs = common.cut(fingerprints(df, id, text, k).select(F.col(id).alias("id"), "fp"))
    distinct = common.cut(docs.groupBy("fp").agg(F.min("id").alias("rep")).where(F.col("rep").isNotNull()), common.files_for(docs))
    groups = components(links(distinct, radius))
    # Only fingerprints that are linked to another move; all others keep the least id of their own fingerprint.
    named = distinct.join(groups, distinct.rep == groups.node, "left").select(F.col("fp").alias("f"), F.coalesce("component", "rep").alias("component_id"))
    return docs.join(named, docs.fp == named.f, "left").select(F.col("id").alias(id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _common(rows: DataFrame, k: int) -> np.ndarray:
    """Shingles that several texts of a sample share, sorted, and their places from the rarest on. They only set an order: no pair depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, k) for t in common.texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))], names=["h"])

    share = max(1, -(-rows.count() // SAMPLE))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select("t")
    counts = sample.mapInArrow(run, "h bigint").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    hashes = counts.column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return np.stack([hashes[order], (len(order) - order).astype(np.uint64)])


def _prefix(shingles: np.ndarray, known: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, common ones last: sets at least so similar share one of them."""
    if not len(shingles):
        return shingles
    need = len(shingles) - int(np.ceil(similarity * len(shingles) - 1e-6)) + 1
    if not known.shape[1]:
        return shingles[:need]
    at = np.minimum(np.searchsorted(known[0], shingles), known.shape[1] - 1)
    place = np.where(known[0][at] == shingles, known[1][at], np.uint64(0))
    return shingles[np.argsort(place, kind="stable")[:need]]


def _planes(x: np.ndarray) -> bytes:
    """Bytes by their places, which compress better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplanes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _lists(sig: np.ndarray, id: np.ndarray, group: np.ndarray, n: np.ndarray, at: np.ndarray, similarity: float) -> list[bytes]:
    """The (id, group) of rows that share a signature, by id, a list for each run of near sizes; rows that by sizes and places are similar to none of their list are left out.

    If a signature is the first that two sets share, neither's size exceeds the
    other's ``reach``. A row goes if the least size of the others is beyond its
    reach, or its size beyond all of theirs; so the work follows the rows, not their pairs.
    """
    share = similarity / (1 + similarity)
    order = np.lexsort((n, sig))
    sig, id, group, n, at = sig[order], id[order], group[order], n[order].astype(np.int64), at[order].astype(np.int64)
    reach = ((1 - share) * n - at + 1e-6) / share
    while len(sig):
        new = np.r_[True, (sig[1:] != sig[:-1]) | (n[:-1] < similarity * n[1:] - 1e-6)]
        starts, run = np.flatnonzero(new), np.cumsum(new) - 1
        several = np.minimum.reduceat(group, starts) != np.maximum.reduceat(group, starts)
        least = np.where(new, np.r_[n[1:], 0], n[starts][run])  # of the others, if there are any
        top = np.maximum.reduceat(reach, starts)[run]
        second = np.maximum.reduceat(np.where(reach == top, -np.inf, reach), starts)[run]
        most = np.where((reach == top) & (np.add.reduceat((reach == top).astype(np.int64), starts)[run] == 1), second, top)
        keep = several[run] & (least <= reach) & (n <= most)
        if keep.all():
            order = np.lexsort((id, run))
            run, members = run[order], np.stack([id, group], 1)[order]
            once = np.r_[True, (run[1:] != run[:-1]) | (members[1:] != members[:-1]).any(1)]
            data, ends = members[once].tobytes(), 16 * np.cumsum(np.bincount(run[once]))
            return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        sig, id, group, n, reach = sig[keep], id[keep], group[keep], n[keep], reach[keep]
    return []


def _spread(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, side, row) for a list: its rows in parts of about LIST, of which each meets itself (side 2) and each other one (sides 0 and 1)."""
    rows = len(data) // 16
    parts = -(-rows // LIST)
    own, there = np.repeat(np.arange(rows) % parts, parts), np.tile(np.arange(parts), rows)
    pair = np.minimum(own, there) * parts + np.maximum(own, there)
    # Lists whose cells have one name only add pairs to test.
    cell = common.mix(pair.astype(np.uint64) + np.uint64(xxhash.xxh64_intdigest(data))).view(np.int64)
    return cell, np.where(own == there, 2, own > there).astype(np.int32), np.repeat(np.arange(rows), parts)


def _near(side: np.ndarray, id: np.ndarray, group: np.ndarray, n: np.ndarray, maps: list[bytes], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b), a < b, of ids of a cell's different groups that may be similar by sizes and parity maps."""
    share, widths = (1 - similarity) / (1 + similarity), np.fromiter(map(len, maps), np.int64, len(maps))
    rows = {int(w): np.flatnonzero(widths == w) for w in np.unique(widths)}
    stacked = {w: np.frombuffer(b"".join(maps[i] for i in at), np.uint64).reshape(len(at), -1) for w, at in rows.items()}
    for w, x in rows.items():
        for y, other in ((x, stacked[w]), *([(rows[2 * w], stacked[2 * w][:, : w // 8] ^ stacked[2 * w][:, w // 8 :])] if 2 * w in rows else [])):
            step = max(1, (1 << 18) // len(y))
            for a in range(0, len(x), step):
                i, j = x[a : a + step, None], y[None]
                may = ((side[i] != side[j]) | (side[i] == 2)) & (group[i] != group[j]) & (id[i] != id[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-6)
                if x is y:
                    may &= i < j
                k, m = np.nonzero(may)
                if not len(k):
                    continue
                apart = np.zeros(len(k), np.int64)
                for c in range(0, len(k), chunk := max(1, (1 << 18) // (w // 8))):
                    apart[c : c + chunk] = np.bitwise_count(stacked[w][a + k[c : c + chunk]] ^ other[m[c : c + chunk]]).sum(1, dtype=np.int64)
                i, j = x[a + k], y[m]
                near = apart <= share * (n[i] + n[j]) + 1e-6
                i, j = id[i[near]], id[j[near]]
                yield np.minimum(i, j), np.maximum(i, j)


def shared_prefixes(sets: DataFrame, maps: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: all pairs of different groups that share a shingle of their prefixes and may be similar by sizes and parity maps, from rows (id, component, n, prefix) and (id, n, map).

    What share a shingle stay lists until their maps are beside them; a list
    that many shingles have is looked at once. Only pairs that the maps let through become rows.
    """
    spark = sets.sparkSession
    total = sets.agg(F.sum(F.length("prefix"))).first()[0] or 0
    buckets = max(common.shuffle_partitions(spark), -(-total // (8 * BUCKET)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = [np.frombuffer(x, np.uint64) for x in batch.column(3).to_pylist()]
            lengths = np.array([len(x) for x in prefixes], np.int64)
            if not lengths.sum():
                continue
            sig = common.mix(np.concatenate(prefixes))
            id, group, n = (np.repeat(batch.column(c).to_numpy(), lengths) for c in range(3))
            at = np.arange(len(sig)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            bucket = ((sig >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
            # 32 bits within a bucket: equal ones of different shingles only add pairs to test.
            parts = (sig.astype(np.uint32), id.astype(np.int64), group.astype(np.int64), n.astype(np.uint32), at.astype(np.uint32))
            parts = [[_planes(x[a:b]) for a, b in zip(edges, edges[1:])] for x in (y[order] for y in parts)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][edges[:-1]]), *(pa.array(x, pa.binary()) for x in parts)], names=["bucket", "sig", "id", "grp", "n", "place"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            for bucket, *parts in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(bucket, []).append([_unplanes(x, kind) for x, kind in zip(parts, (np.uint32, np.int64, np.int64, np.uint32, np.uint32))])
        for bucket in list(held):
            found = list(dict.fromkeys(_lists(*(np.concatenate(x) for x in zip(*held.pop(bucket))), similarity)))
            for a, b in common.slices([len(x) for x in found], 1 << 22):
                yield pa.RecordBatch.from_arrays([pa.array(found[a:b], pa.binary())], names=["list"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                cell, side, row = _spread(data)
                members = np.frombuffer(data, np.int64).reshape(-1, 2)
                for a in range(0, len(cell), 1 << 16):
                    part = members[row[a : a + (1 << 16)]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(y)) for y in (cell[a : a + (1 << 16)], side[a : a + (1 << 16)], part[:, 0], part[:, 1])], names=["cell", "side", "id", "grp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in chain(batches, (None,)):
            table = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if table is None:
                continue
            cell, side, id, group, n = (table.column(c).to_numpy() for c in ("cell", "side", "id", "grp", "n"))
            edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
            whole = edges if batch is None else edges[:-1]  # the last cell may go on in the next batch
            body, out = table.column("map").to_pylist(), []
            for a, b in zip(whole[:-1].tolist(), whole[1:].tolist()):
                out += _near(side[a:b], id[a:b], group[a:b], n[a:b].astype(np.int64), body[a:b], similarity)
            rest = None if batch is None else table.slice(int(whole[-1]))
            if out:
                x, y = (np.concatenate(z) for z in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    dealt = sets.select("id", "component", "n", "prefix").mapInArrow(deal, "bucket int, sig binary, id binary, grp binary, n binary, place binary")
    lists = dealt.repartition(buckets, "bucket").mapInArrow(meet, "list binary").distinct()
    cells = lists.mapInArrow(spread, "cell bigint, side int, id bigint, grp bigint").join(maps, "id").select("cell", "side", "id", "grp", "n", "map")
    return cells.repartition(common.shuffle_partitions(spark), "cell").sortWithinPartitions("cell").mapInArrow(compare, "a bigint, b bigint").distinct()


def parity_map(shingles: np.ndarray) -> bytes:
    """The parity of the shingles at each of 2 to 4 places a shingle (their low bits), packed."""
    bits = 1 << max(6, (2 * len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the number of shingles that only one of two sets has: places whose parities differ."""
    size = min(len(x), len(y))
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    for n in (len(x), len(y)):
        while n > size:  # the halves of a longer map laid over each other are the map of half as many places
            n //= 2
            if len(x) > len(y):
                a = (a >> 8 * n) ^ (a & (1 << 8 * n) - 1)
            else:
                b = (b >> 8 * n) ^ (b & (1 << 8 * n) - 1)
    return (a ^ b).bit_count()


def _possible(maps: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of ids that may be similar by their sets' sizes and parity maps, from rows (id, n, map); no similar pair is lost."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = (1 - similarity) / (1 + similarity)
        for batch in batches:
            keep = [least_difference(x, y) <= share * (m + n) + 1e-6 for m, n, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = maps.select(F.col("id").alias("a"), F.col("n").alias("m"), F.col("map").alias("x"))
    y = maps.select(F.col("id").alias("b"), F.col("n"), F.col("map").alias("y"))
    both = pairs.join(x, "a").join(y, "b").where(F.least("m", "n") >= F.lit(similarity) * F.greatest("m", "n") - 1e-6)
    return both.select("a", "b", "m", "n", "x", "y").mapInArrow(test, "a bigint, b bigint")


def _marked(ids: DataFrame, name: str = "id") -> DataFrame:
    """(mark): the hash buckets of some ids, at most MARKS rows, so they may be broadcast."""
    return F.broadcast(ids.select(_mark(name)).distinct())


def _mark(name: str) -> Column:
    return F.pmod(F.xxhash64(F.col(name).cast("long")), F.lit(MARKS)).alias("mark")


def _tested(rows: DataFrame, pairs: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of ids whose texts' sets are similar; the texts of these ids alone are sent."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.compress(t, 1) for t in common.texts(batch.column(1))], pa.binary())], names=["id", "t"])

    # Most texts that no pair needs are told by their buckets and never shuffled.
    some = rows.select("*", _mark("id")).join(_marked(needed), "mark", "left_semi").select("id", "t")
    bodies = some.mapInArrow(packed, "id bigint, t binary").join(needed, "id", "left_semi")
    both = pairs.join(bodies.select(F.col("id").alias("a"), F.col("t").alias("x")), "a").join(bodies.select(F.col("id").alias("b"), F.col("t").alias("y")), "b").select("a", "b", "x", "y")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = lru_cache(64)(lambda t: shingle_set(zlib.decompress(t), k))
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = sets(x), sets(y)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(test, "a bigint, b bigint")


def similar_groups(df: DataFrame, id: str = "doc_id", text: str = "text", k: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(id, component): every non-null id, and the smallest id that links of similar texts reach.

    Two texts are similar if the Jaccard similarity of their sets of k-word
    shingles is ``similarity`` or more (two texts without a word are, too). Texts of
    equal sets are joined at once. Then two SimHashes of the sets propose
    links, of which those that connect a pair of tiles are tested on the sets;
    this joins most of each group, but misses pairs. So all pairs between the
    groups found that share a shingle of their prefixes, as any similar pair
    does, are tested in the end.
    """
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("t")).where(F.col("id").isNotNull())
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast(_common(rows, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, k) for t in common.texts(batch.column(1))]
            first = np.array([simhash(s) for s in sets], np.uint64)
            second = np.array([simhash(common.mix(s)) for s in sets], np.uint64)
            whole = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)
            sizes = pa.array([len(s) for s in sets], pa.int32())
            prefixes = pa.array([_prefix(s, known.value, similarity).tobytes() for s in sets], pa.binary())
            maps = pa.array([parity_map(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.view(np.int64)) for x in (first, second, whole)), sizes, prefixes, maps], names=["id", "fp", "fp2", "whole", "n", "prefix", "map"])

    hashed = common.cut(rows.mapInArrow(run, "id bigint, fp bigint, fp2 bigint, whole bigint, n int, prefix binary, map binary"))
    files = common.files_for(hashed)
    equal = hashed.groupBy("fp", "fp2", "whole").agg(F.min("id").alias("rep"))
    # The least ids get an exchange of their own (``u`` is ``whole`` again), so that a large group of copies may be split.
    least = equal.select(F.col("fp").alias("f"), F.col("fp2").alias("g"), F.greatest("whole", F.least("whole", "rep")).alias("u"), "rep")
    same = common.cut(hashed.select("id", "fp", "fp2", "whole").join(least, (F.col("fp") == F.col("f")) & (F.col("fp2") == F.col("g")) & (F.col("whole") == F.col("u"))).select("id", "rep", "whole").where("id != rep").distinct(), files)
    distinct = equal.groupBy("fp").agg(F.min(F.struct("rep", "fp2")).alias("m")).select("fp", "m.rep", "m.fp2")
    # Different texts of one fingerprint are tested against its least id here, and against all others by their prefixes below.
    crowded = equal.select("fp", F.col("rep").alias("b")).join(distinct.select("fp", F.col("rep").alias("a")), "fp").where("a != b").select("a", "b")
    maps = hashed.select("id", "n", "map")
    pairs = common.cut(_possible(maps, links(distinct, 4, WIDE).select("a", "b").union(crowded).distinct(), similarity), files)
    linked = _tested(rows, pairs, k, similarity).union(same.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    groups = components(linked)
    first = common.cut(hashed.select("id").distinct().join(groups, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component")), files)

    # Of texts of equal sets only the least id's is compared. Prefixes are shuffled once, after all that is known without them.
    compared = hashed.select("id", "whole").distinct().join(same.select("id", "whole"), ["id", "whole"], "left_anti").join(first, "id")
    sets = hashed.select("id", "whole", "n", "prefix").join(compared, ["id", "whole"])
    pairs = common.cut(shared_prefixes(sets, maps, similarity), files)
    joined = _tested(rows, pairs, k, similarity)
    ends = joined.join(first.select(F.col("id").alias("a"), F.col("component").alias("x")), "a").join(first.select(F.col("id").alias("b"), F.col("component").alias("y")), "b")
    last = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select("node", F.col("component").alias("least"))
    return first.join(last, F.col("component") == F.col("node"), "left").select("id", F.coalesce("least", "component").alias("component"))


def one_of_each(df: DataFrame, id: str = "doc_id", text: str = "text", k: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of the least id of each group of similar texts, and rows without an id; all columns stay. Of rows with one id and one text, one stays."""
    groups = common.cut(similar_groups(df, id, text, k, similarity))
    dropped = groups.where("id <> component").select("id")
    repeated = df.select(F.col(id).cast("long").alias("id")).where(F.col("id").isNotNull()).groupBy("id").count().where("count > 1").select("id")
    # Rows in no bucket of a dropped or repeated id stay as they are, without a shuffle.
    marks = _marked(common.cut(dropped.union(repeated).distinct(), common.files_for(groups)))
    rows = df.withColumn("__mark", _mark(id))
    free = rows.join(marks, F.col("__mark") == F.col("mark"), "left_anti").drop("__mark")
    kept = rows.where(F.col(id).isNotNull()).join(marks, F.col("__mark") == F.col("mark"), "left_semi").join(dropped.select(F.col("id").alias("__dropped")), F.col(id).cast("long") == F.col("__dropped"), "left_anti")
    again = F.row_number().over(Window.partitionBy(id, F.xxhash64(text)).orderBy(id))
    unnumbered = df.where(F.col(id).isNull()).withColumn("__mark", _mark(id)).join(marks, F.col("__mark") == F.col("mark"), "left_semi").drop("__mark")
    return free.unionByName(kept.withColumn("__again", again).where("__again = 1").drop("__again", "__mark")).unionByName(unnumbered)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 4-word shingles, 4 bits."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))
