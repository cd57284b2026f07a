"""Document fingerprints from prefix polynomial hashes.

``Prefix`` holds the running sums of ``code_i * B^i`` modulo two primes. Any
two spans, of one text or of two, are compared in constant time, and longest
common extensions are found by binary search. A fingerprint is the sorted
``SKETCH`` smallest mixed hashes of all spans of ``SPAN`` code points, all read
off the prefix arrays; the share of common values among the smallest of both
estimates how many spans two texts share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
SPAN, SKETCH = 12, 32


def _modulo(x: np.ndarray, p: int) -> np.ndarray:
    """x mod p for products of two residues; p is a little under 2^31."""
    low, gap = np.uint64(0x7FFFFFFF), np.uint64(2147483648 - p)
    x = (x & low) + (x >> np.uint64(31)) * gap
    x = (x & low) + (x >> np.uint64(31)) * gap
    return np.where(x >= p, x - np.uint64(p), x)


class _Powers:
    """Powers of the bases, forward and inverse, grown as longer texts come."""

    def __init__(self) -> None:
        self.tables = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in PRIMES]

    def upto(self, n: int) -> list[list[np.ndarray]]:
        for k, (p, b) in enumerate(zip(PRIMES, BASES)):
            for side, base in enumerate((b, pow(b, -1, p))):
                table = self.tables[k][side]
                while len(table) < n:
                    table = np.concatenate([table, _modulo(table * np.uint64(pow(base, len(table), p)), p)])
                self.tables[k][side] = table
        return self.tables


_powers = _Powers()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Prefix:
    """Modular prefix arrays of one sequence of code points."""

    def __init__(self, sequence: np.ndarray) -> None:
        self.n = len(sequence)
        powers = _powers.upto(self.n + 1)
        values = sequence.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for k, p in enumerate(PRIMES):
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_modulo(values * powers[k][0][: self.n], p), out=sums[1:])
            self.sums.append(_modulo(sums, p))

    def spliced(self, keep: int, tail: np.ndarray) -> Prefix:
        """The prefix arrays of the first ``keep`` code points followed by ``tail``; only the tail is hashed."""
        out = object.__new__(Prefix)
        out.n, out.sums = keep + len(tail), []
        powers = _powers.upto(out.n + 1)
        values = tail.astype(np.uint64) + np.uint64(1)
        for k, p in enumerate(PRIMES):
            more = np.cumsum(_modulo(values * powers[k][0][keep : out.n], p)) + self.sums[k][keep]
            out.sums.append(np.concatenate([self.sums[k][: keep + 1], _modulo(more, p)]))
        return out

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 62-bit hash of each span [start, end); equal spans have equal hashes wherever they stand."""
        out = np.zeros(len(starts), np.uint64)
        for k, p in enumerate(PRIMES):
            inverse = _powers.upto(self.n + 1)[k][1]
            part = _modulo((self.sums[k][ends] + np.uint64(p) - self.sums[k][starts]) * inverse[starts], p)
            out = (out << np.uint64(31)) | part
        return out

    def span(self, start: int, end: int) -> int:
        return int(self.spans(np.array([start]), np.array([end]))[0])


def same(x: Prefix, a: int, y: Prefix, b: int, n: int) -> bool:
    """Whether n code points of x from a equal those of y from b."""
    return a + n <= x.n and b + n <= y.n and x.span(a, a + n) == y.span(b, b + n)


def common_extension(x: Prefix, a: int, y: Prefix, b: int) -> int:
    """Length of the longest common extension of x from a and y from b."""
    low, high = 0, min(x.n - a, y.n - b)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if x.span(a, a + mid) == y.span(b, b + mid) else (low, mid - 1)
    return low


def span_values(prefix: Prefix, begin: int = 0) -> np.ndarray:
    """Mixed 32-bit hashes of the spans from place ``begin`` on; a text shorter than a span is one span, an empty one has none."""
    if not prefix.n:
        return np.zeros(0, np.uint32)
    width = min(SPAN, prefix.n)
    starts = np.arange(begin, prefix.n - width + 1)
    return (common.mix(prefix.spans(starts, starts + width)) >> np.uint64(32)).astype(np.uint32)


def sketch(values: np.ndarray) -> np.ndarray:
    """The sorted smallest distinct values."""
    least = 4 * SKETCH
    while len(values) > least:  # repeated spans may crowd the smallest values
        found = np.unique(np.partition(values, least)[:least])
        if len(found) >= SKETCH:
            return found[:SKETCH]
        least *= 4
    return np.unique(values)[:SKETCH]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smallest values of both that both have; 1 for two empty texts."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:SKETCH]
    return float(np.isin(union, np.intersect1d(a, b)).mean())


def as_hex(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


class Hashed:
    """A text with its prefix arrays, span values and fingerprint."""

    def __init__(self, text: str) -> None:
        self.text, self.prefix = text, Prefix(codes(text))
        self.values = span_values(self.prefix)
        self.sketch = sketch(self.values)

    def edited(self, following: str) -> tuple[str, Prefix, np.ndarray]:
        """The edited text, its prefix arrays and its fingerprint; spans before the edit are taken over."""
        n = len(self.text)
        cut = n // 3
        keep, tail = n - cut, following[:cut]
        prefix = self.prefix.spliced(keep, codes(tail))
        shared = max(0, keep - SPAN + 1) if prefix.n >= SPAN else 0
        values = np.concatenate([self.values[:shared], span_values(prefix, shared)])
        return self.text[:keep] + tail, prefix, sketch(values)


def compared(own: Hashed, following: Hashed) -> tuple:
    """What op9 says of one text and the next document's."""
    edited, prefix, b = own.edited(following.text)
    a, c = own.sketch, following.sketch
    return (len(own.text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_hex(a), as_hex(b), likeness(a, b), likeness(a, c), common_extension(own.prefix, 0, prefix, 0))


FIELDS = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix bigint"
TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]


def neighbours(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Compare every text with its edited text and with the next document, by descending id.

    Rows are dealt out by ranges of ids, so that all but one row of each task
    find their next document beside them. The last text of each task meets the
    first of the next task with rows in a small second step (two rows a task);
    the last of all meets the first. Rows of one id follow each other by text,
    those without an id come last; null texts are empty. An empty table gives no row.
    """
    kind = df.schema[id].dataType.simpleString()
    whole = f"id {kind}, {FIELDS}, edge int, body string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None
        names = [*(f.split()[0] for f in whole.split(", "))]
        id_type = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            kinds = [id_type, *TYPES, pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            rows, id_type = [], batch.column(0).type
            for key, body in zip(batch.column(0).to_pylist(), common.strings(batch.column(1))):
                here = Hashed(body)
                if before is None:
                    rows.append((key, *[None] * 7, 0, body))  # the first of this task
                else:
                    rows.append((before[0], *compared(before[1], here), None, None))
                before = (key, here)
            if rows:
                yield batch_of(rows)
        if before is not None:
            yield batch_of([(before[0], *[None] * 7, 1, before[1].text)])

    spark = df.sparkSession
    rows = df.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    order = [F.col("id").desc_nulls_last(), F.col("body")]
    ranged = rows.repartitionByRange(common.shuffle_partitions(spark), order[0])  # equal ids meet; no text is sampled
    ranged = ranged.sortWithinPartitions(*order)
    parts = common.cut(ranged.mapInArrow(run, whole).withColumn("task", F.spark_partition_id()))
    done = parts.where(F.col("edge").isNull())
    # Two rows a task: heads (0) and tails (1). Only their task numbers are put in order; a tail looks for the next task's head.
    heads = parts.where(F.col("edge") == 0).select("task", F.col("body").alias("following"))
    order_ = heads.select("task").withColumn("next", F.coalesce(F.lead("task").over(Window.orderBy("task")), F.min("task").over(Window.partitionBy())))
    tails = parts.where(F.col("edge") == 1).select("id", "body", "task").join(order_, "task").select("id", "body", F.col("next").alias("task")).join(heads, "task").select("id", "body", "following")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [compared(Hashed(a), Hashed(b)) for a, b in zip(common.strings(batch.column(1)), common.strings(batch.column(2)))]
            columns = list(zip(*found)) if found else [[] for _ in TYPES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, TYPES))], names=["id", *(f.split()[0] for f in FIELDS.split(", "))])

    ends = tails.mapInArrow(last, f"id {kind}, {FIELDS}")
    return done.select(*ends.columns).unionByName(ends).withColumnRenamed("id", id)


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return neighbours(common.table(spark, sf_dir, "documents"))
