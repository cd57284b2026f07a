"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One word of a text: a run of bytes other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that go to a Python worker at once. Texts may be long, and each batch is held a few times over, in Arrow and as Python strings.
BATCH_ROWS = 1000
#: Bytes of such a batch in the pipeline, whose stages share their executors' memory.
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; from here on the session sends texts to Python in batches of at most BATCH_ROWS rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """From here on the session's batches for Python end at about BATCH_BYTES too, so that what Spark and a worker hold of one doesn't follow the texts' lengths."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = spark.conf.get(key).rstrip("b")
    if not bound.isdigit() or int(bound) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints and tables; one of this machine's only in a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return folder or tempfile.mkdtemp(prefix="tessera-")


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the session names, of ``parts`` files at most.

    A folder of this process's own is used only where ``spark.checkpoint.dir``
    is unset and the session is local, as in tests on one machine.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return (df.coalesce(parts) if parts else df).checkpoint(eager=True)


def files_for(df: DataFrame) -> int:
    """How many checkpoint files a frame of about as many rows as this (checkpointed) one needs, up to the shuffle partitions."""
    return min(shuffle_partitions(df.sparkSession), 6 + df.count() // 100_000)


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(modulus))


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null gives the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """A string column as Python strings; null gives the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def slices(lengths: list[int], budget: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose lengths add up to about ``budget``; each has one row at least."""
    begin = total = 0
    for i, n in enumerate(lengths):
        if i > begin and total + n > budget:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def prefix_sums(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """``df`` with, for each column in ``sums``, ``before_<column>``: its sum over all rows that come before in a total order.

    Rows are dealt out by ranges of the order and summed within each; the totals of
    the ranges, one row a partition, are summed apart and broadcast. The ranges are drawn
    from a sample, so they are fixed by a checkpoint before they are counted.
    """
    ranged = cut(df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).withColumn("__range", F.spark_partition_id()))
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__range").agg(*(F.sum(c).alias(c) for c in sums))
    offsets = totals.select("__range", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"__{c}") for c in sums))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.join(F.broadcast(offsets), "__range")
    return found.select(*df.columns, *((F.col(f"__{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"before_{c}") for c in sums))
