"""Contiguous shards of nearly equal bytes, from global prefix sums.

Rows stand in one order: by id (nulls last), then size, then checksum. Each
partition of a range of that order sums its rows' sizes; the totals of the
partitions, summed in their order, give each row the bytes before it in the
whole table. The bytes are cut at equal targets, and a row goes where its middle
byte lies. So each shard is a range of the order, and its bytes differ from the target by one
row's size at most. Texts are read once and never shuffled: only their sizes and checksums are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

SHARDS, HEADER = 40, 16
#: What a row is ordered by. Rows equal up to the last are interchangeable; it only spreads them.
ORDER = ("no_id", "id", "size", "text_crc32", "tie")


def _keys(id: str, text: str) -> list[Column]:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = F.col(id).cast("long")
    return [c.alias(name) for c, name in zip((own.isNull(), F.coalesce(own, F.lit(0)), (F.octet_length(t) + HEADER).cast("long"), F.crc32(t), F.monotonically_increasing_id()), ORDER)]


def _placed(df: DataFrame, shards: int, id: str, text: str) -> DataFrame:
    """The keys of each row, its shard, and the rows before it."""
    rows = common.cut(df.select(*_keys(id, text), F.lit(1).cast("long").alias("n")))
    total = rows.agg(F.sum("size")).first()[0] or 1
    summed = common.prefix_sums(rows, [F.col(c) for c in ORDER], ["size", "n"])
    at = F.expr(f"(2 * before_size + size) * {shards} DIV {2 * total}")  # whole numbers, good for 50 PB
    return summed.withColumn("shard", F.least(F.lit(shards - 1), at).cast("int"))


def assign(df: DataFrame, shards: int = SHARDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot): the shard of each row and its place in it, from 0 without gaps.

    A size is the UTF-8 bytes of the text (null: none) and a header of 16, so every row counts
    for something. Null ids come last; rows equal in id, size and checksum are
    interchangeable and may be cut apart, so a text that a third of the rows hold is no obstacle. Reruns agree. An empty table has no rows;
    with fewer rows than shards some shards are empty.
    """
    placed = _placed(df, shards, id, text)
    first = placed.groupBy("shard").agg(F.min("before_n").alias("first"))  # a row a shard
    out = placed.join(F.broadcast(first), "shard")
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias(id), "size", "text_crc32", "shard", (F.col("before_n") - F.col("first")).alias("slot"))


def write(df: DataFrame, path: str, shards: int = SHARDS, id: str = "doc_id", text: str = "text") -> None:
    """Write all columns of ``df`` to folders ``shard=0`` and so on under ``path``, each in the order of the slots.

    The shards are ranges of the order, so a row's shard follows from the least keys of all shards (that
    many rows, on the driver), without a join. Rows that are equal may go to another shard than
    ``assign`` says where ``df`` gives its rows in another order each time; none is lost.
    """
    least = _placed(df, shards, id, text).groupBy("shard").agg(F.min(F.struct(*ORDER)).alias("k")).orderBy("shard").collect()
    keyed = df.select("*", F.struct(*_keys(id, text)).alias("__key"))
    bound = lambda k: F.struct(*(F.lit(k[c]).cast("boolean" if c == "no_id" else "long").alias(c) for c in ORDER))
    shard = reduce(lambda found, r: F.when(F.col("__key") >= bound(r["k"]), F.lit(r["shard"])).otherwise(found), least[1:], F.lit(least[0]["shard"] if least else 0))
    parts = max(shards, common.shuffle_partitions(df.sparkSession))
    dealt = keyed.withColumn("shard", shard).repartitionByRange(parts, "shard", "__key").sortWithinPartitions("shard", "__key")
    dealt.drop("__key").write.partitionBy("shard").parquet(path)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    found = assign(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP13_SQL = r"""
WITH tab AS (  -- the table of CRC-32 for one byte
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS n) b) z),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, coalesce(text, '') AS text FROM documents),
e AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
         lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc
  FROM d, tab),
s AS (
  SELECT *, sum(size) OVER () AS total,
         sum(size) OVER (ORDER BY doc_id NULLS LAST, size, crc ROWS UNBOUNDED PRECEDING) AS upto,
         row_number() OVER (ORDER BY doc_id NULLS LAST, size, crc) AS n
  FROM e),
p AS (SELECT *, least(39, ((2 * upto - size) * 40) // (2 * total)) AS shard FROM s)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard,
       CAST(n - min(n) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM p
"""
