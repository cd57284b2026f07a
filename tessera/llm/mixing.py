"""Mixing sources to target weights with hash-threshold histograms.

A source takes a whole number of passes over all its documents plus, for what
is left of its target, the documents whose hash lies under a threshold. The
threshold is found without sorting: tokens are summed by source and hash
bucket, the bucket in which the budget runs out is found, and only this
boundary bucket is split further, digit by digit. Every pass is one aggregation
with partial sums before the shuffle, of at most ``sources x 4096`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

#: Hexadecimal digits of the hash that one histogram resolves, digits of the hash of id and text, and digits that tell equal rows apart.
STEP, DIGITS, APART = 3, 15, 12
CAP = 3.0
#: The driver holds one row a source while it shares out the targets.
MAX_SOURCES = 100_000


def word_count(text: str) -> Column:
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(common.WORD)), F.lit(0)).cast("long")


def share(sizes: list[tuple[str | None, int]], cap: float = CAP) -> dict[str | None, float]:
    """Targets of (source, size) pairs.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the
    sum of all sizes. No target exceeds ``cap`` times its source's size; the
    excess goes to the others by weight, again and again.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8")))
    weight = {name: i % 3 + 1 for i, (name, _) in enumerate(order)}
    size, left, target = dict(order), float(sum(n for _, n in order)), {}
    free = [name for name, _ in order]
    while free:
        total = sum(weight[x] for x in free)
        full = [x for x in free if left * weight[x] / total > cap * size[x]]
        if not full:
            target |= {x: left * weight[x] / total for x in free}
            break
        target |= {x: cap * size[x] for x in full}
        left -= sum(target[x] for x in full)
        free = [x for x in free if x not in target]
    return target


def mix(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", cap: float = CAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, source, size, source_size, target, taken, copies): how often the mix takes each row, and the words that it takes, repeats counted; and the columns ``keep``.

    The threshold is on a hash of id and text (nulls count as empty), so reruns
    take the same documents. Rows equal in both are interchangeable; a
    random number tells them apart where the threshold falls among them, so
    that as many of them go in as fit. So the words that a source takes differ from
    its target by half a document at most. Sources without a word have target 0.
    """
    hash_ = F.substring(F.md5(F.concat_ws(" ", F.coalesce(F.col(id).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit("")))), 1, DIGITS)
    apart = F.substring(F.md5(F.monotonically_increasing_id().cast("string")), 1, APART)
    own = [F.col(id).alias("__id"), F.col(source).cast("string").alias("__src"), word_count(text).alias("__size"), F.concat(hash_, apart).alias("__h")]
    docs = common.cut(df.select(*own, *keep))  # kept as it is from here on, random numbers too
    sums = docs.groupBy("__src").agg(F.sum("__size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = [(r["__src"], r["size"]) for r in sums]
    targets = share(sizes, cap)
    spark = df.sparkSession
    passes = {name: int(targets[name] // n) if n else 0 for name, n in sizes}
    state = spark.createDataFrame([(name, "", float(targets[name] - passes[name] * n)) for name, n in sizes], "src string, prefix string, budget double")
    # One threshold a source: hashes under it are taken. Refine the boundary bucket STEP digits at a time, until it has one document.
    edges: dict[str | None, tuple[str, bool]] = {}
    for at in range(0, DIGITS + APART, STEP):
        inside = docs.join(F.broadcast(state), F.col("__src").eqNullSafe(F.col("src")) & F.col("__h").startswith(F.col("prefix")))
        histogram = inside.groupBy("src", "prefix", "budget", F.substring("__h", at + 1, STEP).alias("digit")).agg(F.sum("__size").alias("size"), F.sum((F.col("__size") > 0).cast("long")).alias("n"))
        running = F.sum("size").over(Window.partitionBy("src").orderBy("digit"))
        boundary = (
            histogram.withColumn("upto", running)
            .where(F.col("upto") > F.col("budget"))
            .groupBy("src", "prefix", "budget")
            .agg(F.min(F.struct("digit", "upto", "size", "n")).alias("b"))
            .select("src", F.concat("prefix", "b.digit").alias("prefix"), (F.col("budget") - F.col("b.upto") + F.col("b.size")).alias("budget"), F.col("b.size").alias("last"), F.col("b.n").alias("n"))
        )
        rows = boundary.collect()  # one row a source at most, of which there are at most MAX_SOURCES
        # What is at the boundary goes in if that comes nearer to the budget; a source without a boundary takes no more.
        edges |= {r.src: (r.prefix, bool(r.last - r.budget < r.budget)) for r in rows}
        rows = [r for r in rows if r.n > 1]
        if not rows:
            break
        state = spark.createDataFrame([(r.src, r.prefix, r.budget) for r in rows], "src string, prefix string, budget double")
    known = spark.createDataFrame([(name, n, float(targets[name]), passes[name], *edges.get(name, ("", False))) for name, n in sizes], "src string, source_size long, target double, passes long, edge string, with_edge boolean")
    joined = docs.join(F.broadcast(known), F.col("__src").eqNullSafe(F.col("src")))
    more = F.when(F.col("edge") == "", F.lit(0)).when((F.col("__h") < F.col("edge")) | (F.col("with_edge") & F.col("__h").startswith(F.col("edge"))), 1).otherwise(0)
    copies = F.col("passes") + more
    result = {id: F.col("__id"), source: F.col("__src"), "size": F.col("__size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": F.col("__size") * copies, "copies": copies.cast("int")}
    return joined.select(*(c.alias(name) for name, c in result.items()), *(docs[c] for c in keep if c not in result))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 1, 2, 3, repeating."""
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')), 1, 15) AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
r AS (  -- the sources that reach the limit of 3 sizes first come first
  SELECT *, (SELECT sum(source_size) FROM s) AS total,
         coalesce(sum(source_size) OVER w, 0) AS size_before, coalesce(sum(weight) OVER w, 0) AS weight_before,
         sum(weight) OVER () AS weights
  FROM s WINDOW w AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (
  SELECT *, total - 3.0::DOUBLE * size_before AS rest, weights - weight_before AS free FROM r),
t AS (
  SELECT source, source_size, weight, 3.0::DOUBLE * source_size < rest * weight / free AS full_, rest, free
  FROM c),
l AS (SELECT rest, free FROM t WHERE NOT full_ ORDER BY source_size / weight, source IS NULL, source LIMIT 1),
g AS (
  SELECT t.source, t.source_size, CASE WHEN full_ THEN 3.0::DOUBLE * source_size
         ELSE l.rest * t.weight / l.free END AS target
  FROM t LEFT JOIN l ON true),
b AS (
  SELECT source, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS passes FROM g),
k AS (  -- rows of one hash are equal; they are numbered
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, size > 0 DESC, n ROWS UNBOUNDED PRECEDING) AS upto
  FROM (SELECT *, row_number() OVER (PARTITION BY source, h) AS n FROM d)),
e AS (
  SELECT k.doc_id, k.size, b.source_size, b.target, b.passes,
         upto <= target - passes * source_size
         OR (upto - size <= target - passes * source_size
             AND upto - (target - passes * source_size) < (target - passes * source_size) - (upto - size)) AS more,
         bool_or(upto > target - passes * source_size) OVER (PARTITION BY k.source) AS bounded
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(size * (passes + CASE WHEN more AND bounded THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e
"""
