"""How filters act on each other, over all orders in which they may be applied.

Five filters have 2^5 subsets. A document that meets filter f after the filters
of subset S lies on the lattice edge (S, f), of which there are 5 x 16 = 80. Documents
are first counted by part, failing filters and labels, so that at most some hundred
rows a part are spread over the 80 edges. An order of the filters is a path of five
edges up the lattice: the aggregated edges are joined to the 600 steps of all 120 orders.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
#: Parts that one group of equal texts is dealt over.
SALTS = 64


def _bit(f: int) -> int:
    return 1 << f


def edges() -> list[tuple[int, int]]:
    """(subset as a bit mask, filter) of all 80 edges."""
    return [(s, f) for f in range(len(FILTERS)) for s in range(1 << len(FILTERS)) if not s & _bit(f)]


def paths() -> list[tuple[str, int, int, int]]:
    """(order, step, subset, filter) of all 600 steps."""
    out = []
    for order in permutations(range(len(FILTERS))):
        subset = 0
        for step, f in enumerate(order):
            out.append(("".join(FILTERS[k] for k in order), step + 1, subset, f))
            subset |= _bit(f)
    return out


def text_failures(t: Column) -> tuple[Column, Column]:
    """(words of a text, a function of them and the text as bits of the filters A to D that it fails), in two steps, so that words are split once."""
    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size("__words"), F.size(F.array_distinct("__words"))
    tests = [
        n < MIN_WORDS,
        100 * distinct < DISTINCT_PERCENT * n,
        100 * F.regexp_count("__text", F.lit("[A-Z]")) > CAPITAL_PERCENT * F.length("__text"),
        F.col("__text").rlike(r"[#$%&*|]"),
    ]
    mask = tests[0].cast("int")
    for k, test in enumerate(tests[1:], 1):
        mask = mask + test.cast("int") * _bit(k)
    return words, mask


def signatures(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): documents by source, failing filters and labels.

    Null texts are empty, null sources are the part ''. Filter E fails where a smaller
    id has the same text anywhere in the table; a row without an id neither fails it nor makes others fail, and
    of equal rows none makes the other fail. A document is good (toxic) if any
    label of its id says so; ids without labels are neither.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = docs.select(F.col(id).cast("long").alias("__id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__part"), t.alias("__text"))
    words, mask = text_failures(F.col("__text"))
    rows = own.withColumn("__words", words).select("__id", "__part", F.unhex(F.sha2("__text", 256)).alias("key"), mask.alias("m"))
    # Equal rows are one row with a count from here on, and texts are their digests.
    rows = common.cut(rows.groupBy("__id", "__part", "key", "m").agg(F.count("*").alias("n")))
    # The least id of each text: first of each of its SALTS parts, then of these, then back to the parts, so that no part holds all copies of a text.
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int"))
    least = rows.where("__id IS NOT NULL").groupBy("key", "salt").agg(F.min("__id").alias("first"))
    first = least.groupBy("key").agg(F.min("first").alias("first"), F.collect_list("salt").alias("salts")).select("key", F.explode("salts").alias("salt"), "first")  # at most SALTS a key
    found = rows.join(first, ["key", "salt"], "left").select("__id", "__part", "key", "n", (F.col("m") + F.coalesce((F.col("__id") > F.col("first")).cast("int"), F.lit(0)) * _bit(4)).alias("mask"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("lid")).agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    # Rows without an id meet no label; they are dealt out by their text instead of all into one partition.
    has, at = F.col("__id").isNotNull(), F.coalesce("__id", F.xxhash64("key"))
    labelled = found.withColumns({"has": has, "at": at}).join(known.withColumn("lhas", F.lit(True)), (F.col("at") == F.col("lid")) & (F.col("has") == F.col("lhas")), "left")
    return labelled.groupBy(F.col("__part").alias("part"), "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.sum("n").alias("n"))


def edge_counts(counted: DataFrame) -> DataFrame:
    """(part, subset, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost) of all 80 edges of each part in (part, mask, good, toxic, n)."""
    every = F.array(*(F.struct(F.lit(s).alias("subset"), F.lit(f).alias("filter"), F.lit(_bit(f)).alias("bit")) for s, f in edges()))
    at = counted.select("*", F.explode(every).alias("e")).select("part", "mask", "good", "toxic", "n", "e.subset", "e.filter", "e.bit")
    alive, fails = F.col("mask").bitwiseAND(F.col("subset")) == 0, F.col("mask").bitwiseAND(F.col("bit")) != 0
    of = lambda test: F.sum(F.when(test, F.col("n")).otherwise(F.lit(0))).cast("long")
    return at.groupBy("part", "subset", "filter").agg(
        of(alive & ~fails).alias("kept"), of(alive & fails).alias("removed"), of(~alive & fails).alias("redundant"), of(F.col("mask") == F.col("bit")).alias("unique_fails"),
        of(alive & fails & (F.col("good") == 1)).alias("good_lost"), of(alive & fails & (F.col("toxic") == 1)).alias("toxic_lost"),
    )


def audit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part; none for an empty table.

    See ``signatures`` for nulls and repeated rows. ``shapley`` is the sum, over all orders, of what the step's filter removes.
    """
    spark = docs.sparkSession
    steps = spark.createDataFrame(paths(), "filter_order string, step int, subset int, filter int")
    counted = edge_counts(signatures(docs, labels, id, text, source))
    weights = steps.groupBy("subset", "filter").agg(F.count("*").alias("orders"))
    weighted = counted.join(F.broadcast(weights), ["subset", "filter"])  # 80 rows
    total = F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "filter"))
    out = weighted.withColumn("shapley", total.cast("long")).join(F.broadcast(steps), ["subset", "filter"])  # 600 rows
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders over all documents, by source."""
    return audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT part, doc_id,
         [len(w) < 200,
          100 * len(list_distinct(w)) < 50 * len(w),
          100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
          regexp_matches(text, '[#$%&*|]'),
          coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS bad
  FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
g AS (
  SELECT part, bad, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM f LEFT JOIN l ON l.doc_id = f.doc_id GROUP BY ALL),
o(s) AS (  -- orders grow by a letter that they lack
  SELECT '' UNION ALL SELECT s || c FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) x WHERE length(s) < 5 AND NOT contains(s, c)),
p AS (
  SELECT s AS filter_order, step::INT AS step, ascii(s[step]) - 64 AS k,
         list_transform(range(1, step), lambda q: ascii(s[q]) - 64) AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step) y WHERE length(s) = 5),
r AS (
  SELECT g.*, p.*, bad[k] AS fails, len(list_filter(before, lambda q: bad[q])) > 0 AS gone FROM g, p),
a AS (
  SELECT part, filter_order, step, k,
         sum(n) FILTER (WHERE NOT gone AND NOT fails) AS kept, sum(n) FILTER (WHERE NOT gone AND fails) AS removed,
         sum(n) FILTER (WHERE gone AND fails) AS redundant,
         sum(n) FILTER (WHERE fails AND len(list_filter(bad, lambda q: q)) = 1) AS unique_fails,
         sum(n) FILTER (WHERE NOT gone AND fails AND good) AS good_lost, sum(n) FILTER (WHERE NOT gone AND fails AND toxic) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, k)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, k), 0)::BIGINT AS shapley
FROM a
"""
