"""Connected components of a table of links by alternating star contraction.

Each round is two joins and two aggregations with partial minima; no
neighbourhood is ever gathered in one place, and a hub's rows can be split by
skew handling since every join is a plain one. Rounds are cut by reliable
checkpoints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common


def _both(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l")).select("l.a", "l.b")


def _apart(node: str) -> Column:
    """A node's number, in the row of its minimum ``m``, as an expression by which rows are not yet dealt out.

    The minima then get an exchange of their own, so both sides of the join are
    plain exchanges and skew handling may split a hub's rows.
    """
    return F.greatest(node, F.least(node, "m"))


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of a link; component is the smallest node that can be reached.

    Links are undirected; loops, nulls and repeated links are allowed and add
    nothing. Nodes are integers.
    """
    e = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col("a") != F.col("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    e, before = common.cut(e.distinct()), None
    # Few links need few files; the rounds only ever have fewer.
    parts = common.files_for(e)
    for _ in range(max_rounds):
        # Large star: each node's larger neighbours are linked to the smallest node around it.
        both = _both(e)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(_apart("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = common.cut(large.where(F.col("a") != F.col("b")).distinct(), parts)
        # Small star: each node and its smaller neighbours are linked to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(_apart("a").alias("u"), "m")
        small = large.join(least, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l")).select("l.a", "l.b")
        e = common.cut(small.where(F.col("a") != F.col("b")).distinct(), parts)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components didn't settle")
    roots = e.select("b").distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("b", "b"))
