"""Components, spanning forests and propagation over overlap graphs.

Graphs of any size go through distributed rounds (star contraction, Boruvka,
list ranking) whose lineage is cut by reliable checkpoints in the shared folder
that the session names. Rounds start from what each partition can settle by
itself, so a few are enough for mosaics whose neighbours lie near each other.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import layout

#: Rows that a checkpoint file holds at least, if there are more than six files.
ROWS_A_FILE = 100_000


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the session names.

    Where ``spark.checkpoint.dir`` is unset, a local session takes a folder of its
    own, as in tests; on a cluster that would lose data with its machine, so it is refused.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    return (df.coalesce(parts) if parts else df).checkpoint(eager=True)


def kept(df: DataFrame, parts: int) -> DataFrame:
    """``df`` written as a table into the shared folder and read again, for rounds that join a frame with itself.

    A checkpoint keeps the estimated size of its plan, and a join's is the product of its sides': its digits double each round, until planning
    takes longer than the work. A table's size is that of its files.
    """
    session = df.sparkSession
    folder = session.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not session.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="tessera-")
    path = f"{folder}/round-{uuid.uuid4().hex}"
    df.coalesce(parts).write.parquet(path)
    return session.read.schema(df.schema).parquet(path)


def _both(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l")).select("l.a", "l.b")


def labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least of ``n`` nodes that links (i, j) join each node to."""
    label = np.arange(n)
    while len(i):
        # Every label goes down to the least label across its links, then to its own label's label.
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        while (new[new] != new).any():
            new = new[new]
        label = new[label]
        if (label[i] == label[j]).all():
            break
    return label


def local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of each batch as links of its nodes to the least node that the batch connects them with."""
    for batch in batches:
        a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        nodes, at = np.unique(np.r_[a, b], return_inverse=True)
        label = labels(len(nodes), at[: len(a)], at[len(a) :])
        moved = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["a", "b"])


def _whole(of_batches):
    """The same function over each partition as one batch; for partitions of about ROWS_A_FILE rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := list(batches):
            yield from of_batches(iter(pa.Table.from_batches(found).combine_chunks().to_batches()))

    return run


def local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (i, j, w, ci, cj) of each batch that are in the maximum spanning forest of its nodes ci, cj. No other edge of it can be in that of the whole."""
    for batch in batches:
        i, j, w, ci, cj = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        order = np.lexsort((j, i, -w))
        nodes, at = np.unique(np.r_[ci, cj], return_inverse=True)
        a, b = at[: len(i)][order], at[len(i) :][order]
        label, keep, alive = np.arange(len(nodes)), np.zeros(len(i), bool), np.arange(len(i))
        while len(alive := alive[label[a[alive]] != label[b[alive]]]):
            best = np.full(len(nodes), len(i))
            np.minimum.at(best, label[a[alive]], alive)
            np.minimum.at(best, label[b[alive]], alive)
            picks = np.unique(best[best < len(i)])
            keep[picks] = True
            label = labels(len(nodes), label[a[picks]], label[b[picks]])[label]
        yield batch.take(pa.array(np.sort(order[keep])))


def _settled(links: DataFrame) -> bool:
    """Whether the links (a, b) are stars already: no node has two targets or is both a source and a target."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("b").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("in")))).alias("e")).select("e.*")
    return ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 OR (out = 1 AND in = 1)").isEmpty()


def components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """(tile_id, component): the smallest tile that edges (i, j) reach; ``nodes`` (tile_id) adds tiles without an edge.

    Links are first replaced by stars in each batch of rows, then in each of as many partitions as
    their number asks for; if that is one, they are settled. Else large-star and
    small-star rounds follow: each is two joins and two aggregations with partial
    minima, and one checkpoint. Minima have an exchange of their own, by an
    expression that rows aren't dealt out by yet, so skew handling may split a hub's rows.
    """
    apart = lambda node: F.greatest(node, F.least(node, "m"))
    links = edges.select(F.greatest("i", "j").cast("long").alias("a"), F.least("i", "j").cast("long").alias("b")).where("a <> b")
    e = cut(links.mapInArrow(local_stars, "a bigint, b bigint").distinct())
    parts = 1 + (found := e.count()) // ROWS_A_FILE
    if found:
        e = cut(e.coalesce(parts).mapInArrow(_whole(local_stars), "a bigint, b bigint"))
    for _ in range(max_rounds):
        if parts == 1 or _settled(e):
            break
        both = _both(e)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(apart("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(apart("a").alias("u"), "m")
        small = large.join(least, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l")).select("l.a", "l.b")
        e = cut(small.where("a <> b").distinct(), parts)
    else:
        raise RuntimeError("the components didn't settle")
    named = e.select(F.col("a").alias("tile_id"), F.col("b").alias("component")).union(e.select("b").distinct().select("b", "b"))
    if nodes is None:
        return named
    return nodes.select("tile_id").join(named, "tile_id", "left").select("tile_id", F.coalesce("component", "tile_id").alias("component"))


def spanning_forest(edges: DataFrame, weight: str = "inliers", max_rounds: int = 40) -> DataFrame:
    """The maximum spanning forest of (i, j, weight): Boruvka rounds in which each component takes its best edge.

    Edges are ordered by weight, then the least i, then the least j, a total
    order, so the forest is the one that Kruskal's algorithm finds. Each partition first
    drops the edges that aren't in its own forest. A round's picks join the labels of the round before, so
    only labels that are left are named anew; once one partition holds all edges that are left, its own forest ends the rounds.
    """
    schema = "i bigint, j bigint, w double, ci bigint, cj bigint"
    own = [F.col(c).cast("long").alias(n) for c, n in (("i", "i"), ("j", "j"), ("i", "ci"), ("j", "cj"))]
    kind = edges.schema[weight].dataType
    rest = edges.where("i <> j").select(own[0], own[1], F.col(weight).cast("double").alias("w"), own[2], own[3])
    chosen = []
    for _ in range(max_rounds):
        rest = cut(rest.mapInArrow(_whole(local_forest), schema))
        parts = 1 + rest.count() // ROWS_A_FILE
        if parts == 1:
            chosen.append(cut(rest.coalesce(1).mapInArrow(_whole(local_forest), schema).select("i", "j", "w")))
            break
        key = F.struct((-F.col("w")).alias("n"), "i", "j", "ci", "cj")
        ends = rest.select(F.explode(F.array("ci", "cj")).alias("c"), key.alias("k"))
        picks = cut(ends.groupBy("c").agg(F.min("k").alias("k")).select("k.i", "k.j", (-F.col("k.n")).alias("w"), "k.ci", "k.cj").distinct(), parts)
        chosen.append(picks.select("i", "j", "w"))
        names = components(picks.select(F.col("ci").alias("i"), F.col("cj").alias("j")))
        a, b = names.select(F.col("tile_id").alias("ci"), F.col("component").alias("na")), names.select(F.col("tile_id").alias("cj"), F.col("component").alias("nb"))
        moved = rest.join(a, "ci").join(b, "cj").where("na <> nb").select("i", "j", "w", F.col("na").alias("ci"), F.col("nb").alias("cj"))
        rest = moved.coalesce(parts)
    else:
        raise RuntimeError("the forest didn't settle")
    return reduce(DataFrame.union, chosen).select("i", "j", F.col("w").cast(kind).alias(weight))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the place of each row, from 1 on, in a total order: counted within ranges, whose offsets are one row a partition."""
    ranged = cut(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("__range", F.spark_partition_id()))
    before = F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranged.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "__range").withColumn(name, (F.col("__before") + place).cast("long")).drop("__range", "__before")


def ranked_groups(named: DataFrame, edges: DataFrame, weight: str = "inliers") -> DataFrame:
    """(component, size, weight, rank): groups by size, then weight of their edges, then least tile."""
    sizes = named.groupBy("component").agg(F.count("*").alias("size"))
    sums = edges.join(named.select(F.col("tile_id").alias("i"), "component"), "i").groupBy("component").agg(F.sum(weight).alias("weight"))
    groups = sizes.join(sums, "component", "left").select("component", "size", F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))
    return numbered(groups, [F.desc("size"), F.desc("weight"), F.col("component")], "rank").select("component", "size", "weight", "rank")


def largest_group(groups: DataFrame, policy: str = "largest") -> int:
    """The component that a mosaic keeps. ``reject`` wants a single group; a group of one tile is never enough."""
    first = groups.where("rank <= 2").orderBy("rank").collect()
    if not first or first[0]["size"] < 2:
        raise ValueError("no two tiles overlap")
    if policy == "reject" and len(first) > 1:
        raise ValueError("the tiles don't form one group")
    return first[0]["component"]


def excluded(named: DataFrame, groups: DataFrame) -> DataFrame:
    """Tiles outside the first group."""
    return named.join(groups.where("rank = 1").select("component"), "component", "left_anti").select("tile_id", "component")


def chain(edges: DataFrame, group: str = "grid_row") -> DataFrame:
    """(tile_id, x, y) along rows of neighbours: running sums of the steps, the first tile of each row at zero."""
    w = Window.partitionBy(group).orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    return edges.select(group, F.col("j").alias("tile_id"), F.sum("dx").over(w).alias("x"), F.sum("dy").over(w).alias("y"))


def toured(forest: DataFrame, roots: DataFrame) -> DataFrame:
    """(tile_id, parent, x, y) of every tile that a tree of (i, j, dx, dy) joins to a root (tile_id), with its steps summed from the root.

    Each tree is walked around in an Euler tour: after an edge into a tile comes
    the tile's next edge, in the order of its neighbours. The tour is cut
    at the root, and the sums to its end are found by pointer doubling, so the
    rounds grow with the logarithm of a tree's size and not with its depth. A tree
    has one root at most; trees without a root are left out, and so are the roots.
    """
    e = forest.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("dx").cast("double").alias("dx"), F.col("dy").cast("double").alias("dy")).where("i <> j")
    both = cut(e.union(e.select("j", "i", -F.col("dx"), -F.col("dy"))))
    parts = 1 + (edges := both.count()) // ROWS_A_FILE
    around = Window.partitionBy("i").orderBy("j")
    # After (j, i) comes (i, w): w is the neighbour of i after j, and after the last the first, where a root's tour ends.
    turns = both.select("i", "j", F.lead("j").over(around).alias("next"), F.first("j").over(around).alias("first"))
    ends = roots.select(F.col("tile_id").cast("long").alias("i"), F.lit(True).alias("root")).distinct()
    turns = turns.join(ends, "i", "left").withColumn("w", F.coalesce("next", F.when(F.col("root").isNull(), F.col("first"))))
    after = turns.select(F.col("j").alias("u"), F.col("i").alias("v"), F.when(F.col("w").isNotNull(), F.col("i")).alias("nu"), F.col("w").alias("nv"))
    steps = both.select(F.col("i").alias("u"), F.col("j").alias("v"), "dx", "dy")
    tour = kept(after.join(steps, ["u", "v"]).select("u", "v", "nu", "nv", F.lit(1).cast("long").alias("n"), "dx", "dy"), parts)
    more = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    for _ in range(edges.bit_length() + 1):
        if tour.where("nu IS NOT NULL").isEmpty():
            break
        there = tour.toDF("hu", "hv", "mu", "mv", "m", "ex", "ey")
        tour = kept(tour.join(there, (F.col("nu") == F.col("hu")) & (F.col("nv") == F.col("hv")), "left").select("u", "v", F.col("mu").alias("nu"), F.col("mv").alias("nv"), more("n", "m"), more("dx", "ex"), more("dy", "ey")), parts)
    # n counts the edges to the end: an edge leads down if more are left after it than after its return. A
    # tour's steps sum to zero, so those up to an edge are its own less all from it on.
    done = tour.where("nu IS NULL")
    back = done.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("n").alias("back"))
    down = done.join(back, ["u", "v"]).where("n > back").join(steps.withColumnsRenamed({"dx": "sx", "dy": "sy"}), ["u", "v"])
    return cut(down.select(F.col("v").alias("tile_id"), F.col("u").alias("parent"), (F.col("sx") - F.col("dx")).alias("x"), (F.col("sy") - F.col("dy")).alias("y")), parts)


def tree_positions(forest: DataFrame, roots: DataFrame) -> DataFrame:
    """(tile_id, x, y) by walking trees of (i, j, dx, dy) from their roots (tile_id), one a tree."""
    placed = toured(forest, roots).select("tile_id", "x", "y")
    return placed.union(roots.select(F.col("tile_id").cast("long"), F.lit(0.0), F.lit(0.0)))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, second, g h) of rows (first, second, g, h) of 3 x 3 transforms. As columns, products of products would grow in the plans' constraints, which checkpoints keep."""
    for batch in batches:
        g, h = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, 3, 3) for k in (2, 3))
        m = g @ h
        m = m / m[:, 2:, 2:]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(np.arange(0, 9 * len(m) + 1, 9, dtype=np.int32), m.ravel())], names=["tile_id", "to", "h"])


def tree_transforms(forest: DataFrame, roots: DataFrame) -> DataFrame:
    """(tile_id, transform) from each tile's coordinates to its root's, along trees of (i, j, h) whose h (row-major 3 x 3) takes points of j into i's coordinates.

    A product of matrices can't be undone by another path as a sum can, so each tile keeps the product up to an
    ancestor and doubles the way: it takes over its ancestor's product and ancestor, until that is the root. The rounds grow with
    the logarithm of the depth. Transforms have a lower right entry of 1. Trees without a root (tile_id) are left out; a chain is a tree.
    """
    steps = forest.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("h").cast("array<double>").alias("h")).where("i <> j")
    parents = toured(steps.select("i", "j", F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy")), roots).select("tile_id", "parent")
    both = steps.select(F.col("j").alias("tile_id"), F.col("i").alias("parent"), "h").union(steps.select("i", "j", layout.inverse("h")))
    one = F.transform("h", lambda v: v / F.element_at("h", 9))
    ends = roots.select(F.col("tile_id").cast("long").alias("parent"), F.lit(True).alias("end")).distinct()
    stepped = parents.join(both, ["tile_id", "parent"]).join(ends, "parent", "left")
    way = kept(stepped.select("tile_id", F.when(F.col("end").isNull(), F.col("parent")).alias("to"), one.alias("h")), 1 + parents.count() // ROWS_A_FILE)
    parts = 1 + (left := way.count()) // ROWS_A_FILE
    for _ in range(left.bit_length() + 1):
        open_ = way.where("to IS NOT NULL")
        if open_.isEmpty():
            break
        longer = open_.join(way.toDF("to", "further", "g"), "to").select("tile_id", "further", "g", "h").mapInArrow(_products, "tile_id bigint, to bigint, h array<double>")
        way = kept(way.where("to IS NULL").union(longer), parts)
    same = F.array(*(F.lit(float(k % 4 == 0)) for k in range(9)))
    return way.select("tile_id", F.col("h").alias("transform")).union(ends.select("parent", same))


def tree_centre(forest: DataFrame) -> DataFrame:
    """(component, tile_id): the tile of least eccentricity of each tree (the least id of equals).

    Leaves are peeled a level at a time in numpy, so a deep tree costs no more
    jobs; a tree is one group, at some 100 bytes an edge.
    """

    def peel(table: pa.Table) -> pa.Table:
        i, j = table.column("i").to_numpy(), table.column("j").to_numpy()
        nodes, at = np.unique(np.r_[i, j], return_inverse=True)
        a, b = at[: len(i)], at[len(i) :]
        alive, left = np.ones(len(nodes), bool), np.ones(len(a), bool)
        while alive.sum() > 2:
            degree = np.bincount(np.r_[a[left], b[left]], minlength=len(nodes))
            alive &= degree != 1
            left &= alive[a] & alive[b]
        return pa.table([table.column("component").slice(0, 1), pa.array(nodes[alive][:1], pa.int64())], names=["component", "tile_id"])

    edges = forest.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).where("i <> j").distinct()
    named = components(edges).withColumnRenamed("tile_id", "i")
    return edges.join(named, "i").select("component", "i", "j").groupBy("component").applyInArrow(peel, "component bigint, tile_id bigint")
