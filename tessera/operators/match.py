"""Correspondences: validation, spatial sampling and descriptor matching."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid(w0: Column, h0: Column, w1: Column, h1: Column) -> Column:
    """Whether both points are finite and inside their images and the score, if any, is finite."""
    inside = lambda c, top: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.col(c) >= 0) & (F.col(c) < top)
    score = F.col("score").cast("double")
    finite = F.col("score").isNull() | (~F.isnan(score) & (F.abs(score) < float("inf")))
    return inside("x0", w0) & inside("y0", h0) & inside("x1", w1) & inside("y1", h1) & finite


def validate(matches: DataFrame, width: int, height: int) -> DataFrame:
    """The valid rows of ``correspondences``."""
    w, h = F.lit(width), F.lit(height)
    return matches.where(valid(w, h, w, h))


def discarded(matches: DataFrame, width: int, height: int) -> DataFrame:
    """(pair_id, kept, discarded)."""
    w, h = F.lit(width), F.lit(height)
    ok = valid(w, h, w, h)
    return matches.groupBy("pair_id").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("discarded"))


def spatial_sample(matches: DataFrame, width: int, height: int, budget: int, cells: int = 8) -> DataFrame:
    """Up to ``budget`` rows a pair, dealt round-robin over the cells of the first image, the best scores of each cell first; adds ``pos``."""
    cell = F.least(F.floor(F.col("y0") * cells / float(height)), F.lit(cells - 1)) * cells + F.least(F.floor(F.col("x0") * cells / float(width)), F.lit(cells - 1))
    depth = F.row_number().over(Window.partitionBy("pair_id", "cell").orderBy(F.desc("score"), "k", "x0", "y0", "x1", "y1"))
    pos = F.row_number().over(Window.partitionBy("pair_id").orderBy("depth", "cell"))
    return matches.withColumn("cell", cell).withColumn("depth", depth).withColumn("pos", pos).where(F.col("pos") <= budget).drop("cell", "depth")


#: Left rows that meet a block at once, and what rounding may shift a squared distance by, relative to the norms.
ROWS, SLACK = 512, 1e-12
_BEST = "kp0 bigint, kp1 bigint, distance double"


def two_nearest(queries: np.ndarray, block: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a query, id, distance) of the two nearest rows of a block, the least id of equals.

    One matrix product for many queries narrows each down to the rows that rounding could
    place among the two; their distances are then summed up exactly as differences.
    """
    rows, found, far = [], [], []
    b2 = (block * block).sum(1)
    for at in range(0, len(queries), ROWS):
        q = queries[at : at + ROWS]
        q2 = (q * q).sum(1)
        d2 = q2[:, None] + b2[None] - 2 * q @ block.T
        second = np.partition(d2, min(1, len(block) - 1), axis=1)[:, min(1, len(block) - 1)]
        i, j = np.nonzero(d2 <= (second + SLACK * (q2 + b2.max()))[:, None])
        exact = np.sqrt(((q[i] - block[j]) ** 2).sum(1))
        order = np.lexsort((ids[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        rows.append(at + i[place < 2]), found.append(ids[j[place < 2]]), far.append(exact[place < 2])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(far)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def knn_ratio(left: DataFrame, right: DataFrame, ratio: float, block: int = 16_384) -> DataFrame:
    """(kp0, kp1, distance) of left keypoints whose nearest right descriptor is nearer than ``ratio`` times the second (or is the only one).

    Exact. Right descriptors are dealt into blocks of about ``block`` rows and left ones
    into as large groups; each group meets each block in a task of its own, which
    returns the two best of the block, so no pair of rows is ever made. Rows with a null id or descriptor take no part.
    """
    sides = [x.where("kp_id IS NOT NULL AND descriptor IS NOT NULL") for x in (left, right)]
    groups, blocks = (max(1, -(-x.count() // block)) for x in sides)
    deal = lambda x, n: F.pmod(F.xxhash64("kp_id"), F.lit(n)).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = sides[0].select(deal("kp_id", groups).alias("g"), other(blocks).alias("b"), F.lit(0).alias("side"), F.col("kp_id").cast("long").alias("id"), "descriptor")
    r = sides[1].select(other(groups).alias("g"), deal("kp_id", blocks).alias("b"), F.lit(1).alias("side"), F.col("kp_id").cast("long").alias("id"), "descriptor")

    def nearest(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids, rows = table.column("id").to_numpy(), table.column("descriptor").combine_chunks()
        own, there = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(own) or not len(there):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["kp0", "kp1", "distance"])
        at, found, far = two_nearest(_matrix(rows.take(pa.array(own))), _matrix(rows.take(pa.array(there))), ids[there])
        return pa.table([pa.array(ids[own][at]), pa.array(found), pa.array(far)], names=["kp0", "kp1", "distance"])

    found = q.unionByName(r).groupBy("g", "b").applyInArrow(nearest, _BEST)
    n = F.array_sort(F.collect_list(F.struct("distance", "kp1")))  # two rows a block
    best = found.groupBy("kp0").agg(n.alias("n"))
    first, second = F.col("n")[0], F.get("n", F.lit(1))
    return best.where(second.isNull() | (first["distance"] < ratio * second["distance"])).select("kp0", first["kp1"].alias("kp1"), first["distance"].alias("distance"))


def mutual(matches: DataFrame, score: str = "score") -> DataFrame:
    """(kp0, kp1, score) pairs that are each other's best."""
    a = Window.partitionBy("kp0").orderBy(F.desc(score), "kp1")
    b = Window.partitionBy("kp1").orderBy(F.desc(score), "kp0")
    return matches.withColumn("ra", F.row_number().over(a)).withColumn("rb", F.row_number().over(b)).where("ra = 1 AND rb = 1").drop("ra", "rb")


def top_keypoints(features: DataFrame, k: int, by: str = "tile_id") -> DataFrame:
    """The k best keypoints of each tile."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "kp")
    return features.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


#: Fixed value: the colour (red, green, blue) of matches without a score.
PLAIN = (80, 180, 255)


def drawn(matches: DataFrame, limit: int = 2000, seed: int = 0, key: str = "pair_id", id: str = "k", score: str | None = "score") -> DataFrame:
    """``matches`` as they are drawn: at most ``limit`` a pair, with ``strength`` and a colour (red, green, blue) from red for the pair's least score to green for its greatest.

    The sample goes by a seeded hash of pair and match, so it is the same in each run and is cut before the shuffle; scores are
    scaled by all of a pair's matches, not by those drawn. Equal scores have strength 1; without scores (``None``, or all of a pair null) strength is null and the colour plain.
    A match without a score among others that have one counts as the least.
    """
    chance = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string"), F.col(id).cast("string")))
    order = Window.partitionBy(key).orderBy("__chance", id)
    chosen = matches.withColumn("__chance", chance).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit).drop("__chance", "__n")
    value = F.lit(None).cast("double") if score is None else F.col(score).cast("double")
    span = matches.groupBy(F.col(key).alias("__key")).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    width = F.col("__high") - F.col("__low")
    strength = F.when(F.col("__low").isNull(), F.lit(None)).when(width < 1e-6, F.lit(1.0)).otherwise((F.coalesce(value, F.col("__low")) - F.col("__low")) / width)
    green = F.floor(255 * F.col("strength")).cast("int")
    colour = lambda c, scored: F.when(F.col("strength").isNull(), F.lit(PLAIN[c])).otherwise(scored).cast("int")
    out = chosen.join(span, F.col(key).eqNullSafe(F.col("__key"))).withColumn("strength", strength)
    return out.drop("__key", "__low", "__high").withColumns({"red": colour(0, 255 - green), "green": colour(1, green), "blue": colour(2, F.lit(0))})
