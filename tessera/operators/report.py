"""Roll-ups over pair and tile relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import numbered

STATUSES = ("accepted", "ambiguous", "failed", "predicted")


def role_rollup(edges: DataFrame, tiles: DataFrame, boundary_rows: list[tuple[int, int]]) -> DataFrame:
    """(role, pairs, accepted): pairs across given pairs of rows are ``boundary``, the rest ``control``."""
    a = tiles.select(F.col("tile_id").alias("i"), F.col("grid_row").alias("ri"))
    b = tiles.select(F.col("tile_id").alias("j"), F.col("grid_row").alias("rj"))
    across = F.lit(False)
    for x, y in boundary_rows:
        across = across | ((F.col("ri") == x) & (F.col("rj") == y)) | ((F.col("ri") == y) & (F.col("rj") == x))
    role = F.when(across, "boundary").otherwise("control")
    return edges.join(a, "i").join(b, "j").groupBy(role.alias("role")).agg(F.count("*").alias("pairs"), F.count_if(F.col("status") == "accepted").alias("accepted"))


def expected_negatives(tiles: DataFrame, columns_apart: int = 10, limit: int = 3) -> DataFrame:
    """The first pairs (i, j) of one row whose tiles lie so many columns apart that they can't overlap."""
    a = tiles.select(F.col("tile_id").alias("i"), "grid_row", F.col("grid_col").alias("ca"))
    b = tiles.select(F.col("tile_id").alias("j"), "grid_row", F.col("grid_col").alias("cb"))
    return a.join(b, "grid_row").where(F.col("cb") - F.col("ca") >= columns_apart).orderBy("i", "j").limit(limit).select("i", "j")


def status_histogram(edges: DataFrame) -> DataFrame:
    """One row with a count for each of the fixed statuses, zeros kept."""
    return edges.agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))


def low_agreement(fits: DataFrame, share: float = 0.15) -> DataFrame:
    """One row: pairs, matches, inliers, and whether some pair keeps less than ``share`` of its matches."""
    return fits.agg(F.count("*").alias("pairs"), F.sum("n").alias("matches"), F.sum("inliers").alias("inliers"), F.bool_or(F.col("inliers") / F.greatest("n", F.lit(1)) < share).alias("low_agreement"))


def landmark_metrics(marks: DataFrame) -> DataFrame:
    """Count, median and 95th percentile of landmark errors; null where there is none."""
    return marks.agg(F.count("*").alias("n"), F.median("error_px").alias("median_px"), F.expr("percentile(error_px, 0.95)").alias("p95_px"))


def row_rollup(tiles: DataFrame, edges: DataFrame) -> DataFrame:
    """(grid_row, tiles, accepted, complete): whether all neighbours within a row are linked."""
    inside = edges.where("axis = 'right' AND status = 'accepted'").join(tiles.select(F.col("tile_id").alias("i"), "grid_row"), "i").groupBy("grid_row").agg(F.count("*").alias("accepted"))
    rows = tiles.groupBy("grid_row").agg(F.count("*").alias("tiles")).join(inside, "grid_row", "left")
    n = F.coalesce("accepted", F.lit(0)).cast("long")
    return rows.select("grid_row", "tiles", n.alias("accepted"), (n == F.col("tiles") - 1).alias("complete"))


def matches_per_pair(matches: DataFrame) -> DataFrame:
    return matches.groupBy("pair_id").agg(F.count("*").alias("matches"), F.max("score").alias("best_score"))


def keypoints_per_image(descriptors: DataFrame) -> DataFrame:
    return descriptors.groupBy("image").agg(F.count("*").alias("keypoints"))


def rejected_of(edges: DataFrame, tile: int) -> DataFrame:
    """Pairs that hold a tile, rejected ones first; ``place`` has the order."""
    mine = edges.where((F.col("i") == tile) | (F.col("j") == tile))
    return mine.withColumn("place", F.row_number().over(Window.orderBy(F.col("status") == "accepted", "i", "j")).cast("long"))


def run_status(residual_qc: DataFrame, groups: DataFrame) -> DataFrame:
    """complete if one group is consistent, partial if there are more or flags, failed without a group of two."""
    g = groups.agg(F.count_if(F.col("size") > 1).alias("mosaics"), F.count("*").alias("groups"))
    status = F.when(F.col("mosaics") == 0, "failed").when((F.col("groups") == 1) & F.col("qc_consistent"), "complete").otherwise("partial")
    return residual_qc.join(g).select("mosaics", "groups", "qc_consistent", status.alias("status"))


def distinct_in_order(frame: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return frame.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def benchmark_matrix(slides: DataFrame, configurations: DataFrame) -> DataFrame:
    """Every slide under every configuration: a small matrix of runs, not of data."""
    return slides.crossJoin(configurations)


def health(jobs: DataFrame) -> DataFrame:
    """One row: jobs, and those that run, are done or have failed."""
    return jobs.agg(F.count("*").alias("jobs"), *(F.count_if(F.col("status") == s).alias(s) for s in ("running", "done", "error")))


def evenly(frame: DataFrame, order: str, n: int) -> DataFrame:
    """At most n rows at even steps of the order, both ends included; for listings."""
    total = frame.count()
    if total <= n:
        return frame
    ranked = numbered(frame, [F.col(order)], "k").withColumn("k", F.col("k") - 1)
    wanted = sorted({int(i * (total - 1) / (n - 1)) for i in range(n)}) if n > 1 else [0]
    return ranked.where(F.col("k").isin(wanted)).drop("k")


def best_features(features: DataFrame, cap: int = 4000) -> DataFrame:
    """The strongest features of a merged map."""
    return features.orderBy(F.desc("score"), "tile_id", "kp").limit(cap)
