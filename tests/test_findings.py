"""Tests for the findings of round 4."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.operators import graph
from tessera.plans import catalog, mosaic, synthetic
from tessera.plans.views import view
from tessera.sources import scan
from tessera.streaming import guided

D = "/root/testdata/sf0.001"


def against_sql(spark, folder, name):
    """Rows of a query and of its SQL over the tables in a folder, both sorted."""
    db = duckdb.connect()
    for f in folder.glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}/*.parquet')" if f.is_dir() else f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    out = catalog.queries()[name](spark, str(folder))
    found = db.execute(f"SELECT {', '.join(out.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, out.collect())), sorted(found)


def test_uploads_of_files_with_one_name(spark, tmp_path):
    # Grid rows 1000 and 10000 give the same four digits.
    spark.range(20_000, 20_020).union(spark.range(200_000, 200_020)).toDF("p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    found, expected = against_sql(spark, tmp_path, "scan_match_uploads")
    assert len(found) == 40 and found == expected


def test_uploads_by_the_ends_of_paths(spark):
    tiles = spark.createDataFrame([(0, "s/a/x.png"), (1, "s/b/x.png"), (2, "s\\b\\y.png"), (3, "x.png"), (4, None), (5, "s/ax.png"), (6, "s/a/x.png")], "id int, path string")
    uploads = spark.createDataFrame([("a/x.png",), ("x.png",), ("x.png",), ("b/y.png",), ("t/ax.png",)], "name string")
    out = {r.id: (r.upload, r.missing) for r in scan.match_uploads(tiles, uploads).collect()}
    plain, folder = ("x.png", False), ("a/x.png", False)
    assert out == {0: folder, 1: plain, 2: ("b/y.png", False), 3: plain, 4: (None, True), 5: (None, True), 6: folder}
    assert scan.match_uploads(tiles, uploads).count() == 7


def broadcast_columns(frame):
    """The columns of what a plan broadcasts, before any of it runs."""
    plan, out = frame._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        if node.nodeName() == "BroadcastExchange":
            names = node.output()
            out.extend(names.apply(k).name() for k in range(names.size()))
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(plan)
    return out


def test_descriptors_are_never_broadcast(spark, monkeypatch):
    frames = synthetic.drawn(view(spark, D, "shots"))
    new = graph.cut(guided.extract(frames))
    for f in (guided.matched(new, new), guided.matched(new.limit(3), new), guided.matched(new, new.limit(3))):
        assert not {"a", "b", "descriptors"} & set(broadcast_columns(f))
    # Originals of a session in one part, and in several: the same fits.
    one = sorted(map(tuple, guided.matched(new, new).collect()))
    monkeypatch.setattr(guided, "PART", 2)
    assert one and sorted(map(tuple, guided.matched(new, new).collect())) == one


def test_place_that_whitening_hides():
    """Two pairs of neighbours of the slide whose peak isn't among the whitened correlation's first; tiles apart are still refused."""

    def tile(n):
        x, y = n % 20 * 52 + n * 7 % 5, n // 20 * 42 + n * 5 % 4
        rows, columns = np.mgrid[y : y + 64, x : x + 80].astype(np.int64)
        return synthetic.scene(columns, rows).astype(float)

    for n in (4075, 5795):
        one = kernels.phase_correlation(tile(n), tile(n + 1), (0, 1))
        assert one["status"] == "accepted" and abs(one["dx"] - 54) < 1e-6 and abs(one["dy"] + 3) < 1e-6
        assert kernels.phase_correlation(tile(n), tile(n + 9000), (0, 1))["status"] == "failed"


def test_images_are_never_broadcast(spark):
    tiles = synthetic.slide(spark, D)
    found = spark.createDataFrame([(0, 1, "right")], "i bigint, j bigint, axis string")
    poses = tiles.select("tile_id", F.lit(0).cast("long").alias("component"), F.col("true_x").cast("double").alias("x"), F.col("true_y").cast("double").alias("y"))
    meshes = tiles.select("tile_id", F.lit(None).cast("array<double>").alias("mesh"))
    for f in (mosaic.with_images(found, tiles), mosaic.measure(found, tiles, "phase", 1), mosaic.mosaic(tiles, poses, 256, meshes), mosaic.mosaic(tiles, poses, 256, blend="multiband", levels=3)):
        assert not {"image_i", "image_j", "data"} & set(broadcast_columns(f))
    frames = synthetic.drawn(view(spark, D, "shots")).withColumn("tile_id", F.col("seq"))
    for f in (mosaic.compare(found, frames, ["phase", "corner"]), mosaic.refine_pairs(found.withColumn("dx", F.lit(1.0)).withColumn("dy", F.lit(1.0)), frames)):
        assert not {"image_i", "image_j", "data"} & set(broadcast_columns(f))
