"""Operators that SQL can't express, and their invariants."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import flow
from tessera.functions import kernels as k
from tessera.operators import blocks, events, fit, graph, layout, match, pairs, render, report
from tessera.plans import catalog, mosaic, synthetic
from tessera.plans.views import view
from tessera.sources import scan
from tessera.streaming import growing

D = "/root/testdata/sf0.001"


def scene(seed, h, w):
    """Smooth noise, as of a textured surface."""
    return k.gaussian_blur(np.random.default_rng(seed).integers(0, 256, (h, w)).astype(float), 1.2)


# ---------------------------------------------------------------- scans


def test_templates(spark):
    names = spark.createDataFrame([(0, "tile_r00_c09.png"), (1, "TILE_R12_C103.PNG"), (2, "other.png"), (3, "tile_r00_c09.png")], "idx int, file string")
    out = {r.idx: r for r in scan.positions(names, "tile_{rNN}_{cNN}.png").collect()}
    assert (out[0].grid_row, out[0].grid_col, out[0].error) == (0, 9, None) and (out[1].grid_row, out[1].grid_col) == (12, 103)
    assert "match" in out[2].error and out[3].error == "same cell as tile_r00_c09.png"
    with pytest.raises(ValueError, match="same cell"):
        scan.require_positions(scan.positions(names, "tile_{rNN}_{cNN}.png"))
    odd = scan.positions(spark.createDataFrame([(0, "a+b(7)x3")], "idx int, file string"), "{prefix}({row})x{col}").first()
    assert (odd.grid_row, odd.grid_col) == (7, 3)
    for bad in ("", "{row}", "{row}{row}{col}", "{row}{col}{depth}", "x" * 300):
        with pytest.raises(ValueError):
            scan.compile_template(bad)


def test_files_and_manifests(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("b.PNG", "a/c.tif", "note.txt"):
        (tmp_path / name).write_bytes(name.encode())
    found = scan.with_digest(scan.list_images(spark, str(tmp_path))).collect()
    assert [r.path.rsplit("/", 1)[1] for r in found] == ["c.tif", "b.PNG"] and all(len(r.sha256) == 64 for r in found)
    good = tmp_path / "m.json"
    tile = '{"id": "%s", "path": "x/%s.png", "row": %d, "column": %d, "width": %d}'
    grid = '{"row_direction": "+y", "column_direction": "+x", "nominal_overlap_fraction_x": 0.2, "nominal_overlap_fraction_y": %s}'
    text = '{"schema_version": "%s", "grid": %s, "tiles": [%s]}'
    good.write_text(text % ("1.0", grid % "0.1", ",".join((tile % ("p", "p", 0, 0, 9), tile % ("q", "q", 0, 1, 9)))))
    rows = scan.read_manifest(spark, str(good))
    assert scan.check_manifest(rows).count() == 0
    assert [r.missing for r in scan.match_uploads(rows, spark.createDataFrame([("q.png",)], "name string")).orderBy("id").collect()] == [True, False]
    bad = tmp_path / "n.json"
    bad.write_text(text % ("2.0", grid % "1.5", ",".join((tile % ("p", "p", 0, 0, 9), tile % ("p", "q", 0, 0, 8)))))
    assert {r.check for r in scan.check_manifest(scan.read_manifest(spark, str(bad))).collect()} == {"version", "overlap y", "unique id", "unique cell", "layout"}


def test_data_urls(spark):
    frame = spark.createDataFrame([(bytearray(b"abc"), "data:image/png;base64,%%%"), (bytearray(b""), "nothing")], "b binary, u string")
    out = frame.select(scan.from_data_url("u").alias("broken"), scan.data_url("b").alias("url")).collect()
    assert [r.broken for r in out] == [None, None] and out[0].url == "data:image/png;base64,YWJj"


# ---------------------------------------------------------------- fits


def points(shift, n=20, noise=0.3, bad=80, seed=1):
    rng = np.random.default_rng(seed)
    a = np.stack(np.meshgrid(np.linspace(80, 320, n), np.linspace(80, 320, n)), -1).reshape(-1, 2)
    b = a + shift + rng.normal(0, noise, a.shape)
    at = rng.choice(len(a), bad, replace=False)
    b[at] = rng.uniform(0, 400, (bad, 2))
    return a, b


def frame(spark, a, b, pair=1):
    return spark.createDataFrame([(pair, i, *map(float, x), *map(float, y), 1.0) for i, (x, y) in enumerate(zip(a, b))], "pair_id int, k int, x0 double, y0 double, x1 double, y1 double, score double")


@pytest.mark.parametrize("shift", [(50, -40), (-45, 60)])
def test_translation_with_outliers(spark, shift):
    a, b = points(shift)
    out = fit.reliable_translation(frame(spark, a, b), 400, 400, integer=True).first()
    assert out.accepted and (out.tx, out.ty) == shift and out.inliers >= 315
    shuffled = fit.reliable_translation(frame(spark, a, b).orderBy(F.rand(3)).repartition(3), 400, 400, integer=True).first()
    assert shuffled == out


def test_translation_rejects(spark):
    a, _ = points((0, 0))
    turn = np.array([[np.cos(0.2), -np.sin(0.2)], [np.sin(0.2), np.cos(0.2)]])
    cases = {1: a @ turn.T, 2: a * 1.2, 3: a @ np.array([[1, 0.2], [0, 1]]), 4: a + 500.0}
    for b in cases.values():
        assert not fit.reliable_translation(frame(spark, a, b), 400, 400).first().accepted
    assert fit.reliable_translation(frame(spark, a / 50, a / 50 + 3), 400, 400).first().reason == "inliers in a small region"
    assert fit.reliable_translation(frame(spark, a[:11], a[:11]), 400, 400).first().reason == "fewer than 12 matches"
    exact = fit.reliable_translation(frame(spark, a, a + (10.25, -3.75)), 400, 400, threshold=0.5).first()
    assert (exact.tx, exact.ty) == (10.25, -3.75) and exact.accepted


def test_homography(spark):
    h = np.array([[1.02, 0.03, 12], [-0.02, 0.98, -7], [1e-5, 2e-5, 1]])
    a, _ = points((0, 0))
    b = k.apply_homography(h, a)
    b[::5] = np.random.default_rng(2).uniform(0, 400, b[::5].shape)
    out = fit.reliable_homography(frame(spark, a, b), 400, 400).first()
    assert out.accepted and np.allclose(np.array(out.homography).reshape(3, 3), h, atol=1e-3)
    assert not k.plausible_homography(np.array([[1, 0, 0], [0, 1, 0], [-0.01, 0, 1.0]]), 400, 400) and k.plausible_homography(np.eye(3), 400, 400)
    near = fit.homography_inliers(frame(spark, a, b), out.homography)
    assert near.where("inlier").count() >= 0.75 * len(a)


def test_sampling_knn_and_mutual(spark):
    rng = np.random.default_rng(3)
    left = rng.normal(size=(30, 8)).astype("float32")
    right = np.r_[left[:20] + 0.01, rng.normal(size=(15, 8)).astype("float32")]
    make = lambda d: spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(d)], "kp_id int, descriptor array<float>")
    out = {r.kp0: r.kp1 for r in match.knn_ratio(make(left), make(right), 0.5).collect()}
    assert all(out.get(i) == i for i in range(20))
    assert match.knn_ratio(make(left), make(right[:1]), 0.1).count() == 30
    assert {r.kp0: r.kp1 for r in match.knn_ratio(make(left), make(right), 0.5, block=4).collect()} == out
    rows = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.8), (1, 1, 0.7), (2, 2, 0.1)], "kp0 int, kp1 int, score double")
    assert {(r.kp0, r.kp1) for r in match.mutual(rows).collect()} == {(0, 0), (2, 2)}
    some = view(spark, D, "correspondences")
    assert match.spatial_sample(some, 400, 300, 5).groupBy("pair_id").count().where("count > 5").count() == 0


def test_hull():
    assert k.hull_area(np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1], [1, 0]], float)) == 4 and k.hull_area(np.array([[0, 0], [1, 1], [2, 2]], float)) == 0


# ---------------------------------------------------------------- graphs and layout


def kruskal(edges):
    parent, out = {}, set()

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for i, j, w in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        a, b = root(i), root(j)
        if a != b:
            parent[b] = a
            out.add((i, j))
    return out


def test_forest_centre_and_positions(spark):
    e = view(spark, D, "edges").where("status = 'accepted'")
    rows = [(r.i, r.j, r.inliers) for r in e.collect()]
    forest = graph.cut(graph.spanning_forest(e))
    assert {(r.i, r.j) for r in forest.collect()} == kruskal(rows)
    path = spark.createDataFrame([(i, i + 1, 10.0, 1.0) for i in range(6)] + [(20, 21, 5.0, 0.0)], "i long, j long, dx double, dy double")
    assert {r.component: r.tile_id for r in graph.tree_centre(path).collect()} == {0: 3, 20: 20}
    placed = {r.tile_id: (r.x, r.y) for r in graph.tree_positions(path, spark.createDataFrame([(3,), (21,)], "tile_id long")).collect()}
    assert placed[0] == (-30.0, -3.0) and placed[6] == (30.0, 3.0) and placed[20] == (-5.0, 0.0)


def test_group_policies(spark):
    e = spark.createDataFrame([(0, 1, 5), (2, 3, 9), (5, 6, 9)], "i long, j long, inliers long")
    nodes = spark.range(8).select(F.col("id").alias("tile_id"))
    named = graph.components(e, nodes)
    groups = graph.ranked_groups(named, e)
    assert graph.largest_group(groups) == 2 and {r.tile_id for r in graph.excluded(named, groups).collect()} == {0, 1, 4, 5, 6, 7}
    with pytest.raises(ValueError):
        graph.largest_group(groups, "reject")
    with pytest.raises(ValueError):
        graph.largest_group(graph.ranked_groups(graph.components(e.limit(0), nodes), e.limit(0)))


@pytest.mark.parametrize("method", ["length", "huber"])
def test_solves_recover_truth(spark, method):
    truth = {n: (80.0 * (n % 2), 80.0 * (n // 2)) for n in range(4)}
    rows = [(i, j, truth[j][0] - truth[i][0], truth[j][1] - truth[i][1], "accepted") for i in range(4) for j in range(i + 1, 4)] + [(7, 8, 1.0, 2.0, "accepted"), (0, 7, 0.0, 0.0, "failed")]
    e = spark.createDataFrame(rows, "i long, j long, dx double, dy double, status string")
    named = graph.components(e.where("status = 'accepted'"), spark.range(10).select(F.col("id").alias("tile_id")))
    poses = layout.solve(e, named, method)
    got = {r.tile_id: (r.x, r.y) for r in poses.collect()}
    assert all(np.allclose(got[n], truth[n], atol=1e-6) for n in truth) and np.allclose(got[8], (1, 2), atol=1e-6) and got[5] == got[9] == (0.0, 0.0)
    assert layout.consistent(layout.residuals(e, poses)).first().qc_consistent


def test_outlying_edge_is_flagged(spark):
    rows = [(i, i + 1, 100.0, 0.0, "accepted") for i in range(6)] + [(i, i + 2, 200.0, 0.0, "accepted") for i in range(5)] + [(i, i + 3, 300.0, 0.0, "accepted") for i in range(4)] + [(0, 6, 640.0, 0.0, "accepted")]
    e = spark.createDataFrame(rows, "i long, j long, dx double, dy double, status string")
    poses = layout.solve(e, graph.components(e))
    assert {(r.i, r.j) for r in layout.residuals(e, poses).where("flagged").collect()} == {(0, 6)}


def test_flagship_finds_true_places(spark):
    poses = catalog.flagship(spark, D)
    truth = view(spark, D, "tiles").select("tile_id", "true_x", "true_y")
    best = poses.groupBy("component").count().orderBy(F.desc("count")).first().component
    off = poses.where(F.col("component") == best).join(truth, "tile_id").select((F.col("x") - F.col("true_x")).alias("ox"), (F.col("y") - F.col("true_y")).alias("oy"))
    spread = off.agg(F.stddev("ox"), F.stddev("oy")).first()
    assert max(spread) < 15


def test_mesh(spark):
    i, j = np.zeros(20, int), np.ones(20, int)
    rng = np.random.default_rng(4)
    pa = rng.uniform(20, 80, (20, 2))
    good, reason = k.reconcile_mesh(2, i, j, pa, pa, np.c_[(pa[:, 0] - 50) / 20, np.zeros(20)], 100, 100, 10, 0.2, 3)
    assert reason is None and good.shape == (2, 5, 5, 2) and abs(good.mean(axis=(1, 2))).max() < 1e-9
    one_bad = np.c_[(pa[:, 0] - 50) / 20, np.zeros(20)]
    one_bad[7] += 6  # the greatest error counts, not the mean
    assert k.reconcile_mesh(2, i, j, pa, pa, one_bad, 100, 100, 10, 0.2, 3)[1] == "points that contradict each other"
    assert k.reconcile_mesh(2, i[:0], j[:0], pa[:0], pa[:0], pa[:0], 100, 100, 10, 0.2, 3)[1] == "no points"
    zero, reason = k.reconcile_mesh(2, np.r_[i, i], np.r_[j, j], np.r_[pa, pa], np.r_[pa, pa], np.r_[np.tile([40.0, 0], (20, 1)), np.tile([-40.0, 0], (20, 1))], 100, 100, 2, 0.1, 1)
    assert reason is not None and not zero.any()
    assert np.allclose(k.mesh_displacement(np.ones((5, 5, 2)) * 3, 33.0, 71.0, 100, 100), 3)
    m = spark.createDataFrame([(0, 1, *map(float, p), *map(float, p), 40.0, 0.0) for p in pa], "i long, j long, ax double, ay double, bx double, by double, dx double, dy double")
    named = spark.createDataFrame([(0, 0), (1, 0)], "tile_id long, component long")
    assert layout.mesh(m, named, 100, 100, 2, 0.1, 1).where("NOT accepted AND reason IS NOT NULL").count() == 2


# ---------------------------------------------------------------- registration and pixels


def test_phase_correlation(spark):
    s = scene(17, 128, 230)
    found = k.phase_correlation(s[:, :150], s[:, 80:230], (0, 1))
    assert found["status"] == "accepted" and abs(found["dx"] - 80) <= 0.5 and abs(found["dy"]) <= 0.5
    assert k.phase_correlation(np.zeros((64, 64)), s[:64, :64])["status"] == "failed"
    wave = np.tile(127 + 100 * np.sin(np.arange(160) / 4 * np.pi), (128, 1))
    assert k.phase_correlation(wave[:, :120], wave[:, 40:], (0, 1))["status"] != "accepted"
    assert k.phase_correlation(s[:, :100], scene(99, 128, 100), (0, 1))["status"] == "failed"
    tile = lambda a: bytearray(np.rint(a).astype(np.uint8).tobytes())
    pairs_ = spark.createDataFrame([(0, 1, "right", 82.0, 0.0, tile(s[:, :150]), 128, 150, tile(s[:, 80:]), 128, 150)], "i long, j long, axis string, px double, py double, a binary, ha int, wa int, b binary, hb int, wb int")
    out = render.register_pairs(pairs_, radius=20).first()
    assert out.status == "accepted" and abs(out.dx - 80) <= 0.5
    assert render.register_pairs(pairs_.withColumn("px", F.lit(120.0)), radius=5).first().status == "failed"


def test_preprocessing():
    image = np.random.default_rng(1).integers(0, 256, (800, 1600, 3), np.uint8)
    assert k.preprocess(image, 1080).shape == (540, 1080, 3) and k.preprocess(image, 4000) is image
    square = np.zeros((40, 40), np.uint8)
    square[10:30, 10:30] = 200
    edge = k.preprocess(square, sobel=True)
    assert edge.max() == 255 and edge[20, 10] and edge[10, 20] and not k.preprocess(np.full((9, 9), 7, np.uint8), sobel=True).any()
    small, scale = k.preview(image, 400)
    assert small.shape == (200, 400) and scale == (0.25, 0.25) and small.min() >= 0 and small.max() <= 255


def test_flat_field():
    ramp = np.linspace(0.5, 1.5, 240)[None, :]
    tiles = [np.clip(np.random.default_rng(i).normal(100, 3, (160, 240)) * ramp, 0, 255).astype(np.uint8) for i in range(6)]
    field = k.flat_field(tiles)
    after = k.correct(tiles[0], field)
    assert after.mean(0).std() * 5 < tiles[0].mean(0).std()
    with pytest.raises(ValueError):
        k.flat_field([tiles[0], tiles[1][:50]])


def test_blending():
    a, b = np.full((40, 100), 40, np.uint8), np.full((40, 100), 200, np.uint8)
    ma, mb = np.zeros((40, 100), bool), np.zeros((40, 100), bool)
    ma[:, :70], mb[:, 30:90] = True, True
    row = k.feather_blend([a, b], [ma, mb])[20].astype(int)
    assert (np.diff(row[:90]) >= 0).all() and np.diff(row[:90]).max() < 15 and not row[90:].any()
    for v in (60, 120, 180):
        flat = np.full((65, 79), v, np.uint8)
        assert (k.multiband_blend([flat, flat], [np.ones((65, 79), bool)] * 2) == v).all()
    d = k.edge_distance(np.ones((21, 21), bool))
    assert d[10, 10] == d.max() and np.allclose(d, d.T, atol=1e-9) and np.allclose(d, d[::-1, ::-1], atol=1e-9)
    g = k.exposure_gains(3, np.array([0]), np.array([1]), np.log(np.array([2.0])))
    assert np.allclose(g, [np.sqrt(2), 1 / np.sqrt(2), 1], rtol=1e-4)
    mask = np.ones((20, 30), bool)
    mask[:4, 10:] = mask[:, :2] = False
    assert k.largest_rectangle(mask) == (2, 4, 30, 20)


def test_chunks_dont_change_the_mosaic(spark):
    full = np.rint(scene(5, 120, 200)).astype(np.uint16) * 100
    rows = [(0, n, float(x), float(y), 80, 70, 1, "uint16", bytearray(full[y : y + 70, x : x + 80].tobytes())) for n, (x, y) in enumerate(((0, 0), (60, 0), (120, 0), (0, 50), (60, 50), (120, 50)))]
    tiles = spark.createDataFrame(rows, "component long, tile_id long, x double, y double, width int, height int, channels int, dtype string, data binary")
    canvases = []
    for chunk in (64, 256):
        out, cover = np.zeros((256, 256), np.uint16), np.zeros((256, 256), np.uint16)
        for r in render.render_chunks(tiles, chunk).collect():
            at = np.s_[r.cy * chunk : (r.cy + 1) * chunk, r.cx * chunk : (r.cx + 1) * chunk]
            out[at], cover[at] = np.frombuffer(r.data, np.uint16).reshape(chunk, chunk), np.frombuffer(r.coverage, np.uint16).reshape(chunk, chunk)
        canvases.append((out, cover))
    assert (canvases[0][0] == canvases[1][0]).all() and (canvases[0][1] == canvases[1][1]).all()
    assert (canvases[0][0][:120, :200] == full).all() and canvases[0][1][60, 70] == 4 and not canvases[0][1][130:].any()


def test_pasting(spark):
    a = spark.createDataFrame([(0, 0, 10.0, 1.0), (1, 0, 20.0, 1.0)], "x int, y int, value double, weight double")
    b = spark.createDataFrame([(1, 0, 40.0, 3.0), (2, 0, 50.0, 3.0)], "x int, y int, value double, weight double")
    assert {r.x: r.value for r in render.paste(a, b).collect()} == {0: 10, 1: 35, 2: 50}
    assert {r.x: r.value for r in render.merge_feathered(a, b).collect()} == {0: 10.0, 1: 35.0, 2: 50.0}
    gains = {r.tile_id: r.gain for r in render.exposure(spark.createDataFrame([(0, 0, 1, 100.0, 200.0)], "component long, i long, j long, median_i double, median_j double")).collect()}
    assert gains[0] > 1 > gains[1]


# ---------------------------------------------------------------- streams and events


def test_stream_equals_batch(spark, tmp_path):
    frames = catalog.view(spark, D, "tiles").select(F.concat(F.lit("row "), F.col("grid_row").cast("string")).alias("session"), F.col("tile_id").alias("seq"), *(F.col(c).cast("double").alias(n) for c, n in (("true_x", "x"), ("true_y", "y"), ("width", "width"), ("height", "height"))))
    path = str(tmp_path / "in")
    for low in (0, 80, 40, 120):  # the third file repeats rows that came before
        frames.where(f"seq >= {low} AND seq < {low + 80}").coalesce(1).write.mode("append").parquet(path)
    stream = growing.growing_map(spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(path))
    q = stream.writeStream.format("memory").queryName("grown").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.session, r.seq): r for r in spark.table("grown").collect()}
    want = {(r.session, r.seq): r for r in growing.growing_map_batch(frames).collect()}
    assert got == want


def test_growth_gates():
    frame_ = {"x": 0.0, "y": 0.0, "width": 400.0, "height": 300.0}
    status, box = growing.grow(None, frame_)
    assert status == "seeded" and growing.grow(box, frame_) == ("skipped", box)
    assert growing.grow(box, frame_ | {"x": 0.1})[0] == "skipped" and growing.grow(box, frame_ | {"x": 50.0}) == ("added", (0.0, 0.0, 450.0, 300.0))
    assert growing.grow(box, frame_ | {"x": 20_000.0}) == ("rejected", box) and growing.grow(box, frame_ | {"x": None}) == ("rejected", box)


def test_event_stream(spark, tmp_path):
    e = view(spark, D, "job_events").select("job_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "type", "fraction")
    path = str(tmp_path / "e")
    e.coalesce(1).write.parquet(path)
    e.coalesce(1).write.mode("append").parquet(path)
    source = lambda: spark.readStream.schema(e.schema).parquet(path)
    q = growing.deduplicated_events(source(), "3650 days").writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == e.count()
    q = growing.job_status(source()).writeStream.format("memory").queryName("latest").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("latest").collect()} == {tuple(r) for r in events.latest_status(e).collect()}


# ---------------------------------------------------------------- staged decisions


def test_reports_and_staging(spark):
    e = view(spark, D, "edges")
    assert report.run_status(spark.createDataFrame([(True,)], "qc_consistent boolean"), spark.createDataFrame([(4,)], "size int")).first().status == "complete"
    assert report.run_status(spark.createDataFrame([(True,)], "qc_consistent boolean"), spark.createDataFrame([(4,), (1,)], "size int")).first().status == "partial"
    assert report.run_status(spark.createDataFrame([(True,)], "qc_consistent boolean"), spark.createDataFrame([(1,)], "size int")).first().status == "failed"
    hit, miss = pairs.cached(e.select("i", "j", F.concat_ws("-", "i", "j").alias("cache_key")), spark.createDataFrame([("0-1", "done")], "cache_key string, record string"))
    assert hit.count() == 1 and miss.count() == e.count() - 1
    assert report.benchmark_matrix(spark.range(3), spark.range(4).toDF("c")).count() == 12
    assert report.landmark_metrics(spark.createDataFrame([], "error_px double")).first() == (0, None, None)
    assert render.row_fallback(spark.createDataFrame([(0, 5), (1, 9), (2, 9)], "grid_row int, covered int")).first().grid_row == 1


def test_cycles_cache_and_isolation(spark):
    e = view(spark, D, "edges")
    forest = spark.createDataFrame([(0, 1, 9, 10.0, 0.0), (1, 2, 8, 10.0, 0.0)], "i long, j long, inliers long, dx double, dy double")
    all_ = forest.drop("inliers").union(spark.createDataFrame([(0, 2, 26.0, 8.0)], "i long, j long, dx double, dy double")).withColumn("status", F.lit("accepted"))
    poses = graph.tree_positions(forest, spark.createDataFrame([(0,)], "tile_id long"))
    assert [r.residual_px for r in layout.cycle_residuals(all_, forest, poses).collect()] == [10.0]
    from tessera.plans import cache

    t = spark.createDataFrame([(1, "a"), (2, "b")], "tile_id long, sha256 string")
    assert cache.stage_key(t, "s") == cache.stage_key(t.orderBy(F.desc("tile_id")), "s") != cache.stage_key(t, "other")
    same = spark.createDataFrame([(1, bytearray(b"x"))], "tile_id long, content binary")
    cache.require_unchanged(same.select("tile_id", F.sha2("content", 256).alias("sha256")), same)
    with pytest.raises(ValueError, match=r"\[1, 2\]"):
        cache.require_unchanged(t, same)
    assert t.select(cache.content_key("tile_id", "sha256").alias("k")).distinct().count() == 2
    write = growing.isolated(lambda batch, n: 1 / n)
    write(e, 1)
    write(e, 0)
    assert [n for n, _ in write.errors] == [0]
    assert [r.tile_id for r in report.evenly(spark.range(100).toDF("tile_id"), "tile_id", 3).orderBy("tile_id").collect()] == [0, 49, 99]


def test_template_with_an_apostrophe(spark):
    names = spark.createDataFrame([(0, "o'n_1_2.png"), (1, "other"), (2, "another"), (3, "o'n_1_2.png")], "idx long, file string")
    out = {r.idx: (r.grid_row, r.grid_col, r.error) for r in scan.positions(names, "o'n_{row}_{col}.png").collect()}
    assert out[0] == (1, 2, None) and "match" in out[1][2] and "match" in out[2][2] and "same cell" in out[3][2]


def test_photometric_refinement():
    rng = np.random.default_rng(3)
    scene = k.gaussian_blur(rng.integers(0, 256, (140, 170)).astype(float), 2.0)
    truth = np.array([[1.0, 0.01, 9.3], [-0.008, 1.0, 6.6], [1e-5, -1e-5, 1.0]])
    y, x = np.mgrid[0:100, 0:120].astype(float)
    q = k.apply_homography(truth, np.stack([x.ravel(), y.ravel()], 1))
    a = k.bilinear(scene, q[:, 0], q[:, 1]).reshape(100, 120) * 0.8 + 12
    start = truth + np.array([[0, 0, 1.2], [0, 0, -0.9], [0, 0, 0]])
    corners = np.array([[0, 0], [119, 0], [0, 99], [119, 99]], float)
    off = lambda h: np.hypot(*(k.apply_homography(h, corners) - k.apply_homography(truth, corners)).T).max()
    assert off(k.refine_homography(a, scene, start)) < 0.2 < 1 < off(start)
    assert (k.refine_homography(np.zeros((80, 80)), scene, truth) == truth).all()


def test_multiband_in_chunks(spark):
    """Chunks with halos equal one canvas with zeros around it, whatever their size; a tile alone is copied."""
    rng = np.random.default_rng(31)
    size, places, rows = 60, [(0, 0), (40, 3), (-20, 45), (35, 50)], []
    canvas, margin = np.zeros((2, 384, 384)), 128
    for t, (x, y) in enumerate(places):
        image = np.clip(rng.integers(0, 120, (size, size)) + 30 * t, 0, 255).astype(np.uint8)
        shown = rng.random((size, size)) > (0.1 if t == 2 else -1)
        at = slice(margin + y, margin + y + size), slice(margin + x, margin + x + size)
        canvas[0][at] += image * shown
        canvas[1][at] += shown
        rows.append((0, t, float(x), float(y), size, size, 1, "uint8", bytearray(image.tobytes()), bytearray(shown.astype(np.uint8).tobytes()), 3))
    alone = rng.integers(0, 256, (size, size)).astype(np.uint8)
    rows.append((1, 9, 5.0, 5.0, size, size, 1, "uint8", bytearray(alone.tobytes()), None, 0))
    tiles = spark.createDataFrame(rows, "component bigint, tile_id bigint, x double, y double, width int, height int, channels int, dtype string, data binary, mask binary, levels int")
    whole = k.mixed_bands(canvas[0][..., None], canvas[1], 3, mirrored=False)[..., 0]
    whole = np.where(canvas[1] > 0, np.clip(np.rint(whole), 0, 255), 0)
    for chunk in (16, 64):
        found, single = np.zeros((384, 384)), np.zeros((384, 384))
        for r in render.render_chunks(tiles, chunk, "multiband", 3).collect():
            at = slice(margin + r.cy * chunk, margin + (r.cy + 1) * chunk), slice(margin + r.cx * chunk, margin + (r.cx + 1) * chunk)
            (single if r.component else found)[at] = np.frombuffer(r.data, np.uint8).reshape(chunk, chunk)
        assert (found == whole).all()
        assert (single[133 : 133 + size, 133 : 133 + size] == alone).all() and single.sum() == alone.sum()
    # The bands of the sum are the sum of the bands of each image, worked out apart.
    parts = rng.random((2, 40, 48, 1)), rng.random((2, 40, 48)) > 0.3
    both = k.mixed_bands((parts[0] * parts[1][..., None]).sum(0), parts[1].sum(0).astype(float), 2)
    g = [[(x * m[..., None], m.astype(float))] for x, m in zip(*parts)]
    for pyramid in g:
        for _ in range(2):
            pyramid.append((k._down(pyramid[-1][0]), k._down(pyramid[-1][1])))
    bands = [sum(p[n][0] - (k._up(p[n + 1][0], p[n][0].shape) if n < 2 else 0) for p in g) / np.maximum(sum(p[n][1] for p in g), 1e-6)[..., None] for n in range(3)]
    share = np.where(parts[1].sum(0) == 0, 1.0, parts[1].sum(0))[..., None]
    bands[0] = sum(p[0][0] - k._up(p[1][0], p[0][0].shape) for p in g) / share
    plain = k._up(k._up(bands[2], bands[1].shape) + bands[1], bands[0].shape) + bands[0]
    assert np.allclose(both, plain)
    with pytest.raises(ValueError):
        render.render_chunks(tiles, 100, "multiband", 3)


def test_merging_blends_the_overlap_alone():
    base, added = np.full((64, 96), 80, np.uint8), np.full((64, 96), 120, np.uint8)
    left, right = np.zeros((64, 96), bool), np.zeros((64, 96), bool)
    left[:, :60], right[:, 40:] = True, True
    out, mask = k.merge_multiband(np.where(left, base, 0).astype(np.uint8), left, np.where(right, added, 0).astype(np.uint8), right)
    assert mask.all() and (out[:, :30] == 80).all() and (out[:, 70:] == 120).all() and 85 < out[32, 50] < 115
    apart = right & ~left
    out, mask = k.merge_multiband(base, left, added, apart)
    assert (out[:, 60:] == 120).all() and (out[:, :60] == 80).all()


def test_flow_finds_a_smooth_warp():
    rng = np.random.default_rng(3)
    world = k.gaussian_blur(rng.integers(0, 256, (400, 500)).astype(float), 1.5)
    y, x = np.mgrid[0:200, 0:240].astype(float)
    bend = lambda u, v: np.stack([2 * np.sin(u / 60) + 1, 1.5 * np.cos(v / 50)], -1)
    moved = bend(x, y)
    a, b = world[50:250, 50:290], k.bilinear(world, x + 150 + moved[..., 0], y + 60 + moved[..., 1])
    for dx, dy in ((100.0, 10.0), (100.4, 9.3)):
        r = flow.refine(a, b, dx, dy)
        pb = r["points_b"]
        error = np.hypot(*(pb + (100, 10) + bend(pb[:, 0], pb[:, 1]) - r["points_a"]).T)
        assert r["status"] == "success" and len(pb) > 100 and error.max() < 0.5 and np.median(error) < 0.1
    assert flow.refine(a, b, 235.0, 0.0)["status"] == "unsupported_input"
    assert flow.refine(a, b, 900.0, 0.0)["reason"] == "no overlap"
    assert flow.refine(np.full(a.shape, 90.0), b, 100.0, 10.0)["status"] == "no_improvement"


def test_refined_pairs_are_valid(spark):
    frames = synthetic.tiles(spark, 1, 3, size=160, step=110)
    places = [(0, 1, 117.0, 5.0), (1, 2, 116.0, 6.0), (0, 2, 900.0, 0.0), (2, 1, None, None)]
    out = mosaic.refine_pairs(spark.createDataFrame(places, "i bigint, j bigint, dx double, dy double"), frames)
    assert layout.invalid_refinements(out).count() == 0
    assert {(r.i, r.j): r.status for r in out.collect()} == {(0, 1): "success", (1, 2): "success", (0, 2): "unsupported_input"}


def test_engines_compared_on_pairs(spark):
    frames = synthetic.tiles(spark, 1, 4, size=160, step=110, blank=(3,))
    chosen = spark.createDataFrame([(0, 1), (0, 1), (1, 2), (2, 3), (0, 0), (1, 77)], "i bigint, j bigint")
    out = mosaic.compare(chosen, frames, ["phase", "corner"], retry="r1").cache()
    rows = {(r.i, r.j, r.engine): r for r in out.collect()}
    assert out.count() == len(rows) == 10 and {r.retry_id for r in rows.values()} == {"r1-phase", "r1-corner"}
    assert rows[0, 1, "phase"].accepted and rows[0, 1, "corner"].accepted and rows[0, 1, "phase"].reason is None
    assert rows[0, 0, "phase"].reason == "choose two distinct tiles" and rows[1, 77, "corner"].reason == "unknown tile"
    assert not rows[2, 3, "phase"].accepted and rows[2, 3, "phase"].reason
    found = {(r.i, r.j): r for r in fit.compared(out).collect()}
    assert len(found) == 5 and found[0, 1].agree and found[0, 1].accepted == found[0, 1].engines == 2
    assert found[2, 3].agree is None and found[2, 3].dx is None and found[0, 0].accepted == 0
    apart = spark.createDataFrame([(0, 1, "a", True, 0.9, 10.0, 0.0), (0, 1, "b", True, 0.8, 90.0, 0.0), (0, 1, "c", True, 0.9, 11.0, 0.0)], "i bigint, j bigint, engine string, accepted boolean, ncc double, dx double, dy double")
    assert [(r.best, r.dx, r.agree) for r in fit.compared(apart).collect()] == [("a", 10.0, False)]
    first, second = (mosaic.compare(chosen.limit(1), frames, ["phase"]).first().retry_id for _ in range(2))
    assert first != second
    with pytest.raises(ValueError):
        mosaic.compare(chosen, frames, ["phase"], {"phase": {"peaks": 0}})
    for bad in ([], ["phase"] * 2, ["nothing"], ["phase", 3], "phase", [f"e{n}" for n in range(9)]):
        with pytest.raises(ValueError):
            mosaic.compare(chosen, frames, bad)


def test_drawn_matches(spark):
    rows = [(p, n, None if p == 3 else 0.5 if p == 2 else n / 10) for p in (1, 2, 3) for n in range(11)] + [(None, 1, 0.2)]
    frame = spark.createDataFrame(rows, "pair_id int, k int, score double")
    found = match.drawn(frame, 5, 1).collect()
    assert len(found) == 16 and sorted(map(str, found)) == sorted(map(str, match.drawn(frame.repartition(3), 5, 1).collect()))
    assert {r.k for r in found if r.pair_id == 1} != {r.k for r in match.drawn(frame, 5, 2).collect() if r.pair_id == 1}
    for r in found:
        wanted = {1: r.k / 10, 2: 1.0, 3: None, None: 1.0}[r.pair_id]
        assert r.strength is None if wanted is None else abs(r.strength - wanted) < 1e-12
        assert (r.red, r.green, r.blue) == (match.PLAIN if wanted is None else (255 - int(255 * r.strength), int(255 * r.strength), 0))
    assert match.drawn(frame, 5, 1, score=None).where("strength IS NOT NULL").count() == 0
    assert match.drawn(frame.limit(0)).count() == 0


def test_refinement_results(spark):
    rows = [("success", layout.FRAME, [[1.0, 2.0]], [[1.0, 3.0]]), ("success", layout.FRAME, None, None), ("odd", layout.FRAME, None, None), ("failed", "crop", None, None), ("success", layout.FRAME, [[1.0, 2.0]], []), ("success", layout.FRAME, [[1.0, float("nan")]], [[1.0, 2.0]]), (None, None, None, None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, status string, frame string, points_a array<array<double>>, points_b array<array<double>>")
    assert {r.id: r.error for r in layout.invalid_refinements(frame).collect()} == {2: "unknown status", 3: "unknown frame", 4: "points that don't fit together", 5: "points that don't fit together", 6: "unknown status"}


def grid_of(rows, columns, outliers=True):
    tile = np.arange(rows * columns).reshape(rows, columns)
    truth = np.stack([(tile % columns).ravel() * 90.0, (tile // columns).ravel() * 70.0], 1) + np.random.default_rng(7).normal(size=(rows * columns, 2))
    i, j = np.r_[tile[:, :-1].ravel(), tile[:-1].ravel()], np.r_[tile[:, 1:].ravel(), tile[1:].ravel()]
    d = truth[j] - truth[i]
    if outliers:
        d[min(500, len(d) // 2) :: 1000] += 40
        d[7::61] -= 12
    return tile.ravel(), truth, i, j, d


@pytest.mark.parametrize("rows, columns", [(6, 9), (19, 21), (1, 400)])
def test_places_equal_a_dense_solve(rows, columns):
    """Each round of reweighting solved densely, below and above the size up to which components are eliminated."""
    nodes, _, i, j, d = grid_of(rows, columns)
    m, robust = np.zeros((len(i), len(nodes))), np.ones(len(i))
    m[np.arange(len(i)), j], m[np.arange(len(i)), i] = 1, -1
    for _ in range(6):
        root = np.sqrt(robust)[:, None]
        p = np.zeros((len(nodes), 2))
        p[1:] = np.linalg.lstsq(m[:, 1:] * root, d * root, rcond=None)[0]
        r = np.hypot(*(p[j] - p[i] - d).T)
        robust = np.minimum(1, max(2.0, 1.5 * np.median(r)) / np.maximum(r, 1e-12))
    assert np.abs(k.solve_translations(nodes, i, j, d, np.ones(len(i))) - p).max() < 1e-5


def test_many_tiles_in_one_component():
    """50,000 tiles of one component: true places without outliers, and with them the normal equations of a round hold."""
    nodes, truth, i, j, d = grid_of(200, 250, outliers=False)
    began = time.time()
    assert np.abs(k.solve_translations(nodes, i, j, d, np.ones(len(i))) - (truth - truth[0])).max() < 1e-4
    nodes, truth, i, j, d = grid_of(200, 250)
    weight = np.random.default_rng(3).uniform(0.2, 2, len(i))
    p = k.solve_translations(nodes, i, j, d, weight, rounds=1)
    force = weight[:, None] * (p[j] - p[i] - d)
    left = [np.bincount(j, f, len(nodes)) - np.bincount(i, f, len(nodes)) for f in force.T]
    assert max(np.abs(x).max() for x in left) < 1e-4
    k.solve_translations(nodes, i, j, d, weight)
    assert time.time() - began < 120


def forest_by_kruskal(edges):
    parent, out = {}, set()

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, j, w in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if root(i) != root(j):
            parent[root(i)] = root(j)
            out.add((i, j, w))
    return out


@pytest.mark.parametrize("rows_a_file", [100_000, 40])
def test_forest_in_rounds(spark, monkeypatch, rows_a_file):
    """Many ties, repeated edges and several components, in one partition and in many rounds."""
    monkeypatch.setattr(graph, "ROWS_A_FILE", rows_a_file)
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b), int(w)) for a, b, w in zip(rng.integers(0, 150, 700), rng.integers(0, 150, 700), rng.integers(1, 6, 700)) if a != b and a % 5 == b % 5]
    edges += edges[:20] + [(1000 + n, 1001 + n, 1 + n % 3) for n in range(200)]
    frame = spark.createDataFrame(edges, "i long, j long, inliers int").repartition(7)
    assert {tuple(r) for r in graph.spanning_forest(frame).collect()} == forest_by_kruskal(edges)
    assert graph.spanning_forest(frame.limit(0)).count() == 0
    parts = {r.tile_id: r.component for r in graph.components(frame.select("i", "j")).collect()}
    assert all(parts[i] == parts[j] for i, j, _ in edges) and len(set(parts.values())) == len(parts) - len(forest_by_kruskal(edges))


def test_nearest_in_blocks(spark):
    """Blocks, ties and repeated descriptors give what comparing all pairs gives."""
    rng = np.random.default_rng(8)
    points = rng.integers(0, 4, (90, 6)).astype(float)
    sides = [spark.createDataFrame([(int(n), [float(v) for v in points[n]]) for n in r], "kp_id long, descriptor array<float>") for r in (range(40), range(40, 90))]
    expected = {}
    for a in range(40):
        near = sorted((float(np.sqrt(((points[a] - points[b]) ** 2).sum())), b) for b in range(40, 90))
        if near[0][0] < 0.9 * near[1][0]:
            expected[a] = near[0][1]
    for block in (7, 1000):
        assert {r.kp0: r.kp1 for r in match.knn_ratio(*sides, 0.9, block=block).collect()} == expected
    assert match.knn_ratio(sides[0], sides[1].limit(0), 0.9).count() == 0 and match.knn_ratio(sides[0], sides[1].limit(1), 0.9).count() == 40


def test_hub_and_long_chain(spark):
    hub = [(0, n) for n in range(1, 400)] + [(1000 + n, 1001 + n) for n in range(300)]
    frame = spark.createDataFrame(hub, "i long, j long").repartition(4)
    out = {r.tile_id: r.component for r in graph.components(frame).collect()}
    assert all(out[n] == 0 for n in range(400)) and all(out[1000 + n] == 1000 for n in range(301))


def test_gates_of_transforms(spark):
    square = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)
    assert k.clipped_area(square + 5, 10, 10) == 25 and k.clipped_area(square + 20, 10, 10) == 0 and k.clipped_area(square * 3 - 5, 10, 10) == 100
    shift = lambda x, y: np.array([[1.0, 0, x], [0, 1.0, y], [0, 0, 1]])
    assert k.plausible_homography(shift(300, 0), 400, 300) and not k.plausible_homography(shift(395, 0), 400, 300)
    assert not k.plausible_homography(np.diag([-1.0, 1, 1]) + shift(400, 0) - np.eye(3), 400, 300)
    a, _ = points((0, 0))
    small = a / 100 + 50
    for p, q, reason in ((a[:5], a[:5], "fewer than 12 matches"), (small, small + 3, "inliers in a small region"), (a, np.random.default_rng(1).uniform(0, 400, a.shape), "too few inliers")):
        out = fit.reliable_homography(frame(spark, p, q), 400, 400).first()
        assert not out.accepted and out.reason == reason


@pytest.mark.parametrize("shift", [(90.0, 3.0), (88.5, -6.25), (91.75, 0.5), (70.125, 12.875)])
def test_shifts_of_parts_of_pixels(shift):
    """A fine scene sampled at every eighth place, from two starts: the shift is known to an eighth, and found within 0.1 pixel."""
    fine = k.gaussian_blur(np.random.default_rng(5).integers(0, 256, (960, 2000)).astype(float) * 20, 9.0)
    fine = 128 + (fine - fine.mean()) * (45 / fine.std())
    x, y = (round(8 * v) for v in shift)
    a, b = fine[80 : 80 + 800 : 8, : 8 * 140 : 8], fine[80 + y : 80 + y + 760 : 8, x : x + 8 * 140 : 8]
    out = k.phase_correlation(a, b, (0, 1))
    assert out["status"] == "accepted" and abs(out["dx"] - shift[0]) < 0.1 and abs(out["dy"] - shift[1]) < 0.1


def test_dirt_under_masks_moves_nothing():
    """The same bright dirt on both tiles, where it would match at no shift, is out of the way under masks."""
    s = scene(11, 130, 260)
    a, b = s[:, :150].copy(), s[3:, 97:247].copy()
    dirt = scene(12, 60, 80) * 3
    dirty = np.ones(a.shape, bool), np.ones(b.shape, bool)
    for image, mask in zip((a, b), dirty):
        image[30:90, 60:140] = dirt
        mask[30:90, 60:140] = False
    out = k.phase_correlation(a, b, mask_a=dirty[0], mask_b=dirty[1])
    assert out["status"] == "accepted" and abs(out["dx"] - 97) < 0.1 and abs(out["dy"] - 3) < 0.1
    clean = k.phase_correlation(s[:, :150], s[3:, 97:247], (0, 1))
    assert clean["status"] == "accepted" and abs(clean["dx"] - 97) < 0.1
    assert k.phase_correlation(a, b, mask_a=dirty[0] & False)["status"] == "failed"


def test_masked_correlation_equals_sums():
    rng = np.random.default_rng(2)
    a, b = rng.uniform(0, 255, (9, 11)), rng.uniform(0, 255, (8, 10))
    ma, mb = rng.random((9, 11)) > 0.3, rng.random((8, 10)) > 0.3
    surface = k._masked_correlation(a, b, ma, mb, (18, 24))
    for dx, dy in ((0, 0), (3, 2), (-2, 1), (5, -3)):
        pairs = [(a[y, x], b[y - dy, x - dx]) for y in range(9) for x in range(11) if 0 <= y - dy < 8 and 0 <= x - dx < 10 and ma[y, x] and mb[y - dy, x - dx]]
        assert abs(surface[dy, dx] - np.corrcoef(np.array(pairs).T)[0, 1]) < 1e-9


def plain_warp(tiles, size, origin=(0, 0)):
    """The whole canvas at once: every pixel looks for its place in every tile by many rounds."""
    total, weight, count = np.zeros(size), np.zeros(size), np.zeros(size, int)
    gy, gx = np.mgrid[: size[0], : size[1]].astype(float)
    for t, x, y, image, mesh, mask in tiles:
        h, w = image.shape
        u = bx = gx + origin[0] - x
        v = by = gy + origin[1] - y
        for _ in range(60):
            cu, cv = np.clip(u / (w - 1), 0, 1) * 4, np.clip(v / (h - 1), 0, 1) * 4
            c, r = np.minimum(cu.astype(int), 3), np.minimum(cv.astype(int), 3)
            fu, fv = cu - c, cv - r
            m = [(1 - fu) * (1 - fv) * mesh[r, c, a] + fu * (1 - fv) * mesh[r, c + 1, a] + (1 - fu) * fv * mesh[r + 1, c, a] + fu * fv * mesh[r + 1, c + 1, a] for a in (0, 1)]
            u, v = bx - m[0], by - m[1]
        ok = (u >= 0) & (v >= 0) & (u <= w - 1) & (v <= h - 1)
        for yy, xx in zip(*np.nonzero(ok)):
            p, q = u[yy, xx], v[yy, xx]
            i, j = min(int(p), w - 2), min(int(q), h - 2)
            corners = [((1 - (p - i)) * (1 - (q - j)), j, i), ((p - i) * (1 - (q - j)), j, i + 1), ((1 - (p - i)) * (q - j), j + 1, i), ((p - i) * (q - j), j + 1, i + 1)]
            if mask is not None and sum(f * mask[b, a] for f, b, a in corners) < 0.999:
                continue
            k = min(p + 1, q + 1, w - p, h - q)
            total[yy, xx] += k * sum(f * float(image[b, a]) for f, b, a in corners)
            weight[yy, xx] += k
            count[yy, xx] += 1
    return np.clip(np.rint(total / np.maximum(weight, 1e-12)), 0, 255), count


def rendered(spark, tiles, chunk, size, meshes=True):
    rows = [(0, t, float(x), float(y), im.shape[1], im.shape[0], 1, "uint8", bytearray(im.tobytes()), [float(v) for v in mesh.ravel()] if meshes else None, None if mask is None else bytearray(mask.astype(np.uint8).tobytes())) for t, x, y, im, mesh, mask in tiles]
    frame = spark.createDataFrame(rows, "component long, tile_id long, x double, y double, width int, height int, channels int, dtype string, data binary, mesh array<double>, mask binary")
    canvas, count = np.zeros(size), np.zeros(size, int)
    for r in render.render_chunks(frame, chunk).collect():
        a, b = slice(r.cy * chunk, min((r.cy + 1) * chunk, size[0])), slice(r.cx * chunk, min((r.cx + 1) * chunk, size[1]))
        if r.cy >= 0 and r.cx >= 0 and a.start < size[0] and b.start < size[1]:
            canvas[a, b] = np.frombuffer(r.data, np.uint8).reshape(chunk, chunk)[: a.stop - a.start, : b.stop - b.start]
            count[a, b] = np.frombuffer(r.coverage, np.uint16).reshape(chunk, chunk)[: a.stop - a.start, : b.stop - b.start]
    return canvas, count


def test_meshes_and_masks_in_chunks(spark):
    """Bent and masked tiles equal a plain warp of the whole canvas, for chunks of two sizes; zero meshes change nothing."""
    rng = np.random.default_rng(3)
    tiles = []
    for t, (x, y) in enumerate([(4.25, 3.0), (50.5, 6.75), (30.0, 41.3)]):
        image = rng.integers(0, 256, (50, 61)).astype(np.uint8)
        mask = np.ones((50, 61), bool)
        mask[10:20, 12:30] = False
        tiles.append((t, x, y, image, rng.uniform(-1.5, 1.5, (5, 5, 2)), mask if t == 1 else None))
    expected, covered = plain_warp(tiles, (110, 130))
    for chunk in (32, 200):
        canvas, count = rendered(spark, tiles, chunk, (110, 130))
        assert (count == covered).all() and np.abs(canvas - expected).max() <= 1 and (canvas != expected).mean() < 1e-3
    flat = [(*t[:4], t[4] * 0, t[5]) for t in tiles]
    for a, b in zip(rendered(spark, flat, 64, (110, 130)), rendered(spark, flat, 64, (110, 130), meshes=False)):
        assert (a == b).all()
    assert (plain_warp(flat, (110, 130))[1] == rendered(spark, flat, 32, (110, 130))[1]).all()


def test_transforms_along_trees(spark):
    """Random trees, one of them a path of 3,000 tiles, against a plain walk; edges point up and down, one tree has no root."""
    rng = np.random.default_rng(6)
    parent = {n: n - 1 for n in range(1, 3000)} | {4000 + n: 4000 + int(rng.integers(0, n)) for n in range(1, 200)} | {9001: 9000}
    edges, step = [], {}
    for n, p in parent.items():
        t = rng.uniform(-0.02, 0.02)
        h = np.array([[np.cos(t), -np.sin(t), rng.uniform(-5, 5)], [np.sin(t), np.cos(t), rng.uniform(-5, 5)], [rng.uniform(-1, 1) * 1e-6, 0, 1]])
        step[n] = h
        edges.append((p, n, h.ravel().tolist()) if n % 3 else (n, p, (np.linalg.inv(h) * 2).ravel().tolist()))
    out = {r.tile_id: np.array(r.transform).reshape(3, 3) for r in graph.tree_transforms(spark.createDataFrame(edges, "i long, j long, h array<double>").repartition(4), spark.createDataFrame([(0,), (4000,), (7777,)], "tile_id long")).collect()}
    want = {0: np.eye(3), 4000: np.eye(3), 7777: np.eye(3)}
    for n in sorted(parent):
        if n < 9000:
            m = want[parent[n]] @ step[n]
            want[n] = m / m[2, 2]
    assert out.keys() == want.keys() and all(np.allclose(out[n], want[n], rtol=1e-6, atol=1e-5) for n in want)


@pytest.mark.parametrize("rows, columns, side, rounds", [(40, 40, 8, 1), (7, 19, 3, 2)])
def test_large_component_in_cells(spark, rows, columns, side, rounds):
    """Nested elimination over several levels equals the solve in one task, with outliers."""
    nodes, truth, i, j, d = grid_of(rows, columns)
    weight = np.random.default_rng(1).uniform(0.5, 2, len(i))
    edges = spark.createDataFrame([(int(a), int(b), float(x), float(y), "accepted", float(w)) for a, b, (x, y), w in zip(i, j, d, weight)], "i long, j long, dx double, dy double, status string, weight double")
    rough = spark.createDataFrame([(int(n), float(x), float(y)) for n, (x, y) in zip(nodes, truth + 1000)], "tile_id long, x double, y double")
    out = {r.tile_id: (r.x, r.y) for r in blocks.solve_large(edges.repartition(4), blocks.cells_of(rough, 90.0, 70.0, side), rounds).collect()}
    want = k.solve_translations(nodes, i, j, d, weight, rounds)
    assert len(out) == len(nodes) and np.abs(np.array([out[n] for n in nodes]) - want).max() < 1e-3
