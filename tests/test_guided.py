"""Frames that arrive without places: matching in the stream, versions, failures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.kernels import gaussian_blur
from tessera.plans import catalog
from tessera.streaming import guided

FRAME = "session string, seq long, height int, width int, channels int, dtype string, data binary"


def world(seed, h=420, w=520):
    return np.rint(gaussian_blur(np.random.default_rng(seed).integers(0, 256, (h, w)).astype(float), 1.3)).clip(0, 255).astype(np.uint8)


def frame(session, seq, scene, x, y, w=150, h=120):
    part = scene if scene is None else np.ascontiguousarray(scene[y : y + h, x : x + w])
    return (session, seq, h, w, 1, "uint8", None if part is None else bytearray(part.tobytes()))


def story():
    """Two sessions: a walk with a frame too early, one that adds nothing, one of another world and one without samples."""
    a, b, other = world(1), world(2), world(3)
    places = {("a", 0): (100, 100), ("a", 1): (180, 110), ("a", 2): (330, 200), ("a", 3): (250, 150), ("a", 4): (101, 100), ("b", 0): (10, 20), ("b", 1): (60, 80), ("b", 2): (130, 95)}
    rows = [frame(s, n, a if s == "a" else b, *at) for (s, n), at in places.items()]
    rows += [frame("a", 5, other, 50, 50), frame("b", 9, None, 0, 0)]
    return rows, places


def check(maps, places):
    out = {(r.session, r.seq): r for r in maps.decisions().collect()}
    assert {k: r.status for k, r in out.items()} == {("a", 0): "seeded", ("a", 1): "added", ("a", 2): "added", ("a", 3): "added", ("a", 4): "skipped", ("a", 5): "waiting", ("b", 0): "seeded", ("b", 1): "added", ("b", 2): "added", ("b", 9): "waiting"}
    found = {(r.session, r.seq): (r.x, r.y) for r in maps.placed().collect()}
    for (s, n), (x, y) in found.items():
        x0, y0 = places[s, 0]
        assert (x, y) == (places[s, n][0] - x0, places[s, n][1] - y0)
    return out, found


def test_stream_finds_what_one_batch_finds(spark, tmp_path):
    rows, places = story()
    whole = guided.GrowingMaps(spark, f"{tmp_path}/whole")
    whole.writer()(spark.createDataFrame(rows, FRAME), 0)
    expected, _ = check(whole, places)
    # Three triggers, the second of which fails after its artifact is written; then the stream starts again from its checkpoint.
    source, maps = f"{tmp_path}/in", guided.GrowingMaps(spark, f"{tmp_path}/maps")
    for n, part in enumerate((rows[:3] + rows[5:6], rows[3:5] + rows[8:], rows[6:8])):
        spark.createDataFrame(part, FRAME).coalesce(1).write.mode("append").parquet(f"{source}/part={n}")

    def stream(write):
        frames = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).parquet(f"{source}/part=*")
        return frames.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()

    good, failed = maps.commit, []

    def broken(artifact, batch):
        if batch == 1 and not failed:
            failed.append(artifact)
            raise RuntimeError("lost before the commit")
        return good(artifact, batch)

    maps.commit = broken
    with pytest.raises(Exception):
        stream(maps.writer()).awaitTermination()
    assert failed and maps.version() == 1 and maps.placed().count() >= 2  # the old version, whole
    before = sorted(maps.placed().collect())
    stream(maps.writer()).awaitTermination()
    out, _ = check(maps, places)
    assert maps.version() == 3 and sorted(maps.placed(1).collect()) == before
    assert {k: r.added_px for k, r in out.items() if k[0] == "b"} == {k: r.added_px for k, r in expected.items() if k[0] == "b"}
    maps.writer()(spark.createDataFrame(rows[:2], FRAME), 1)  # a batch that comes again
    assert maps.version() == 3


def test_places_that_disagree_and_limits(spark, tmp_path):
    rows = [("s", "frame", n, None, None, None, None, None, None, None, None, 100, 80) for n in range(4)]
    fits = [(1, 0, 40, 60.0, 0.0), (2, 0, 40, 0.0, 50.0), (2, 1, 30, 20.0, 0.0), (3, 0, 20, 20_000.0, 0.0)]
    rows += [("s", "fit", q, r, i, 50, x, y, None, None, None, None, None) for q, r, i, x, y in fits]
    import pandas as pd

    pdf = pd.DataFrame(rows, columns=["session", "kind", "seq", "reference", "inliers", "matches", "x", "y", "x1", "y1", "area", "width", "height"])
    out = {r.seq: (r.status, r.reason) for r in guided.decide(pdf).itertuples()}
    assert out[0][0] == "seeded" and out[1][0] == "added" and out[2] == ("rejected", "matching images disagree") and out[3] == ("rejected", "the map would grow too large")


def test_uncovered_area():
    rng = np.random.default_rng(4)
    for _ in range(20):
        boxes = rng.integers(0, 20, (6, 4)).astype(float)
        boxes[:, 2:] += boxes[:, :2]
        hit = np.zeros((60, 60), bool)
        for x0, y0, x1, y1 in boxes.astype(int):
            hit[y0:y1, x0:x1] = True
        assert guided.uncovered((5.0, 5.0, 25.0, 30.0), boxes) == (~hit[5:30, 5:25]).sum()
    assert guided.uncovered((0.0, 0.0, 3.0, 2.0), np.zeros((0, 4))) == 6
