"""Maps that grow by frames whose places must be found: propose, persist, commit.

A frame is matched with the originals that are placed already, not with a blend of them. A batch of a stream
is a proposal over the last committed version: pairs of frames are joined and matched in
tasks, and what is left, some numbers a pair, is decided in the order of the frames of each
session. The proposal is written as an artifact under a name of its own, and
becomes a version by one row of the table of commits. Tables are only ever appended to; a reader sees
what is committed, so a failure before the commit leaves the version before, and a batch that comes again after its commit does nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import features, kernels
from tessera.operators import fit, graph
from tessera.sources.images import array_of

FEATURES = "session string, seq bigint, width int, height int, points binary, descriptors binary"
DECISIONS = "session string, seq bigint, status string, reason string, x double, y double, width int, height int, reference bigint, inliers bigint, matches bigint, added_px bigint"
COMMITS = "version bigint, run string, batch bigint, artifact string"
FITS = "session string, seq bigint, reference bigint, inliers bigint, matches bigint, dx double, dy double"
PLACED = ("seeded", "added")
#: Parts over which the placed originals of one session are dealt at most, and originals that one part has before there is another.
SALTS, PART = 16, 64
#: Pixels that must be shared and added, the share of the map that must be added, the limits of a map, and how far places may disagree.
MIN_SHARED, MIN_ADDED, MIN_SHARE, MAX_SIDE, MAX_PIXELS, DISAGREE = 100, 100, 0.001, 16_000, 40_000_000, 12.0


def extract(frames: DataFrame, limit: int = 256) -> DataFrame:
    """Corners of frames (session, seq and samples) with their descriptors, as packed 32-bit floats; a frame without samples has none."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                if r["data"] is None:
                    rows.append((r["session"], r["seq"], 0, 0, b"", b""))
                    continue
                image = array_of(r)
                points = features.harris(image, limit)[0]
                rows.append((r["session"], r["seq"], r["width"], r["height"], points.astype("<f4").tobytes(), features.patches(image, points).astype("<f4").tobytes()))
            yield pd.DataFrame(rows, columns=["session", "seq", "width", "height", "points", "descriptors"])

    wanted = frames.select(F.col("session").cast("string").alias("session"), F.col("seq").cast("long").alias("seq"), "height", "width", "channels", "dtype", "data")
    return wanted.where("session IS NOT NULL AND seq IS NOT NULL").dropDuplicates(["session", "seq"]).mapInPandas(run, FEATURES)


def matched(new: DataFrame, known: DataFrame, salts: int = SALTS) -> DataFrame:
    """Reliable displacements (``FITS``) of frames against originals of the same session: (dx, dy) is the frame's place in the original's coordinates.

    The originals of a session are dealt over up to ``salts`` parts, as their number asks for, and the frames sent to each, so one session
    with most of all originals isn't one task, and a session of few isn't sent about many times.
    """
    parts = known.groupBy("session").agg(F.least(F.ceil(F.count("*") / PART), F.lit(salts)).cast("int").alias("parts"))
    # Spark doesn't know how long descriptors are, so the joins are named: they are never broadcast.
    side = lambda df, s: df.select("session", F.col("seq").alias(f"seq_{s}"), F.struct("width", "height", "points", "descriptors").alias(s)).hint("merge").join(parts, "session")
    a = side(new, "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    b = side(known, "b").withColumn("salt", F.pmod(F.xxhash64("seq_b"), F.col("parts")).cast("int")).drop("parts")

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                (pa, da), (pb, db) = (unpack(r[s]) for s in "ab")
                i, j, _ = features.ratio_matches(da, db, 0.8)
                w, h = max(r["a"]["width"], r["b"]["width"]), max(r["a"]["height"], r["b"]["height"])
                found = kernels.translation_consensus(pa[i], pb[j], w, h, 3.0, True, fit.HYPOTHESES, fit.REFINEMENTS)
                if found["inliers"] >= max(fit.MIN_MATCHES, fit.MIN_SHARE * found["n"]) and min(found["hull0"], found["hull1"]) >= fit.MIN_HULL:
                    rows.append((r["session"], r["seq_a"], r["seq_b"], found["inliers"], found["n"], found["tx"], found["ty"]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FITS.split(", ")])

    return a.hint("merge").join(b, ["session", "salt"]).where("seq_a <> seq_b").drop("salt").mapInPandas(run, FITS)


def unpack(r: dict) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(r["points"], "<f4").reshape(-1, 2).astype(float)
    return points, np.frombuffer(r["descriptors"], "<f4").reshape(len(points), -1 if len(points) else 1).astype(float)


def uncovered(box: tuple[float, float, float, float], boxes: np.ndarray) -> float:
    """The area of a box (x0, y0, x1, y1) that none of the others (rows) covers: cells between all their edges within it."""
    clipped = np.c_[np.maximum(boxes[:, :2], box[:2]), np.minimum(boxes[:, 2:], box[2:])] if len(boxes) else np.zeros((0, 4))
    clipped = clipped[(clipped[:, 0] < clipped[:, 2]) & (clipped[:, 1] < clipped[:, 3])]
    xs, ys = (np.unique(np.r_[clipped[:, k], clipped[:, k + 2], box[k], box[k + 2]]) for k in (0, 1))
    hit = np.zeros((len(ys), len(xs)), bool)
    for x0, y0, x1, y1 in clipped:
        hit[np.searchsorted(ys, y0) : np.searchsorted(ys, y1), np.searchsorted(xs, x0) : np.searchsorted(xs, x1)] = True
    return float((~hit[:-1, :-1] * np.diff(ys)[:, None] * np.diff(xs)[None]).sum())


class Session:
    """One session's map as boxes: what is decided of a frame depends on those before it."""

    def __init__(self, boxes: np.ndarray, bounds: tuple | None, area: float):
        self.boxes, self.bounds, self.area = boxes, bounds, area

    def seed(self, width: int, height: int) -> tuple[str, str | None, float]:
        if max(width, height) > MAX_SIDE:
            return "rejected", "larger than a map may be", 0.0
        return self._place((0.0, 0.0, float(width), float(height)), "seeded")

    def add(self, x: float, y: float, width: int, height: int) -> tuple[str, str | None, float]:
        box = (x, y, x + width, y + height)
        both = (min(self.bounds[0], x), min(self.bounds[1], y), max(self.bounds[2], box[2]), max(self.bounds[3], box[3]))
        w, h = both[2] - both[0], both[3] - both[1]
        if max(w, h) > MAX_SIDE or w * h > MAX_PIXELS:
            return "rejected", "the map would grow too large", 0.0
        added = uncovered(box, self.boxes)
        if width * height - added < MIN_SHARED:
            return "rejected", "too little overlap with the map", 0.0
        if added < max(MIN_ADDED, int(MIN_SHARE * self.area)):
            return "skipped", "adds nothing to the map", 0.0
        return self._place(box, "added")

    def _place(self, box: tuple[float, float, float, float], status: str) -> tuple[str, str | None, float]:
        added = uncovered(box, self.boxes)
        self.boxes = np.r_[self.boxes, [box]]
        self.bounds = box if self.bounds is None else (*np.minimum(self.bounds[:2], box[:2]), *np.maximum(self.bounds[2:], box[2:]))
        self.area += added
        return status, None, added


def decide(pdf: pd.DataFrame) -> pd.DataFrame:
    """Decisions on one session's frames, from rows of four kinds: 'map' (bounds and area), 'box' (a placed original near them), 'frame' and 'fit'.

    Frames are taken by number, again and again until none is placed any more, so an early frame may wait for a later one.
    """
    maps, near, frames, fits = (pdf[pdf.kind == k] for k in ("map", "box", "frame", "fit"))
    known = {int(r.seq): (r.x, r.y) for r in near.itertuples()}
    boxes = np.c_[near.x, near.y, near.x + near.width, near.y + near.height].astype(float) if len(near) else np.zeros((0, 4))
    state = Session(boxes, None, 0.0)
    if len(maps):
        m = maps.iloc[0]
        state = Session(boxes, (m.x, m.y, m.x1, m.y1), m.area)
    links: dict[int, list] = {}
    for r in fits.sort_values(["seq", "reference"]).itertuples():
        links.setdefault(int(r.seq), []).append((int(r.inliers), int(r.reference), int(r.matches), r.x, r.y))
    left = {int(r.seq): (int(r.width), int(r.height)) for r in frames.sort_values("seq").itertuples()}
    out = []

    def done(seq: int, status: str, reason: str | None, x=None, y=None, best=(None, None, None), added=0.0) -> None:
        w, h = left.pop(seq)
        out.append((pdf.session.iloc[0], seq, status, reason, x, y, w, h, best[1], best[0], best[2], int(added)))
        if status in PLACED:
            known[seq] = (x, y)

    while True:
        before = len(known)
        for seq in list(left):
            w, h = left[seq]
            if state.bounds is None:
                if w and h:
                    status, reason, added = state.seed(w, h)
                    done(seq, status, reason, 0.0, 0.0, added=added) if status in PLACED else done(seq, status, reason)
                continue
            found = [(n, ref, m, known[ref][0] + dx, known[ref][1] + dy) for n, ref, m, dx, dy in links.get(seq, []) if ref in known]
            if not found:
                continue
            best = max(found, key=lambda f: (f[0], -f[1]))
            if any(f[0] >= max(fit.MIN_MATCHES, 0.5 * best[0]) and np.hypot(f[3] - best[3], f[4] - best[4]) > DISAGREE for f in found):
                done(seq, "rejected", "matching images disagree", best=best[:3])
                continue
            status, reason, added = state.add(best[3], best[4], w, h)
            done(seq, status, reason, best[3] if status in PLACED else None, best[4] if status in PLACED else None, best[:3], added)
        if len(known) == before:
            break
    for seq in list(left):
        done(seq, "waiting", "no reliable overlap with the map")
    kinds = {"reference": "Int64", "inliers": "Int64", "matches": "Int64", "x": float, "y": float}
    return pd.DataFrame(out, columns=[c.split()[0] for c in DECISIONS.split(", ")]).astype(kinds)


class GrowingMaps:
    """Maps of many sessions under one folder that all machines share: ``features``, ``decisions`` and ``commits``."""

    def __init__(self, spark: SparkSession, path: str, run: str = "run"):
        self.spark, self.path, self.run = spark, path.rstrip("/"), run

    def _table(self, name: str, schema: str) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def commits(self) -> DataFrame:
        """(version, run, batch, artifact), a row a commit."""
        return self._table("commits", COMMITS)

    def version(self) -> int:
        return self.commits().agg(F.max("version")).first()[0] or 0

    def _committed(self, name: str, schema: str, version: int | None) -> DataFrame:
        seen = self.commits() if version is None else self.commits().where(F.col("version") <= version)
        return self._table(name, schema + ", artifact string").join(F.broadcast(seen.select("artifact", "version")), "artifact")  # a row a batch

    def decisions(self, version: int | None = None) -> DataFrame:
        """The last decision on each frame (``DECISIONS`` and its version), as of a version."""
        rows = self._committed("decisions", DECISIONS, version).drop("artifact")
        return rows.groupBy("session", "seq").agg(F.max_by(F.struct(*rows.columns), "version").alias("r")).select("r.*")

    def placed(self, version: int | None = None) -> DataFrame:
        """(session, seq, x, y, width, height) of the originals of each map, as of a version; pixels stay with the frames."""
        return self.decisions(version).where(F.col("status").isin(*PLACED)).select("session", "seq", "x", "y", "width", "height")

    def propose(self, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(features, decisions) for new frames (session, seq and samples) over the last version; the version isn't touched.

        New frames meet all placed originals and each other; frames that wait meet only new ones, since they met the others before. Frames
        that are placed already are left out.
        """
        last = graph.cut(self.decisions())
        placed = last.where(F.col("status").isin(*PLACED))
        new = graph.cut(extract(frames).join(placed.select("session", "seq"), ["session", "seq"], "left_anti"))
        stored = self._committed("features", FEATURES, None).drop("artifact", "version").dropDuplicates(["session", "seq"])
        touched = new.select("session").distinct()
        stored = stored.join(touched, "session", "left_semi")
        waits = last.where("status = 'waiting'").join(new.select("session", "seq"), ["session", "seq"], "left_anti").join(touched, "session", "left_semi")
        old = stored.join(placed.select("session", "seq"), ["session", "seq"], "left_semi")
        waiting = stored.join(waits.select("session", "seq"), ["session", "seq"], "left_semi")
        fits = matched(new, old).union(matched(new, new)).union(matched(waiting, new)).union(matched(new, waiting))
        fits = graph.cut(fits)
        pending = new.select("session", "seq", "width", "height").union(waits.select("session", "seq", "width", "height"))
        return new, self._decided(pending, fits, placed.join(touched, "session", "left_semi"))

    def _decided(self, pending: DataFrame, fits: DataFrame, placed: DataFrame) -> DataFrame:
        empty = {c: F.lit(None).cast(t) for c, t in (("seq", "long"), ("reference", "long"), ("inliers", "long"), ("matches", "long"), ("x", "double"), ("y", "double"), ("x1", "double"), ("y1", "double"), ("area", "double"), ("width", "int"), ("height", "int"))}
        row = lambda df, kind, **own: df.select("session", F.lit(kind).alias("kind"), *(own.get(c, e).alias(c) for c, e in empty.items()))
        col = lambda *names: {c: F.col(c) for c in names}
        maps = placed.groupBy("session").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1"), F.sum("added_px").cast("double").alias("area"))
        # Only originals that the batch's frames can reach go along: around the places that they match, as far as so many frames may go.
        reach = pending.groupBy("session").agg(((F.count("*") + 1) * F.max(F.greatest("width", "height"))).alias("reach"))
        at = fits.join(placed.select("session", F.col("seq").alias("reference"), "x", "y"), ["session", "reference"])
        around = at.groupBy("session").agg(F.min("x").alias("ax"), F.min("y").alias("ay"), F.max("x").alias("bx"), F.max("y").alias("by")).join(reach, "session")
        side = F.greatest("width", "height")
        near = placed.join(around, "session").where((F.col("x") + side >= F.col("ax") - F.col("reach")) & (F.col("x") <= F.col("bx") + F.col("reach") + side) & (F.col("y") + side >= F.col("ay") - F.col("reach")) & (F.col("y") <= F.col("by") + F.col("reach") + side))
        rows = row(maps, "map", **col("x", "y", "x1", "y1", "area")).union(row(near, "box", **col("seq", "x", "y", "width", "height"))).union(row(pending, "frame", **col("seq", "width", "height")))
        rows = rows.union(row(fits, "fit", **col("seq", "reference", "inliers", "matches"), x=F.col("dx"), y=F.col("dy")))
        return rows.groupBy("session").applyInPandas(decide, DECISIONS)

    def persist(self, proposal: tuple[DataFrame, DataFrame]) -> str:
        """Write a proposal under a new name, which nobody sees before its commit."""
        artifact = uuid.uuid4().hex
        for name, rows in zip(("features", "decisions"), proposal):
            rows.write.parquet(f"{self.path}/{name}/artifact={artifact}")
        return artifact

    def commit(self, artifact: str, batch: int) -> int:
        """Make an artifact the next version: one row in one file, which appears as a whole."""
        version = self.version() + 1
        self.spark.createDataFrame([(version, self.run, batch, artifact)], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return version

    def is_committed(self, batch: int) -> bool:
        return not self.commits().where((F.col("run") == self.run) & (F.col("batch") == batch)).isEmpty()

    def writer(self) -> Callable[[DataFrame, int], None]:
        """The function for ``foreachBatch``; a batch that was committed before is passed over. One writer a folder."""

        def write(frames: DataFrame, batch: int) -> None:
            if not self.is_committed(batch):
                self.commit(self.persist(self.propose(frames)), batch)

        return write
