"""Live growing mosaics and the live event log as stateful streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "x0 double, y0 double, x1 double, y1 double, frames long, last_seq long"
OUTPUT = "session string, seq long, status string, x0 double, y0 double, x1 double, y1 double, frames long"
#: Frames must add so many pixels, or such a share of the covered area; a side must not pass the limit.
MIN_ADDED, MIN_SHARE, MAX_SIDE = 100.0, 0.001, 16_000.0


def grow(box: tuple | None, frame: dict, min_added: float = MIN_ADDED, min_share: float = MIN_SHARE, max_side: float = MAX_SIDE) -> tuple[str, tuple]:
    """(status, box) after a frame at (x, y) of a width and height: seeded, added, skipped (adds too little) or rejected (unplaced, or too large a map)."""
    if frame["x"] is None or frame["x"] != frame["x"]:
        return "rejected", box
    new = (frame["x"], frame["y"], frame["x"] + frame["width"], frame["y"] + frame["height"])
    if box is None:
        return "seeded", new
    both = (min(box[0], new[0]), min(box[1], new[1]), max(box[2], new[2]), max(box[3], new[3]))
    if both[2] - both[0] > max_side or both[3] - both[1] > max_side:
        return "rejected", box
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    if area(both) - area(box) < max(min_added, min_share * area(box)):
        return "skipped", box
    return "added", both


def growing_map(frames: DataFrame) -> DataFrame:
    """A stream of placed frames (session, seq, x, y, width, height) folded into growing bounds a session.

    Frames of a trigger are taken by seq; a seq that was seen is dropped, so replays change nothing.
    State is a box and two numbers; pixels stay in tables.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        box, frames_, last = None, 0, -1
        if state.exists:
            x0, y0, x1, y1, frames_, last = state.get
            box = (x0, y0, x1, y1) if frames_ else None
        rows = pd.concat(list(batches)).sort_values("seq").to_dict("records")
        out = []
        for r in rows:
            if r["seq"] <= last:
                continue
            status, box = grow(box, r)
            frames_, last = frames_ + (status in ("seeded", "added")), r["seq"]
            out.append((key[0], r["seq"], status, *(box or (None,) * 4), frames_))
        state.update((*(box or (0.0,) * 4), frames_, last))
        yield pd.DataFrame(out, columns=["session", "seq", "status", "x0", "y0", "x1", "y1", "frames"])

    return frames.groupBy("session").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def growing_map_batch(frames: DataFrame) -> DataFrame:
    """The same fold over a table of frames: one group a session."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        box, n, last, out = None, 0, -1, []
        for r in pdf.sort_values("seq").to_dict("records"):
            if r["seq"] <= last:
                continue
            status, box = grow(box, r)
            n, last = n + (status in ("seeded", "added")), r["seq"]
            out.append((r["session"], r["seq"], status, *(box or (None,) * 4), n))
        return pd.DataFrame(out, columns=["session", "seq", "status", "x0", "y0", "x1", "y1", "frames"])

    return frames.groupBy("session").applyInPandas(fold, OUTPUT)


def deduplicated_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (job_id, seq) once, within a watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id", "seq"])


def job_status(events: DataFrame) -> DataFrame:
    """The latest event of each job; for update mode."""
    return events.groupBy("job_id").agg(F.max(F.struct("seq", "type", "fraction")).alias("last")).select("job_id", "last.*")


def windowed_activity(events: DataFrame, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Events by window and type."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "type", "n")


def sessions(frames: DataFrame, controls: DataFrame) -> DataFrame:
    """Frames of sessions that were not finished or deleted before them, from control rows (session, seq, action)."""
    ends = controls.where(F.col("action").isin("finish", "delete")).groupBy("session").agg(F.min("seq").alias("closed"))
    return frames.join(ends, "session", "left").where(F.col("closed").isNull() | (F.col("seq") < F.col("closed"))).drop("closed")


def isolated(write):
    """A foreachBatch function whose failures are noted in ``errors`` and never stop the stream."""
    errors: list[tuple[int, str]] = []

    def run(batch: DataFrame, number: int) -> None:
        try:
            write(batch, number)
        except Exception as e:  # a broken transport must not end the job
            errors.append((number, str(e)))

    run.errors = errors
    return run
