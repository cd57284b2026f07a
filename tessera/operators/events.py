"""The event log of jobs: sequence, progress, timings, status, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Share of the whole that each stage of a batch job stands for.
STAGE_WEIGHTS = {"plan": 0.05, "step": 0.30, "image": 0.25, "result": 0.15}


def sequence(events: DataFrame, order: list[str]) -> DataFrame:
    """Add ``seq``, the place of an event in its job."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("job_id").orderBy(*order)))


def running_progress(events: DataFrame) -> DataFrame:
    """Add ``best``: the highest fraction of a job's stage so far; an event of type ``error`` starts anew."""
    job = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    runs = events.withColumn("run", F.count_if(F.col("type") == "error").over(job))
    stage = Window.partitionBy("job_id", "type", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("best", F.max("fraction").over(stage))


def total_progress(events: DataFrame, weights: dict[str, float] = STAGE_WEIGHTS) -> DataFrame:
    """(job_id, progress): weighted sum of the latest fraction of each stage, 1 at most."""
    latest = events.groupBy("job_id", "type").agg(F.max_by("fraction", "seq").alias("fraction"))
    table = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    return latest.groupBy("job_id").agg(F.least(F.lit(1.0), F.sum(F.coalesce(table[F.col("type")], F.lit(0.0)) * F.col("fraction"))).alias("progress"))


def stage_timing(events: DataFrame) -> DataFrame:
    """(job_id, type, first_us, last_us, n): when each stage began and ended, in microseconds."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.groupBy("job_id", "type").agg(F.min(us).alias("first_us"), F.max(us).alias("last_us"), F.count("*").alias("n"))


def latest_status(events: DataFrame) -> DataFrame:
    """(job_id, seq, type, fraction) of the last event of each job: partial maxima of structs, no sort."""
    return events.groupBy("job_id").agg(F.max(F.struct("seq", "type", "fraction")).alias("e")).select("job_id", "e.*")


def replayed(history: DataFrame, live: DataFrame) -> DataFrame:
    """History followed by live events, each sequence number of a job once; the history's copy wins."""
    both = history.withColumn("from_live", F.lit(0)).unionByName(live.withColumn("from_live", F.lit(1)))
    w = Window.partitionBy("job_id", "seq").orderBy("from_live")
    return both.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "from_live")


def retained(events: DataFrame, keep: int = 40) -> DataFrame:
    """(job_id, created_us, rank) of the newest jobs by their first event."""
    jobs = events.groupBy("job_id").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("created_us"))
    return jobs.orderBy(F.desc("created_us"), "job_id").limit(keep).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("created_us"), "job_id")).cast("long"))


def forwarded(events: DataFrame, parent: str, low: float, high: float) -> DataFrame:
    """A child job's steps, images and errors as its parent's, with fractions moved into the parent's share; plans and results stay behind."""
    return events.where(~F.col("type").isin("plan", "result")).withColumn("job_id", F.lit(parent)).withColumn("fraction", low + (high - low) * F.col("fraction"))


def last_text(frame: DataFrame, column: str, n: int = 6000) -> DataFrame:
    """The last n characters of a log column."""
    return frame.withColumn(column, F.expr(f"right(`{column}`, {n})"))
