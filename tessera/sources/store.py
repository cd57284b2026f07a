"""Tables and artifacts of runs: events, projects, attempts, residuals, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import numbered

EVENT = "job_id string, seq bigint, type string, marker string, status string, message string, level string, fraction double, image string, ts timestamp"


def append_events(events: DataFrame, path: str) -> None:
    """One JSON object a line, by job."""
    events.write.mode("append").partitionBy("job_id").json(path)


def read_events(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    """Events of a log; blank and broken lines are skipped, and relative images get a prefix."""
    rows = spark.read.schema(EVENT + ", _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    good = rows.where("_broken IS NULL AND seq IS NOT NULL").drop("_broken")
    if prefix is None:
        return good
    relative = F.col("image").isNotNull() & ~F.col("image").rlike("^(/|data:|https?:)")
    return good.withColumn("image", F.when(relative, F.concat(F.lit(prefix), F.col("image"))).otherwise(F.col("image")))


def save_projects(projects: DataFrame, path: str) -> None:
    """Projects (id, name, created_at, status, ...), one folder each."""
    projects.write.mode("append").partitionBy("id").parquet(path)


def list_projects(spark: SparkSession, path: str) -> DataFrame:
    """Projects, the newest first."""
    return spark.read.parquet(path).orderBy(F.desc("created_at"), "id")


def renamed(projects: DataFrame, project: str, name: str) -> DataFrame:
    return projects.withColumn("name", F.when(F.col("id") == project, F.lit(name)).otherwise(F.col("name")))


def thumbnails(projects: DataFrame, shots: DataFrame) -> DataFrame:
    """(id, thumbnail): the result, else the first shot by name, else null."""
    first = shots.groupBy("id").agg(F.min("path").alias("shot"))
    return projects.join(first, "id", "left").select("id", F.coalesce("result", "shot").alias("thumbnail"))


def save_attempts(attempts: DataFrame, path: str) -> None:
    attempts.write.mode("overwrite").json(path)


def save_residuals(residuals: DataFrame, path: str) -> None:
    """CSV with the header i, j, residual_px, flagged."""
    residuals.select("i", "j", "residual_px", "flagged").write.mode("overwrite").option("header", True).csv(path)


def save_correspondences(matches: DataFrame, path: str) -> None:
    """Parquet, clustered by pair."""
    matches.repartition("pair_id").sortWithinPartitions("pair_id", "k").write.mode("overwrite").parquet(path)


def save_finite(frame: DataFrame, path: str) -> None:
    """Parquet of a frame that has no NaN and no infinity in a floating column; ValueError if it has."""
    numbers = [f.name for f in frame.schema.fields if f.dataType.simpleString() in ("double", "float")]
    odd = [F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in numbers]
    if odd and (bad := [c for c, n in frame.agg(*odd).first().asDict().items() if n]):
        raise ValueError(f"values that aren't finite in {bad}")
    frame.write.mode("overwrite").parquet(path)


def quality_pages(tiles: DataFrame, size: int = 2000) -> DataFrame:
    """(page, html): HTML tables of all tiles (tile_id, component, x, y, evidence) by id, escaped, ``size`` tiles a page."""
    columns = ["tile_id", "component", "x", "y", "evidence"]

    def escaped(name: str) -> Column:
        out = F.coalesce(F.col(name).cast("string"), F.lit(""))
        for mark, text in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            out = F.replace(out, F.lit(mark), F.lit(text))
        return F.concat(F.lit("<td>"), out, F.lit("</td>"))

    rows = numbered(tiles.select(*columns), [F.col("tile_id"), F.col("component")], "place")
    row = F.concat(F.lit("<tr>"), *(escaped(c) for c in columns), F.lit("</tr>"))
    pages = rows.groupBy(F.floor((F.col("place") - 1) / size).cast("long").alias("page")).agg(F.array_sort(F.collect_list(F.struct("place", row.alias("row")))).alias("rows"))
    head = "<!DOCTYPE html><meta charset='utf-8'><table><tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"
    return pages.select("page", F.concat(F.lit(head), F.array_join("rows.row", ""), F.lit("</table>")).alias("html"))


def save_graph(tiles: DataFrame, edges: DataFrame, named: DataFrame, path: str) -> None:
    """A JSON object a tile: its component and all tested pairs (i, j, status, inliers) in which it comes first."""
    tested = edges.groupBy(F.col("i").alias("tile_id")).agg(F.array_sort(F.collect_list(F.struct("j", "status", "inliers"))).alias("pairs"))  # a tile's own neighbours
    tiles.select("tile_id").join(named, "tile_id", "left").join(tested, "tile_id", "left").write.mode("overwrite").json(path)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """(tile_id, component, pairs) of a saved graph."""
    return spark.read.schema("tile_id bigint, component bigint, pairs array<struct<j:bigint,status:string,inliers:bigint>>").json(path)


REPORT = "run string, engine string, status string, error string, elapsed double, accepted bigint, components bigint"


def save_report(rows: DataFrame, path: str) -> None:
    """Rows of a comparison, failed ones with their error, as JSON lines by run."""
    rows.write.mode("append").partitionBy("run").json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all reports in a folder."""
    return spark.read.schema(REPORT).json(path)


def artifacts(files: DataFrame) -> DataFrame:
    """Files that a run shows: images, tables and reports, without sources, caches and parts."""
    return files.where(F.col("path").rlike(r"(?i)\.(png|jpe?g|tiff?|json|jsonl|csv|html)$") & ~F.col("path").rlike(r"/(sources|inputs|cache)/|\.partial\."))
