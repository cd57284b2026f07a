"""Tile scans: listing, name templates, manifests and their checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Image files that a listing takes.
EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")
MAX_TEMPLATE = 256


def list_images(spark: SparkSession, directory: str) -> DataFrame:
    """(path, modificationTime, length, content) of the image files below a directory, by path; contents are read only if selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*EXTENSIONS)).orderBy("path")


def with_digest(files: DataFrame) -> DataFrame:
    """Add sha256 of each file's content."""
    return files.withColumn("sha256", F.sha2("content", 256))


def compile_template(template: str) -> tuple[str, int, int]:
    """A Java pattern for a file-name template, and the groups that hold row and column.

    ``{row}`` and ``{col}`` (or ``{rNN}``, ``{cNN}``: the letter, then digits) take numbers, ``{prefix}``
    takes any text; all else stands for itself, in either case.
    """
    if not template or len(template) > MAX_TEMPLATE:
        raise ValueError(f"a template has 1 to {MAX_TEMPLATE} characters")
    tokens = {"{prefix}": ".+?", "{row}": r"(\d+)", "{col}": r"(\d+)", "{rNN}": r"r(\d+)", "{cNN}": r"c(\d+)"}
    groups: list[str] = []
    parts = []
    for part in re.split(r"(\{[^{}]*\})", template):
        if part in tokens:
            parts.append(tokens[part])
            if "(" in tokens[part]:
                groups.append(part[1])
        elif re.fullmatch(r"\{[^{}]*\}", part):
            raise ValueError(f"unknown token {part}")
        else:
            parts.append(re.escape(part))
    if sorted(groups) != ["c", "r"]:
        raise ValueError("a template has one row and one column token")
    return f"(?i)^{''.join(parts)}$", groups.index("r") + 1, groups.index("c") + 1


def positions(names: DataFrame, template: str, name: str = "file", order: str = "idx") -> DataFrame:
    """Add grid_row, grid_col and error (null if the name is good) to named files.

    A name that doesn't match the template, or that takes a cell which the name
    before it at this cell has, is an error.
    """
    pattern, row, col = compile_template(template)
    number = lambda g: F.regexp_extract(name, pattern, g).try_cast("int")
    parsed = names.withColumn("grid_row", number(row)).withColumn("grid_col", number(col))
    lost = F.col("grid_row").isNull() | F.col("grid_col").isNull()
    # Names without a cell are spread by themselves.
    before = F.lag(name).over(Window.partitionBy("grid_row", "grid_col", F.when(lost, F.col(name))).orderBy(order))
    error = F.when(lost, F.lit("name doesn't match the template")).when(before.isNotNull(), F.concat(F.lit("same cell as "), before))
    return parsed.withColumn("error", error)


def require_positions(placed: DataFrame, order: str = "idx", shown: int = 8) -> DataFrame:
    """The frame itself; ValueError with the first errors if it has some."""
    errors = placed.where("error IS NOT NULL").orderBy(order).limit(shown).collect()
    if errors:
        raise ValueError("; ".join(r.error for r in errors))
    return placed


def snake_order(tiles: DataFrame) -> DataFrame:
    """Add ``step``: the place of a tile on a path that goes along even rows and back along odd ones (by rank of the row)."""
    ranked = _row_rank(tiles)
    along = F.when(F.col("row_rank") % 2 == 0, F.col("grid_col")).otherwise(-F.col("grid_col"))
    in_row = F.row_number().over(Window.partitionBy("grid_row").orderBy(along))
    return ranked.withColumn("step", (F.col("before") + in_row).cast("long")).drop("before", "row_rank")


def _row_rank(tiles: DataFrame) -> DataFrame:
    """Rank of each row and number of tiles in the rows before it, from one small row per grid row."""
    rows = tiles.groupBy("grid_row").agg(F.count("*").alias("n"))
    order = Window.orderBy("grid_row")
    ranks = rows.select("grid_row", (F.row_number().over(order) - 1).alias("row_rank"), (F.sum("n").over(order) - F.col("n")).alias("before"))
    return tiles.join(ranks, "grid_row")


def layout_slice(tiles: DataFrame, rows: int, columns: int) -> DataFrame:
    """The tiles of the upper left corner of the grid."""
    return tiles.where((F.col("grid_row") < rows) & (F.col("grid_col") < columns))


def duplicate_cells(tiles: DataFrame) -> DataFrame:
    """Cells of more than one tile."""
    return tiles.groupBy("grid_row", "grid_col").agg(F.count("*").alias("n"), F.min("tile_id").alias("first_tile")).where("n > 1")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a tile of a JSON manifest: its fields, and those of the manifest as ``manifest_*``."""
    raw = spark.read.option("multiLine", True).json(path)
    return raw.select(F.col("schema_version").alias("manifest_version"), F.col("grid").alias("manifest_grid"), F.posexplode("tiles").alias("idx", "tile")).select("manifest_version", "manifest_grid", "idx", "tile.*")


def check_manifest(tiles: DataFrame) -> DataFrame:
    """(check, tile) of each violated constraint of manifest tiles; no row means the manifest is good.

    Checked: version 1.0, directions, overlap fractions within (0, 1), unique
    ids and cells, positive calibration, one layout for all.
    """
    field = lambda name: F.col(name) if name in tiles.columns else F.lit(None)
    grid = set(tiles.schema["manifest_grid"].dataType.names)
    part = lambda name: F.col(f"manifest_grid.{name}") if name in grid else F.lit(None)
    checks: list[tuple[str, Column]] = [
        ("version", F.coalesce(F.col("manifest_version") != "1.0", F.lit(True))),
        ("row direction", part("row_direction") != "+y"),
        ("column direction", part("column_direction") != "+x"),
        ("overlap x", ~((part("nominal_overlap_fraction_x") > 0) & (part("nominal_overlap_fraction_x") < 1))),
        ("overlap y", ~((part("nominal_overlap_fraction_y") > 0) & (part("nominal_overlap_fraction_y") < 1))),
        ("id", F.coalesce(F.col("id") == "", F.lit(True))),
        ("calibration x", field("pixel_size_um_x") <= 0),
        ("calibration y", field("pixel_size_um_y") <= 0),
    ]
    single = [tiles.where(F.coalesce(bad.cast("boolean"), F.lit(False))).select(F.lit(name).alias("check"), F.col("id").alias("tile")) for name, bad in checks]
    ids = tiles.groupBy("id").count().where("count > 1").select(F.lit("unique id").alias("check"), F.col("id").alias("tile"))
    cells = tiles.groupBy("row", "column").agg(F.count("*").alias("n"), F.max("id").alias("tile")).where("n > 1").select(F.lit("unique cell").alias("check"), "tile")
    layout = [c for c in ("width", "height", "dtype", "channels", "timepoint", "plane", "z_index", "pixel_size_um_x", "pixel_size_um_y") if c in tiles.columns]
    out = ids.unionByName(cells)
    if layout:
        kinds = tiles.groupBy(*layout).agg(F.min("id").alias("tile"))
        out = out.unionByName(kinds.withColumn("n", F.count("*").over(Window.partitionBy())).where("n > 1").select(F.lit("layout").alias("check"), "tile"))
    for s in single:
        out = out.unionByName(s)
    return out


def match_uploads(tiles: DataFrame, uploads: DataFrame, path: str = "path", name: str = "name") -> DataFrame:
    """Add the upload of each tile; ``missing`` where there is none. Every tile stays one row.

    An upload's name must end the path at a folder's border: a plain name is the path's base name, and one with folders says in which of
    several folders with files of that name it belongs. The longest name that fits is taken.
    """
    parts = lambda c: F.split(F.col(c).cast("string"), r"[/\\]")
    named = uploads.select(F.array_join(parts(name), "/").alias("__end"), F.col(name).alias("upload")).groupBy("__end").agg(F.min("upload").alias("upload"))
    # A path's ends, one for each of its folders and one without any, make this an equi-join.
    ends = tiles.select(F.col(path).alias("__path"), parts(path).alias("p")).distinct().select("__path", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"))
    ends = ends.select("__path", "n", F.array_join(F.slice("p", -F.col("n"), F.col("n")), "/").alias("__end")).where("__end <> ''")
    found = ends.join(named, "__end").groupBy("__path").agg(F.max_by("upload", "n").alias("upload"))
    return tiles.join(found, tiles[path] == found["__path"], "left").drop("__path").withColumn("missing", F.col("upload").isNull())


def watch_images(spark: SparkSession, directory: str) -> DataFrame:
    """A stream of the image files that arrive in a directory; each file comes once."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*EXTENSIONS))


def data_url(content: str, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(content))


def from_data_url(url: str) -> Column:
    """The bytes of a data URL; null if it is none or broken."""
    body = F.regexp_extract(url, r"^data:image/[a-z+]+;base64,(.*)$", 1)
    return F.when(body != "", F.try_to_binary(F.regexp_replace(body, r"\s", ""), F.lit("base64")))
