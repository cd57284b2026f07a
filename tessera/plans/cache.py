"""Reuse of finished work by content keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Part of every key; raise it when results change.
VERSION = "1"


def content_key(*columns: str) -> Column:
    """A hash of some columns and the version."""
    return F.sha2(F.to_json(F.struct(F.lit(VERSION).alias("version"), *columns)), 256)


def stage_key(tiles: DataFrame, settings: str) -> str:
    """One key of a whole stage: its settings and the digests of all its tiles, in any order."""
    row = tiles.agg(F.sum(F.xxhash64("tile_id", "sha256").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).select(F.sha2(F.concat_ws("|", F.lit(VERSION), F.lit(settings), F.col("s").cast("string"), "n"), 256)).first()
    return row[0]


def changed_sources(stored: DataFrame, now: DataFrame) -> DataFrame:
    """Tiles whose content differs from what was registered, or is gone."""
    current = now.select("tile_id", F.sha2("content", 256).alias("now"))
    return stored.join(current, "tile_id", "left").where(~F.col("sha256").eqNullSafe(F.col("now"))).select("tile_id", "sha256", "now")


def require_unchanged(stored: DataFrame, now: DataFrame) -> None:
    """ValueError with the first tiles that changed."""
    bad = changed_sources(stored, now).orderBy("tile_id").limit(8).collect()
    if bad:
        raise ValueError(f"changed since registration: {[r.tile_id for r in bad]}")
