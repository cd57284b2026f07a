"""Deterministic views that project the test tables onto the engine's relations.

The texts run unchanged in Spark and in DuckDB, so that both sides of a
comparison start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "tiles": """
SELECT tile_id, grid_row, grid_col,
       'tile_r' || lpad(CAST(grid_row AS STRING), 4, '0') || '_c' || lpad(CAST(grid_col AS STRING), 2, '0') || '.png' AS file,
       400 AS width, 300 AS height,
       grid_col * 320 + (tile_id * 7) % 11 AS true_x, grid_row * 240 + (tile_id * 5) % 9 AS true_y
FROM (SELECT p_partkey AS tile_id, CAST(FLOOR(p_partkey / 20.0) AS INT) AS grid_row, CAST(p_partkey % 20 AS INT) AS grid_col FROM part) t""",
    "slide": """
SELECT tile_id, grid_row, grid_col, 80 AS width, 64 AS height,
       grid_col * 52 + (tile_id * 7) % 5 AS true_x, grid_row * 42 + (tile_id * 5) % 4 AS true_y
FROM (SELECT s_suppkey AS tile_id, CAST(FLOOR(s_suppkey / 20.0) AS INT) AS grid_row, CAST(s_suppkey % 20 AS INT) AS grid_col FROM supplier) t""",
    "shots": """
SELECT 'row ' || CAST(grid_row AS STRING) AS session, tile_id AS seq, 180 AS width, 140 AS height,
       grid_col * 100 + (tile_id * 7) % 5 AS true_x, grid_row * 500 + (tile_id * 5) % 4 AS true_y
FROM (SELECT s_suppkey AS tile_id, CAST(FLOOR(s_suppkey / 20.0) AS INT) AS grid_row, CAST(s_suppkey % 20 AS INT) AS grid_col FROM supplier) t""",
    "edges": """
SELECT i, j, mdx + CASE WHEN (i * 31 + j) % 17 = 0 THEN 40 ELSE 0 END AS dx,
       mdy - CASE WHEN (i * 31 + j) % 17 = 0 THEN 25 ELSE 0 END AS dy,
       12 + (i * 3 + j * 5) % 50 AS inliers,
       CASE WHEN (i * 5 + j * 3) % 7 = 0 OR i % 97 = 5 OR j % 97 = 5 OR (axis = 'down' AND FLOOR(i / 20.0) % 10 = 9) THEN 'failed' ELSE 'accepted' END AS status, axis
FROM (SELECT a.tile_id i, b.tile_id j, b.true_x - a.true_x mdx, b.true_y - a.true_y mdy, 'right' axis
      FROM tiles a JOIN tiles b ON b.grid_row = a.grid_row AND b.grid_col = a.grid_col + 1
      UNION ALL
      SELECT a.tile_id, b.tile_id, b.true_x - a.true_x, b.true_y - a.true_y, 'down'
      FROM tiles a JOIN tiles b ON b.grid_row = a.grid_row + 1 AND b.grid_col = a.grid_col) e""",
    "correspondences": """
SELECT pair_id, k, x0, y0,
       CASE WHEN bad THEN (l_orderkey * 29) % 400 ELSE x0 - (100 + pair_id % 37) END AS x1,
       CASE WHEN bad THEN (l_partkey * 11) % 300 ELSE y0 + (pair_id * 3) % 23 - 11 END AS y1, score
FROM (SELECT l_suppkey pair_id, l_orderkey * 8 + l_linenumber k, l_orderkey, l_partkey,
             (l_partkey * 17) % 360 + 20 x0, (l_orderkey * 13) % 260 + 20 y0, l_linenumber >= 6 bad, l_discount score FROM lineitem) t""",
    "descriptors": "SELECT vec_id AS kp_id, CAST(vec_id % 2 AS INT) AS image, embedding AS descriptor, label FROM embeddings",
    "job_events": """
SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts,
       CASE event_type WHEN 'signup' THEN 'plan' WHEN 'view' THEN 'step' WHEN 'click' THEN 'image' WHEN 'purchase' THEN 'result' ELSE 'error' END AS type,
       least(value / 500.0, 1.0) AS fraction, props FROM events""",
}
#: What each view reads.
_NEEDS = {"tiles": "part", "slide": "supplier", "shots": "supplier", "edges": "tiles", "correspondences": "lineitem", "descriptors": "embeddings", "job_events": "events"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the Parquet tables in ``sf_dir``."""
    source = _NEEDS[name]
    frame = view(spark, sf_dir, source) if source in VIEWS else spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return spark.sql(re.sub(rf"(FROM|JOIN) {source}\b", rf"\1 {{{source}}}", VIEWS[name]), **{source: frame})


def prelude(*names: str) -> str:
    """The views as common table expressions for DuckDB."""
    order: list[str] = []
    for name in names:
        chain = [name]
        while _NEEDS[chain[-1]] in VIEWS:
            chain.append(_NEEDS[chain[-1]])
        order += [x for x in reversed(chain) if x not in order]
    return ",\n".join(f"{x} AS ({VIEWS[x]})" for x in order)
