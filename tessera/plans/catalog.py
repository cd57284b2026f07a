"""Registry of the engine's named queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import blocks, events, fit, graph, layout, match, pairs, render, report
from tessera.plans import cache, engines, mosaic, synthetic
from tessera.plans.views import prelude, view
from tessera.sources import images, scan
from tessera.streaming import growing, guided

Query = Callable[[SparkSession, str], DataFrame]
TEMPLATE = "tile_{rNN}_{cNN}.png"
_REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Register a query by its function's name, with its DuckDB text over some views."""

    def add(f: Query) -> Query:
        text = None if sql is None else f"WITH RECURSIVE {prelude(*views)}{',' if sql.lstrip().startswith('+') else ''}\n{sql.lstrip().lstrip('+')}" if views else sql
        _REGISTRY[f.__name__] = (f, text)
        return f

    return add


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTRY.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tiles connect, and where is each? Names to cells to neighbours to components to places."""
    return layout_poses(spark, sf_dir)


#: Components of accepted edges, as DuckDB finds them.
_COMPONENTS = """+ und AS (SELECT i a, j b FROM edges WHERE status = 'accepted' UNION ALL SELECT j, i FROM edges WHERE status = 'accepted'),
r(n, l) AS (SELECT tile_id, tile_id FROM tiles UNION SELECT und.b, r.l FROM r JOIN und ON und.a = r.n WHERE und.b > r.l),
comp AS (SELECT n AS tile_id, min(l) AS component FROM r GROUP BY n)
"""


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "tiles")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "edges")


def _components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_edges(spark, d).where("status = 'accepted'"), _tiles(spark, d))


# ---------------------------------------------------------------- scans


@query("SELECT tile_id, file, CAST(regexp_extract(file, '_r(\\d+)', 1) AS INT) AS grid_row, CAST(regexp_extract(file, '_c(\\d+)', 1) AS INT) AS grid_col FROM tiles", "tiles")
def scan_tile_positions(spark, d):
    names = _tiles(spark, d).select("tile_id", "file")
    return scan.positions(names, TEMPLATE, order="tile_id").select("tile_id", "file", "grid_row", "grid_col")


@query("SELECT tile_id, CASE WHEN lag(file) OVER (PARTITION BY CAST(floor(grid_row / 2.0) AS INT), grid_col ORDER BY tile_id) IS NULL THEN 0 ELSE 1 END AS duplicate FROM tiles", "tiles")
def scan_name_errors(spark, d):
    names = _tiles(spark, d).select("tile_id", F.concat(F.lit("a_r"), F.floor(F.col("grid_row") / 2).cast("string"), F.lit("_c"), F.col("grid_col").cast("string")).alias("file"))
    return scan.positions(names, "{prefix}_{rNN}_{cNN}", order="tile_id").select("tile_id", F.col("error").isNotNull().cast("int").alias("duplicate"))


@query("SELECT CAST(floor(grid_row / 2.0) AS INT) AS grid_row, grid_col, count(*) AS n, min(tile_id) AS first_tile FROM tiles GROUP BY 1, 2 HAVING count(*) > 1", "tiles")
def scan_duplicate_cells(spark, d):
    return scan.duplicate_cells(_tiles(spark, d).withColumn("grid_row", F.floor(F.col("grid_row") / 2).cast("int")))


@query("SELECT tile_id, row_number() OVER (ORDER BY grid_row, CASE WHEN (SELECT count(DISTINCT u.grid_row) FROM tiles u WHERE u.grid_row < tiles.grid_row) % 2 = 0 THEN grid_col ELSE -grid_col END) AS step FROM tiles", "tiles")
def scan_snake_order(spark, d):
    return scan.snake_order(_tiles(spark, d)).select("tile_id", "step")


@query("SELECT tile_id, grid_row, grid_col FROM tiles WHERE grid_row < 4 AND grid_col < 5", "tiles")
def scan_layout_slice(spark, d):
    return scan.layout_slice(_tiles(spark, d), 4, 5).select("tile_id", "grid_row", "grid_col")


@query("SELECT tile_id, file, CASE WHEN tile_id % 3 <> 0 THEN file END AS upload, tile_id % 3 = 0 AS missing FROM tiles", "tiles")
def scan_match_uploads(spark, d):
    """Names are four digits of the row, so that rows beyond 9999 repeat them: each row has a folder, and uploads name it."""
    inside = F.concat(F.col("grid_row").cast("string"), F.lit("/"), F.col("file"))
    t = _tiles(spark, d).withColumn("inside", inside)
    matched = scan.match_uploads(t.select("tile_id", "file", F.concat(F.lit("slides/"), "inside").alias("path")), t.where("tile_id % 3 <> 0").select(F.col("inside").alias("name")))
    return matched.select("tile_id", "file", F.element_at(F.split("upload", "/"), -1).alias("upload"), "missing")


@query("SELECT tile_id, sha256(file) AS sha256 FROM tiles", "tiles")
def scan_digest(spark, d):
    return scan.with_digest(_tiles(spark, d).select("tile_id", F.encode("file", "UTF-8").alias("content"))).select("tile_id", "sha256")


@query("SELECT tile_id, file AS text FROM tiles", "tiles")
def scan_data_url(spark, d):
    t = _tiles(spark, d).withColumn("b", F.encode("file", "UTF-8"))
    return t.withColumn("url", scan.data_url("b")).select("tile_id", F.decode(scan.from_data_url("url"), "UTF-8").alias("text"))


# ---------------------------------------------------------------- pairs


@query("SELECT tile_id AS i, lead(tile_id) OVER (PARTITION BY grid_row ORDER BY tile_id) AS j FROM tiles QUALIFY j IS NOT NULL", "tiles")
def pair_sequential(spark, d):
    return pairs.sequential(_tiles(spark, d), group="grid_row")


@query("SELECT a.tile_id AS i, b.tile_id AS j FROM tiles a JOIN tiles b ON a.grid_row = b.grid_row AND a.tile_id < b.tile_id", "tiles")
def pair_all(spark, d):
    """All pairs of each of many sets of unordered images; a set is a row of the grid."""
    return pairs.all_pairs(_tiles(spark, d), "grid_row")


@query("SELECT a.tile_id AS i, b.tile_id AS j, CASE WHEN a.grid_row = b.grid_row THEN 'right' ELSE 'down' END AS axis FROM tiles a JOIN tiles b ON abs(a.grid_row - b.grid_row) + abs(a.grid_col - b.grid_col) = 1 AND a.tile_id < b.tile_id", "tiles")
def pair_grid_neighbors(spark, d):
    return pairs.grid_neighbors(_tiles(spark, d))


@query("SELECT i, j, axis FROM edges WHERE status <> 'accepted'", "edges")
def pair_failed_antijoin(spark, d):
    e = _edges(spark, d)
    return pairs.without_accepted(e.select("i", "j", "axis"), e).select("i", "j", "axis")


@query(_COMPONENTS + "SELECT e.i, e.j, a.component AS component_i, b.component AS component_j FROM edges e JOIN comp a ON a.tile_id = e.i JOIN comp b ON b.tile_id = e.j WHERE a.component <> b.component", "edges")
def pair_cross_component(spark, d):
    return pairs.cross_component(_edges(spark, d).select("i", "j"), _components(spark, d)).select("i", "j", "component_i", "component_j")


@query("SELECT i, j, CASE WHEN status = 'failed' AND (i + j) % 2 = 0 THEN 'retried' ELSE status END AS status FROM edges", "edges")
def pair_upsert(spark, d):
    e = _edges(spark, d).select("i", "j", "status")
    return pairs.upsert(e, e.where("status = 'failed' AND (i + j) % 2 = 0").withColumn("status", F.lit("retried")))


_STRIDE = """SELECT a.tile_id AS i, b.tile_id AS j, CAST(b.true_x - a.true_x AS BIGINT) AS dx, CAST(b.true_y - a.true_y AS BIGINT) AS dy
FROM tiles a JOIN tiles b ON a.tile_id < b.tile_id AND a.tile_id % 3 <> b.tile_id % 3 AND abs(a.grid_row - b.grid_row) <= 2
WHERE abs(b.true_x - a.true_x) < 400 AND abs(b.true_y - a.true_y) < 300 AND (400 - abs(b.true_x - a.true_x)) * (300 - abs(b.true_y - a.true_y)) >= 3600"""


@query(_STRIDE, "tiles")
def pair_stride_candidates(spark, d):
    poses = _tiles(spark, d).select("tile_id", (F.col("tile_id") % 3).alias("component"), F.col("true_x").alias("x"), F.col("true_y").alias("y"))
    return pairs.stride_candidates(poses, 400, 300).select("i", "j", F.col("dx").cast("long").alias("dx"), F.col("dy").cast("long").alias("dy"))


@query("SELECT i AS tile_a, j AS tile_b, round(sqrt(1.0 * (b.true_x - a.true_x - dx) * (b.true_x - a.true_x - dx) + (b.true_y - a.true_y - dy) * (b.true_y - a.true_y - dy)), 6) AS error_px FROM edges e JOIN tiles a ON a.tile_id = e.i JOIN tiles b ON b.tile_id = e.j", "edges")
def pair_landmarks(spark, d):
    poses = _tiles(spark, d).select("tile_id", F.lit(0).alias("component"), F.col("true_x").alias("x"), F.col("true_y").alias("y"))
    marks = _edges(spark, d).select(F.col("i").alias("tile_a"), F.col("j").alias("tile_b"), F.col("dx").alias("ax"), F.col("dy").alias("ay"), F.lit(0).alias("bx"), F.lit(0).alias("by"))
    return pairs.landmarks(marks, poses).select("tile_a", "tile_b", F.round("error_px", 6).alias("error_px"))


# ---------------------------------------------------------------- matches and fits


@query(
    """+ s AS (SELECT a.kp_id kp0, b.kp_id kp1, sqrt(list_sum(list_transform(range(1, 65), lambda q: (a.descriptor[q]::DOUBLE - b.descriptor[q]::DOUBLE) * (a.descriptor[q]::DOUBLE - b.descriptor[q]::DOUBLE)))) distance
 FROM descriptors a JOIN descriptors b ON a.image = 0 AND b.image = 1),
q AS (SELECT *, row_number() OVER (PARTITION BY kp0 ORDER BY distance, kp1) r FROM s)
SELECT x.kp0, x.kp1, round(x.distance, 5) AS distance FROM q x LEFT JOIN q y ON y.kp0 = x.kp0 AND y.r = 2 WHERE x.r = 1 AND (y.kp0 IS NULL OR x.distance < 0.97 * y.distance)""",
    "descriptors",
)
def match_knn_ratio(spark, d):
    v = view(spark, d, "descriptors")
    return match.knn_ratio(v.where("image = 0"), v.where("image = 1"), 0.97).select("kp0", "kp1", F.round("distance", 5).alias("distance"))


@query("SELECT pair_id, k, x0, y0, x1, y1, score FROM correspondences WHERE x0 >= 0 AND x0 < 400 AND y0 >= 0 AND y0 < 300 AND x1 >= 0 AND x1 < 400 AND y1 >= 0 AND y1 < 300", "correspondences")
def match_validate(spark, d):
    return match.validate(view(spark, d, "correspondences"), 400, 300)


@query("SELECT pair_id, count(*) FILTER (WHERE ok) AS kept, count(*) FILTER (WHERE NOT ok) AS discarded FROM (SELECT pair_id, x0 >= 0 AND x0 < 400 AND y0 >= 0 AND y0 < 300 AND x1 >= 0 AND x1 < 400 AND y1 >= 0 AND y1 < 300 AS ok FROM correspondences) t GROUP BY pair_id", "correspondences")
def match_discarded(spark, d):
    return match.discarded(view(spark, d, "correspondences"), 400, 300)


@query(
    """SELECT pair_id, k, x0, y0, x1, y1, score, pos
FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY depth, cell) pos
      FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, cell ORDER BY score DESC, k, x0, y0, x1, y1) depth
            FROM (SELECT *, least(floor(y0 * 8 / 300.0), 7) * 8 + least(floor(x0 * 8 / 400.0), 7) cell FROM correspondences) a) b) z
WHERE pos <= 64""",
    "correspondences",
)
def match_spatial_sample(spark, d):
    return match.spatial_sample(view(spark, d, "correspondences"), 400, 300, 64)


@query("SELECT kp0, kp1, score FROM (SELECT *, row_number() OVER (PARTITION BY kp0 ORDER BY score DESC, kp1) ra, row_number() OVER (PARTITION BY kp1 ORDER BY score DESC, kp0) rb FROM (SELECT pair_id kp0, k % 50 kp1, max(score) score FROM correspondences GROUP BY 1, 2) t) u WHERE ra = 1 AND rb = 1", "correspondences")
def match_mutual(spark, d):
    best = view(spark, d, "correspondences").groupBy(F.col("pair_id").alias("kp0"), F.pmod("k", F.lit(50)).alias("kp1")).agg(F.max("score").alias("score"))
    return match.mutual(best).select("kp0", "kp1", "score")


@query("SELECT tile_id, kp, score FROM (SELECT l_suppkey tile_id, l_orderkey * 8 + l_linenumber kp, l_extendedprice score, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 8 + l_linenumber) r FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem) t) u WHERE r <= 40")
def match_top_keypoints(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("tile_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("kp"), F.col("l_extendedprice").alias("score")).distinct()
    return match.top_keypoints(rows, 40)


_MODE = """o AS (SELECT pair_id, x1 - x0 dx, y1 - y0 dy FROM correspondences),
m AS (SELECT pair_id, dx mx, dy my FROM (SELECT pair_id, dx, dy, row_number() OVER (PARTITION BY pair_id ORDER BY count(*) DESC, dx, dy) q FROM o GROUP BY 1, 2, 3) z WHERE q = 1),
f AS (SELECT o.pair_id, dx, dy, sqrt((dx - mx) * (dx - mx) + (dy - my) * (dy - my)) <= 3 ok FROM o JOIN m ON m.pair_id = o.pair_id),
fits AS (SELECT pair_id, count(*) n, count(*) FILTER (WHERE ok) inliers, median(dx) FILTER (WHERE ok) tx, median(dy) FILTER (WHERE ok) ty FROM f GROUP BY pair_id)
"""


@query("+" + _MODE + "SELECT pair_id, n, inliers, CAST(tx AS DOUBLE) AS tx, CAST(ty AS DOUBLE) AS ty FROM fits", "correspondences")
def fit_translation_mode(spark, d):
    return fit.translation_mode(view(spark, d, "correspondences"))


#: The gates of a fit but for the spread of its inliers.
_GATES = """, gate AS (SELECT fits.pair_id, n, inliers, tx, ty, greatest(0, 400 - abs(tx)) * greatest(0, 300 - abs(ty)) / 120000.0 AS overlap FROM fits)
SELECT pair_id, CAST(n AS BIGINT) AS n, CAST(inliers AS BIGINT) AS inliers, CAST(tx AS DOUBLE) AS tx, CAST(ty AS DOUBLE) AS ty, round(CAST(overlap AS DOUBLE), 9) AS overlap,
       inliers >= 12 AND inliers >= 0.5 * n AND overlap >= 0.03 AS accepted_but_for_spread,
       coalesce(CASE WHEN n < 12 THEN 'fewer than 12 matches' WHEN inliers < 12 OR inliers < 0.5 * n THEN 'too few inliers' WHEN overlap < 0.03 THEN 'too little overlap' END, '') AS reason_but_for_spread
FROM gate"""


@query("+" + _MODE + _GATES, "correspondences")
def fit_reliable_translation(spark, d):
    """Fits with their gates; the hull's is tested against known areas, and never decides here."""
    out = fit.reliable_translation(view(spark, d, "correspondences"), 400, 300)
    small = F.col("reason") == "inliers in a small region"
    accepted = F.col("accepted") | F.coalesce(small, F.lit(False))
    return out.select("pair_id", "n", "inliers", "tx", "ty", F.round("overlap", 9).alias("overlap"), accepted.alias("accepted_but_for_spread"), F.when(F.coalesce(small, F.lit(False)), "").otherwise(F.coalesce("reason", F.lit(""))).alias("reason_but_for_spread"))


@query("+" + _MODE + ", q AS (SELECT c.pair_id, sqrt((x1 - x0 - tx) * (x1 - x0 - tx) + (y1 - y0 - ty) * (y1 - y0 - ty)) r FROM correspondences c JOIN fits ON fits.pair_id = c.pair_id) SELECT pair_id, count(*) AS matches, count(*) FILTER (WHERE r < 3) AS inliers, round(median(r) FILTER (WHERE r < 3), 6) AS residual_median FROM q GROUP BY pair_id", "correspondences")
def fit_pair_diagnostics(spark, d):
    m = view(spark, d, "correspondences")
    return fit.diagnostics(m, fit.translation_mode(m)).withColumn("residual_median", F.round("residual_median", 6))


@query("SELECT j, arg_min(i, -inliers * 1000000 + i) AS i, max(inliers) AS inliers, arg_min(dx, -inliers * 1000000 + i) AS dx, arg_min(dy, -inliers * 1000000 + i) AS dy FROM edges WHERE status = 'accepted' GROUP BY j", "edges")
def fit_best_candidate(spark, d):
    return fit.best_candidate(_edges(spark, d))


@query("+ p AS (SELECT e.j, e.inliers, e.i, t.true_x + e.dx px, t.true_y + e.dy py FROM edges e JOIN tiles t ON t.tile_id = e.i WHERE status = 'accepted'), b AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY inliers DESC, i) r FROM p) SELECT p.j, count(*) AS candidates, bool_and(sqrt((p.px - b.px) * (p.px - b.px) + (p.py - b.py) * (p.py - b.py)) <= 6) AS agree FROM p JOIN b ON b.j = p.j AND b.r = 1 GROUP BY p.j", "edges")
def fit_agreement(spark, d):
    return fit.agreement(_edges(spark, d), _tiles(spark, d).select("tile_id", F.col("true_x").alias("x"), F.col("true_y").alias("y")), 3.0)


_ATTEMPTS = """a AS (SELECT i, j, 1 attempt, CASE WHEN status = 'accepted' AND (i + j) % 3 > 0 THEN 'accepted' WHEN i % 5 = 0 THEN 'ambiguous' ELSE 'failed' END status FROM edges
UNION ALL SELECT i, j, 2, status FROM edges WHERE (i + j) % 3 = 0)
"""


def _attempts(spark, d):
    e = _edges(spark, d)
    first = e.select("i", "j", F.lit(1).alias("attempt"), F.when((F.col("status") == "accepted") & ((F.col("i") + F.col("j")) % 3 > 0), "accepted").when(F.col("i") % 5 == 0, "ambiguous").otherwise("failed").alias("status"))
    return first.union(e.where("(i + j) % 3 = 0").select("i", "j", F.lit(2), "status"))


@query("+" + _ATTEMPTS + "SELECT i, j, CASE WHEN bool_or(status = 'accepted') THEN 'accepted' WHEN bool_or(status = 'ambiguous') THEN 'ambiguous' ELSE 'failed' END AS status, coalesce(min(CASE WHEN status = 'accepted' THEN attempt END), 0) AS attempt, count(*) AS attempts FROM a GROUP BY i, j", "edges")
def fit_cascade(spark, d):
    return fit.cascade(_attempts(spark, d)).withColumn("attempt", F.coalesce("attempt", F.lit(0)))


@query("+" + _ATTEMPTS + "SELECT i, j FROM edges e WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.i = e.i AND a.j = e.j AND a.status IN ('accepted', 'ambiguous'))", "edges")
def fit_alternative_candidates(spark, d):
    return fit.next_attempts(_edges(spark, d).select("i", "j"), _attempts(spark, d), alternative=True)


@query("SELECT pair_id, k, x0, y0, x1, y1, round(sqrt((x0 - 120 - x1) * (x0 - 120 - x1) + (y0 + 3 - y1) * (y0 + 3 - y1)), 6) AS error, sqrt((x0 - 120 - x1) * (x0 - 120 - x1) + (y0 + 3 - y1) * (y0 + 3 - y1)) < 4 AS inlier FROM correspondences", "correspondences")
def fit_homography_inliers(spark, d):
    out = fit.homography_inliers(view(spark, d, "correspondences").drop("score"), [1.0, 0.0, -120.0, 0.0, 1.0, 3.0, 0.0, 0.0, 1.0])
    return out.withColumn("error", F.round("error", 6))


# ---------------------------------------------------------------- layout


@query(_COMPONENTS + "SELECT tile_id, component FROM comp", "edges")
def layout_components(spark, d):
    return _components(spark, d)


@query(_COMPONENTS + """, z AS (SELECT component, count(*) AS size FROM comp GROUP BY component),
w AS (SELECT component, sum(inliers)::BIGINT AS weight FROM edges JOIN comp ON comp.tile_id = edges.i WHERE status = 'accepted' GROUP BY component)
SELECT z.component, size, coalesce(weight, 0) AS weight, row_number() OVER (ORDER BY size DESC, coalesce(weight, 0) DESC, z.component) AS rank FROM z LEFT JOIN w ON w.component = z.component""", "edges")
def layout_groups_ranked(spark, d):
    return graph.ranked_groups(_components(spark, d), _edges(spark, d).where("status = 'accepted'"))


@query(_COMPONENTS + """, g AS (SELECT component, count(*) n, (SELECT coalesce(sum(inliers), 0) FROM edges JOIN comp q ON q.tile_id = edges.i WHERE status = 'accepted' AND q.component = comp.component) w FROM comp GROUP BY component)
SELECT tile_id, component FROM comp WHERE component <> (SELECT component FROM g ORDER BY n DESC, w DESC, component LIMIT 1)""", "edges")
def layout_excluded(spark, d):
    named = graph.cut(_components(spark, d))
    return graph.excluded(named, graph.ranked_groups(named, _edges(spark, d).where("status = 'accepted'")))


#: An edge is in the forest unless better edges join its ends already.
_KRUSKAL = """+ o AS (SELECT i, j, inliers, row_number() OVER (ORDER BY inliers DESC, i, j) k FROM edges WHERE status = 'accepted'),
und AS (SELECT i a, j b, k FROM o UNION ALL SELECT j, i, k FROM o),
r(k, n) AS (SELECT k, i FROM o UNION SELECT r.k, und.b FROM r JOIN und ON und.a = r.n AND und.k < r.k)
SELECT i, j, inliers FROM o WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = o.k AND r.n = o.j)"""


@query(_KRUSKAL, "edges")
def layout_spanning_forest(spark, d):
    return graph.spanning_forest(_edges(spark, d).where("status = 'accepted'"))


@query("SELECT t.grid_row, e.j AS tile_id, CAST(sum(dx) OVER w AS BIGINT) AS x, CAST(sum(dy) OVER w AS BIGINT) AS y FROM edges e JOIN tiles t ON t.tile_id = e.i WHERE axis = 'right' WINDOW w AS (PARTITION BY t.grid_row ORDER BY e.j)", "edges")
def layout_chain(spark, d):
    e = _edges(spark, d).where("axis = 'right'").join(_tiles(spark, d).select(F.col("tile_id").alias("i"), "grid_row"), "i")
    return graph.chain(e)


#: Quarter turns and shifts along the rows of the grid: T of a tile is T of the tile before times the edge's.
_TURNS = """+ e AS (SELECT i, j, dx, dy, (i + j) % 4 AS q FROM edges WHERE axis = 'right'),
m AS (SELECT i, j, [CASE q WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END, CASE q WHEN 1 THEN -1 WHEN 3 THEN 1 ELSE 0 END, dx, CASE q WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END, CASE q WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END, dy] AS h FROM e),
r(tile_id, t) AS (SELECT i, [1::BIGINT, 0, 0, 0, 1, 0] FROM m WHERE i NOT IN (SELECT j FROM m)
  UNION ALL
  SELECT m.j, [t[1] * h[1] + t[2] * h[4], t[1] * h[2] + t[2] * h[5], t[1] * h[3] + t[2] * h[6] + t[3], t[4] * h[1] + t[5] * h[4], t[4] * h[2] + t[5] * h[5], t[4] * h[3] + t[5] * h[6] + t[6]] FROM r JOIN m ON m.i = r.tile_id)
SELECT tile_id, t[1] AS a, t[2] AS b, t[3] AS x, t[4] AS c, t[5] AS d, t[6] AS y FROM r"""


@query(_TURNS, "edges")
def layout_transforms(spark, d):
    """Products of the edges' transforms along each row of the grid, from its first tile."""
    e = _edges(spark, d).where("axis = 'right'").select("i", "j", "dx", "dy", F.pmod(F.col("i") + F.col("j"), F.lit(4)).alias("q"))
    turn = lambda *values: F.element_at(F.array(*map(F.lit, values)), F.col("q").cast("int") + 1)
    one, zero = F.lit(1.0), F.lit(0.0)
    h = F.array(turn(1.0, 0.0, -1.0, 0.0), turn(0.0, -1.0, 0.0, 1.0), F.col("dx").cast("double"), turn(0.0, 1.0, 0.0, -1.0), turn(1.0, 0.0, -1.0, 0.0), F.col("dy").cast("double"), zero, zero, one)
    forest = e.select("i", "j", h.alias("h"))
    roots = forest.select(F.col("i").alias("tile_id")).join(forest.select(F.col("j").alias("tile_id")), "tile_id", "left_anti")
    out = graph.tree_transforms(forest, roots)
    return out.select("tile_id", *(F.round(F.element_at("transform", k + 1)).cast("long").alias(c) for k, c in enumerate("abxcdy")))


@query()
def layout_poses(spark, d):
    return layout.solve(_edges(spark, d), _components(spark, d)).select("component", "tile_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("SELECT tile_id, (true_x - first_value(true_x) OVER w)::BIGINT AS x, (true_y - first_value(true_y) OVER w)::BIGINT AS y FROM tiles WINDOW w AS (ORDER BY tile_id)", "tiles")
def layout_poses_in_cells(spark, d):
    """All tiles as one component, solved cell by cell: every edge is right, so the places are the true ones."""
    t = view(spark, d, "tiles")
    wrong = (F.col("i") * 31 + F.col("j")) % 17 == 0
    e = _edges(spark, d).withColumn("dx", F.col("dx") - F.when(wrong, 40).otherwise(0)).withColumn("dy", F.col("dy") + F.when(wrong, 25).otherwise(0)).withColumn("status", F.lit("accepted"))
    rough = t.select("tile_id", (F.col("grid_col") * 320.0).alias("x"), (F.col("grid_row") * 240.0).alias("y"))
    out = blocks.solve_large(e, blocks.cells_of(rough, 320.0, 240.0), rounds=1)
    return out.select("tile_id", F.round("x").cast("long").alias("x"), F.round("y").cast("long").alias("y"))


@query()
def layout_poses_huber(spark, d):
    e = _edges(spark, d).withColumn("uncertainty_px", 1.0 + F.col("inliers") / 50.0)
    return layout.solve(e, _components(spark, d), "huber").select("component", "tile_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("SELECT e.i, e.j, round(sqrt(1.0 * (b.true_x - a.true_x - dx) * (b.true_x - a.true_x - dx) + (b.true_y - a.true_y - dy) * (b.true_y - a.true_y - dy)), 6) AS residual_px, (e.i * 31 + e.j) % 17 = 0 AS flagged FROM edges e JOIN tiles a ON a.tile_id = e.i JOIN tiles b ON b.tile_id = e.j WHERE status = 'accepted'", "edges")
def layout_residuals(spark, d):
    truth = _tiles(spark, d).select("tile_id", F.col("true_x").alias("x"), F.col("true_y").alias("y"))
    return layout.residuals(_edges(spark, d), truth).withColumn("residual_px", F.round("residual_px", 6))


@query("SELECT count(*) AS edges, count(*) FILTER (WHERE (i * 31 + j) % 17 = 0) AS flagged, round(CASE WHEN bool_or((i * 31 + j) % 17 = 0) THEN sqrt(40.0 * 40 + 25 * 25) ELSE 0 END, 6) AS worst_px, NOT bool_or((i * 31 + j) % 17 = 0) AS qc_consistent FROM edges WHERE status = 'accepted'", "edges")
def layout_qc(spark, d):
    truth = _tiles(spark, d).select("tile_id", F.col("true_x").alias("x"), F.col("true_y").alias("y"))
    return layout.consistent(layout.residuals(_edges(spark, d), truth)).withColumn("worst_px", F.round("worst_px", 6))


@query("SELECT tile_id, CASE WHEN EXISTS (SELECT 1 FROM edges WHERE status = 'accepted' AND (i = tile_id OR j = tile_id)) THEN 'image_supported' ELSE 'unresolved' END AS evidence FROM tiles", "edges")
def layout_evidence(spark, d):
    return layout.evidence(_tiles(spark, d), _edges(spark, d))


@query("SELECT axis, count(*) AS n, median(dx)::DOUBLE AS dx, median(dy)::DOUBLE AS dy FROM edges WHERE status = 'accepted' GROUP BY axis HAVING count(*) >= 2", "edges")
def layout_strides(spark, d):
    return layout.strides(_edges(spark, d))


_PRIOR = "m AS (SELECT axis, count(*) n, median(dx) mx, median(dy) my FROM edges WHERE status = 'accepted' GROUP BY axis), s AS (SELECT m.axis, n, mx, my, max(sqrt((dx - mx) * (dx - mx) + (dy - my) * (dy - my))) spread FROM edges e JOIN m ON m.axis = e.axis WHERE status = 'accepted' GROUP BY m.axis, n, mx, my)\n"


@query("+" + _PRIOR + "SELECT axis, n, mx::DOUBLE AS dx, my::DOUBLE AS dy, round(spread, 6) AS spread, n >= 2 AND spread <= greatest(5, 0.1 * sqrt(mx * mx + my * my)) AS usable FROM s", "edges")
def layout_grid_prior(spark, d):
    return layout.grid_prior(_edges(spark, d)).withColumn("spread", F.round("spread", 6))


_PREDICT = _COMPONENTS + """, m AS (SELECT axis, median(dx) gx, median(dy) gy FROM edges WHERE status = 'accepted' AND (i * 31 + j) % 17 <> 0 GROUP BY axis),
p AS (SELECT e.i, e.j, e.axis, CASE WHEN a.component = b.component THEN tb.true_x - ta.true_x ELSE gx END::DOUBLE AS px, CASE WHEN a.component = b.component THEN tb.true_y - ta.true_y ELSE gy END::DOUBLE AS py, CASE WHEN a.component = b.component THEN 'layout' ELSE 'grid_median' END AS source
FROM edges e JOIN comp a ON a.tile_id = e.i JOIN comp b ON b.tile_id = e.j JOIN tiles ta ON ta.tile_id = e.i JOIN tiles tb ON tb.tile_id = e.j JOIN m ON m.axis = e.axis WHERE e.status = 'failed')
"""


def _predicted(spark, d):
    e = _edges(spark, d)
    poses = _tiles(spark, d).select("tile_id", F.col("true_x").alias("x"), F.col("true_y").alias("y")).join(_components(spark, d), "tile_id")
    prior = layout.grid_prior(e.where("(i * 31 + j) % 17 <> 0"), share=1.0)
    p = layout.predict(e.where("status = 'failed'").select("i", "j", "axis"), poses, prior)
    return p.withColumns({c: F.col(c).cast("double") for c in ("px", "py")})


@query(_PREDICT + "SELECT i, j, axis, px, py, source FROM p", "edges")
def layout_predicted(spark, d):
    return _predicted(spark, d)


@query(_PREDICT + "SELECT i, j, px AS dx, py AS dy, 0.02::DOUBLE AS weight, 'predicted' AS status FROM p WHERE source = 'grid_median' AND abs(px) < 400 AND abs(py) < 300 AND (400 - abs(px)) * (300 - abs(py)) >= 3600", "edges")
def layout_prior_edges(spark, d):
    return layout.prior_edges(_predicted(spark, d), 400, 300)


@query(_PREDICT + "SELECT i, j, greatest(0, floor(px - 8))::INT AS x0, greatest(0, floor(py - 8))::INT AS y0, least(400, ceil(px + 408))::INT AS x1, least(300, ceil(py + 308))::INT AS y1, greatest(0, floor(-px - 8))::INT AS bx0, greatest(0, floor(-py - 8))::INT AS by0, least(400, ceil(-px + 408))::INT AS bx1, least(300, ceil(-py + 308))::INT AS by1 FROM p", "edges")
def layout_crop_bounds(spark, d):
    return layout.crop_bounds(_predicted(spark, d), 400, 300, 8).select("i", "j", "x0", "y0", "x1", "y1", "bx0", "by0", "bx1", "by1")


@query("SELECT i, j, CASE WHEN axis = 'right' THEN dx / 400.0 > 0.05 AND dx / 400.0 < 0.98 AND abs(dy) / 300.0 < 0.4 ELSE dy / 300.0 > 0.05 AND dy / 300.0 < 0.98 AND abs(dx) / 400.0 < 0.4 END AS plausible FROM edges", "edges")
def layout_plausible(spark, d):
    return _edges(spark, d).select("i", "j", layout.plausible(400, 300).alias("plausible"))


# ---------------------------------------------------------------- rendering


def _placed(spark, d):
    return _tiles(spark, d).select("tile_id", F.col("true_x").alias("x"), F.col("true_y").alias("y"), "width", "height")


@query("SELECT min(true_x)::BIGINT AS x0, min(true_y)::BIGINT AS y0, max(true_x + 400)::BIGINT AS x1, max(true_y + 300)::BIGINT AS y1, (max(true_x + 400) - min(true_x) + 40)::BIGINT AS canvas_width, (max(true_y + 300) - min(true_y) + 40)::BIGINT AS canvas_height, round(least(1.0, 12000.0 / greatest(max(true_x + 400) - min(true_x) + 40, max(true_y + 300) - min(true_y) + 40)), 9) AS scale FROM tiles", "tiles")
def render_canvas(spark, d):
    box = render.canvas(_placed(spark, d))
    return box.select(*(F.col(c).cast("long").alias(c) for c in box.columns if c != "scale"), F.round("scale", 9).alias("scale"))


_CHUNKS = "c AS (SELECT tile_id, true_x x, true_y y, unnest(range(CAST(floor(true_y / 512.0) AS BIGINT), CAST(floor((true_y + 299) / 512.0) AS BIGINT) + 1)) cy FROM tiles), k AS (SELECT *, unnest(range(CAST(floor(x / 512.0) AS BIGINT), CAST(floor((x + 399) / 512.0) AS BIGINT) + 1)) cx FROM c)\n"


@query("+" + _CHUNKS + "SELECT tile_id, cy, cx FROM k", "tiles")
def render_chunk_tiles(spark, d):
    return render.chunk_tiles(_placed(spark, d)).select("tile_id", "cy", "cx")


@query("+" + _CHUNKS + "SELECT cy, cx, count(*) AS tiles, sum((least(x + 400, (cx + 1) * 512) - greatest(x, cx * 512)) * (least(y + 300, (cy + 1) * 512) - greatest(y, cy * 512)))::DOUBLE AS area FROM k GROUP BY cy, cx", "tiles")
def render_coverage(spark, d):
    return render.coverage(_placed(spark, d))


@query("SELECT a.tile_id AS i, b.tile_id AS j, CAST((400 - abs(b.true_x - a.true_x)) * (300 - abs(b.true_y - a.true_y)) AS BIGINT) AS overlap_px FROM tiles a JOIN tiles b ON a.tile_id < b.tile_id AND abs(a.grid_row - b.grid_row) <= 2 WHERE abs(b.true_x - a.true_x) < 400 AND abs(b.true_y - a.true_y) < 300 AND (400 - abs(b.true_x - a.true_x)) * (300 - abs(b.true_y - a.true_y)) >= 500", "tiles")
def render_exposure_pairs(spark, d):
    return render.overlaps(_placed(spark, d))


_PIXELS = "p AS (SELECT tile_id, px, py, 12 AS width, 9 AS height, grid_col * 10 + px AS x, grid_row * 7 + py AS y, (tile_id * 31 + px * 7 + py * 3) % 256 AS value FROM tiles, (SELECT unnest(range(12)) px), (SELECT unnest(range(9)) py))\n"


@query("+" + _PIXELS + "SELECT y, x, CAST(round_even(sum(least(px + 1, py + 1, width - px, height - py) * value) / sum(least(px + 1, py + 1, width - px, height - py)), 0) AS INT) AS value, count(*) AS coverage FROM p GROUP BY y, x", "tiles")
def render_boundary_feather(spark, d):
    p = _tiles(spark, d).withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(8))))
    p = p.select("tile_id", "px", "py", F.lit(12).alias("width"), F.lit(9).alias("height"), (F.col("grid_col") * 10 + F.col("px")).cast("long").alias("x"), (F.col("grid_row") * 7 + F.col("py")).cast("long").alias("y"), ((F.col("tile_id") * 31 + F.col("px") * 7 + F.col("py") * 3) % 256).alias("value"))
    return render.boundary_feather(p)


# ---------------------------------------------------------------- events


def _events(spark, d):
    return view(spark, d, "job_events")


@query("SELECT job_id, seq, type FROM job_events", "job_events")
def event_sequence(spark, d):
    raw = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("job_id"), "ts", "event_id", "event_type")
    kind = F.when(F.col("event_type") == "signup", "plan").when(F.col("event_type") == "view", "step").when(F.col("event_type") == "click", "image").when(F.col("event_type") == "purchase", "result").otherwise("error")
    return events.sequence(raw.withColumn("type", kind), ["ts", "event_id"]).select("job_id", F.col("seq").cast("long").alias("seq"), "type")


@query("+ q AS (SELECT *, count(*) FILTER (WHERE type = 'error') OVER (PARTITION BY job_id ORDER BY seq) run FROM job_events) SELECT job_id, seq, type, round(max(fraction) OVER (PARTITION BY job_id, type, run ORDER BY seq), 6) AS best FROM q", "job_events")
def event_running_progress(spark, d):
    return events.running_progress(_events(spark, d)).select("job_id", F.col("seq").cast("long").alias("seq"), "type", F.round("best", 6).alias("best"))


@query("+ l AS (SELECT job_id, type, arg_max(fraction, seq) f FROM job_events GROUP BY 1, 2) SELECT job_id, round(least(1.0, sum(CASE type WHEN 'plan' THEN 0.05 WHEN 'step' THEN 0.3 WHEN 'image' THEN 0.25 WHEN 'result' THEN 0.15 ELSE 0 END * f)), 6) AS progress FROM l GROUP BY job_id", "job_events")
def event_total_progress(spark, d):
    return events.total_progress(_events(spark, d)).withColumn("progress", F.round("progress", 6))


@query("SELECT job_id, type, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM job_events GROUP BY 1, 2", "job_events")
def event_stage_timing(spark, d):
    return events.stage_timing(_events(spark, d))


@query("SELECT job_id, max(seq) AS seq, arg_max(type, seq) AS type, round(arg_max(fraction, seq), 6) AS fraction FROM job_events GROUP BY job_id", "job_events")
def event_latest_status(spark, d):
    return events.latest_status(_events(spark, d)).select("job_id", F.col("seq").cast("long").alias("seq"), "type", F.round("fraction", 6).alias("fraction"))


@query("SELECT job_id, seq, type FROM job_events", "job_events")
def event_dedupe_replay(spark, d):
    e = _events(spark, d).select("job_id", "seq", "type")
    return events.replayed(e.where("seq <= 20"), e.where("seq > 10")).withColumn("seq", F.col("seq").cast("long"))


@query("+ f AS (SELECT job_id, epoch_us(min(ts)) created_us FROM job_events GROUP BY job_id) SELECT job_id, created_us, row_number() OVER (ORDER BY created_us DESC, job_id) AS rank FROM f ORDER BY created_us DESC, job_id LIMIT 40", "job_events")
def event_retention(spark, d):
    return events.retained(_events(spark, d), 40)


@query("SELECT 'parent' AS job_id, seq, type, round(0.2 + 0.65 * fraction, 6) AS fraction FROM job_events WHERE type NOT IN ('plan', 'result')", "job_events")
def event_forwarded(spark, d):
    out = events.forwarded(_events(spark, d), "parent", 0.2, 0.85)
    return out.select("job_id", F.col("seq").cast("long").alias("seq"), "type", F.round("fraction", 6).alias("fraction"))


# ---------------------------------------------------------------- reports


@query("SELECT CASE WHEN (a.grid_row = 3 AND b.grid_row = 4) OR (a.grid_row = 5 AND b.grid_row = 6) THEN 'boundary' ELSE 'control' END AS role, count(*) AS pairs, count(*) FILTER (WHERE status = 'accepted') AS accepted FROM edges e JOIN tiles a ON a.tile_id = e.i JOIN tiles b ON b.tile_id = e.j GROUP BY 1", "edges")
def report_role_rollup(spark, d):
    return report.role_rollup(_edges(spark, d), _tiles(spark, d), [(3, 4), (5, 6)])


@query("SELECT a.tile_id AS i, b.tile_id AS j FROM tiles a JOIN tiles b ON a.grid_row = b.grid_row AND b.grid_col - a.grid_col >= 10 ORDER BY i, j LIMIT 3", "tiles")
def report_expected_negatives(spark, d):
    return report.expected_negatives(_tiles(spark, d))


@query("SELECT count(*) FILTER (WHERE status = 'accepted') AS accepted, 0::BIGINT AS ambiguous, count(*) FILTER (WHERE status = 'failed') AS failed, 0::BIGINT AS predicted FROM edges", "edges")
def report_status_histogram(spark, d):
    return report.status_histogram(_edges(spark, d))


@query("+" + _MODE + "SELECT count(*) AS pairs, sum(n)::BIGINT AS matches, sum(inliers)::BIGINT AS inliers, bool_or(inliers / greatest(n, 1) < 0.15) AS low_agreement FROM fits", "correspondences")
def report_low_agreement(spark, d):
    return report.low_agreement(fit.translation_mode(view(spark, d, "correspondences")))


@query("+ m AS (SELECT sqrt(1.0 * (b.true_x - a.true_x - dx) * (b.true_x - a.true_x - dx) + (b.true_y - a.true_y - dy) * (b.true_y - a.true_y - dy)) e FROM edges q JOIN tiles a ON a.tile_id = q.i JOIN tiles b ON b.tile_id = q.j) SELECT count(*) AS n, round(median(e), 6) AS median_px, round(quantile_cont(e, 0.95), 6) AS p95_px FROM m", "edges")
def report_landmarks(spark, d):
    out = report.landmark_metrics(pair_landmarks(spark, d))
    return out.select("n", F.round("median_px", 6).alias("median_px"), F.round("p95_px", 6).alias("p95_px"))


@query("+ a AS (SELECT t.grid_row, count(*) n FROM edges e JOIN tiles t ON t.tile_id = e.i WHERE axis = 'right' AND status = 'accepted' GROUP BY 1) SELECT t.grid_row, count(*) AS tiles, coalesce(max(a.n), 0) AS accepted, coalesce(max(a.n), 0) = count(*) - 1 AS complete FROM tiles t LEFT JOIN a ON a.grid_row = t.grid_row GROUP BY t.grid_row", "edges")
def report_row_rollup(spark, d):
    return report.row_rollup(_tiles(spark, d), _edges(spark, d))


@query("SELECT pair_id, count(*) AS matches, max(score) AS best_score FROM correspondences GROUP BY pair_id", "correspondences")
def report_matches_per_pair(spark, d):
    return report.matches_per_pair(view(spark, d, "correspondences"))


@query("SELECT image, count(*) AS keypoints FROM descriptors GROUP BY image", "descriptors")
def report_keypoints_per_image(spark, d):
    return report.keypoints_per_image(view(spark, d, "descriptors"))


@query("SELECT i, j, status, row_number() OVER (ORDER BY status = 'accepted', i, j) AS place FROM edges WHERE i = 45 OR j = 45", "edges")
def report_rejected_of(spark, d):
    return report.rejected_of(_edges(spark, d), 45).select("i", "j", "status", "place")


# ---------------------------------------------------------------- streams


#: The fold of frames into a box, one frame of each session a step.
_GROW = """+ f AS (SELECT 'row ' || CAST(grid_row AS VARCHAR) AS session, tile_id AS seq, true_x::DOUBLE AS x, true_y::DOUBLE AS y, row_number() OVER (PARTITION BY grid_row ORDER BY tile_id) AS k FROM tiles),
g(session, k, seq, status, x0, y0, x1, y1, frames) AS (
  SELECT session, k, seq, 'seeded', x, y, x + 400.0, y + 300.0, 1::BIGINT FROM f WHERE k = 1
  UNION ALL
  SELECT session, k, seq, s, CASE WHEN s = 'added' THEN u0 ELSE x0 END, CASE WHEN s = 'added' THEN v0 ELSE y0 END, CASE WHEN s = 'added' THEN u1 ELSE x1 END, CASE WHEN s = 'added' THEN v1 ELSE y1 END, frames + CASE WHEN s = 'added' THEN 1 ELSE 0 END
  FROM (SELECT *, CASE WHEN u1 - u0 > 16000 OR v1 - v0 > 16000 THEN 'rejected'
                       WHEN (u1 - u0) * (v1 - v0) - (x1 - x0) * (y1 - y0) < greatest(100, 0.001 * (x1 - x0) * (y1 - y0)) THEN 'skipped' ELSE 'added' END AS s
        FROM (SELECT f.session, f.k, f.seq, g.x0, g.y0, g.x1, g.y1, g.frames, least(g.x0, f.x) u0, least(g.y0, f.y) v0, greatest(g.x1, f.x + 400.0) u1, greatest(g.y1, f.y + 300.0) v1
              FROM g JOIN f ON f.session = g.session AND f.k = g.k + 1) q) r)
SELECT session, seq, status, x0, y0, x1, y1, frames FROM g"""


@query(_GROW, "tiles")
def stream_growing_bbox(spark, d):
    frames = _tiles(spark, d).select(F.concat(F.lit("row "), F.col("grid_row").cast("string")).alias("session"), F.col("tile_id").alias("seq"), F.col("true_x").cast("double").alias("x"), F.col("true_y").cast("double").alias("y"), F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"))
    return growing.growing_map_batch(frames)


@query("SELECT session, seq, CASE WHEN row_number() OVER w = 1 THEN 'seeded' ELSE 'added' END AS status, (true_x - first_value(true_x) OVER w)::BIGINT AS x, (true_y - first_value(true_y) OVER w)::BIGINT AS y FROM shots WINDOW w AS (PARTITION BY session ORDER BY seq)", "shots")
def stream_guided_places(spark, d):
    """A batch of frames without places, matched with each other and laid down in order; each row of shots is a session."""
    frames = synthetic.drawn(view(spark, d, "shots"))
    _, decisions = guided.GrowingMaps(spark, f"{d}/no-maps-yet").propose(frames)
    return decisions.select("session", "seq", "status", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


# ---------------------------------------------------------------- catalog and whole runs


@query()
def catalog_engines(spark, d):
    return engines.engines(spark)


@query("SELECT 'native' AS status, 2 AS n UNION ALL SELECT 'implemented', 16 UNION ALL SELECT 'blocked', 58")
def catalog_gated(spark, d):
    return engines.engines(spark).groupBy("status").agg(F.count("*").cast("int").alias("n"))


@query()
def catalog_verify(spark, d):
    return mosaic.verify(spark, "phase").union(mosaic.verify(spark, "corner")).drop("elapsed")


#: All pixels of all tiles (X, Y in the world, u, v in the tile) and their values.
_DRAWN = f"px AS (SELECT tile_id, X, Y, u, v, {synthetic.scene_sql('X', 'Y')} AS value FROM (SELECT tile_id, u, v, (true_x + u)::BIGINT AS X, (true_y + v)::BIGINT AS Y FROM slide, (SELECT unnest(range(80)) u), (SELECT unnest(range(64)) v)) a)\n"


def _true_poses(tiles: DataFrame) -> DataFrame:
    return tiles.select("tile_id", F.lit(0).cast("long").alias("component"), F.col("true_x").cast("double").alias("x"), F.col("true_y").cast("double").alias("y"))


@query("SELECT tile_id, (SELECT min(tile_id) FROM slide) AS component, 0::BIGINT AS off_x, 0::BIGINT AS off_y FROM slide", "slide")
def run_register(spark, d):
    """Places of the slide's tiles against their true places, in whole pixels from the component's first tile."""
    tiles = synthetic.slide(spark, d)
    found = mosaic.register(tiles)["poses"].join(tiles.select("tile_id", "true_x", "true_y"), "tile_id")
    first = tiles.select(F.col("tile_id").alias("component"), F.col("true_x").alias("fx"), F.col("true_y").alias("fy"))
    off = lambda at, true, origin: F.round(F.col(at) - (F.col(true) - F.col(origin))).cast("long")
    return found.join(first, "component").select("tile_id", "component", off("x", "true_x", "fx").alias("off_x"), off("y", "true_y", "fy").alias("off_y"))


@query("SELECT t.tile_id, (SELECT min(grid_row) FROM slide)::BIGINT AS band, (t.true_x - f.true_x)::BIGINT AS x, (t.true_y - f.true_y)::BIGINT AS y FROM slide t, (SELECT true_x, true_y FROM slide ORDER BY tile_id LIMIT 1) f", "slide")
def run_rows_first(spark, d):
    out = mosaic.rows_first(synthetic.slide(spark, d))["poses"]
    return out.select("tile_id", F.col("component").alias("band"), F.round("x").cast("long").alias("x"), F.round("y").cast("long").alias("y"))


_SUMS = "CAST(count(*) AS BIGINT) AS covered, CAST(sum(n) AS BIGINT) AS contributions, CAST(sum(value) AS BIGINT) AS total, CAST(sum(value * (1 + (X * 31 + Y * 17) % 1009)) AS BIGINT) AS moment"


@query("+" + _DRAWN + f", c AS (SELECT X, Y, value, count(*) n FROM px GROUP BY ALL) SELECT 0::BIGINT AS component, Y // 256 AS cy, X // 256 AS cx, {_SUMS} FROM c GROUP BY ALL", "slide")
def run_mosaic(spark, d):
    """Tiles of one scene blend to the scene."""
    tiles = synthetic.slide(spark, d)
    return render.chunk_sums(mosaic.mosaic(tiles, _true_poses(tiles), 256))


#: The mesh of a tile moves its pixel (u, v) by (a u / 79, b v / 63), so its inverse has a closed form.
_WARP_A, _WARP_B = "((tile_id % 5) - 2) * 0.37", "((tile_id % 3) - 1) * 0.53"
_WARPED = f"""q AS (SELECT tile_id, X, Y, (X - true_x) / (1 + {_WARP_A} / 79) AS u, (Y - true_y) / (1 + {_WARP_B} / 63) AS v, true_x, true_y
  FROM (SELECT *, true_x + unnest(range(-2, 83)) AS X FROM (SELECT *, true_y + unnest(range(-2, 67)) AS Y FROM slide) s) t),
ok AS (SELECT *, least(floor(u), 78)::BIGINT i, least(floor(v), 62)::BIGINT j FROM q WHERE u >= 0 AND v >= 0 AND u <= 79 AND v <= 63),
e AS (SELECT X, Y, u, v, i, j, {synthetic.scene_sql('true_x + i', 'true_y + j')} s00, {synthetic.scene_sql('true_x + i + 1', 'true_y + j')} s01, {synthetic.scene_sql('true_x + i', 'true_y + j + 1')} s10, {synthetic.scene_sql('true_x + i + 1', 'true_y + j + 1')} s11 FROM ok),
w AS (SELECT X, Y, least(u + 1, v + 1, 80 - u, 64 - v) k, (s00 * (1 - (u - i)) + s01 * (u - i)) * (1 - (v - j)) + (s10 * (1 - (u - i)) + s11 * (u - i)) * (v - j) s FROM e),
c AS (SELECT X, Y, count(*) n, round(sum(k * s) / sum(k))::BIGINT AS value FROM w GROUP BY X, Y)
SELECT 0::BIGINT AS component, (Y + 256) // 256 - 1 AS cy, (X + 256) // 256 - 1 AS cx, {_SUMS.replace("(X * 31 + Y * 17) % 1009", "((X * 31 + Y * 17) % 1009 + 1009) % 1009")} FROM c GROUP BY ALL"""


@query("+" + _WARPED, "slide")
def run_mosaic_bent(spark, d):
    """The slide rendered through a mesh a tile, against a warp of all pixels by the closed form."""
    tiles = synthetic.slide(spark, d)
    node = F.array(*(F.expr(f"CAST({_WARP_A} * {c} / 4 AS DOUBLE)") if k == 0 else F.expr(f"CAST({_WARP_B} * {r} / 4 AS DOUBLE)") for r in range(5) for c in range(5) for k in (0, 1)))
    return render.chunk_sums(mosaic.mosaic(tiles, _true_poses(tiles), 256, tiles.select("tile_id", node.alias("mesh"))))


def _bands_sql(levels: int) -> str:
    """Multiband blending of the pixels lit(X, Y, v) as joins and sums a level: r0(X, Y, s) is the result, g0 has the coverage c."""
    kernel = "k AS (SELECT a.o AS ox, b.o AS oy, a.w * b.w AS w FROM (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) a(o, w), (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) b(o, w))"
    up = "SELECT 2 * X + ox AS X, 2 * Y + oy AS Y, sum(w * s) / 64 AS s FROM {}, k GROUP BY 1, 2"
    share = "CASE WHEN coalesce(g.c, 0) < 1e-6 THEN 1 ELSE g.c END"
    out = [kernel, "g0 AS (SELECT X, Y, sum(v)::DOUBLE AS s, count(*)::DOUBLE AS c FROM lit GROUP BY 1, 2)"]
    for n in range(levels):
        out.append(f"g{n + 1} AS (SELECT (X + ox) // 2 AS X, (Y + oy) // 2 AS Y, sum(w * s) / 256 AS s, sum(w * c) / 256 AS c FROM g{n}, k WHERE (X + ox) % 2 = 0 AND (Y + oy) % 2 = 0 GROUP BY 1, 2)")
        out.append(f"b{n} AS (SELECT u.X, u.Y, (coalesce(g.s, 0) - u.s) / {share} AS s FROM ({up.format(f'g{n + 1}')}) u LEFT JOIN g{n} g USING (X, Y))")
    out.append(f"r{levels} AS (SELECT X, Y, s / {share} AS s FROM g{levels} g)")
    for n in reversed(range(levels)):
        out.append(f"r{n} AS (SELECT u.X, u.Y, u.s + coalesce(b.s, 0) AS s FROM ({up.format(f'r{n + 1}')}) u LEFT JOIN b{n} b USING (X, Y))")
    return ",\n".join(out)


@query("+" + _DRAWN + f", lit AS (SELECT X, Y, value // 2 + 16 * (tile_id % 5) AS v FROM px), {_bands_sql(3)}, c AS (SELECT X, Y, g0.c::BIGINT AS n, greatest(0, least(255, round_even(r0.s, 0)))::BIGINT AS value FROM g0 JOIN r0 USING (X, Y)) SELECT 0::BIGINT AS component, Y // 256 AS cy, X // 256 AS cx, {_SUMS} FROM c GROUP BY ALL", "slide")
def run_mosaic_multiband(spark, d):
    """Tiles under lights of their own, blended in bands by chunks with halos."""
    tiles = synthetic.lit(synthetic.slide(spark, d))
    config = engines.MosaicConfig(blend="multiband", blend_levels=3, chunk=256)
    return render.chunk_sums(mosaic.rendered(tiles, _true_poses(tiles), config))


@query("SELECT a.seq AS i, b.seq AS j, 2::BIGINT AS engines, (b.true_x - a.true_x)::BIGINT AS dx, (b.true_y - a.true_y)::BIGINT AS dy, true AS agree FROM shots a JOIN shots b ON a.session = b.session AND b.seq = a.seq + 1", "shots")
def catalog_compare(spark, d):
    """All neighbours under both engines: the best one's shift is the true one, and those accepted agree."""
    frames = synthetic.drawn(view(spark, d, "shots")).withColumn("tile_id", F.col("seq"))
    at = lambda s: frames.select("session", F.col("seq").alias(s))
    results = mosaic.compare(at("i").join(at("j"), "session").where("j = i + 1"), frames, ["phase", "corner"], retry="query")
    return fit.compared(results).select("i", "j", "engines", F.round("dx").cast("long").alias("dx"), F.round("dy").cast("long").alias("dy"), "agree")


@query("SELECT a.tile_id AS i, b.tile_id AS j, 'success' AS status, (b.true_x - a.true_x)::BIGINT AS dx, (b.true_y - a.true_y)::BIGINT AS dy, true AS close FROM (SELECT *, seq AS tile_id FROM shots) a JOIN (SELECT *, seq AS tile_id FROM shots) b ON a.session = b.session AND b.seq = a.seq + 1", "shots")
def image_flow(spark, d):
    """Neighbours whose measured shift is off by (2, -1): the flow's points find the true one, all within half a pixel."""
    frames = synthetic.drawn(view(spark, d, "shots")).withColumn("tile_id", F.col("seq"))
    at = lambda s: frames.select("session", F.col("seq").alias(s), F.col("true_x").alias(f"x{s}"), F.col("true_y").alias(f"y{s}"))
    pair = at("i").join(at("j"), "session").where("j = i + 1").selectExpr("i", "j", "xj - xi AS tx", "yj - yi AS ty")
    out = mosaic.refine_pairs(pair.selectExpr("i", "j", "tx + 2 AS dx", "ty - 1 AS dy"), frames).join(pair, ["i", "j"])
    moved = lambda c: F.transform(F.arrays_zip("points_a", "points_b"), lambda p: p["points_a"][c] - p["points_b"][c])
    mean = lambda c: F.round(F.aggregate(moved(c), F.lit(0.0), lambda s, x: s + x) / F.size("points_a")).cast("long")
    close = lambda c, true: F.forall(moved(c), lambda x: F.abs(x - F.col(true)) < 0.5)
    return out.select("i", "j", "status", mean(0).alias("dx"), mean(1).alias("dy"), (close(0, "tx") & close(1, "ty")).alias("close"))


@query("""SELECT pair_id, k, round(strength, 6) AS strength, 255 - green AS red, green, 0 AS blue FROM (SELECT *, floor(255 * strength)::INT AS green FROM (
  SELECT pair_id, k, CASE WHEN high - low < 1e-6 THEN 1.0 ELSE (score - low) / (high - low) END AS strength, row_number() OVER (PARTITION BY pair_id ORDER BY md5('7:' || pair_id || ':' || k), k) AS n
  FROM (SELECT pair_id, k, score::DOUBLE AS score, min(score::DOUBLE) OVER (PARTITION BY pair_id) AS low, max(score::DOUBLE) OVER (PARTITION BY pair_id) AS high FROM correspondences) a) b WHERE n <= 100) c""", "correspondences")
def match_drawn(spark, d):
    """A hundred matches of each pair, coloured by their scores."""
    return match.drawn(view(spark, d, "correspondences"), 100, 7).select("pair_id", "k", F.round("strength", 6).alias("strength"), "red", "green", "blue")


@query()
def image_keypoints(spark, d):
    return images.keypoints(synthetic.slide(spark, d), 64).select("tile_id", "kp", "x", "y", F.round("score", 3).alias("score"))


@query()
def image_preprocess(spark, d):
    return images.preprocess(synthetic.slide(spark, d), 64, True).select("tile_id", "height", "width", F.sha2("data", 256).alias("sha256"))


@query()
def image_flatfield(spark, d):
    return images.correct_flatfield(synthetic.slide(spark, d)).select("tile_id", F.sha2("data", 256).alias("sha256"))


@query("+" + _DRAWN + "SELECT tile_id, CAST(sum(value) AS BIGINT) AS total, CAST(sum(value * (1 + (u * 31 + v * 17) % 1009)) AS BIGINT) AS moment FROM px GROUP BY tile_id", "slide")
def image_png_round_trip(spark, d):
    """Sums of the slide's tiles after they were written as PNG and read back."""
    back = images.decode(images.encode_png(synthetic.slide(spark, d).drop("grid_row", "grid_col", "true_x", "true_y")).select("tile_id", "png"), "png")
    return images.sums(back)


@query(_COMPONENTS + "SELECT e.i, e.j, a.file AS file_i, b.file AS file_j FROM edges e JOIN tiles a ON a.tile_id = e.i JOIN tiles b ON b.tile_id = e.j", "edges")
def pair_named(spark, d):
    return pairs.named(_edges(spark, d).select("i", "j"), _tiles(spark, d))


@query("SELECT f.tile_id AS frame, p.tile_id FROM tiles f JOIN tiles p ON abs(f.grid_row - p.grid_row) + abs(f.grid_col - p.grid_col) = 1 WHERE f.tile_id % 2 = 1 AND p.tile_id % 2 = 0", "tiles")
def pair_frame_candidates(spark, d):
    t = _tiles(spark, d)
    return pairs.frame_candidates(t.where("tile_id % 2 = 1").withColumnRenamed("tile_id", "frame"), t.where("tile_id % 2 = 0"))


@query("SELECT 0::BIGINT AS component, t.tile_id, (t.true_x - r.true_x)::BIGINT AS x, (t.true_y - r.true_y)::BIGINT AS y FROM tiles t, (SELECT true_x, true_y FROM tiles WHERE tile_id = 45) r", "tiles")
def layout_relative(spark, d):
    poses = _tiles(spark, d).select(F.lit(0).cast("long").alias("component"), "tile_id", F.col("true_x").cast("long").alias("x"), F.col("true_y").cast("long").alias("y"))
    return layout.relative_to(poses, spark.createDataFrame([(0, 45)], "component long, tile_id long"))


@query("SELECT round(CASE WHEN bool_or((i * 31 + j) % 17 = 0) THEN sqrt(40.0 * 40 + 25 * 25) ELSE 0 END, 6) AS worst_px, bool_or((i * 31 + j) % 17 = 0) AS warning FROM edges WHERE status = 'accepted'", "edges")
def layout_warning(spark, d):
    truth = _tiles(spark, d).select("tile_id", F.col("true_x").alias("x"), F.col("true_y").alias("y"))
    return layout.layout_warning(layout.residuals(_edges(spark, d), truth)).withColumn("worst_px", F.round("worst_px", 6))


@query("+ q AS (SELECT pair_id, k, x0, y0, least(x0 * 4 // 399, 3) c, least(y0 * 4 // 299, 3) r, x0 / 99.75 u, y0 / 74.75 v FROM correspondences) SELECT pair_id, k, x0, y0, CAST(r AS BIGINT) AS mesh_row, CAST(c AS BIGINT) AS mesh_col, round((1 - (u - c)) * (1 - (v - r)), 9) AS w00, round((u - c) * (1 - (v - r)), 9) AS w01, round((1 - (u - c)) * (v - r), 9) AS w10, round((u - c) * (v - r), 9) AS w11 FROM q", "correspondences")
def layout_mesh_basis(spark, d):
    out = view(spark, d, "correspondences").select("pair_id", "k", "x0", "y0", *layout.mesh_basis("x0", "y0", 400.0, 300.0))
    return out.select("pair_id", "k", "x0", "y0", F.col("mesh_row").cast("long").alias("mesh_row"), F.col("mesh_col").cast("long").alias("mesh_col"), *(F.round(w, 9).alias(w) for w in ("w00", "w01", "w10", "w11")))


@query("SELECT pair_id AS i, pair_id + 1 AS j, count(*) AS points, round(avg(abs(y0 - y1)), 6) AS baseline, round(avg(abs(y0 - y1 + 3)), 6) AS refined, count(*) >= 12 AND avg(abs(y0 - y1 + 3)) < 0.98 * avg(abs(y0 - y1)) AS kept FROM correspondences WHERE x1 >= 0 AND x1 < 398 GROUP BY pair_id", "correspondences")
def layout_refinement_gate(spark, d):
    m = view(spark, d, "correspondences").select(F.col("pair_id").alias("i"), (F.col("pair_id") + 1).alias("j"), F.col("y0").alias("a"), F.col("y1").alias("b"), (F.col("y1") - 3).alias("b_refined"), ((F.col("x1") >= 0) & (F.col("x1") < 398)).alias("inside"))
    return layout.refinement_gate(m).withColumns({c: F.round(c, 6) for c in ("baseline", "refined")})


@query("SELECT pair_id AS frame, count(*) AS n, round(CASE WHEN count(*) >= 200 AND median(y1 + 50) > 0 THEN least(greatest(median(y0 + 50) / median(y1 + 50), 1 / 1.6), 1.6) ELSE 1.0 END, 9) AS gain FROM correspondences GROUP BY pair_id", "correspondences")
def render_incremental_gain(spark, d):
    m = view(spark, d, "correspondences").select(F.col("pair_id").alias("frame"), (F.col("y0") + 50).alias("base"), (F.col("y1") + 50).alias("added"))
    return render.incremental_gain(m).withColumn("gain", F.round("gain", 9))


@query("SELECT tile_id, (true_x - (SELECT min(true_x) FROM tiles))::BIGINT AS x, (true_y - (SELECT min(true_y) FROM tiles))::BIGINT AS y, (SELECT min(true_x) FROM tiles)::BIGINT AS x0, (SELECT min(true_y) FROM tiles)::BIGINT AS y0 FROM tiles", "tiles")
def render_world_origin(spark, d):
    out = render.world_origin(_placed(spark, d))
    return out.select("tile_id", *(F.col(c).cast("long").alias(c) for c in ("x", "y", "x0", "y0")))


@query("+ s AS (SELECT job_id, arg_max(type, seq) t FROM job_events GROUP BY job_id) SELECT count(*) AS jobs, count(*) FILTER (WHERE t IN ('step', 'plan', 'image')) AS running, count(*) FILTER (WHERE t = 'result') AS done, count(*) FILTER (WHERE t = 'error') AS error FROM s", "job_events")
def report_health(spark, d):
    last = events.latest_status(_events(spark, d))
    status = F.when(F.col("type") == "result", "done").when(F.col("type") == "error", "error").otherwise("running")
    return report.health(last.select(status.alias("status")))


@query("SELECT l_suppkey AS tile_id, l_orderkey * 8 + l_linenumber AS kp, l_extendedprice AS score FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem) t ORDER BY l_extendedprice DESC, 1, 2 LIMIT 4000")
def report_best_features(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("tile_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("kp"), F.col("l_extendedprice").alias("score")).distinct()
    return report.best_features(rows)


@query("SELECT user_id AS session, seq FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) seq FROM events) e WHERE NOT (user_id % 2 = 0 AND seq >= 5)")
def stream_open_sessions(spark, d):
    e = _events(spark, d).select(F.col("job_id").alias("session"), F.col("seq").cast("long").alias("seq"))
    ends = e.where("session % 2 = 0 AND seq = 5").withColumn("action", F.lit("finish"))
    return growing.sessions(e, ends)


@query("SELECT tile_id, sha256(file) AS sha256, CASE WHEN tile_id % 10 > 0 THEN sha256(file || 'x') END AS now FROM tiles WHERE tile_id % 5 = 0", "tiles")
def cache_changed_sources(spark, d):
    t = _tiles(spark, d)
    stored = t.select("tile_id", F.sha2("file", 256).alias("sha256"))
    now = t.where("tile_id % 10 > 0").select("tile_id", F.when(F.col("tile_id") % 5 == 0, F.concat("file", F.lit("x"))).otherwise(F.col("file")).cast("binary").alias("content"))
    return cache.changed_sources(stored, now)
