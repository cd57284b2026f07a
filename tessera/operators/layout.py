"""Placement of tiles: global solves, priors, recovery and residuals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import kernels

POSES = "component bigint, tile_id bigint, x double, y double"

def solve(edges: DataFrame, named: DataFrame, method: str = "length", weight: str | None = None) -> DataFrame:
    """(component, tile_id, x, y): least-squares places of each component's tiles, its least tile at zero.

    ``length``: reweighted on the residuals' lengths; ``huber``: Huber loss on each coordinate,
    weighted by ``uncertainty_px``. A component is one group, solved over its sparse
    edges in one task, at some 200 bytes an edge; components without an edge are placed at zero.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    u = F.col("uncertainty_px") if "uncertainty_px" in edges.columns else F.lit(None).cast("double")
    rows = edges.where("status = 'accepted'").join(named.select(F.col("tile_id").alias("i"), "component"), "i")
    rows = rows.select("component", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("dx").cast("double").alias("dx"), F.col("dy").cast("double").alias("dy"), w.alias("w"), u.alias("u"))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "j"])
        nodes = np.unique(np.r_[pdf.i, pdf.j])
        d = pdf[["dx", "dy"]].to_numpy(float)
        if method == "huber":
            p = kernels.solve_huber(nodes, pdf.i.to_numpy(), pdf.j.to_numpy(), d, pdf.u.fillna(0).to_numpy(float))
        else:
            p = kernels.solve_translations(nodes, pdf.i.to_numpy(), pdf.j.to_numpy(), d, pdf.w.to_numpy(float))
        return pd.DataFrame({"component": pdf.component.iloc[0], "tile_id": nodes, "x": p[:, 0], "y": p[:, 1]})

    placed = rows.groupBy("component").applyInPandas(place, POSES)
    alone = named.where("tile_id = component").join(placed.select("component").distinct(), "component", "left_anti")
    return placed.unionByName(alone.select(F.col("component").cast("long"), F.col("tile_id").cast("long"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))


def residuals(edges: DataFrame, poses: DataFrame, limit: float = 8.0) -> DataFrame:
    """(i, j, residual_px, flagged) of accepted edges."""
    a = poses.select(F.col("tile_id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"))
    b = poses.select(F.col("tile_id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    r = F.hypot(F.col("xj") - F.col("xi") - F.col("dx"), F.col("yj") - F.col("yi") - F.col("dy"))
    return edges.where("status = 'accepted'").join(a, "i").join(b, "j").select("i", "j", r.alias("residual_px"), (r > limit).alias("flagged"))


def consistent(residual: DataFrame) -> DataFrame:
    """One row: edges, flagged, worst and whether none is flagged."""
    return residual.agg(F.count("*").alias("edges"), F.count_if("flagged").alias("flagged"), F.max("residual_px").alias("worst_px"), (~F.coalesce(F.bool_or("flagged"), F.lit(False))).alias("qc_consistent"))


def evidence(tiles: DataFrame, edges: DataFrame) -> DataFrame:
    """(tile_id, evidence): image_supported if an accepted edge touches the tile, else unresolved."""
    touched = edges.where("status = 'accepted'").select(F.explode(F.array("i", "j")).alias("tile_id")).distinct().withColumn("hit", F.lit(True))
    return tiles.select("tile_id").join(touched, "tile_id", "left").select("tile_id", F.when(F.col("hit"), "image_supported").otherwise("unresolved").alias("evidence"))


def strides(edges: DataFrame, minimum: int = 2) -> DataFrame:
    """(axis, n, dx, dy): median step of each axis over accepted edges, if there are enough."""
    return edges.where("status = 'accepted'").groupBy("axis").agg(F.count("*").alias("n"), F.median("dx").alias("dx"), F.median("dy").alias("dy")).where(F.col("n") >= minimum)


def grid_prior(edges: DataFrame, minimum: int = 2, share: float = 0.1, floor: float = 5.0) -> DataFrame:
    """(axis, n, dx, dy, spread, usable): the median step and whether all steps lie near enough to it to predict others."""
    good = edges.where("status = 'accepted'")
    mid = good.groupBy("axis").agg(F.count("*").alias("n"), F.median("dx").alias("mx"), F.median("dy").alias("my"))
    spread = good.join(F.broadcast(mid), "axis").groupBy("axis", "n", "mx", "my").agg(F.max(F.hypot(F.col("dx") - F.col("mx"), F.col("dy") - F.col("my"))).alias("spread"))
    limit = F.greatest(F.lit(floor), share * F.hypot("mx", "my"))
    return spread.select("axis", "n", F.col("mx").alias("dx"), F.col("my").alias("dy"), "spread", ((F.col("n") >= minimum) & (F.col("spread") <= limit)).alias("usable"))


def predict(pairs: DataFrame, poses: DataFrame, prior: DataFrame) -> DataFrame:
    """(i, j, axis, px, py, source): expected displacement of pairs, from the layout within a component, else from a usable grid prior."""
    a = poses.select(F.col("tile_id").alias("i"), F.col("component").alias("ci"), F.col("x").alias("xi"), F.col("y").alias("yi"))
    b = poses.select(F.col("tile_id").alias("j"), F.col("component").alias("cj"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    p = F.broadcast(prior.where("usable").select("axis", F.col("dx").alias("gx"), F.col("dy").alias("gy")))  # two axes
    joined = pairs.join(a, "i").join(b, "j").join(p, "axis", "left")
    same = F.col("ci") == F.col("cj")
    source = F.when(same, "layout").when(F.col("gx").isNotNull(), "grid_median")
    return joined.select("i", "j", "axis", F.when(same, F.col("xj") - F.col("xi")).otherwise(F.col("gx")).alias("px"), F.when(same, F.col("yj") - F.col("yi")).otherwise(F.col("gy")).alias("py"), source.alias("source"))


def prior_edges(predicted: DataFrame, width: int, height: int, weight: float = 0.02, share: float = 0.03) -> DataFrame:
    """Weak edges from grid predictions whose tiles would overlap enough; they stay labelled and never count as accepted."""
    w, h = F.lit(width) - F.abs("px"), F.lit(height) - F.abs("py")
    good = predicted.where((F.col("source") == "grid_median") & (w > 0) & (h > 0) & (w * h >= share * width * height))
    return good.select("i", "j", F.col("px").alias("dx"), F.col("py").alias("dy"), F.lit(weight).alias("weight"), F.lit("predicted").alias("status"))


def crop_bounds(predicted: DataFrame, width: int, height: int, radius: float, minimum: int = 32) -> DataFrame:
    """Crop windows (x0, y0, x1, y1 of tile i; the same with b of tile j) around the predicted overlap of each pair, with room for the search; pairs with a side under ``minimum`` go."""

    def along(shift: str, size: int) -> tuple[Column, Column, Column, Column]:
        a0, a1 = F.greatest(F.lit(0), F.floor(F.col(shift) - radius)), F.least(F.lit(size), F.ceil(F.col(shift) + size + radius))
        b0, b1 = F.greatest(F.lit(0), F.floor(-F.col(shift) - radius)), F.least(F.lit(size), F.ceil(-F.col(shift) + size + radius))
        return a0, a1, b0, b1

    x, y = along("px", width), along("py", height)
    out = predicted.where("px IS NOT NULL").select("*", *(c.cast("int").alias(n) for c, n in zip((x[0], y[0], x[1], y[1], x[2], y[2], x[3], y[3]), ("x0", "y0", "x1", "y1", "bx0", "by0", "bx1", "by1"))))
    return out.where(f"x1 - x0 >= {minimum} AND y1 - y0 >= {minimum} AND bx1 - bx0 >= {minimum} AND by1 - by0 >= {minimum}")


def plausible(width: int, height: int, dx: str = "dx", dy: str = "dy", axis: str = "axis") -> Column:
    """Whether a displacement runs between 5 and 98 % of the tile along its axis and under 40 % across; the limits themselves are not allowed."""
    along = F.when(F.col(axis) == "right", F.col(dx) / width).otherwise(F.col(dy) / height)
    across = F.when(F.col(axis) == "right", F.abs(dy) / height).otherwise(F.abs(dx) / width)
    return (along > 0.05) & (along < 0.98) & (across < 0.4)


def corner_offsets(homography: str, width: int, height: int) -> list[Column]:
    """How far a row-major 3 x 3 transform in an array column moves the four corners."""
    h = lambda k: F.element_at(homography, k + 1)
    out = []
    for name, x, y in (("tl", 0, 0), ("tr", width - 1, 0), ("bl", 0, height - 1), ("br", width - 1, height - 1)):
        w = h(6) * x + h(7) * y + h(8)
        out += [((h(0) * x + h(1) * y + h(2)) / w - x).alias(f"{name}_dx"), ((h(3) * x + h(4) * y + h(5)) / w - y).alias(f"{name}_dy")]
    return out


def compose(a: str, b: str) -> Column:
    """Product of two row-major 3 x 3 transforms in array columns."""
    cell = lambda r, c: sum((F.element_at(a, 3 * r + k + 1) * F.element_at(b, 3 * k + c + 1) for k in range(1, 3)), F.element_at(a, 3 * r + 1) * F.element_at(b, c + 1))
    return F.array(*(cell(r, c) for r in range(3) for c in range(3)))


def inverse(a: str) -> Column:
    """Inverse of a row-major 3 x 3 transform in an array column, of lower right entry 1; null where there is none."""
    h = lambda r, c: F.element_at(a, 3 * (r % 3) + c % 3 + 1)
    cofactor = lambda r, c: h(r + 1, c + 1) * h(r + 2, c + 2) - h(r + 1, c + 2) * h(r + 2, c + 1)
    last = F.nullif(cofactor(2, 2), F.lit(0.0))
    return F.array(*(cofactor(c, r) / last for r in range(3) for c in range(3)))


def mesh(points: DataFrame, named: DataFrame, width: int, height: int, max_motion: float, max_strain: float, max_error: float) -> DataFrame:
    """(component, tile_id, mesh, accepted, reason): reconciled 5 x 5 meshes from matched points (i, j, ax, ay, bx, by, dx, dy) of each component; ``render_chunks`` takes them."""
    rows = points.join(named.select(F.col("tile_id").alias("i"), "component"), "i")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(np.r_[pdf.i, pdf.j])
        i, j = np.searchsorted(nodes, pdf.i), np.searchsorted(nodes, pdf.j)
        meshes, reason = kernels.reconcile_mesh(len(nodes), i, j, pdf[["ax", "ay"]].to_numpy(float), pdf[["bx", "by"]].to_numpy(float), pdf[["dx", "dy"]].to_numpy(float), width, height, max_motion, max_strain, max_error)
        return pd.DataFrame({"component": pdf.component.iloc[0], "tile_id": nodes, "mesh": [m.reshape(-1).tolist() for m in meshes], "accepted": reason is None, "reason": reason})

    return rows.groupBy("component").applyInPandas(fit, "component bigint, tile_id bigint, mesh array<double>, accepted boolean, reason string")


def relative_to(poses: DataFrame, references: DataFrame) -> DataFrame:
    """Poses with each component's reference tile (component, tile_id) at zero."""
    at = references.join(poses, ["component", "tile_id"]).select("component", F.col("x").alias("rx"), F.col("y").alias("ry"))
    return poses.join(at, "component").select("component", "tile_id", (F.col("x") - F.col("rx")).alias("x"), (F.col("y") - F.col("ry")).alias("y"))


def layout_warning(residual: DataFrame, limit: float = 25.0) -> DataFrame:
    """One row: the worst residual and whether it passes the limit."""
    return residual.agg(F.max("residual_px").alias("worst_px")).withColumn("warning", F.coalesce(F.col("worst_px") > limit, F.lit(False)))


def cycle_residuals(edges: DataFrame, forest: DataFrame, poses: DataFrame, limit: float = 8.0) -> DataFrame:
    """Residuals of the accepted edges that close cycles, under places that only the forest's edges set."""
    return residuals(edges.join(forest.select("i", "j"), ["i", "j"], "left_anti"), poses, limit)


def mesh_basis(x: str, y: str, width: float, height: float, nodes: int = 5) -> list[Column]:
    """Row and column of the mesh cell around a point of a tile, whose outer nodes are the centres of its corner pixels, and the four bilinear weights (upper left, upper right, lower left, lower right)."""
    u, v = (F.least(F.greatest(F.col(p) / max(size - 1, 1), F.lit(0.0)), F.lit(1.0)) * (nodes - 1) for p, size in ((x, width), (y, height)))
    c, r = F.least(F.floor(u), F.lit(nodes - 2)), F.least(F.floor(v), F.lit(nodes - 2))
    fu, fv = u - c, v - r
    return [r.alias("mesh_row"), c.alias("mesh_col"), ((1 - fu) * (1 - fv)).alias("w00"), (fu * (1 - fv)).alias("w01"), ((1 - fu) * fv).alias("w10"), (fu * fv).alias("w11")]


def refinement_gate(samples: DataFrame, minimum: int = 12, share: float = 0.98) -> DataFrame:
    """(i, j, points, baseline, refined, kept) from samples (i, j, a, b, b_refined, inside): a refinement is kept if enough points are inside and their mean error falls."""
    ok = samples.where("inside")
    out = ok.groupBy("i", "j").agg(F.count("*").alias("points"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("baseline"), F.avg(F.abs(F.col("a") - F.col("b_refined"))).alias("refined"))
    return out.withColumn("kept", (F.col("points") >= minimum) & (F.col("refined") < share * F.col("baseline")))


#: What a refiner may report, and the frame of its points.
REFINED, FRAME = ("success", "no_improvement", "unsupported_input", "failed"), "original_tile_pixel_centers_xy"


def invalid_refinements(results: DataFrame) -> DataFrame:
    """``results`` (status, frame, points_a, points_b: arrays of (x, y) arrays) that can't be used, with an ``error``; points count only for a success that has some."""
    finite = lambda c: F.forall(c, lambda p: (F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    given = (F.col("status") == "success") & F.col("points_a").isNotNull()
    good = F.col("points_b").isNotNull() & (F.size("points_a") == F.size("points_b")) & finite("points_a") & finite("points_b")
    error = (
        F.when(~F.coalesce(F.col("status").isin(*REFINED), F.lit(False)), "unknown status")
        .when(F.coalesce(F.col("frame") != FRAME, F.lit(True)), "unknown frame")
        .when(given & ~F.coalesce(good, F.lit(False)), "points that don't fit together")
    )
    return results.withColumn("error", error).where("error IS NOT NULL")
