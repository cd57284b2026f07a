"""Least-squares places of one component that is too large for a task: nested elimination over cells.

Each cell of tiles eliminates the tiles that only its own edges touch and hands on a dense form
over its border. Groups of GROUP x GROUP cells do the same with the forms of their cells, and so on until
one group is left, which is solved with one tile held at zero; then the places go back down. What a
task holds is the border of a group squared, so no task sees all tiles, and the result is exact.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph, layout

#: Tiles along a side of a cell, and cells along a side of a group.
SIDE, GROUP = 16, 4
#: A quadratic form over some tiles: their ids, a dense matrix and two right-hand sides.
FORM = "cy bigint, cx bigint, nodes array<bigint>, matrix binary, `right` binary"


def _forms(edges: DataFrame) -> DataFrame:
    """A form of two tiles for each edge (cy, cx, i, j, dx, dy, w)."""

    def run(batches):
        for pdf in batches:
            w, d = pdf.w.to_numpy(float), pdf[["dx", "dy"]].to_numpy(float)
            matrix = w[:, None] * np.array([1.0, -1.0, -1.0, 1.0])
            right = np.concatenate([-w[:, None] * d, w[:, None] * d], 1)
            yield pd.DataFrame({"cy": pdf.cy, "cx": pdf.cx, "nodes": list(pdf[["i", "j"]].to_numpy()), "matrix": [r.tobytes() for r in matrix], "right": [r.tobytes() for r in right]})

    return edges.select("cy", "cx", "i", "j", "dx", "dy", "w").mapInPandas(run, FORM)


def _assembled(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, matrix, right) of the sum of forms."""
    lists = [np.asarray(n, np.int64) for n in pdf.nodes]
    nodes = np.unique(np.concatenate(lists))
    matrix, right = np.zeros((len(nodes), len(nodes))), np.zeros((len(nodes), 2))
    if len(lists[0]) == 2 and all(len(n) == 2 for n in lists):  # edges, all at once
        at = np.searchsorted(nodes, np.stack(lists))
        m, r = (np.frombuffer(b"".join(pdf[c]), float).reshape(len(lists), 2, 2) for c in ("matrix", "right"))
        np.add.at(matrix, (at[:, :, None], at[:, None, :]), m)
        np.add.at(right, at, r)
    else:
        for n, m, r in zip(lists, pdf.matrix, pdf.right):
            at = np.searchsorted(nodes, n)
            matrix[np.ix_(at, at)] += np.frombuffer(m, float).reshape(len(n), len(n))
            right[at] += np.frombuffer(r, float).reshape(len(n), 2)
    return nodes, matrix, right


def _shared(forms: DataFrame) -> DataFrame:
    """(cy, cx, shared): the tiles of each group that other groups' forms have too."""
    at = forms.select("cy", "cx", F.explode("nodes").alias("node")).distinct()
    among = at.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    return at.join(among.select(F.col("node").alias("of")), F.col("node") == F.col("of"), "left_semi").groupBy("cy", "cx").agg(F.collect_list("node").alias("shared"))  # a group's border


def _grouped(forms: DataFrame, shared: DataFrame, work: Callable, schema: str) -> DataFrame:
    other = shared.select(F.col("cy").alias("gy"), F.col("cx").alias("gx"), *(c for c in shared.columns if c not in ("cy", "cx")))
    return forms.groupBy("cy", "cx").cogroup(other.groupBy("gy", "gx")).applyInPandas(work, schema)


def _reduced(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """A group's form over its border: inner tiles are eliminated."""
    nodes, m, r = _assembled(left)
    border = np.isin(nodes, np.asarray(right.shared.iloc[0]) if len(right) else np.zeros(0, np.int64))
    inner = ~border
    if inner.any():
        gone = np.linalg.solve(m[np.ix_(inner, inner)], np.c_[m[np.ix_(inner, border)], r[inner]])
        size = int(border.sum())
        r = r[border] - m[np.ix_(border, inner)] @ gone[:, size:]
        m = m[np.ix_(border, border)] - m[np.ix_(border, inner)] @ gone[:, :size]
    return pd.DataFrame([(left.cy.iloc[0], left.cx.iloc[0], nodes[border], np.ascontiguousarray(m).tobytes(), np.ascontiguousarray(r).tobytes())], columns=["cy", "cx", "nodes", "matrix", "right"])


def _placed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Places of a group's inner tiles, given those of its border (tile_id, x, y); without a border the least tile is at zero."""
    if not len(left):
        return pd.DataFrame({"tile_id": [], "x": [], "y": []})
    nodes, m, r = _assembled(left)
    known = right.dropna(subset=["tile_id"]) if len(right) else right
    border = np.isin(nodes, known.tile_id.to_numpy(np.int64)) if len(known) else np.arange(len(nodes)) == 0
    p = np.zeros((len(nodes), 2))
    if len(known):
        p[np.searchsorted(nodes, known.tile_id.to_numpy(np.int64))] = known[["x", "y"]].to_numpy(float)
    inner = ~border
    if inner.any():
        p[inner] = np.linalg.solve(m[np.ix_(inner, inner)], r[inner] - m[np.ix_(inner, border)] @ p[border])
    own = inner if len(known) else np.ones(len(nodes), bool)
    return pd.DataFrame({"tile_id": nodes[own], "x": p[own, 0], "y": p[own, 1]})


def weighted_places(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """(tile_id, x, y) of one component from edges (i, j, dx, dy, w) by weighted least squares; ``cells`` (tile_id, cy, cx) says which tiles lie near each other. The zero is any tile's."""
    at = edges.join(cells.withColumnRenamed("tile_id", "i"), "i")
    forms = graph.cut(_forms(at))
    levels = []
    while True:
        shared = graph.cut(_shared(forms))
        levels.append((forms, shared))
        if shared.isEmpty():
            break
        reduced = _grouped(forms, shared, _reduced, FORM)
        up = lambda c: F.floor(F.col(c) / GROUP).cast("long").alias(c)
        forms = graph.cut(reduced.select(up("cy"), up("cx"), "nodes", "matrix", "right"))
    places = None
    for forms, shared in reversed(levels):
        if places is None:
            given = shared.select("cy", "cx", F.lit(None).cast("long").alias("tile_id"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
        else:
            given = shared.select("cy", "cx", F.explode("shared").alias("tile_id")).join(places, "tile_id").select("cy", "cx", "tile_id", "x", "y")
        found = _grouped(forms, given, _placed, "tile_id bigint, x double, y double")
        places = graph.cut(found if places is None else places.union(found))
    return places


def cells_of(rough: DataFrame, step_x: float, step_y: float, side: int = SIDE) -> DataFrame:
    """(tile_id, cy, cx) from rough places (tile_id, x, y) and the distance of neighbours, so that a cell has about ``side`` squared tiles."""
    cell = lambda at, step: F.floor(F.col(at) / (side * step)).cast("long")
    return rough.select("tile_id", cell("y", step_y).alias("cy"), cell("x", step_x).alias("cx"))


def solve_large(edges: DataFrame, cells: DataFrame, rounds: int = 6) -> DataFrame:
    """(tile_id, x, y): what ``layout.solve`` finds by lengths for one component, its least tile at zero, without a task that holds it.

    edges: i, j, dx, dy, status and perhaps weight; all of one component. The median of the residuals, which sets the scale of the weights, is
    taken to one in 10^5 of its rank.
    """
    w = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    rows = graph.cut(edges.where("status = 'accepted'").select(*(F.col(c).cast(t).alias(c) for c, t in (("i", "long"), ("j", "long"), ("dx", "double"), ("dy", "double"))), w.alias("base"), F.lit("accepted").alias("status")))
    cells = graph.cut(cells)
    weighted = rows.withColumn("w", F.col("base"))
    for k in range(rounds):
        places = weighted_places(weighted.select("i", "j", "dx", "dy", "w"), cells)
        if k + 1 == rounds:
            break
        r = graph.cut(layout.residuals(rows, places).select("i", "j", "residual_px"))
        middle = r.agg(F.percentile_approx("residual_px", 0.5, 100_000)).first()[0] or 0.0
        robust = F.least(F.lit(1.0), F.lit(max(2.0, 1.5 * middle)) / F.greatest("residual_px", F.lit(1e-12)))
        weighted = graph.cut(rows.join(r, ["i", "j"]).withColumn("w", F.col("base") * robust))
    first = places.agg(F.min_by(F.struct("x", "y"), "tile_id").alias("o")).select("o.x", "o.y").first()
    return places.select("tile_id", *((F.col(c) - F.lit(v)).alias(c) for c, v in zip("xy", first or (0.0, 0.0))))
