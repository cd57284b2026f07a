"""Canvas, chunk joins and compositing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import kernels


def canvas(poses: DataFrame, margin: int = 20, max_dim: int = 12_000, by: str | None = None) -> DataFrame:
    """Bounds, size with margins and the scale that keeps the longer side within ``max_dim``, from placed tiles (x, y, width, height)."""
    bounds = [F.min(F.floor("x")).alias("x0"), F.min(F.floor("y")).alias("y0"), F.max(F.ceil(F.col("x") + F.col("width"))).alias("x1"), F.max(F.ceil(F.col("y") + F.col("height"))).alias("y1")]
    box = poses.groupBy(by).agg(*bounds) if by else poses.agg(*bounds)
    w, h = F.col("x1") - F.col("x0") + 2 * margin, F.col("y1") - F.col("y0") + 2 * margin
    return box.withColumn("canvas_width", w).withColumn("canvas_height", h).withColumn("scale", F.least(F.lit(1.0), F.lit(float(max_dim)) / F.greatest("canvas_width", "canvas_height")))


def chunk_tiles(poses: DataFrame, chunk: int = 512) -> DataFrame:
    """(cy, cx, tile_id) for every chunk that a placed tile touches: a range join turned into rows of an equi-join key."""
    span = lambda at, size: F.sequence(F.floor(F.col(at) / chunk), F.floor((F.ceil(F.col(at) + F.col(size)) - 1) / chunk))
    return poses.withColumn("cy", F.explode(span("y", "height"))).withColumn("cx", F.explode(span("x", "width")))


def coverage(poses: DataFrame, chunk: int = 512) -> DataFrame:
    """(cy, cx, tiles, area): tiles in each chunk, and their areas inside it summed."""
    at = chunk_tiles(poses, chunk)
    w = F.least(F.col("x") + F.col("width"), (F.col("cx") + 1) * chunk) - F.greatest(F.col("x"), F.col("cx") * chunk)
    h = F.least(F.col("y") + F.col("height"), (F.col("cy") + 1) * chunk) - F.greatest(F.col("y"), F.col("cy") * chunk)
    return at.groupBy("cy", "cx").agg(F.count("*").alias("tiles"), F.sum(w * h).cast("double").alias("area"))


def overlaps(poses: DataFrame, minimum: int = 500) -> DataFrame:
    """(i, j, overlap_px) of placed tiles that share ``minimum`` pixels, through a raster of the largest tile instead of all pairs.

    A pair counts in one cell only, that of its overlap's upper left corner.
    """
    size = poses.agg(F.max("width").alias("w"), F.max("height").alias("h"))
    at = poses.join(F.broadcast(size)).withColumn("cx", F.explode(F.sequence(F.floor(F.col("x") / F.col("w")), F.floor((F.col("x") + F.col("width") - 1) / F.col("w"))))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("y") / F.col("h")), F.floor((F.col("y") + F.col("height") - 1) / F.col("h")))))
    side = lambda s: at.select(F.col("tile_id").alias(s), F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}"), F.col("width").alias(f"w{s}"), F.col("height").alias(f"h{s}"), "cx", "cy", *(["w", "h"] if s == "i" else []))
    left, top = F.greatest("xi", "xj"), F.greatest("yi", "yj")
    w = F.least(F.col("xi") + F.col("wi"), F.col("xj") + F.col("wj")) - left
    h = F.least(F.col("yi") + F.col("hi"), F.col("yj") + F.col("hj")) - top
    out = side("i").join(side("j"), ["cx", "cy"]).where((F.col("i") < F.col("j")) & (w > 0) & (h > 0) & (w * h >= minimum))
    return out.where((F.col("cx") == F.floor(left / F.col("w"))) & (F.col("cy") == F.floor(top / F.col("h")))).select("i", "j", (w * h).cast("long").alias("overlap_px"))


def boundary_feather(pixels: DataFrame) -> DataFrame:
    """(y, x, value, coverage) of pixels (tile_id, px, py, width, height, x, y, value): weights min distance to the tile's border, one weighted mean a canvas pixel."""
    w = F.least(F.col("px") + 1, F.col("py") + 1, F.col("width") - F.col("px"), F.col("height") - F.col("py")).cast("double")
    return pixels.groupBy("y", "x").agg(F.rint(F.sum(w * F.col("value")) / F.greatest(F.sum(w), F.lit(1e-12))).cast("int").alias("value"), F.count("*").alias("coverage"))


#: A crop of a tile for one chunk.
CROPS = "component bigint, cy bigint, cx bigint, tile_id bigint, x double, y double, width int, height int, channels int, dtype string, mesh array<double>, levels int, `left` int, top int, cols int, `rows` int, data binary, mask binary"
CHUNKS = "component bigint, cy bigint, cx bigint, height int, width int, data binary, coverage binary"


def _mesh_of(values) -> np.ndarray | None:
    """A square mesh of (dx, dy) from a flat array; None for no mesh or one that moves nothing."""
    if values is None or not len(values):
        return None
    mesh = np.asarray(values, float)
    side = round((len(mesh) / 2) ** 0.5)
    mesh = mesh.reshape(side, side, 2)
    return mesh if mesh.any() else None


def crops(tiles: DataFrame, chunk: int = 512, halo: int = 0, levels: int = 0) -> DataFrame:
    """The part of each placed tile that each chunk, with a halo around it, can need (``CROPS``): the chunk less the tile's place, reaching as far as the tile's mesh moves anything.

    Only these parts are shuffled, so a tile's pixels travel about once, however many chunks it touches.
    """

    def cut(batches):
        names = [f.strip("` ").split()[0].strip("`") for f in CROPS.split(", ")]
        for pdf in batches:
            for r in pdf.to_dict("records"):
                w, h, n = r["width"], r["height"], r["channels"]
                image = np.frombuffer(r["data"], np.dtype(r["dtype"])).reshape(h, w, n)
                hidden = None if r["mask"] is None else np.frombuffer(r["mask"], np.uint8).reshape(h, w) > 0
                mesh = _mesh_of(r["mesh"])
                low, high = ((0.0, 0.0), (0.0, 0.0)) if mesh is None else (mesh.min(axis=(0, 1)), mesh.max(axis=(0, 1)))
                spans = []
                for at, size, a, b in ((r["x"], w, low[0], high[0]), (r["y"], h, low[1], high[1])):
                    first, last = int(np.floor((at + a - halo) / chunk)), int(np.floor((at + size - 1 + b + halo) / chunk))
                    found = []
                    for c in range(first, last + 1):
                        begin = max(0, int(np.floor(c * chunk - halo - at - b)) - 1)
                        end = min(size, int(np.ceil((c + 1) * chunk - 1 + halo - at - a)) + 2)
                        if begin < end:
                            found.append((c, begin, end))
                    spans.append(found)
                out = []
                for cy, top, bottom in spans[1]:
                    for cx, left, right in spans[0]:
                        part = np.ascontiguousarray(image[top:bottom, left:right]).tobytes()
                        shown = None if hidden is None else np.ascontiguousarray(hidden[top:bottom, left:right]).tobytes()
                        out.append((r["component"], cy, cx, r["tile_id"], r["x"], r["y"], w, h, n, r["dtype"], r["mesh"], r["levels"], left, top, right - left, bottom - top, part, shown))
                yield pd.DataFrame(out, columns=names)

    own = [F.col(c).cast("double").alias(c) if c in ("x", "y") else F.col(c) for c in ("component", "tile_id", "x", "y", "width", "height", "channels", "dtype", "data")]
    more = [F.col(c) if c in tiles.columns else F.lit(None).cast(t).alias(c) for c, t in (("mesh", "array<double>"), ("mask", "binary"))]
    more.append(F.least(F.col("levels") if "levels" in tiles.columns else F.lit(levels), F.lit(levels)).cast("int").alias("levels"))
    return tiles.select(*own, *more).where("x IS NOT NULL AND y IS NOT NULL AND data IS NOT NULL").mapInPandas(cut, CROPS)


def render_chunks(tiles: DataFrame, chunk: int = 512, blend: str = "feather", levels: int = 6) -> DataFrame:
    """(component, cy, cx, height, width, data, coverage): blended chunks, of those that some pixel covers, of placed 8- or 16-bit tiles.

    tiles: component, tile_id, x, y, width, height, channels, dtype, data (raw samples), and perhaps mesh (square, rows of
    (dx, dy) over the tile, as ``layout.mesh`` gives it) and mask (a byte a pixel, 0 hides it). A tile's pixel p lies at its place plus p
    plus the mesh at p; a chunk's pixels look for it by fixed-point rounds. A chunk's crops come in the order
    of the tiles and are added up one by one, so memory is a chunk's however many tiles lie there, and results don't depend on the chunk size.

    ``blend`` is ``feather``, whose weights are the distances to the tile's border, or ``multiband``: pyramids of ``levels`` levels (of fewer where
    tiles have a column levels that says so, the same for a whole component; 0 is the plain mean) over masks of full weight, zero beyond all tiles.
    Chunks are then worked out with a halo of 4 x 2^levels pixels, as far as a pixel's bands reach, and must be multiples of 2^levels, so that all share one grid a level.
    """
    if blend not in ("feather", "multiband"):
        raise ValueError("blend is feather or multiband")
    banded = blend == "multiband"
    if banded and not (0 <= levels <= 8 and chunk % 2**levels == 0):
        raise ValueError("levels lie within 0 and 8, and the chunk is a multiple of 2^levels")
    halo = 4 * 2**levels if banded and levels else 0
    side, core = chunk + 2 * halo, slice(halo, halo + chunk)

    def mix(batches):
        key, kind, depth, total, weight, count = None, None, None, None, None, None

        def done() -> pd.DataFrame | None:
            seen = np.ascontiguousarray(count[core, core])
            if not seen.any():
                return None  # what reached here was masked, fell between the pixels or lies in the halo
            if banded and depth:
                value = np.where(seen[..., None] > 0, kernels.mixed_bands(total, weight, depth, mirrored=False)[core, core], 0)
            else:
                value = (total / np.maximum(weight, 1e-12)[..., None])[core, core]
            if kind.kind in "ui":
                value = np.clip(np.rint(value), 0, np.iinfo(kind).max)
            return pd.DataFrame([(*key, chunk, chunk, value.astype(kind).tobytes(), seen.tobytes())], columns=["component", "cy", "cx", "height", "width", "data", "coverage"])

        for pdf in batches:
            for r in pdf.to_dict("records"):
                here = (r["component"], r["cy"], r["cx"])
                if here != key:
                    if key is not None and (out := done()) is not None:
                        yield out
                    key, kind, n, depth = here, np.dtype(r["dtype"]), r["channels"], r["levels"]
                    total, weight, count = np.zeros((side, side, n)), np.zeros((side, side)), np.zeros((side, side), np.uint16)
                w, h, left, top = r["width"], r["height"], r["left"], r["top"]
                image = np.frombuffer(r["data"], kind).reshape(r["rows"], r["cols"], -1)
                mesh = _mesh_of(r["mesh"])
                # Only the chunk's rows and columns that the tile can reach are looked at.
                low, high = ((0.0, 0.0), (0.0, 0.0)) if mesh is None else (mesh.min(axis=(0, 1)), mesh.max(axis=(0, 1)))
                x0, y0 = here[2] * chunk - halo, here[1] * chunk - halo
                x_from, x_to = max(0, int(np.floor(r["x"] + low[0])) - x0), min(side, int(np.ceil(r["x"] + w - 1 + high[0])) - x0 + 1)
                y_from, y_to = max(0, int(np.floor(r["y"] + low[1])) - y0), min(side, int(np.ceil(r["y"] + h - 1 + high[1])) - y0 + 1)
                if x_from >= x_to or y_from >= y_to:
                    continue
                gy, gx = np.mgrid[y0 + y_from : y0 + y_to, x0 + x_from : x0 + x_to].astype(float)
                u, v = gx - r["x"], gy - r["y"]
                ok = np.ones(u.shape, bool)
                if mesh is not None:
                    u, v, ok = kernels.unwarped(mesh, u, v, w, h)
                ok &= (u >= 0) & (v >= 0) & (u <= w - 1) & (v <= h - 1)
                if r["mask"] is not None and ok.any():
                    shown = np.frombuffer(r["mask"], np.uint8).reshape(r["rows"], r["cols"]).astype(float)
                    ok[ok] = kernels.bilinear(shown, u[ok], v[ok], left, top, (h, w)) >= 0.999
                if not ok.any():
                    continue
                at = tuple(i + o for i, o in zip(np.nonzero(ok), (y_from, x_from)))
                u, v = u[ok], v[ok]
                mine = np.ones(u.shape) if banded else np.minimum(np.minimum(u + 1, v + 1), np.minimum(w - u, h - v))
                total[at] += kernels.bilinear(image.astype(float), u, v, left, top, (h, w)) * mine[:, None]
                weight[at] += mine
                count[at] += 1
        if key is not None and (out := done()) is not None:
            yield out

    keys = ["component", "cy", "cx"]
    return crops(tiles, chunk, halo, levels if banded else 0).repartition(*keys).sortWithinPartitions(*keys, "tile_id").mapInPandas(mix, CHUNKS)


def chunk_sums(chunks: DataFrame, dtype: str = "uint8") -> DataFrame:
    """(component, cy, cx, covered, contributions, total, moment) of chunks of samples of a type: covered pixels, tiles that gave to them, values, and values times a weight of 1 to 1009 by the place."""

    def add(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                h, w = r["height"], r["width"]
                count = np.frombuffer(r["coverage"], np.uint16).astype(np.int64)
                value = np.frombuffer(r["data"], dtype).reshape(h * w, -1).astype(np.int64).sum(1)
                y, x = np.mgrid[r["cy"] * h : (r["cy"] + 1) * h, r["cx"] * w : (r["cx"] + 1) * w]
                place = 1 + (x * 31 + y * 17).ravel() % 1009
                out.append((r["component"], r["cy"], r["cx"], (count > 0).sum(), count.sum(), value.sum(), (value * place).sum()))
            yield pd.DataFrame(out, columns=["component", "cy", "cx", "covered", "contributions", "total", "moment"])

    return chunks.mapInPandas(add, "component bigint, cy bigint, cx bigint, covered bigint, contributions bigint, total bigint, moment bigint")


def exposure(ratios: DataFrame) -> DataFrame:
    """(component, tile_id, gain) from (component, i, j, median_i, median_j) of overlaps: least squares on log ratios a component; medians under 1 say nothing."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(np.r_[pdf.i, pdf.j])
        r = np.log(pdf.median_j.to_numpy(float) / pdf.median_i.to_numpy(float))
        gains = kernels.exposure_gains(len(nodes), np.searchsorted(nodes, pdf.i), np.searchsorted(nodes, pdf.j), r)
        return pd.DataFrame({"component": pdf.component.iloc[0], "tile_id": nodes, "gain": gains})

    return ratios.where("median_i >= 1 AND median_j >= 1").groupBy("component").applyInPandas(solve, "component bigint, tile_id bigint, gain double")


def register_pairs(pairs: DataFrame, radius: float = float("inf")) -> DataFrame:
    """(i, j, status, dx, dy, ncc, texture, overlap_px) of pairs of grey tiles (a, b as raw bytes with their sizes) by phase correlation."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                a = np.frombuffer(r["a"], np.uint8).reshape(r["ha"], r["wa"]).astype(float)
                b = np.frombuffer(r["b"], np.uint8).reshape(r["hb"], r["wb"]).astype(float)
                axis = r.get("axis")
                direction = None if axis is None else (0, 1) if axis == "right" else (1, 0)
                prior = None if r.get("px") is None else (r["px"], r["py"])
                out.append({"i": r["i"], "j": r["j"], **kernels.phase_correlation(a, b, direction, prior, radius)})
            yield pd.DataFrame(out, columns=["i", "j", "status", "dx", "dy", "ncc", "texture", "overlap_px"])

    return pairs.mapInPandas(run, "i bigint, j bigint, status string, dx double, dy double, ncc double, texture double, overlap_px bigint")


def covered_box(covered: DataFrame) -> DataFrame:
    """Bounds of pixels (x, y, coverage) that some tile covers."""
    return covered.where("coverage > 0").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def strided(pixels: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th pixel in both directions."""
    return pixels.where((F.pmod("x", F.lit(step)) == 0) & (F.pmod("y", F.lit(step)) == 0))


def merge_feathered(base: DataFrame, added: DataFrame) -> DataFrame:
    """Two weighted canvases (x, y, value, weight) as one: the weighted mean is associative, so only sums are kept."""
    both = base.unionByName(added)
    return both.groupBy("x", "y").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value"), F.sum("weight").alias("weight"))


def paste(base: DataFrame, added: DataFrame) -> DataFrame:
    """Feathered where both cover a pixel, an exact copy where one does."""
    a, b = base.select("x", "y", F.col("value").alias("va"), F.col("weight").alias("wa")), added.select("x", "y", F.col("value").alias("vb"), F.col("weight").alias("wb"))
    both = a.join(b, ["x", "y"], "full")
    value = F.when(F.col("va").isNull(), F.col("vb")).when(F.col("vb").isNull(), F.col("va")).otherwise(F.floor((F.col("va") * F.col("wa") + F.col("vb") * F.col("wb")) / (F.col("wa") + F.col("wb"))))
    return both.select("x", "y", value.alias("value"), (F.coalesce("wa", F.lit(0)) + F.coalesce("wb", F.lit(0))).alias("weight"))


def row_fallback(rows: DataFrame) -> DataFrame:
    """The completed row (grid_row, covered) of most covered pixels, the first of equals."""
    best = rows.agg(F.max_by(F.struct(*rows.columns), F.struct("covered", -F.col("grid_row"))).alias("b")).where("b IS NOT NULL")
    return best.select(*(F.col(f"b.{c}").alias(c) for c in rows.columns))


def incremental_gain(pixels: DataFrame, minimum: int = 200, limit: float = 1.6) -> DataFrame:
    """(frame, n, gain) from overlap pixels (frame, base, added): the ratio of medians within 1 / limit to limit; 1 for small overlaps."""
    out = pixels.groupBy("frame").agg(F.count("*").alias("n"), F.median("base").alias("b"), F.median("added").alias("a"))
    gain = F.when((F.col("n") >= minimum) & (F.col("a") > 0), F.least(F.greatest(F.col("b") / F.col("a"), F.lit(1 / limit)), F.lit(limit))).otherwise(F.lit(1.0))
    return out.select("frame", "n", gain.alias("gain"))


def world_origin(poses: DataFrame) -> DataFrame:
    """Canvas places of tiles that are kept in world coordinates: the origin is their least x and y at the time of reading, and may be negative."""
    least = poses.agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    return poses.join(F.broadcast(least)).select("tile_id", (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"), "x0", "y0")
