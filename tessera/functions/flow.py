"""Dense displacement between two overlapping images by polynomial expansion.

Each neighbourhood is a quadratic polynomial, fitted under Gaussian weights; a displaced
polynomial differs in its linear part, so the displacement solves a small linear system
a pixel, summed over a window and refined over iterations and a pyramid.
"""

from __future__ import annotations

import numpy as np

from tessera.functions import kernels

#: Pyramid levels, window side, iterations and the width of the Gaussian weights.
LEVELS, WINDOW, ITERATIONS, SIGMA = 3, 25, 5, 1.5
#: Distance of sampled points, their distance from the border, the least of them, the disagreement of both directions and the variance that texture needs.
STEP, BORDER, LEAST, DISAGREEMENT, TEXTURE = 12, 8, 12, 1.0, 16.0
#: Sides under this have too little to look at.
NARROW = 24


def _filtered(x: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    r, n = len(kernel) // 2, x.shape[axis]
    pad = [(0, 0)] * x.ndim
    pad[axis] = (r, r)
    wide = np.pad(x, pad, mode="edge")
    return sum(w * np.take(wide, np.arange(k, k + n), axis=axis) for k, w in enumerate(kernel) if w)


def expansion(image: np.ndarray) -> np.ndarray:
    """(xx, xy, yy, x, y): for each pixel the quadratic and linear coefficients of the polynomial that fits around it best."""
    r = int(np.ceil(3 * SIGMA))
    t = np.arange(-r, r + 1)
    g = np.exp(-(t**2) / (2 * SIGMA**2))
    g /= g.sum()
    m2, m4 = (g * t**2).sum(), (g * t**4).sum()
    along = [_filtered(image, g * t**p, 1) for p in range(3)]
    one, y, yy = (_filtered(along[0], g * t**p, 0) for p in range(3))
    x, xy = _filtered(along[1], g, 0), _filtered(along[1], g * t, 0)
    xx = _filtered(along[2], g, 0)
    # 1, x^2 and y^2 aren't orthogonal under the weights, x, y and x y are.
    inverse = np.linalg.inv(np.array([[1, m2, m2], [m2, m4, m2 * m2], [m2, m2 * m2, m4]]))
    axx = inverse[1, 0] * one + inverse[1, 1] * xx + inverse[1, 2] * yy
    ayy = inverse[2, 0] * one + inverse[2, 1] * xx + inverse[2, 2] * yy
    return np.stack([axx, xy / (2 * m2 * m2), ayy, x / m2, y / m2], -1)


def _window_mean(x: np.ndarray, side: int) -> np.ndarray:
    for axis in (0, 1):
        r, n = side // 2, x.shape[axis]
        pad = [(0, 0)] * x.ndim
        pad[axis] = (r + 1, r)
        total = np.cumsum(np.pad(x, pad, mode="edge"), axis=axis)
        x = (np.take(total, np.arange(side, side + n), axis=axis) - np.take(total, np.arange(n), axis=axis)) / side
    return x


def _certainty(x: np.ndarray, y: np.ndarray, width: int, height: int) -> np.ndarray:
    """Weight of the polynomials at some places: little near the border, beyond which their neighbourhoods reach, none outside."""
    inside = np.minimum(np.minimum(x, width - 1 - x), np.minimum(y, height - 1 - y))
    return np.clip((inside + 0.5) / np.ceil(3 * SIGMA), 0, 1) ** 2


def flow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(height, width, 2): where each pixel of a lies in b, as (dx, dy) from its own place; both have one size."""
    pyramid = [(a.astype(float), b.astype(float))]
    while len(pyramid) <= LEVELS and min(pyramid[-1][0].shape) >= 64:
        pyramid.append(tuple(kernels._down(x) for x in pyramid[-1]))
    move = np.zeros((*pyramid[-1][0].shape, 2))
    for fine, coarse in zip(pyramid[::-1], [None, *pyramid[:0:-1]]):
        h, w = fine[0].shape
        gy, gx = np.mgrid[0:h, 0:w].astype(float)
        if coarse is not None:
            ch, cw = move.shape[:2]
            move = 2 * kernels.bilinear(move, np.minimum(gx / 2, cw - 1), np.minimum(gy / 2, ch - 1))
        first, second = expansion(fine[0]), expansion(fine[1])
        own = _certainty(gx, gy, w, h)
        for _ in range(ITERATIONS):
            tx, ty = gx + move[..., 0], gy + move[..., 1]
            there = kernels.bilinear(second, np.clip(tx, 0, w - 1), np.clip(ty, 0, h - 1))
            xx, xy, yy = np.moveaxis((first[..., :3] + there[..., :3]) / 2, -1, 0)
            bx, by = np.moveaxis((first[..., 3:] - there[..., 3:]) / 2, -1, 0)
            bx = bx + xx * move[..., 0] + xy * move[..., 1]
            by = by + xy * move[..., 0] + yy * move[..., 1]
            sure = (own * _certainty(tx, ty, w, h))[..., None]
            sums = _window_mean(sure * np.stack([xx * xx + xy * xy, xy * (xx + yy), xy * xy + yy * yy, xx * bx + xy * by, xy * bx + yy * by], -1), WINDOW)
            p, q, s, u, v = np.moveaxis(sums, -1, 0)
            # A flat window has no answer; its displacement stays near zero.
            det = p * s - q * q + 1e-3
            move = np.stack([(s * u - q * v) / det, (p * v - q * u) / det], -1)
    return move


def refine(a: np.ndarray, b: np.ndarray, dx: float, dy: float) -> dict:
    """Points of grey tiles a and b that show the same, from b's place (dx, dy) in a: status, reason, points_a and points_b in each tile's own pixels.

    Points lie on a grid over the overlap; kept are those whose flow there and back ends within a pixel of the start, in textured places and away from the border.
    """
    none = {"points_a": None, "points_b": None}
    left, top = int(np.ceil(max(0.0, dx))), int(np.ceil(max(0.0, dy)))
    right, bottom = int(np.floor(min(a.shape[1] - 1, b.shape[1] - 1 + dx))), int(np.floor(min(a.shape[0] - 1, b.shape[0] - 1 + dy)))
    if right < left or bottom < top:
        return {"status": "unsupported_input", "reason": "no overlap", **none}
    h, w = bottom - top + 1, right - left + 1
    if min(h, w) < NARROW:
        return {"status": "unsupported_input", "reason": "the overlap is too narrow", **none}
    p = a[top : bottom + 1, left : right + 1].astype(float)
    gy, gx = np.mgrid[top : bottom + 1, left : right + 1].astype(float)
    q = kernels.bilinear(b.astype(float), gx - dx, gy - dy)
    there, back = flow(p, q), flow(q, p)
    y, x = (g.ravel() for g in np.mgrid[BORDER : h - BORDER : STEP, BORDER : w - BORDER : STEP])
    target = np.stack([x, y], 1) + there[y, x]
    inside = (target > 2).all(1) & (target[:, 0] < w - 3) & (target[:, 1] < h - 3)
    returned = kernels.bilinear(back, np.clip(target[:, 0], 0, w - 1), np.clip(target[:, 1], 0, h - 1))
    around = kernels.gaussian_blur(np.stack([p * p, p], -1), 1.7)
    variance = around[..., 0] - around[..., 1] ** 2
    good = inside & (np.hypot(*(there[y, x] + returned).T) < DISAGREEMENT) & (variance[y, x] > TEXTURE)
    if good.sum() < LEAST:
        return {"status": "no_improvement", "reason": "too few points agree in both directions", **none}
    origin = np.array([left, top])
    return {"status": "success", "reason": None, "points_a": np.stack([x, y], 1)[good] + origin.astype(float), "points_b": target[good] + origin - (dx, dy)}
