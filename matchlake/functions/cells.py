"""Areas of Voronoi cells, cut out by half-planes; for many frames at once."""

from __future__ import annotations

import math

import numpy as np

#: Half the side of the square that cells are cut out of, in metres.
FAR = 1e6


def cut(x: np.ndarray, y: np.ndarray, n: np.ndarray, ax: np.ndarray, ay: np.ndarray, mid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of polygons (a row each, the first n corners) where ax * x + ay * y <= mid; no polygon vanishes."""
    at = np.arange(x.shape[1])
    real = at < n[:, None]
    f = x * ax[:, None] + y * ay[:, None] - mid[:, None]
    after = np.where(at + 1 < n[:, None], at + 1, 0)
    x2, y2, f2 = (np.take_along_axis(v, after, axis=1) for v in (x, y, f))
    kept, cross = real & (f <= 0), real & (f * f2 < 0)
    t = np.divide(f, f - f2, out=np.zeros_like(f), where=cross)
    both = np.stack([kept, cross], axis=2).reshape(len(x), -1)
    n = both.sum(axis=1)
    order = np.argsort(~both, axis=1, kind="stable")[:, : n.max()]
    pair = lambda v, v2: np.take_along_axis(np.stack([v, v + (v2 - v) * t], axis=2).reshape(len(v), -1), order, axis=1)
    return pair(x, x2), pair(y, y2), n


def areas(sites: np.ndarray, most: float) -> np.ndarray:
    """(frames, sites) areas of the cells of sites (frames, sites, 2), at most `most` each, 0 for unbounded ones.

    Each cell is cut by the other sites, the nearest first; sites in the same place don't cut each other. Corners are
    rounded to a millionth. A cell is bounded if the other sites surround its site: no two of their directions in turn
    are half a turn apart.
    """
    frames, n, _ = sites.shape
    x, y = sites[:, :, 0], sites[:, :, 1]
    dx, dy = x[:, None, :] - x[:, :, None], y[:, None, :] - y[:, :, None]
    far2 = dx * dx + dy * dy
    other = (dx != 0) | (dy != 0)
    order = np.argsort(np.where(other, far2, np.inf), axis=2, kind="stable").reshape(frames * n, n)
    flat = lambda v: v.reshape(frames * n, n)
    ax, ay, real = (np.take_along_axis(flat(v), order, axis=1) for v in (dx, dy, other))
    sx, sy = x.ravel(), y.ravel()
    mid = (ax * (2 * sx[:, None] + ax) + ay * (2 * sy[:, None] + ay)) / 2
    px, py = np.tile([-FAR, FAR, FAR, -FAR], (frames * n, 1)), np.tile([-FAR, -FAR, FAR, FAR], (frames * n, 1))
    corners = np.full(frames * n, 4)
    for k in range(n - 1):
        px, py, corners = cut(px, py, corners, ax[:, k], ay[:, k], np.where(real[:, k], mid[:, k], 1.0))
    px, py = np.floor(px * 1e6 + 0.5) / 1e6, np.floor(py * 1e6 + 0.5) / 1e6
    at = np.arange(px.shape[1])
    after = np.where(at + 1 < corners[:, None], at + 1, 0)
    turn = px * np.take_along_axis(py, after, axis=1) - np.take_along_axis(px, after, axis=1) * py
    area = np.minimum(np.abs(np.where(at < corners[:, None], turn, 0).sum(axis=1)) / 2, most)
    angle = np.sort(np.where(real, np.arctan2(ay, ax), np.inf), axis=1)
    last = np.take_along_axis(angle, np.maximum(real.sum(axis=1, keepdims=True) - 1, 0), axis=1)[:, 0]
    with np.errstate(invalid="ignore"):
        between = np.diff(angle, axis=1)
    widest = np.maximum(np.where(np.isfinite(between), between, 0).max(axis=1, initial=0), angle[:, 0] + 2 * math.pi - last)
    return np.where(real.any(axis=1) & (widest < math.pi - 1e-7), area, 0.0).reshape(frames, n)
