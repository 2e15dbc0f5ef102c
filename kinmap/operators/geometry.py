"""Geometry of matched keypoints: consistent sets, homographies by least median of squares, affine maps and their condition."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

TURN = 2.0 * 3.1416  # fixed value: a full turn as the matching rule takes it


def consistent(q: np.ndarray, t: np.ndarray, i: int, j: int, most: float) -> np.ndarray:
    """Indices of the matches that agree with references i and j: query and train points (2 x n, matched columns) are put to one scale by
    the references' distances and one turn by their angles, train points are moved by the mean offset, and must come within ``most``
    pixels on both axes. The offset is taken before the turn, as the rule has it."""
    rq, rt = q[:, j] - q[:, i], t[:, j] - t[:, i]
    dq, dt = float(np.hypot(*rq)), float(np.hypot(*rt))
    rate = dq / dt if dt > 0 else 1.0
    if rate <= 0:
        return np.zeros(0, np.int64)
    q, t = (q, t * rate) if rate > 1 else (q / rate, t)
    turn = math.atan2(rq[1], rq[0]) - math.atan2(rt[1], rt[0])
    if abs(turn) > TURN:
        turn = math.modf(turn / TURN)[0]
    if turn < 0:
        turn += TURN
    offset = (q[:, i] - t[:, i] + q[:, j] - t[:, j]) / 2
    c, s = math.cos(turn), math.sin(turn)
    moved = np.array([[c, -s], [s, c]]) @ t + offset[:, None]
    return np.flatnonzero((np.abs(q - moved) < most).all(axis=0))


def largest_consistent(q: np.ndarray, t: np.ndarray, references: int = 50, most: float = 20.0) -> np.ndarray:
    """The largest set that any pair of the first ``references`` matches agrees with; a match that was in a set is no second reference
    again, and of equal sets the first counts."""
    n = min(references, q.shape[1])
    best, used = np.zeros(0, np.int64), set()
    for i in range(n - 1):
        sets = [consistent(q, t, i, j, most) for j in range(i + 1, n) if j not in used]
        for found in sets:
            best = found if len(found) > len(best) else best
            used.update(found.tolist())
    return best


def solve_homography(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """3 x 3 map of points a to b (n x 2, n of 4 or more) by the direct linear transform on normalised points."""

    def norm(p: np.ndarray) -> np.ndarray:
        m = p.mean(axis=0)
        d = np.sqrt(((p - m) ** 2).sum(axis=1)).mean()
        s = math.sqrt(2) / d if d > 0 else 1.0
        return np.array([[s, 0, -s * m[0]], [0, s, -s * m[1]], [0, 0, 1]])

    na, nb = norm(a), norm(b)
    x, y = (na @ np.c_[a, np.ones(len(a))].T)[:2]
    u, v = (nb @ np.c_[b, np.ones(len(b))].T)[:2]
    o, z = np.ones_like(x), np.zeros_like(x)
    rows = np.r_[np.c_[-x, -y, -o, z, z, z, u * x, u * y, u], np.c_[z, z, z, -x, -y, -o, v * x, v * y, v]]
    h = np.linalg.inv(nb) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ na
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def project(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    out = h @ np.c_[p, np.ones(len(p))].T
    with np.errstate(divide="ignore", invalid="ignore"):
        return (out[:2] / out[2]).T


def least_median_homography(a: np.ndarray, b: np.ndarray, tries: int = 300, seed: int = 7) -> np.ndarray | None:
    """The homography of four points with the least median of squared errors, fitted again to the points it explains."""
    if len(a) < 4:
        return None
    rng = np.random.default_rng(seed)
    best, least = None, math.inf
    for _ in range(tries if len(a) > 4 else 1):
        pick = rng.choice(len(a), 4, replace=False)
        h = solve_homography(a[pick], b[pick])
        if h is None:
            continue
        error = np.nan_to_num(((project(h, a) - b) ** 2).sum(axis=1), nan=math.inf)
        if (median := float(np.median(error))) < least:
            best, least = h, median
    if best is None:
        return None
    sigma = 2.5 * 1.4826 * (1 + 5 / max(len(a) - 4, 1)) * math.sqrt(max(least, 1e-12))
    good = ((project(best, a) - b) ** 2).sum(axis=1) <= sigma**2
    return (solve_homography(a[good], b[good]) if good.sum() >= 4 else None) if good.sum() > 4 else best


def affine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """2 x 3 map of a to b by least squares; with four points or fewer, the fixed singular matrix that stands for failure."""
    if len(a) <= 4:
        return np.array([[0, 1e10, 0], [1e10, 0, 0]])
    return np.linalg.lstsq(np.c_[a, np.ones(len(a))], b, rcond=None)[0].T


def inverse_condition(m: np.ndarray) -> float:
    """1 over the condition number of the map as a 3 x 3 matrix."""
    c = np.linalg.cond(np.r_[m, [[0, 0, 1]]])
    return 0.0 if not np.isfinite(c) else 1.0 / float(c)


def warp(image: np.ndarray, h: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image under a 3 x 3 map (2 x 3 maps get a last row), by inverse mapping and bilinear interpolation; zero outside."""
    h = np.r_[h, [[0, 0, 1]]] if h.shape == (2, 3) else h
    y, x = np.mgrid[:height, :width]
    at = project(np.linalg.inv(h), np.c_[x.ravel(), y.ravel()].astype(float))
    fx, fy = np.floor(at[:, 0]), np.floor(at[:, 1])
    out = np.zeros(height * width)
    for dx in (0, 1):
        for dy in (0, 1):
            px, py = fx + dx, fy + dy
            ok = (px >= 0) & (px < image.shape[1]) & (py >= 0) & (py < image.shape[0])
            weight = (1 - np.abs(at[:, 0] - px)) * (1 - np.abs(at[:, 1] - py))
            out[ok] += weight[ok] * image[py[ok].astype(int), px[ok].astype(int)]
    return out.reshape(height, width)


def _points(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return rows[["qx", "qy"]].to_numpy(float), rows[["tx", "ty"]].to_numpy(float)


def geometric_consistency(matches: DataFrame) -> DataFrame:
    """i, j, q_kp, t_kp of the largest consistent set of each pair's matches (with qx, qy, tx, ty), in order of their query keypoints. A
    pair has at most some thousand matches."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["q_kp", "t_kp"]).reset_index(drop=True)
        q, t = _points(rows)
        return rows.loc[largest_consistent(q.T, t.T), ["i", "j", "q_kp", "t_kp"]]

    return matches.groupBy("i", "j").applyInPandas(run, "i long, j long, q_kp long, t_kp long")


def homographies(matches: DataFrame) -> DataFrame:
    """i, j, h (9 values, null without one), error: the map of each pair's query points to train points and its median error."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["q_kp", "t_kp"])
        a, b = _points(rows)
        h = least_median_homography(a, b)
        error = None if h is None else float(np.median(np.sqrt(((project(h, a) - b) ** 2).sum(axis=1))))
        return pd.DataFrame({"i": [rows["i"].iloc[0]], "j": [rows["j"].iloc[0]], "h": [None if h is None else h.ravel().tolist()], "error": [error]})

    return matches.groupBy("i", "j").applyInPandas(run, "i long, j long, h array<double>, error double")


def affine_maps(matches: DataFrame) -> DataFrame:
    """i, j, m (6 values), rcond."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["q_kp", "t_kp"])
        m = affine(*_points(rows))
        return pd.DataFrame({"i": [rows["i"].iloc[0]], "j": [rows["j"].iloc[0]], "m": [m.ravel().tolist()], "rcond": [round(inverse_condition(m), 6)]})

    return matches.groupBy("i", "j").applyInPandas(run, "i long, j long, m array<double>, rcond double")
