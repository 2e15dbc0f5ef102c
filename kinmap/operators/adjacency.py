"""Measures of image pairs from the images themselves: matches, warps both ways, and the likeness of what they show."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmap.operators import features, geometry, knn, tier2
from kinmap.operators.match import RATIO

#: Matches whose points bound the patches that are compared.
PATCH_MATCHES = 100
MEASURES = ("kp", "dist", "mi_out", "mi_in", "mse_out", "mse_in")


def ratio_matches(qv: np.ndarray, tv: np.ndarray, ratio: float = RATIO) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of both sides and distances of the matches that pass the ratio test."""
    r, found, d = knn.nearest(qv, tv, np.arange(len(tv)), 2)
    at = np.flatnonzero(r[1:] == r[:-1])
    good = at[(d[at + 1] > 0) & (d[at] < ratio * d[at + 1])]
    return r[good], found[good], d[good]


def warped_both_ways(a: np.ndarray, pa_: np.ndarray, b: np.ndarray, pb: np.ndarray) -> tuple | None:
    """(a on b, its points there, b on a, its points there) by the homographies of the matched points, or None without one."""
    forth, back = geometry.least_median_homography(pa_, pb), geometry.least_median_homography(pb, pa_)
    if forth is None or back is None or min(abs(np.linalg.det(h)) for h in (forth, back)) < 1e-12:
        return None
    on_b, on_a = (np.round(geometry.project(h, p), 3) for h, p in ((forth, pa_), (back, pb)))  # so that whole pixels stay whole
    return geometry.warp(a, forth, *b.shape), on_b, geometry.warp(b, back, *a.shape), on_a


def measures(a: np.ndarray, points_a: np.ndarray, vecs_a: np.ndarray, b: np.ndarray, points_b: np.ndarray, vecs_b: np.ndarray) -> dict | None:
    """``MEASURES`` of two gray images with keypoints (x, y) and descriptors: number and mean distance of geometrically consistent matches, and
    mutual information and mean squared error of each image, laid on the other, with that other around the matches. None with three
    matches or fewer. Patches that are too small have no information and an error of -1."""
    swapped = len(points_a) < len(points_b)
    q, t, d = ratio_matches(*((vecs_b, vecs_a) if swapped else (vecs_a, vecs_b))) if len(vecs_a) and len(vecs_b) else (np.zeros(0, int),) * 3
    i, j = (t, q) if swapped else (q, t)
    good = geometry.largest_consistent(*((points_b[j].T, points_a[i].T) if swapped else (points_a[i].T, points_b[j].T)))
    i, j, d = i[good], j[good], d[good]
    warped = warped_both_ways(a, points_a[i], b, points_b[j]) if len(d) > 3 else None
    if warped is None:
        return None
    top = slice(0, PATCH_MATCHES)
    forth = tier2.patch_likeness(warped[0], warped[1][top], b, points_b[j][top])
    back = tier2.patch_likeness(warped[2], warped[3][top], a, points_a[i][top])
    mi, mse = ([0.0 if x is None else x["mutual_information"] for x in (forth, back)], [-1.0 if x is None else x["mean_squared_error"] for x in (forth, back)])
    return {"kp": len(d), "dist": float(d.mean()), "mi_out": mi[0], "mi_in": mi[1], "mse_out": mse[0], "mse_in": mse[1]}


def adjacency(pairs: DataFrame, images: DataFrame, keypoints: DataFrame) -> DataFrame:
    """i, j and ``MEASURES`` of ``pairs(i, j)`` that match: images (image_id, height, width, channels, data) and their keypoints (image_id, kp_idx,
    x, y, vec) come together pair by pair, a task taking any number of pairs, one at a time."""

    def side(c: str, second: bool) -> DataFrame:
        points = pairs.join(keypoints.filter("vec IS NOT NULL").select(F.col("image_id").alias(c), "kp_idx", "x", "y", "vec"), c)
        picture = pairs.join(images.select(F.col("image_id").alias(c), "height", "width", "channels", "data"), c)
        none = [F.lit(None).cast(t).alias(n) for n, t in (("height", "int"), ("width", "int"), ("channels", "int"), ("data", "binary"))]
        rows = points.select("i", "j", F.lit(second).alias("second"), F.col("kp_idx").cast("long").alias("kp_idx"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "vec", *none)
        head = picture.select("i", "j", F.lit(second).alias("second"), F.lit(-1).cast("long").alias("kp_idx"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.expr("cast(NULL AS array<double>)").alias("vec"), "height", "width", "channels", "data")
        return rows.unionByName(head)

    def run(rows: pa.Table) -> pa.Table:
        sides = []
        for second in (False, True):
            own = rows.filter(pc.equal(rows.column("second"), second)).sort_by("kp_idx")
            head = own.slice(0, 1).to_pylist()
            if not head or head[0]["kp_idx"] != -1 or not head[0]["data"]:
                return empty
            points = own.slice(1)
            picture = features.gray(head[0]["height"], head[0]["width"], head[0]["channels"], head[0]["data"])
            at = np.c_[points.column("x").to_numpy(), points.column("y").to_numpy()]
            sides += [picture, at, knn.matrix(points.column("vec").combine_chunks()) if points.num_rows else np.zeros((0, 1))]
        got = measures(*sides)
        if got is None:
            return empty
        return pa.table({"i": rows.column("i")[:1], "j": rows.column("j")[:1], "kp": pa.array([got["kp"]], pa.int64()), **{m: pa.array([round(got[m], 6)], pa.float64()) for m in MEASURES[1:]}})

    ids = [("i", pa.int64()), ("j", pa.int64()), ("kp", pa.int64()), *((m, pa.float64()) for m in MEASURES[1:])]
    empty = pa.table({n: pa.array([], t) for n, t in ids})
    both = side("i", False).unionByName(side("j", True))
    return both.groupBy("i", "j").applyInArrow(run, "i long, j long, kp long, " + ", ".join(f"{m} double" for m in MEASURES[1:]))


def as_cells(found: DataFrame) -> DataFrame:
    """i, j, kp, dist, mi, mse: both directions of each pair, as the cells of the four matrices."""
    out = found.select("i", "j", "kp", "dist", F.col("mi_out").alias("mi"), F.col("mse_out").alias("mse"))
    return out.unionByName(found.select(F.col("j").alias("i"), F.col("i").alias("j"), "kp", "dist", F.col("mi_in").alias("mi"), F.col("mse_in").alias("mse")))
