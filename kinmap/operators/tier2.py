"""Second-tier comparison of a probe with a result: registration, difference map, change mask; and the likeness of matched patches."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinmap.operators import features, geometry, masks, pixels

LEAST_CONDITION = 0.1
Similarity = Callable[[np.ndarray, np.ndarray], float]
_similarities: dict[str, Similarity] = {}


def register_similarity(name: str, f: Similarity) -> None:
    """f(patch, patch of the same shape) gives a number."""
    _similarities[name] = f


class Change(NamedTuple):
    level: np.ndarray
    modified: bool
    everywhere: bool
    share: float


def difference_map(a: np.ndarray, b: np.ndarray, sigma: float = 5.0, threshold: float = pixels.CHANGED, least: int = pixels.LEAST_PIXELS) -> Change:
    """Where two gray images of one shape differ after a blur: 0 for most alike, more for more different. They count as changed if their
    largest gap is ``threshold`` of the possible one or more, and ``least`` pixels or more come close to it; as changed everywhere if more
    than half of the signal-to-noise map lies near its least."""
    a, b = masks.blur(a, sigma), masks.blur(b, sigma)
    gap, possible = np.abs(a - b), max(np.ptp(np.array([a.max(), b.min()])), np.ptp(np.array([b.max(), a.min()])))
    close = gap > gap.max() - pixels.CLOSE * threshold * possible
    if gap.max() < threshold * possible or close.sum() < least:
        return Change(np.zeros_like(gap), False, False, -1.0)
    signal = 10 * np.log10(pixels.PEAK**2 / (1 + (gap / gap.max()) ** 2))  # gap.max() > 0, as some pixels are close to it
    share = float((signal < pixels.NEAR * signal.min()).mean())
    return Change(1 - signal / signal.max(), True, share > 0.5, share)


def normalised_map(level: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """A map clipped at four deviations and stretched to 255, inside the mask."""
    low, high = max(level.min(), level.mean() - 4 * level.std()), min(level.max(), level.mean() + 4 * level.std())
    return (np.clip(level, low, high) - low) / ((high - low) or 1.0) * 255.0 * mask


def histogram_matched(source: np.ndarray, template: np.ndarray) -> np.ndarray:
    """The source with its values moved to the template's at the same quantiles."""
    if not source.size or not template.size:
        return source
    _, at, counts = np.unique(source, return_inverse=True, return_counts=True)
    values, own = np.unique(template, return_counts=True)
    return np.interp(np.cumsum(counts) / source.size, np.cumsum(own) / template.size, values)[at].reshape(source.shape)


def mutual_information(a: np.ndarray, b: np.ndarray, bins: int = 256) -> float:
    def edges(x: np.ndarray) -> tuple[float, float]:
        half = 0.5 * (x.max() - x.min()) / (bins - 1)
        return x.min() - half, x.max() + half

    ra, rb = edges(a), edges(b)
    if ra[1] - ra[0] <= 1 or rb[1] - rb[0] <= 1:
        return 0.0
    joint = np.histogram2d(a.ravel(), b.ravel(), bins=bins, range=[ra, rb])[0] / a.size

    def entropy(p: np.ndarray) -> float:
        p = p[p > 0]
        return float(-(p * np.log2(p)).sum())

    return entropy(joint.sum(axis=1)) + entropy(joint.sum(axis=0)) - entropy(joint)


register_similarity("mutual_information", mutual_information)
register_similarity("mean_squared_error", lambda a, b: float(((a - b) ** 2).mean()))


def box_of(points: np.ndarray) -> tuple[slice, slice]:
    low, high = np.floor(points.min(axis=0)).astype(int), np.floor(points.max(axis=0)).astype(int)
    return slice(max(low[1], 0), high[1] + 1), slice(max(low[0], 0), high[0] + 1)


def patch_likeness(a: np.ndarray, pa: np.ndarray, b: np.ndarray, pb: np.ndarray, least: int = 9) -> dict[str, float] | None:
    """Every registered similarity of the patches around matched points, the first matched in histogram and resized to the second; None
    if a side of a patch is under ``least`` pixels."""
    if not len(pa) or not len(pb):
        return None
    first, second = a[box_of(pa)], b[box_of(pb)]
    if min(*first.shape, *second.shape) < least:
        return None
    first = masks.resized(histogram_matched(first, second), *second.shape)
    return {name: f(first, second) for name, f in _similarities.items()}


def compare(probe: np.ndarray, result: np.ndarray, pp: np.ndarray, rp: np.ndarray) -> dict:
    """rcond, modified, everywhere, share, mask of a result registered to a probe by matched points (result points rp to probe points
    pp). A map whose inverse condition is under ``LEAST_CONDITION`` compares nothing."""
    m = geometry.affine(rp, pp)
    scaled = m.copy()
    scaled[:, 2] /= max(probe.shape)  # the shift in image units, so that far shifts do not look singular
    rcond = geometry.inverse_condition(scaled)
    out = {"rcond": round(rcond, 6), "modified": None, "everywhere": None, "share": None, "mask": None}
    if rcond < LEAST_CONDITION:
        return out
    warped = geometry.warp(result, m, *probe.shape)
    covered = geometry.warp(np.ones_like(result), m, *probe.shape) > 0.99
    change = difference_map(np.where(covered, probe, 0.0), np.where(covered, warped, 0.0))
    mask = masks.change_mask(change.level * 255) & covered if change.modified else np.zeros(probe.shape, bool)
    return out | {"modified": change.modified, "everywhere": change.everywhere, "share": round(change.share, 6), "mask": np.packbits(mask).tobytes()}


def change_masks(pairs: DataFrame) -> DataFrame:
    """probe_id, result_id, rcond, modified, everywhere, share, mask (packed bits, row by row) for pairs with images (height, width, and
    gray bytes on both sides) and matched points (px, py, rx, ry, arrays). A row is one comparison, so rows can be dealt to any task."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                probe = np.frombuffer(r.probe, np.uint8).reshape(r.probe_height, -1).astype(float)
                result = np.frombuffer(r.result, np.uint8).reshape(r.result_height, -1).astype(float)
                rows.append({"probe_id": r.probe_id, "result_id": r.result_id} | compare(probe, result, np.c_[r.px, r.py], np.c_[r.rx, r.ry]))
            yield pd.DataFrame(rows, columns=["probe_id", "result_id", "rcond", "modified", "everywhere", "share", "mask"])

    return pairs.mapInPandas(run, "probe_id long, result_id long, rcond double, modified boolean, everywhere boolean, share double, mask binary")


def by_condition(changes: DataFrame, least: float = LEAST_CONDITION) -> DataFrame:
    """Adds pos (from 1): the results of each probe from the best conditioned map on; those under ``least`` are left out, ties go to the
    smaller result."""
    order = Window.partitionBy("probe_id").orderBy(F.col("rcond").desc(), "result_id")
    return changes.filter(F.col("rcond") >= least).withColumn("pos", F.row_number().over(order))


def uncovered(probe_mask: np.ndarray, used: np.ndarray, least: int = 50) -> np.ndarray | None:
    """A mask without what earlier objects cover; None if no more than ``least`` pixels are left."""
    left = probe_mask & ~used
    return left if math.floor(left.sum()) > least else None


def objects_of(mask: np.ndarray, share: float = 0.16, least: int = 125 * 125) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, w, h) of the parts of a change mask that may be an object: smaller than the image by more than ``share`` on both sides,
    and of more than ``least`` pixels."""
    h, w = mask.shape
    boxes = masks.component_boxes(mask)[["x", "y", "w", "h"]].to_numpy().tolist() if mask.any() else []
    return [b for b in map(tuple, boxes) if w - b[2] > share * w and h - b[3] > share * h and b[2] * b[3] > least]


def object_features(probe: np.ndarray, results: list[tuple[int, np.ndarray, np.ndarray]], share: float = 0.16, least: int = 125 * 125) -> list[tuple]:
    """(result id, object, "q" or "r", vec) of the objects in which ``results`` (id, image registered to the probe, change mask) differ from the
    probe: features of the result in the object's mask, and of the probe where no earlier object has covered it."""
    used, out = np.zeros(probe.shape, bool), []
    for result, image, mask in results:
        for k, (x, y, w, h) in enumerate(objects_of(mask, share, least)):
            at = (slice(y, y + h), slice(x, x + w))
            left = uncovered(mask[at], used[at])
            used[at] |= mask[at]
            sides = ([("q", probe[at], left)] if left is not None else []) + [("r", image[at], mask[at])]
            for side, pixels_, inside in sides:
                _, vecs = features.masked_surf(pixels_, inside, scaled=False)
                out += [(result, k, side, v.tolist()) for v in vecs]
    return out


def second_tier_queries(pairs: DataFrame) -> DataFrame:
    """probe_id, result_id, object_id, side, q, vec: what to search for in the second tier, from pairs as ``change_masks`` takes them. A probe
    has some dozen results (its list is cut), which are taken together, the best conditioned first, as each object leaves less of the
    probe to the next."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        probe = np.frombuffer(rows["probe"].iloc[0], np.uint8).reshape(rows["probe_height"].iloc[0], -1).astype(float)
        found = []
        for r in rows.itertuples():
            result = np.frombuffer(r.result, np.uint8).reshape(r.result_height, -1).astype(float)
            seen = compare(probe, result, np.c_[r.px, r.py], np.c_[r.rx, r.ry])
            if seen["modified"]:
                mask = np.unpackbits(np.frombuffer(seen["mask"], np.uint8), count=probe.size).reshape(probe.shape).astype(bool)
                found.append((seen["rcond"], r.result_id, geometry.warp(result, geometry.affine(np.c_[r.rx, r.ry], np.c_[r.px, r.py]), *probe.shape), mask))
        found.sort(key=lambda x: (-x[0], x[1]))
        got = object_features(probe, [x[1:] for x in found])
        return pd.DataFrame([(r.probe_id, result, k, side, i, v) for i, (result, k, side, v) in enumerate(got)], columns=["probe_id", "result_id", "object_id", "side", "q", "vec"])

    return pairs.groupBy("probe_id").applyInPandas(run, "probe_id long, result_id long, object_id long, side string, q long, vec array<double>")
