"""Binary masks: connected components, morphology, local thresholds, and their use on whole images in Spark."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def components(mask: np.ndarray) -> np.ndarray:
    """Labels (0 outside, else from 1 in reading order) of 4-connected parts: labels fall to their neighbours' least until none moves."""
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        low = labels.copy()
        for a, b in ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None))):
            for x, y in (((a, slice(None)), (b, slice(None))), ((slice(None), a), (slice(None), b))):
                both = (labels[x] > 0) & (labels[y] > 0)
                low[x] = np.where(both, np.minimum(low[x], labels[y]), low[x])
        hop = np.where(low > 0, low.ravel()[np.maximum(low, 1) - 1], 0)
        low = np.where(low > 0, np.minimum(low, hop), 0)
        if (low == labels).all():
            break
        labels = low
    found, out = np.unique(labels, return_inverse=True)
    return out.reshape(mask.shape) + (0 if found[0] == 0 else 1)


def component_boxes(mask: np.ndarray) -> pd.DataFrame:
    """label, x, y, w, h, area."""
    labels = components(mask)
    y, x = np.nonzero(labels)
    rows = pd.DataFrame({"label": labels[y, x], "x": x, "y": y}).groupby("label")
    low, high = rows.min(), rows.max()
    return pd.DataFrame({"label": low.index, "x": low["x"].to_numpy(), "y": low["y"].to_numpy(), "w": (high["x"] - low["x"] + 1).to_numpy(), "h": (high["y"] - low["y"] + 1).to_numpy(), "area": rows.size().to_numpy()})


def ellipse(size: int) -> np.ndarray:
    r = (size - 1) / 2
    y, x = np.mgrid[:size, :size]
    return ((x - r) ** 2 + (y - r) ** 2) <= (r + 0.25) ** 2


def dilate(mask: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    h, w = kernel.shape
    padded = np.pad(mask.astype(bool), ((h // 2, h - 1 - h // 2), (w // 2, w - 1 - w // 2)))
    out = np.zeros(mask.shape, bool)
    for dy, dx in np.argwhere(kernel):
        out |= padded[dy : dy + mask.shape[0], dx : dx + mask.shape[1]]
    return out


def erode(mask: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return ~dilate(~mask.astype(bool), kernel[::-1, ::-1])


def closing(mask: np.ndarray, size: int) -> np.ndarray:
    return erode(dilate(mask, ellipse(size)), ellipse(size))


def opening(mask: np.ndarray, size: int) -> np.ndarray:
    return dilate(erode(mask, ellipse(size)), ellipse(size))


def blur(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian of 2 * ceil(2 * sigma) + 1 taps, borders mirrored."""
    r = int(np.ceil(2 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    out = image.astype(float)
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        wide = np.pad(out, pad, mode="reflect" if out.shape[axis] > r else "symmetric")
        out = sum(k[i] * np.take(wide, np.arange(i, i + image.shape[axis]), axis=axis) for i in range(2 * r + 1))
    return out


def change_mask(level: np.ndarray, block: int = 35, offset: float = 10.0) -> np.ndarray:
    """Where a map is above its local mean less an offset, closed by 30 and 15 and opened by 15."""
    local = blur(level, (block - 1) / 6)
    return opening(closing(closing(level > local - offset, 30), 15), 15)


def mask_components(pixels: DataFrame, image: str, height: int, width: int, threshold: str) -> DataFrame:
    """image, label, x, y, w, h, area of the parts of each image's pixels over its ``threshold`` column."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((height, width), bool)
        mask[rows["y"], rows["x"]] = rows["v"] > rows[threshold]
        return component_boxes(mask).assign(**{image: rows[image].iloc[0]})[[image, "label", "x", "y", "w", "h", "area"]]

    return pixels.groupBy(image).applyInPandas(run, f"{image} long, label long, x long, y long, w long, h long, area long")


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    y = np.clip((np.arange(height) + 0.5) * image.shape[0] / height - 0.5, 0, image.shape[0] - 1)
    x = np.clip((np.arange(width) + 0.5) * image.shape[1] / width - 0.5, 0, image.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    bottom = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return top * (1 - fy) + bottom * fy
