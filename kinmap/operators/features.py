"""Keypoints and descriptors of images: a registry of kernels, and the default, a determinant-of-Hessian detector (after Bay et al.)."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmap.operators import masks
from kinmap.operators.catalogs import pending

KEYPOINT = "x float, y float, size float, angle float, response float, octave int"
Detector = Callable[[np.ndarray], np.ndarray]
Describer = Callable[[np.ndarray, np.ndarray], np.ndarray]
_detectors: dict[str, Detector] = {}
_describers: dict[str, Describer] = {}


def register_detector(name: str, f: Detector) -> None:
    """f(gray image) gives rows of x, y, size, angle, response, octave."""
    _detectors[name] = f


def register_descriptor(name: str, f: Describer) -> None:
    """f(gray image, keypoints) gives a row for each keypoint."""
    _describers[name] = f


def integral(image: np.ndarray) -> np.ndarray:
    return np.pad(image.astype(float).cumsum(0).cumsum(1), ((1, 0), (1, 0)))


def box(sums: np.ndarray, y: np.ndarray, x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Sums of boxes with the given top left corners; parts beyond the image are empty."""
    top, bottom = np.clip(y, 0, sums.shape[0] - 1), np.clip(y + h, 0, sums.shape[0] - 1)
    left, right = np.clip(x, 0, sums.shape[1] - 1), np.clip(x + w, 0, sums.shape[1] - 1)
    return sums[bottom, right] - sums[top, right] - sums[bottom, left] + sums[top, left]


def hessian_response(sums: np.ndarray, size: int) -> np.ndarray:
    """Determinant of the Hessian by box filters of ``size`` (9, 15, 21, ...), at every pixel."""
    h, w = sums.shape[0] - 1, sums.shape[1] - 1
    y, x = np.mgrid[:h, :w]
    lobe, half = size // 3, size // 2
    wide = 2 * lobe - 1
    dyy = box(sums, y - half, x - wide // 2, size, wide) - 3 * box(sums, y - lobe // 2, x - wide // 2, lobe, wide)
    dxx = box(sums, y - wide // 2, x - half, wide, size) - 3 * box(sums, y - wide // 2, x - lobe // 2, wide, lobe)
    dxy = box(sums, y - lobe, x + 1, lobe, lobe) + box(sums, y + 1, x - lobe, lobe, lobe) - box(sums, y - lobe, x - lobe, lobe, lobe) - box(sums, y + 1, x + 1, lobe, lobe)
    area = float(size * size)
    return dxx / area * (dyy / area) - (0.9 * dxy / area) ** 2


def detect_surf(image: np.ndarray, threshold: float = 10.0, sizes: tuple[int, ...] = (9, 15, 21, 27, 39, 51)) -> np.ndarray:
    """Maxima over space and scale, strongest first."""
    sizes = tuple(s for s in sizes if s < min(image.shape))
    if len(sizes) < 3:
        return np.zeros((0, 6))
    sums = integral(image)
    levels = np.stack([hessian_response(sums, s) for s in sizes])
    padded = np.pad(levels, 1, constant_values=-np.inf)
    inner = levels[1:-1]
    peak = inner > threshold
    for dz in range(3):
        for dy in range(3):
            for dx in range(3):
                if (dz, dy, dx) != (1, 1, 1):
                    other = padded[dz + 1 : dz + 1 + len(inner), dy : dy + image.shape[0], dx : dx + image.shape[1]]
                    peak &= inner > other if (dz, dy, dx) < (1, 1, 1) else inner >= other
    z, y, x = np.nonzero(peak)
    rows = np.c_[x, y, np.array(sizes)[z + 1] * 1.2 / 9 * 10, np.zeros(len(z)), inner[z, y, x], z]
    return rows[np.lexsort((x, y, -rows[:, 4]))]


def describe_surf(image: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Upright 64-value descriptors: sums of Haar responses and of their sizes over a 4 x 4 grid, to unit length. Keypoints of one size are
    taken together."""
    sums, out = integral(image), np.zeros((len(points), 64))
    grid = np.arange(-10, 10) + 0.5
    gy, gx = np.meshgrid(grid, grid, indexing="ij")
    weight = np.exp(-(gx**2 + gy**2) / (2 * 3.3**2))
    for size in np.unique(points[:, 2]) if len(points) else ():
        same = np.flatnonzero(points[:, 2] == size)
        s = max(1.0, size / 12 * 1.2)
        w = max(1, int(round(s)))
        for at in range(0, len(same), 2048):
            own = same[at : at + 2048]
            y, x = (np.rint(points[own, c][:, None, None] + g * s).astype(int) for c, g in ((1, gy), (0, gx)))
            dx = (box(sums, y - w, x, 2 * w, w) - box(sums, y - w, x - w, 2 * w, w)) * weight
            dy = (box(sums, y, x - w, w, 2 * w) - box(sums, y - w, x - w, w, 2 * w)) * weight
            cells = [c.reshape(-1, 4, 5, 4, 5).sum(axis=(2, 4)).reshape(-1, 16) for c in (dx, np.abs(dx), dy, np.abs(dy))]
            vecs = np.stack(cells, axis=2).reshape(-1, 64)
            norms = np.linalg.norm(vecs, axis=1, keepdims=True)
            out[own] = vecs / np.where(norms > 0, norms, 1.0)
    return out


def topped_up(image: np.ndarray, points: np.ndarray, most: int = 5000, cells: int = 35, dense: bool = False) -> np.ndarray:
    """The first ``most`` keypoints; where there are under a tenth of that, or if asked for, after up to half as many points of a grid of
    about ``cells`` by ``cells``, in a fixed random order."""
    if len(points) < 0.1 * most or dense:
        dy, dx = (max(1, n // cells) for n in image.shape)
        y, x = (g.ravel() for g in np.meshgrid(np.arange(0, image.shape[0], dy), np.arange(0, image.shape[1], dx), indexing="ij"))
        order = np.random.RandomState(7).permutation(len(x))[: most // 2]  # fixed value: the seed
        flat = np.zeros(len(order))
        points = np.r_[np.c_[x[order], y[order], flat + max(dx, dy), flat - 1, flat, flat], points]
    return points[:most]


def without_collisions(points: np.ndarray, top: int = 2500, most: int = 5000) -> np.ndarray:
    """The ``top`` strongest keypoints, then weaker ones that are farther from the nearest taken one than the mean of both sizes, up to
    ``most``."""
    taken = np.zeros(len(points), bool)
    taken[: min(top, most)] = True
    for i in range(int(taken.sum()), len(points)):
        if taken.sum() >= most:
            break
        held = np.flatnonzero(taken)
        apart = np.hypot(*(points[held, :2] - points[i, :2]).T)
        near = int(apart.argmin())
        taken[i] = apart[near] > (points[held[near], 2] + points[i, 2]) / 2
    return points[taken]


def spread_out(points: np.ndarray, top: int = 2500, most: int = 5000, apart: float = 50.0) -> np.ndarray:
    """The ``top`` strongest keypoints, then weaker ones farther than ``apart`` pixels from all taken before, up to ``most``. The order
    matters, so the rest is taken one by one; a grid of cells keeps each step local."""
    taken = list(range(min(top, len(points), most)))
    grid: dict[tuple[int, int], list[int]] = {}
    cell = lambda i: (int(points[i, 0] // apart), int(points[i, 1] // apart))
    for i in taken:
        grid.setdefault(cell(i), []).append(i)
    for i in range(len(taken), len(points)):
        if len(taken) >= most:
            break
        cx, cy = cell(i)
        near = [k for a in (-1, 0, 1) for b in (-1, 0, 1) for k in grid.get((cx + a, cy + b), ())]
        if not near or np.hypot(*(points[near, :2] - points[i, :2]).T).min() > apart:
            taken.append(i)
            grid.setdefault((cx, cy), []).append(i)
    return points[taken]


def uniform_patterns(patch: np.ndarray, samples: int, radius: float) -> np.ndarray:
    """For each pixel the number of the ``samples`` points on a circle that are no darker, or ``samples`` + 1 if these do not lie in one arc.
    Points between pixels are interpolated, those outside are 0."""
    angle = 2 * np.pi * np.arange(samples) / samples
    padded = np.pad(patch.astype(float), int(radius) + 2)
    edge = int(radius) + 2
    y, x = np.mgrid[: patch.shape[0], : patch.shape[1]]
    signs = np.zeros((samples, *patch.shape), bool)
    for k, (dy, dx) in enumerate(zip(np.round(-radius * np.sin(angle), 5), np.round(radius * np.cos(angle), 5))):
        fy, fx = int(np.floor(dy)), int(np.floor(dx))
        ty, tx = dy - fy, dx - fx
        at = lambda a, b: padded[y + edge + fy + a, x + edge + fx + b]  # noqa: E731, B023
        value = (1 - ty) * ((1 - tx) * at(0, 0) + tx * at(0, 1)) + ty * ((1 - tx) * at(1, 0) + tx * at(1, 1))
        signs[k] = value >= patch
    turns = (signs != np.roll(signs, 1, axis=0)).sum(axis=0)
    return np.where(turns <= 2, signs.sum(axis=0), samples + 1)


def local_binary_patterns(image: np.ndarray, points: np.ndarray, bins: int = 64, radius: float = 5) -> np.ndarray:
    """For each keypoint the normalised histogram of uniform patterns in a window of 30 pixels or its size."""
    out = np.zeros((len(points), bins))
    for n, (x, y, size) in enumerate(points[:, :3]):
        half = int(max(size, 30) / 2)
        patch = image[max(0, int(y) - half) : int(y) + half, max(0, int(x) - half) : int(x) + half]
        if patch.size:
            codes = uniform_patterns(patch, bins, max(2, min(radius, patch.shape[0] // 2, patch.shape[1] // 2)))
            counts = np.histogram(codes, bins=bins, range=(0, int(codes.max()) + 1))[0]
            out[n] = counts / counts.sum()
    return out


def masked_surf(image: np.ndarray, mask: np.ndarray | None = None, most: int = 2000, threshold: float = 100.0, scaled: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Keypoints and descriptors inside a mask, the ``most`` strongest. Black borders never count: what is 1 or less once the image is stretched
    to 255. ``scaled`` first shrinks wide images to 512 columns; keypoints come back in the image's own pixels."""
    own = image.astype(float)
    low, high = own.min(), own.max()
    inside = (own - low) * (255.0 / (high - low) if high > low else 0.0) > 1
    inside = inside & mask.astype(bool) if mask is not None else inside
    factor = min(1.0, 512 / own.shape[1]) if scaled else 1.0
    if factor < 1:
        own = masks.resized(own, max(1, int(own.shape[0] * factor)), 512)
    points = detect_surf(own, threshold)
    at = np.minimum((points[:, :2] / factor).astype(int), np.array([image.shape[1] - 1, image.shape[0] - 1]))
    points = points[inside[at[:, 1], at[:, 0]]][:most] if len(points) else points
    vecs = describe_surf(own, points)
    points[:, :3] /= factor
    return points, vecs


def rooted(name: str) -> Describer:
    """The descriptors of a registered kernel, each divided by its sum and its values' roots taken."""

    def describe(image: np.ndarray, points: np.ndarray) -> np.ndarray:
        vecs = _describers[name](image, points)
        return np.sqrt(vecs / (vecs.sum(axis=1, keepdims=True) + 1e-8))

    return describe


def shrunk(image: np.ndarray, most: int = 2_073_600) -> np.ndarray:
    """An image of more than ``most`` pixels (HD) at that size, its shape kept."""
    h, w = image.shape
    if h * w <= most:
        return image
    width = round(math.sqrt(most * w / h))
    return masks.resized(image, round(h / w * width), width)


register_detector("SURF", lambda image: topped_up(image, detect_surf(image)))
register_detector("SURF2", lambda image: without_collisions(detect_surf(image)))
register_detector("SURF3", lambda image: spread_out(detect_surf(image)))
register_detector("SURF4", lambda image: detect_surf(image)[:2000])
register_detector("SURF_MASKED", lambda image: masked_surf(image, scaled=False)[0])
register_descriptor("SURF", describe_surf)
register_descriptor("LBP", local_binary_patterns)
register_descriptor("RootSIFT", rooted("SIFT"))  # for a registered SIFT


def gray(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """A decoded image (rows of BGR bytes, as Spark's image source gives them) as gray values."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
    return pixels[:, :, 0] if channels == 1 else pixels[:, :, :3] @ np.array([0.114, 0.587, 0.299])


def extract_features(images: DataFrame, detector: str = "SURF3", descriptor: str = "SURF", tasks: int | None = None, flip: bool = False, downsize: bool = False) -> DataFrame:
    """image_id, kp_idx, x, y, size, angle, response, octave, vec from images (image_id, height, width, channels, data); an image that
    cannot be read gives one row without vec and with an error. ``tasks`` deals images out anew where a few files hold many; ``downsize``
    shrinks images to HD, ``flip`` then turns them upside down."""
    detect, describe = _detectors[detector], _describers[descriptor]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in KEYPOINT.split(", ")]
        for batch in batches:
            for row in batch.to_pandas().itertuples():
                try:
                    image = gray(row.height, row.width, row.channels, row.data)
                    image = shrunk(image) if downsize else image
                    image = image[::-1] if flip else image
                    points = detect(image)
                    vecs, error = list(describe(image, points)), None
                except Exception as x:
                    points, vecs, error = np.full((1, len(names)), np.nan), [None], repr(x)
                n = len(vecs)
                columns = [pa.array([row.image_id] * n, pa.int64()), pa.array(range(n), pa.int64())]
                columns += [pa.array(c, pa.float32(), from_pandas=True) for c in points[:, :-1].T]
                columns += [pa.array(points[:, -1], pa.float64(), from_pandas=True).cast(pa.int32())]
                columns += [pa.array(vecs, pa.list_(pa.float64())), pa.array([error] * n, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["image_id", "kp_idx", *names, "vec", "error"])

    chosen = images.select("image_id", "height", "width", "channels", "data")
    return (chosen.repartition(tasks, "image_id") if tasks else chosen).mapInArrow(run, f"image_id long, kp_idx long, {KEYPOINT}, vec array<double>, error string")


def extract_pending(images: DataFrame, folder: str, machine: str = "0", **how) -> DataFrame:
    """Extracts features of the images (with a name) that no ledger in ``folder`` names as done, appends them to ``folder``/features, and then
    adds this run's ledger; returns it: name, image_id, status. A run that is cut off leaves features whose images no ledger names; they
    are extracted again, and ``read_features`` passes the former over."""
    spark = images.sparkSession
    todo = pending(images, merged_ledgers(spark, folder), "name")
    run = f"{machine}-{uuid.uuid4().hex}"
    extract_features(todo, **how).withColumn("run", F.lit(run)).write.mode("append").parquet(f"{folder}/features")
    found = spark.read.parquet(f"{folder}/features").filter(F.col("run") == run)
    failed = found.filter("error IS NOT NULL").select("image_id").distinct().withColumn("failed", F.lit(True))
    ledger = todo.select("name", "image_id").join(failed, "image_id", "left").select("name", "image_id", F.when(F.col("failed"), "unable").otherwise("completed").alias("status"), F.lit(run).alias("run"))
    ledger.write.mode("append").parquet(f"{folder}/ledgers")
    return spark.read.parquet(f"{folder}/ledgers").filter(F.col("run") == run).drop("run")


LEDGER = "name string, image_id long, status string, run string"


def merged_ledgers(spark: SparkSession, folder: str) -> DataFrame:
    """name, status of all machines' ledgers in a folder: done once is done, and what only failed stays unable."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/ledgers")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "name string, status string")
    return spark.read.schema(LEDGER).parquet(f"{folder}/ledgers").groupBy("name").agg(F.min("status").alias("status"))


def read_features(spark: SparkSession, folder: str) -> DataFrame:
    """Keypoints with their descriptors, of the runs that a ledger names."""
    done = spark.read.schema(LEDGER).parquet(f"{folder}/ledgers").filter("status = 'completed'").select("image_id", "run").distinct()
    return spark.read.parquet(f"{folder}/features").join(done, ["image_id", "run"], "left_semi").filter("vec IS NOT NULL").drop("run", "error")
