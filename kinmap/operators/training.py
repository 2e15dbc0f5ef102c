"""Training of search models: principal axes, rotations for product quantisation, coarse centroids, code books."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmap.operators.knn import matrix


def gram(rows: DataFrame, vec: str = "vec") -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sum and Gram matrix of all vectors: a matrix for each task, added up in a tree of partial sums."""
    import pyarrow as pa

    def run(batches):
        n, total, square = 0, None, None
        for batch in batches:
            m = matrix(batch.column("vec"))
            if len(m):
                n += len(m)
                total = m.sum(axis=0) + (0 if total is None else total)
                square = m.T @ m + (0 if square is None else square)
        if n:
            d = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d + d + 1)), pa.array(np.concatenate((square.ravel(), total, [float(n)])))], names=["cell", "v"])

    cells = rows.select(F.col(vec).alias("vec")).filter("vec IS NOT NULL").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).orderBy("cell").collect()
    v = np.array([r["v"] for r in cells])
    d = int((-1 + np.sqrt(1 + 4 * (len(v) - 1))) / 2)
    return int(v[-1]), v[d * d : d * d + d], v[: d * d].reshape(d, d)


def principal_axes(rows: DataFrame, dims: int, rotate_seed: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes): the ``dims`` directions of largest variance as rows, after a random rotation if a seed is given."""
    n, total, square = gram(rows)
    mean = total / n
    values, axes = np.linalg.eigh(square / n - np.outer(mean, mean))
    axes = axes[:, np.argsort(-values)[:dims]].T
    axes *= np.where(axes[np.arange(dims), np.abs(axes).argmax(axis=1)] < 0, -1, 1)[:, None]
    if rotate_seed is not None:
        q, r = np.linalg.qr(np.random.default_rng(rotate_seed).normal(size=(dims, dims)))
        axes = (q * np.sign(np.diag(r))) @ axes
    return mean, axes


#: Training rows that a centroid needs at least.
ROWS_A_CENTROID = 39


def coarse_centroids(rows: DataFrame, k: int, seed: int = 1, iterations: int = 20) -> DataFrame:
    """list_id, centroid by k-means. Too few training rows for ``k`` centroids are an error; ``most_lists`` tells how many they allow."""
    if k > (most := most_lists(rows.count())):
        raise ValueError(f"{k} lists need {ROWS_A_CENTROID} training rows each; these rows allow {most}")
    model = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="f").fit(rows.select(array_to_vector("vec").alias("f")))
    centers = [(i, c.tolist()) for i, c in enumerate(model.clusterCenters())]
    return rows.sparkSession.createDataFrame(centers, "list_id long, centroid array<double>")


def most_lists(n: int) -> int:
    return max(1, n // ROWS_A_CENTROID)


def nearest_center(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)).argmin(axis=1)


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 20) -> np.ndarray:
    """Centers of the rows of ``x``, from ``k`` distinct rows on; a center that no row is nearest to stays where it is."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centers = distinct[np.sort(rng.choice(len(distinct), min(k, len(distinct)), replace=False))]
    for _ in range(rounds):
        near = nearest_center(x, centers)
        sums, counts = np.zeros_like(centers), np.bincount(near, minlength=len(centers))
        np.add.at(sums, near, x)
        moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
        if np.allclose(moved, centers):
            break
        centers = moved
    return centers


#: Rows that code books and rotations are fitted on at most; all rows are coded.
TRAIN_ROWS = 50_000


def training_rows(rows: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """vec of the ``most`` rows with the least hash, a bounded sample that every run repeats."""
    return rows.filter("vec IS NOT NULL").orderBy(F.xxhash64("vec")).limit(most).select("vec")


def code_books(rows: DataFrame, subs: int, codes: int, seed: int = 1) -> DataFrame:
    """sub, code, centroid: k-means on each slice of the vectors of a bounded sample, a task for each slice."""
    import pyarrow as pa

    width = len(rows.select("vec").first()[0]) // subs
    slices = training_rows(rows).select("vec", F.explode(F.sequence(F.lit(0), F.lit(subs - 1))).alias("sub")).select("sub", F.expr(f"slice(vec, sub * {width} + 1, {width})").alias("vec"))

    def run(group: pa.Table) -> pa.Table:
        centers = k_means(matrix(group.column("vec").combine_chunks()), codes, seed)
        return pa.table({"sub": pa.array([group.column("sub")[0].as_py()] * len(centers), pa.int32()), "code": np.arange(len(centers)), "centroid": pa.array(list(centers), pa.list_(pa.float64()))})

    return slices.groupBy("sub").applyInArrow(run, "sub int, code long, centroid array<double>")


def optimized_rotation(rows: DataFrame, subs: int, codes: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """A rotation (columns are the new axes) that lowers the error of product quantisation: quantise a bounded sample, rotate the vectors
    onto their codes (Procrustes), and again."""
    sample = np.array([r["vec"] for r in training_rows(rows, TRAIN_ROWS // 5).collect()], np.float64)
    rotation = np.eye(sample.shape[1])
    for _ in range(rounds):
        x = sample @ rotation
        coded = np.empty_like(x)
        for part in np.split(np.arange(x.shape[1]), subs):
            centers = k_means(x[:, part], codes, seed, 4)
            coded[:, part] = centers[nearest_center(x[:, part], centers)]
        u, _, vt = np.linalg.svd(sample.T @ coded)
        rotation = u @ vt
    return rotation


def transformed(rows: DataFrame, id_column: str, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """``id_column``, vec: (vec - mean) times the axes."""
    import pyarrow as pa

    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = (matrix(batch.column("vec")) - mean) @ axes.T if batch.num_rows else np.zeros((0, len(axes)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * len(axes), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(id_column), flat], names=[id_column, "vec"])

    return rows.select(id_column, "vec").filter("vec IS NOT NULL").mapInArrow(run, f"{id_column} {kind}, vec array<double>")


def save_model(spark: SparkSession, path: str, mean: np.ndarray, axes: np.ndarray, centroids: DataFrame, books: DataFrame) -> None:
    """A model is a folder of small tables."""
    spark.createDataFrame([(json.dumps({"mean": mean.tolist(), "axes": axes.tolist()}),)], "transform string").write.mode("overwrite").parquet(f"{path}/transform")
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    books.write.mode("overwrite").parquet(f"{path}/books")


def load_model(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray, DataFrame, DataFrame]:
    held = json.loads(spark.read.parquet(f"{path}/transform").first()[0])
    return np.array(held["mean"]), np.array(held["axes"]), spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/books")
