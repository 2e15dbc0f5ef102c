"""An index from end to end: rotation, lists and code books trained on a sample, every descriptor coded into a list, and search by images."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmap.operators import knn, training, votes
from kinmap.operators.features import extract_features


@dataclass(frozen=True)
class Index:
    """A folder: transform, centroids and books (the model), lists (list_id, b_id, image_id, codes) and names (image_id, name)."""

    spark: SparkSession
    path: str
    subs: int

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def transformed(self, rows: DataFrame, key: str) -> DataFrame:
        mean, axes, _, _ = training.load_model(self.spark, f"{self.path}/model")
        return training.transformed(rows, key, mean, axes)

    def search(self, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
        """q_id, rank, b_id, dist by codes, for queries (q_id, vec)."""
        _, _, centroids, books = training.load_model(self.spark, f"{self.path}/model")
        return knn.knn_ivfpq(self.transformed(queries, "q_id"), self.table("lists"), centroids, books, k, nprobe, self.subs)

    def rank_images(self, queries: DataFrame, k: int, nprobe: int, top: int) -> DataFrame:
        """probe_id, name, votes, pos: the images that the keypoints of each probe (probe_id, q_id, vec) vote for."""
        found = self.search(queries.select("q_id", "vec"), k, nprobe).join(self.table("lists").select("b_id", "image_id"), "b_id")
        tally = votes.tally(found.join(queries.select("q_id", "probe_id"), "q_id"), ["probe_id"])
        return votes.name_images(votes.top_images(tally, ["probe_id"], top), self.table("names")).select("probe_id", "name", "votes", "pos")


def build_index(features: DataFrame, names: DataFrame, path: str, lists: int, subs: int, codes: int = 256, seed: int = 1) -> Index:
    """Writes an index of features (image_id, kp_idx, vec) and returns it. The model is trained on at most ``training.TRAIN_ROWS`` vectors (lists:
    on all), every vector is coded; b_id numbers vectors gaplessly in order of image and keypoint."""
    from kinmap.operators.ordering import dense_ids

    spark = features.sparkSession
    valid = features.filter("vec IS NOT NULL").select("image_id", "kp_idx", "vec")
    dense_ids(valid, "image_id", ["kp_idx"], "b_id").write.mode("overwrite").parquet(f"{path}/vectors")
    rows = spark.read.parquet(f"{path}/vectors")
    n, total, _ = training.gram(rows)
    mean = total / n
    rotation = training.optimized_rotation(training.transformed(training.training_rows(rows).withColumn("k", F.lit(0)), "k", mean, np.eye(len(mean))), subs, codes, rounds=4)
    turned = training.transformed(rows, "b_id", mean, rotation.T)
    centroids = training.coarse_centroids(turned, lists, seed)
    residuals = knn.closest_lists(turned, centroids, "b_id", residuals=True).select(F.col("residual").alias("vec"))
    training.save_model(spark, f"{path}/model", mean, rotation.T, centroids, training.code_books(residuals, subs, codes, seed))
    _, _, centroids, books = training.load_model(spark, f"{path}/model")
    coded = knn.build_pq_lists(turned, centroids, books, subs).join(rows.select("b_id", "image_id"), "b_id")
    coded.repartition("list_id").sortWithinPartitions("list_id", "b_id").write.mode("overwrite").parquet(f"{path}/lists")
    names.select("image_id", "name").write.mode("overwrite").parquet(f"{path}/names")
    return Index(spark, path, subs)


def index_images(images: DataFrame, path: str, lists: int, subs: int, codes: int = 256, **how) -> Index:
    """From images (image_id, name, height, width, channels, data) to a searchable index."""
    features = extract_features(images, **how)
    features.write.mode("overwrite").parquet(f"{path}/features")
    return build_index(images.sparkSession.read.parquet(f"{path}/features"), images, path, lists, subs, codes)
