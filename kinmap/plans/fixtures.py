"""The edited-copy world that queries run on, from the ``embeddings`` table: families of images that drift from an original.

``family = vec_id div 20``; version v of a family keeps keypoints from ``4 * v`` on and mixes each vector with itself, rotated. The SQL
constants define the same frames for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SQL_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
SQL_D = (
    SQL_E
    + """, d AS (
  SELECT vec_id // 20 AS family, v AS version, 4 * (vec_id // 20) + v AS image_id, vec_id % 20 AS kp_idx, vec_id,
    list_transform(range(64), lambda i: e[i + 1] + (0.05::DOUBLE * v) * e[(i + v) % 64 + 1]) AS vec
  FROM e, (SELECT unnest(range(4)) AS v) WHERE vec_id % 20 >= 4 * v
), probes AS (SELECT image_id * 100 + kp_idx AS q_id, image_id AS q_image, kp_idx AS q_kp, vec FROM d WHERE version = 1
), base AS (SELECT image_id * 100 + kp_idx AS b_id, image_id, kp_idx, vec FROM d WHERE version <> 1)"""
)
SQL_P = SQL_E + ", p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, least(255, greatest(0, floor((e[i + 1] + 1) * 127.5)))::DOUBLE AS v FROM e, (SELECT unnest(range(64)) AS i))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """family, version, image_id, kp_idx, vec_id, vec."""
    rows = vectors(spark, sf_dir).withColumn("version", F.explode(F.array(*(F.lit(v).cast("long") for v in range(4)))))
    mixed = F.expr("transform(sequence(0, 63), i -> e[i] + (cast(0.05 AS double) * version) * e[cast((i + version) % 64 AS int)])")
    return rows.filter("vec_id % 20 >= 4 * version").select(
        F.expr("vec_id div 20").alias("family"), "version", F.expr("4 * (vec_id div 20) + version").alias("image_id"), F.expr("vec_id % 20").alias("kp_idx"), "vec_id", mixed.alias("vec")
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keypoints of the probe images: q_id, q_image, q_kp, vec."""
    return descriptors(spark, sf_dir).filter("version = 1").select((F.col("image_id") * 100 + F.col("kp_idx")).alias("q_id"), F.col("image_id").alias("q_image"), F.col("kp_idx").alias("q_kp"), "vec")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keypoints of the world's images: b_id, image_id, kp_idx, vec."""
    return descriptors(spark, sf_dir).filter("version <> 1").select((F.col("image_id") * 100 + F.col("kp_idx")).alias("b_id"), "image_id", "kp_idx", "vec")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 gray patches: vec_id, y, x, v."""
    rows = vectors(spark, sf_dir).select("vec_id", F.posexplode("e").alias("i", "c"))
    return rows.select("vec_id", F.expr("i div 8").alias("y"), F.expr("cast(i % 8 AS bigint)").alias("x"), F.expr("cast(least(255, greatest(0, floor((c + 1) * 127.5D))) AS double)").alias("v"))


def l2(a: str, b: str) -> Column:
    """Euclidean distance of two array columns, in the JVM."""
    return F.expr(f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))")
