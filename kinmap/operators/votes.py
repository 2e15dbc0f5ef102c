"""Votes of neighbours for images, and what is done with scores: normalising, cutting, merging, ignoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PLACES = 6


def tally(hits: DataFrame, by: list[str], image: str = "image_id", weighted: bool = True) -> DataFrame:
    """``by``, image, votes: the sum of 1 / rank over hits (or their number). Missing images (null, negative) get no votes."""
    vote = F.sum(1.0 / F.col("rank")) if weighted else F.count("*").cast("double")
    return hits.filter(F.col(image) >= 0).groupBy(*by, image).agg(F.round(vote, PLACES).alias("votes"))


def positions(scores: DataFrame, by: list[str], score: str = "votes", image: str = "image_id") -> DataFrame:
    """Adds pos (from 1): score descending, ties by image descending."""
    return scores.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(image).desc())))


def top_images(scores: DataFrame, by: list[str], n: int, score: str = "votes") -> DataFrame:
    return positions(scores, by, score).filter(F.col("pos") <= n)


def max_vote(queries: DataFrame, by: list[str], k: int) -> DataFrame:
    """``by``, max_vote: what an image would get that is every query's every hit."""
    return queries.groupBy(*by).agg((F.count("*") * sum(1.0 / r for r in range(1, k + 1))).alias("max_vote"))


def normalize_by_first(scores: DataFrame, by: list[str], score: str = "votes") -> DataFrame:
    """Adds norm: the score divided by that at the first position."""
    first = F.first(score).over(Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return scores.withColumn("norm", F.round(F.col(score) / first, PLACES))


def name_images(ranked: DataFrame, names: DataFrame) -> DataFrame:
    """Inner join with (image_id, name): images without a name have used up their position."""
    return ranked.join(names, "image_id")


def ignore(scores: DataFrame, ignored: DataFrame, on: list[str]) -> DataFrame:
    return scores.join(ignored.select(*on).distinct(), on, "left_anti")


def merge_shards(hits: DataFrame, k: int, expand: float = 1.5) -> DataFrame:
    """The ``floor(expand * k)`` nearest of each query over all shards, ranked anew. Hits carry shard and id, so ids never collide."""
    order = Window.partitionBy("q_id").orderBy("dist", "shard_id", "b_id")
    return hits.filter("b_id >= 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= int(expand * k))


def merge_scores(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Scores of both sides; where both name an image, the right side's counts."""
    both = left.select(*by, F.col("votes").alias("a")).join(right.select(*by, F.col("votes").alias("b")), by, "full")
    return both.select(*by, F.coalesce("b", "a").alias("votes"))
