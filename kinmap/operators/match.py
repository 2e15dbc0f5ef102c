"""Matching of keypoints between images, relatedness of images, and breadth-first levels from a probe."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinmap.operators.knn import matrix, nearest
from kinmap.session import checkpointed

RATIO = 0.8


def keypoints_of_pairs(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """i, j, second, kp_idx, vec: the keypoints of both images of each pair. A pair's rows are as many as its keypoints, not as their product."""
    side = lambda c, second: pairs.join(points.select(F.col("image_id").alias(c), "kp_idx", "vec"), c).select("i", "j", F.lit(second).alias("second"), "kp_idx", "vec")
    return side("i", False).unionByName(side("j", True))


def _by_pair(keypoints: DataFrame, find: Callable, schema: str) -> DataFrame:
    """``find(query points, query vectors, train points, train vectors)`` for each pair, a distance block at a time: the image with more
    keypoints is the query side, the first if they have as many. It returns columns that follow i, j and query."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("second", "ascending"), ("kp_idx", "ascending")])
        names, vecs, second = rows.column("kp_idx").to_numpy(), matrix(rows.column("vec").combine_chunks()), rows.column("second").to_numpy()
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        sides = [(names[~second], vecs[~second], i), (names[second], vecs[second], j)]
        if len(sides[0][0]) < len(sides[1][0]):
            sides.reverse()
        q, t = sides
        found = find(*q[:2], *t[:2]) if len(t[0]) else {}
        n = len(found["q_kp"]) if found else 0
        columns = {"i": pa.array([i] * n, pa.int64()), "j": pa.array([j] * n, pa.int64()), "query": pa.array([q[2]] * n, pa.int64())}
        kinds = {"q_kp": pa.int64(), "t_kp": pa.int64(), "dist": pa.float64()}
        return pa.table(columns | {c: pa.array(found[c] if found else [], t) for c, t in kinds.items()})

    return keypoints.groupBy("i", "j").applyInArrow(run, schema)


_MATCHES = "i long, j long, query long, q_kp long, t_kp long, dist double"


def ratio_test(keypoints: DataFrame, ratio: float = RATIO) -> DataFrame:
    """i, j, query, q_kp, t_kp, dist: nearest keypoints whose distance is under ``ratio`` of the second nearest's. A keypoint without a
    second neighbour, or with one at distance 0, does not match."""

    def find(q: np.ndarray, qv: np.ndarray, t: np.ndarray, tv: np.ndarray) -> dict:
        r, found, d = nearest(qv, tv, t, 2)
        at = np.flatnonzero(r[1:] == r[:-1])  # the first of each two
        good = at[(d[at + 1] > 0) & (d[at] / np.where(d[at + 1] > 0, d[at + 1], 1) < ratio)]
        return {"q_kp": q[r[good]], "t_kp": found[good], "dist": d[good]}

    return _by_pair(keypoints, find, _MATCHES)


def cross_check(keypoints: DataFrame) -> DataFrame:
    """i, j, query, q_kp, t_kp, dist: pairs of keypoints that are each other's nearest."""

    def find(q: np.ndarray, qv: np.ndarray, t: np.ndarray, tv: np.ndarray) -> dict:
        r, forth, d = nearest(qv, tv, t, 1)
        _, back, _ = nearest(tv, qv, q, 1)
        good = np.flatnonzero(back[np.searchsorted(t, forth)] == q[r])
        return {"q_kp": q[r[good]], "t_kp": forth[good], "dist": d[good]}

    return _by_pair(keypoints, find, _MATCHES)


def best_half(matches: DataFrame) -> DataFrame:
    """The half of each pair's matches with the smallest distances; an odd half is rounded to even."""
    pair = Window.partitionBy("i", "j")
    placed = matches.withColumn("r", F.row_number().over(pair.orderBy("dist", "q_kp", "t_kp"))).withColumn("n", F.count("*").over(pair))
    return placed.filter(F.col("r") <= F.rint(F.col("n") / 2)).drop("r", "n")


def pair_stats(matches: DataFrame, digits: int | None = 6) -> DataFrame:
    """i, j, kp_count, avg_dist, rounded or not; the sum is exact, so its order does not matter."""
    mean = F.sum(F.col("dist").cast("decimal(28,9)")).cast("double") / F.count("*")
    return matches.groupBy("i", "j").agg(F.count("*").alias("kp_count"), (mean if digits is None else F.round(mean, digits)).alias("avg_dist"))


def related(matches: DataFrame, points: DataFrame, width: int, height: int, least: int = 4, enough: int = 10, spread: float = 0.02) -> DataFrame:
    """i, j, n, related: enough matches relate a pair, too few do not; in between, matched points must lie close together (x against the
    height and y against the width)."""
    at = points.select(F.col("image_id").alias("query"), F.col("kp_idx").alias("q_kp"), "x", "y")
    seen = matches.join(at, ["query", "q_kp"]).groupBy("i", "j").agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("dx"), (F.max("y") - F.min("y")).alias("dy"))
    close = (F.col("dx") <= spread * height) & (F.col("dy") <= spread * width)
    return seen.select("i", "j", "n", ((F.col("n") >= enough) | ((F.col("n") >= least) & close)).alias("related"))


def bfs_levels(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node, level for all nodes that ``edges(u, v)`` (undirected) connect to each of ``starts(start)``, however many levels away.

    A join for each level, until one is empty. A neighbour of a level lies in it, the one before or the next, so an anti-join with two
    levels is enough to leave out what is known. Every level is a table of its own, so lineage stays short.
    """
    both = checkpointed(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    levels = [checkpointed(starts.select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("level")).distinct())]
    while not levels[-1].isEmpty():
        step = levels[-1].join(both, F.col("node") == F.col("u")).select("start", F.col("v").alias("node")).distinct()
        for known in levels[-2:]:
            step = step.join(known.select("start", "node"), ["start", "node"], "left_anti")
        levels.append(checkpointed(step.withColumn("level", F.lit(len(levels)).cast("long"))))
    return union_all(levels[:-1] or levels)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Unions in a balanced tree, so that plans of many parts stay shallow."""
    while len(parts) > 1:
        parts = [parts[i].unionByName(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def candidate_pairs(levels: DataFrame) -> DataFrame:
    """start, i, j: pairs of images of one level (i < j) or of a level and the next, to be compared for the adjacency matrices."""
    a, b = levels.select("start", F.col("node").alias("i"), F.col("level").alias("li")), levels.select("start", F.col("node").alias("j"), F.col("level").alias("lj"))
    ahead = F.col("lj") == F.col("li") + 1
    same = (F.col("lj") == F.col("li")) & (F.col("i") < F.col("j")) & (F.col("lj") > 0)
    step = a.withColumn("lj", F.explode(F.array(F.col("li"), F.col("li") + 1)))  # so that the join is an equi-join
    return step.join(b, ["start", "lj"]).filter(ahead | same).select("start", "i", "j")


def symmetric(stats: DataFrame) -> DataFrame:
    """Both directions of each pair."""
    return stats.union(stats.select(F.col("j").alias("i"), F.col("i").alias("j"), *stats.columns[2:]))
