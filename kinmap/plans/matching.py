"""Queries of matching and relatedness, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinmap.operators import match
from kinmap.plans.fixtures import SQL_D, descriptors


def pairs(spark, sf):
    """Candidate pairs: images of one family or of neighbouring families."""
    images = descriptors(spark, sf).select("image_id", "family").distinct()
    a = images.select(F.col("image_id").alias("i"), F.explode(F.array("family", F.col("family") + 1)).alias("family"))
    return a.join(images.select(F.col("image_id").alias("j"), "family"), "family").filter("i < j").select("i", "j")


def keypoints(spark, sf):
    return match.keypoints_of_pairs(pairs(spark, sf), descriptors(spark, sf))


def points(spark, sf):
    return descriptors(spark, sf).select("image_id", "kp_idx", F.expr("(vec_id * 37) % 640").alias("x"), F.expr("(vec_id * 53) % 480").alias("y"))


SQL_DISTS = f"""WITH {SQL_D}, sizes AS (SELECT image_id, family, count(*) AS n FROM d GROUP BY ALL
), prs AS (
  SELECT a.image_id AS i, b.image_id AS j, if(a.n < b.n, b.image_id, a.image_id) AS query, if(a.n < b.n, a.image_id, b.image_id) AS train
  FROM sizes a JOIN sizes b ON a.image_id < b.image_id AND (b.family = a.family OR b.family = a.family + 1)
), dists AS (
  SELECT i, j, query, train, q.kp_idx AS q_kp, t.kp_idx AS t_kp, round(list_distance(q.vec, t.vec), 9) AS dist
  FROM prs JOIN d q ON q.image_id = query JOIN d t ON t.image_id = train
)"""
SQL_RATIO = SQL_DISTS + """, ranked AS (
  SELECT *, row_number() OVER w AS r, lead(dist) OVER w AS second FROM dists WINDOW w AS (PARTITION BY i, j, q_kp ORDER BY dist, t_kp)
), m AS (SELECT i, j, query, q_kp, t_kp, dist FROM ranked WHERE r = 1 AND second > 0 AND dist / second < 0.8)"""
SQL_CROSS = SQL_DISTS + """, f AS (SELECT *, row_number() OVER (PARTITION BY i, j, q_kp ORDER BY dist, t_kp) AS r FROM dists
), b AS (SELECT *, row_number() OVER (PARTITION BY i, j, t_kp ORDER BY dist, q_kp) AS r FROM dists
), c AS (SELECT f.i, f.j, f.q_kp, f.t_kp, f.dist FROM f JOIN b USING (i, j, q_kp, t_kp) WHERE f.r = 1 AND b.r = 1
), half AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY dist, q_kp, t_kp) AS r, count(*) OVER (PARTITION BY i, j) AS n FROM c) WHERE r <= round_even(n / 2, 0))"""
SQL_RELATED = SQL_RATIO + """, sp AS (
  SELECT m.i, m.j, count(*) AS n, max(vec_id * 37 % 640) - min(vec_id * 37 % 640) AS dx, max(vec_id * 53 % 480) - min(vec_id * 53 % 480) AS dy
  FROM m JOIN d ON d.image_id = m.query AND d.kp_idx = m.q_kp GROUP BY ALL
), rel AS (SELECT i, j, n, n >= 10 OR (n >= 4 AND dx <= 0.5 * 480 AND dy <= 0.5 * 640) AS related FROM sp)"""
#: The walk may take as many levels as there are images.
SQL_EDGES = SQL_RELATED + """, ed AS (SELECT i AS u, j AS v FROM rel WHERE related
), lv AS (SELECT DISTINCT image_id AS start FROM d WHERE version = 1
), walk AS (
  WITH RECURSIVE w(start, node, level) AS (
    SELECT start, start, 0::BIGINT FROM lv
    UNION
    SELECT w.start, if(u = node, v, u), level + 1 FROM w JOIN ed ON u = node OR v = node WHERE level < (SELECT count(*) FROM sizes)
  ) SELECT start, node, min(level) AS level FROM w GROUP BY ALL
)"""


def ratio_test_matches(spark, sf):
    return match.ratio_test(keypoints(spark, sf))


def cross_check_matches(spark, sf):
    return match.cross_check(keypoints(spark, sf)).select("i", "j", "q_kp", "t_kp", "dist")


def half_best_matches(spark, sf):
    return match.best_half(match.cross_check(keypoints(spark, sf))).select("i", "j", "q_kp", "t_kp", "dist")


def pair_match_stats(spark, sf):
    return match.pair_stats(ratio_test_matches(spark, sf))


def relatedness_spread(spark, sf):
    return match.related(ratio_test_matches(spark, sf), points(spark, sf), 640, 480, spread=0.5)


def _levels(spark, sf):
    edges = relatedness_spread(spark, sf).filter("related").select(F.col("i").alias("u"), F.col("j").alias("v"))
    starts = descriptors(spark, sf).filter("version = 1").select(F.col("image_id").alias("start")).distinct()
    return match.bfs_levels(edges, starts)


def bfs_levels(spark, sf):
    return _levels(spark, sf)


def candidate_pairs(spark, sf):
    return match.candidate_pairs(_levels(spark, sf))


def symmetric_adjacency(spark, sf):
    return match.symmetric(pair_match_stats(spark, sf))


def cumulative_distance_score(spark, sf):
    """Mean of each pair's smallest distances, as long as they sum to under 65 % of all."""
    from pyspark.sql.window import Window

    own = match.cross_check(keypoints(spark, sf))
    pair = Window.partitionBy("i", "j")
    share = F.round(F.sum("dist").over(pair.orderBy("dist", "q_kp", "t_kp").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("dist").over(pair), 9)
    return own.withColumn("share", share).filter("share < 0.65").groupBy("i", "j").agg(F.round(F.avg("dist"), 6).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (ratio_test_matches, cross_check_matches, half_best_matches, pair_match_stats, relatedness_spread, bfs_levels, candidate_pairs, symmetric_adjacency, cumulative_distance_score)
}
ORACLES = {
    "ratio_test_matches": f"{SQL_RATIO} SELECT * FROM m",
    "cross_check_matches": f"{SQL_CROSS} SELECT * FROM c",
    "half_best_matches": f"{SQL_CROSS} SELECT i, j, q_kp, t_kp, dist FROM half",
    "pair_match_stats": f"{SQL_RATIO} SELECT i, j, count(*) AS kp_count, round(sum(dist::DECIMAL(28, 9))::DOUBLE / count(*), 6) AS avg_dist FROM m GROUP BY ALL",
    "relatedness_spread": f"{SQL_RELATED} SELECT * FROM rel",
    "bfs_levels": f"{SQL_EDGES} SELECT * FROM walk",
    "candidate_pairs": f"""{SQL_EDGES} SELECT a.start, a.node AS i, b.node AS j FROM walk a JOIN walk b ON a.start = b.start
      AND (b.level = a.level + 1 OR (b.level = a.level AND b.level > 0 AND a.node < b.node))""",
    "symmetric_adjacency": f"{SQL_RATIO}, st AS (SELECT i, j, count(*) AS kp_count, round(sum(dist::DECIMAL(28, 9))::DOUBLE / count(*), 6) AS avg_dist FROM m GROUP BY ALL) SELECT * FROM st UNION ALL SELECT j, i, kp_count, avg_dist FROM st",
    "cumulative_distance_score": f"""{SQL_CROSS}, sh AS (
      SELECT i, j, dist, round(sum(dist) OVER (PARTITION BY i, j ORDER BY dist, q_kp, t_kp ROWS UNBOUNDED PRECEDING) / sum(dist) OVER (PARTITION BY i, j), 9) AS share FROM c)
    SELECT i, j, round(avg(dist), 6) AS score FROM sh WHERE share < 0.65 GROUP BY ALL""",
}
