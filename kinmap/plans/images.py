"""Queries on matrices and pixels, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinmap.operators import match, matrices, pixels
from kinmap.plans import matching
from kinmap.plans.fixtures import SQL_P, descriptors, patches, vectors
from kinmap.session import checkpointed

#: Neighbouring patches are compared: vec_id with the next of its family.
SQL_PAIRS = SQL_P + ", pr AS (SELECT a.vec_id AS i, b.vec_id AS j, a.y, a.x, a.v AS a, b.v AS b FROM p a JOIN p b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 20 < 19 AND a.y = b.y AND a.x = b.x)"


def patch_pairs(spark, sf):
    own = patches(spark, sf)
    left = own.filter("vec_id % 20 < 19").select(F.col("vec_id").alias("i"), (F.col("vec_id") + 1).alias("j"), "y", "x", F.col("v").alias("a"))
    return left.join(own.select(F.col("vec_id").alias("j"), "y", "x", F.col("v").alias("b")), ["j", "y", "x"]).select("i", "j", "y", "x", "a", "b")


def id_pairs(spark, sf, a, b):
    return vectors(spark, sf).filter("vec_id % 20 < 19").select(F.col("vec_id").alias(a), (F.col("vec_id") + 1).alias(b))


def links(spark, sf):
    """Both directions of the matched pairs of a family's images: family, i, j, kp, dist."""
    sym = match.symmetric(checkpointed(match.pair_stats(matching.ratio_test_matches(spark, sf), digits=None)))
    return sym.filter("i div 4 = j div 4").select(F.expr("i div 4").alias("family"), "i", "j", F.col("kp_count").alias("kp"), F.col("avg_dist").alias("dist"))


SQL_LINKS = matching.SQL_RATIO + """, st AS (SELECT i, j, count(*) AS kp, sum(dist::DECIMAL(28, 9))::DOUBLE / count(*) AS dist FROM m GROUP BY ALL
), links AS (SELECT i // 4 AS family, i, j, kp, dist FROM (SELECT * FROM st UNION ALL SELECT j, i, kp, dist FROM st) WHERE i // 4 = j // 4)"""


def thumbnails(spark, sf):
    """8 x 8 gray values of each image: the vector of its last keypoint. image, y, x, v."""
    rows = descriptors(spark, sf).filter("kp_idx = 19").select(F.col("image_id").alias("image"), F.posexplode("vec").alias("i", "c"))
    return rows.select("image", F.expr("i div 8").alias("y"), F.expr("cast(i % 8 AS bigint)").alias("x"), F.expr("cast(least(255, greatest(0, floor((c + 1) * 127.5D))) AS double)").alias("v"))


def pair_similarity(spark, sf):
    """Mutual information (256 bins) and mean squared error of each linked pair, in both directions: the first image's values are moved to
    the second's at the same quantiles."""
    return pixels.pair_similarity(links(spark, sf).select("i", "j"), thumbnails(spark, sf))


SQL_SIMILAR = SQL_LINKS + """, th AS (
  SELECT image_id AS image, k // 8 AS y, k % 8 AS x, least(255, greatest(0, floor((vec[k + 1] + 1) * 127.5::DOUBLE)))::DOUBLE AS v FROM d, (SELECT unnest(range(64)) AS k) WHERE kp_idx = 19
), tc AS (SELECT image, v, count(*) AS n FROM th GROUP BY ALL
), tq AS (SELECT image, v, sum(n) OVER (PARTITION BY image ORDER BY v) / sum(n) OVER (PARTITION BY image) AS q FROM tc
), tt AS (SELECT *, lead(q) OVER w AS nq, lead(v) OVER w AS nv, first_value(q) OVER w AS fq, first_value(v) OVER w AS fv FROM tq WINDOW w AS (PARTITION BY image ORDER BY v)
), mv AS (
  SELECT l.i, l.j, s.v, round(if((s.q < fq AND t.v = fv) OR nq IS NULL, t.v, t.v + (s.q - t.q) / (nq - t.q) * (nv - t.v)), 6) AS w
  FROM links l JOIN tq s ON s.image = l.i JOIN tt t ON t.image = l.j WHERE (t.q <= s.q AND (nq IS NULL OR s.q < nq)) OR (s.q < fq AND t.v = fv)
), pp AS (SELECT mv.i, mv.j, mv.w AS a, b.v AS b FROM mv JOIN th a ON a.image = mv.i AND a.v = mv.v JOIN th b ON b.image = mv.j AND b.y = a.y AND b.x = a.x
), pr2 AS (SELECT *, min(a) OVER w AS la, max(a) OVER w AS ha, min(b) OVER w AS lb, max(b) OVER w AS hb FROM pp WINDOW w AS (PARTITION BY i, j)
), pt AS (SELECT i, j, (ha - la) * (1 + 1.0::DOUBLE / 255) <= 1 OR (hb - lb) * (1 + 1.0::DOUBLE / 255) <= 1 AS flat,
    least(floor((a - (la - 0.5::DOUBLE * (ha - la) / 255)) / (ha - la + 2 * (0.5::DOUBLE * (ha - la) / 255)) * 256), 255)::BIGINT AS ba,
    least(floor((b - (lb - 0.5::DOUBLE * (hb - lb) / 255)) / (hb - lb + 2 * (0.5::DOUBLE * (hb - lb) / 255)) * 256), 255)::BIGINT AS bb FROM pr2
), pj AS (SELECT i, j, flat, ba, bb, count(*) / 64 AS s FROM pt GROUP BY ALL
), h1 AS (SELECT i, j, -sum(s * log2(s)) AS h FROM (SELECT i, j, ba, sum(s) AS s FROM pj GROUP BY ALL) GROUP BY ALL
), h2 AS (SELECT i, j, -sum(s * log2(s)) AS h FROM (SELECT i, j, bb, sum(s) AS s FROM pj GROUP BY ALL) GROUP BY ALL
), h3 AS (SELECT i, j, bool_or(flat) AS flat, -sum(s * log2(s)) AS h FROM pj GROUP BY ALL
), se AS (SELECT i, j, round(avg((a - b) ^ 2), 6) AS mse FROM pp GROUP BY ALL
), sim AS (SELECT i, j, round(if(flat, 0, h1.h + h2.h - h3.h), 6) AS mi, mse FROM h1 JOIN h2 USING (i, j) JOIN h3 USING (i, j) JOIN se USING (i, j))"""


def cells(spark, sf):
    """The matrices of a family's images as rows: family, i, j, kp, dist, mi_out (i to j), mi_in, mse."""
    own = links(spark, sf)
    sim = checkpointed(pixels.pair_similarity(own.select("i", "j"), thumbnails(spark, sf)))
    back = sim.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("mi").alias("mi_in"))
    return own.join(sim.withColumnRenamed("mi", "mi_out"), ["i", "j"]).join(back, ["i", "j"]).select("family", "i", "j", "kp", "dist", "mi_out", "mi_in", "mse")


SQL_CELLS = SQL_SIMILAR + """, cells AS (
  SELECT family, i, j, kp, dist, a.mi AS mi_out, b.mi AS mi_in, a.mse FROM links l JOIN sim a USING (i, j) JOIN sim b ON b.i = l.j AND b.j = l.i
)"""


def _norms(spark, sf):
    """Four matrices of each family, normalised: kp, dist, mi, mse."""
    own = checkpointed(cells(spark, sf))
    each = {"kp": ("kp", False), "dist": ("dist", True), "mi": ("mi_out", False), "mse": ("mse", True)}
    out = None
    for kind, (column, dissimilar) in each.items():
        norm = matrices.min_max(own.select("family", "i", "j", F.col(column).cast("double").alias("value")), ["family"], dissimilar).withColumn("kind", F.lit(kind))
        out = norm if out is None else out.unionByName(norm)
    return out


#: From the dense matrices: n x n with n images of a family, 0 where a similarity is absent, -1 where a dissimilarity is.
SQL_NORMS = SQL_CELLS + """, im AS (SELECT DISTINCT family, i AS image FROM cells
), kinds AS (SELECT unnest(['kp', 'dist', 'mi', 'mse']) AS kind
), dense AS (
  SELECT kind, a.family, a.image AS i, b.image AS j, c.i IS NOT NULL AS there,
    CASE kind WHEN 'kp' THEN coalesce(c.kp, 0) WHEN 'mi' THEN coalesce(c.mi_out, 0) WHEN 'dist' THEN -coalesce(c.dist, -1) ELSE -coalesce(c.mse, -1) END::DOUBLE AS s
  FROM kinds, im a JOIN im b ON a.family = b.family LEFT JOIN cells c ON c.i = a.image AND c.j = b.image
), rng AS (
  SELECT kind, family, min(s) FILTER (kind IN ('kp', 'mi') OR s <> 1) AS lo, max(s) FILTER (kind IN ('kp', 'mi') OR s <> 1) AS hi FROM dense GROUP BY ALL
), norms AS (
  SELECT kind, family, i, j, round(if((kind IN ('kp', 'mi') AND s = 0) OR (kind IN ('dist', 'mse') AND s = 1) OR lo IS NULL OR hi = lo, -1, (s - lo) / (hi - lo)), 6) AS norm
  FROM dense JOIN rng USING (kind, family) WHERE there
)"""


def matrix_minmax_norm(spark, sf):
    return _norms(spark, sf)


def joined_cells(spark, sf):
    """The mean of the normalised matrices of matches and mutual information."""
    return matrices.join_matrices(_norms(spark, sf).filter("kind IN ('kp', 'mi')"), ["family"], 2)


SQL_JOINED = SQL_NORMS + ", jn AS (SELECT family, i, j, if(bool_or(norm = -1), -1, sum(norm)) / 2 AS value FROM norms WHERE kind IN ('kp', 'mi') GROUP BY family, i, j)"


def matrix_join_poison(spark, sf):
    return matrices.join_matrices(_norms(spark, sf), ["family"], 4)


def near_duplicate_stats(spark, sf):
    """Sets: versions 0 to 2 of each family; targets: version 3."""
    own = links(spark, sf)
    sets = own.filter("i % 4 < 3").select(F.col("family").alias("set_id"), F.col("i").alias("node")).distinct()
    return matrices.near_duplicate_gate(sets, own.select("i", "j", "kp"), own.filter("j % 4 = 3").select(F.col("family").alias("set_id"), F.col("j").alias("target")).distinct())


def strongest_link(spark, sf):
    return matrices.strongest_link(cells(spark, sf), ["family"])


def histogram256(spark, sf):
    return pixels.histogram(patches(spark, sf), ["vec_id"])


def entropy(spark, sf):
    return pixels.entropy(histogram256(spark, sf), ["vec_id"])


def mutual_information(spark, sf):
    return pixels.mutual_information(patch_pairs(spark, sf), ["i", "j"], 16)


def mse(spark, sf):
    return pixels.mean_squared_error(patch_pairs(spark, sf), ["i", "j"])


def histogram_match(spark, sf):
    own = patches(spark, sf).select(F.col("vec_id").alias("image"), "v")
    return pixels.match_histogram(id_pairs(spark, sf, "source", "template"), own)


def histogram_intersection(spark, sf):
    counts = histogram256(spark, sf).withColumnRenamed("vec_id", "image").groupBy("image", F.expr("bin div 16").alias("bin")).agg(F.sum("n").alias("n"))
    return pixels.histogram_intersection(id_pairs(spark, sf, "a", "b"), counts, 64)


def psnr_decision(spark, sf):
    return pixels.difference_decision(patch_pairs(spark, sf), ["i", "j"], least=6)


def scale_image_sigma(spark, sf):
    return pixels.scale_image(patches(spark, sf), ["vec_id"], 255.0, 1.5)


def scale_image_plain(spark, sf):
    return pixels.scale_image(patches(spark, sf), ["vec_id"], 2.0)


def otsu_threshold(spark, sf):
    return pixels.otsu(histogram256(spark, sf), ["vec_id"])


def mean_mask(spark, sf):
    return pixels.mean_mask(patches(spark, sf).withColumn("family", F.expr("vec_id div 20")), "family")


def flip_vertical(spark, sf):
    return pixels.flip_vertical(patches(spark, sf), 8)


def rotate_90(spark, sf):
    return pixels.rotate_90(patches(spark, sf), 8, 8)


def patch_extraction(spark, sf):
    """The box around the matched points of each pair's query image."""
    matched = matching.ratio_test_matches(spark, sf).join(matching.points(spark, sf).select(F.col("image_id").alias("query"), F.col("kp_idx").alias("q_kp"), "x", "y"), ["query", "q_kp"])
    return pixels.bounding_patch(matched, ["i", "j"])


QUERIES = {
    f.__name__: f
    for f in (
        pair_similarity, matrix_minmax_norm, matrix_join_poison, near_duplicate_stats, strongest_link, histogram256, entropy, mutual_information, mse, histogram_match, histogram_intersection,
        psnr_decision, scale_image_sigma, scale_image_plain, otsu_threshold, mean_mask, flip_vertical, rotate_90, patch_extraction,
    )
}
_HIST = f"WITH {SQL_P}, h AS (SELECT vec_id, floor(v)::BIGINT AS bin, count(*) AS n FROM p GROUP BY ALL)"
ORACLES = {
    "pair_similarity": f"{SQL_SIMILAR} SELECT * FROM sim",
    "matrix_minmax_norm": f"{SQL_NORMS} SELECT * FROM norms",
    "matrix_join_poison": f"{SQL_NORMS} SELECT family, i, j, if(bool_or(norm = -1), -1, sum(norm)) / 4 AS value FROM norms GROUP BY family, i, j",
    "near_duplicate_stats": f"""{SQL_LINKS}, s AS (SELECT DISTINCT family, i AS node FROM links WHERE i % 4 < 3), sz AS (SELECT family, count(*) AS size FROM s GROUP BY ALL
    ), ins AS (SELECT a.family, coalesce(kp, 0) AS kp FROM s a JOIN s b ON a.family = b.family AND a.node < b.node LEFT JOIN links c ON c.i = a.node AND c.j = b.node
    ), st2 AS (SELECT family, avg(kp) AS mean, stddev_pop(kp) AS std FROM ins GROUP BY ALL
    ), tg AS (SELECT DISTINCT family, j AS target FROM links WHERE j % 4 = 3
    ), o AS (SELECT tg.family, target, size, mean, std, count(*) FILTER (coalesce(kp, 0) < mean - std OR coalesce(kp, 0) > mean + std) AS outside
      FROM tg JOIN s USING (family) JOIN sz USING (family) LEFT JOIN st2 USING (family) LEFT JOIN links c ON c.i = s.node AND c.j = target GROUP BY ALL)
    SELECT family AS set_id, target, round(mean, 6) AS mean, round(std, 6) AS std, outside, size <= 2 OR outside <= size / 2 AS passes FROM o""",
    "strongest_link": f"""{SQL_CELLS} SELECT family, i AS node, j AS best, CASE WHEN mi_out > mi_in THEN 0 WHEN mi_out < mi_in THEN 1 ELSE -1 END::BIGINT AS direction, kp
    FROM (SELECT *, row_number() OVER (PARTITION BY family, i ORDER BY kp DESC, greatest(mi_out, mi_in) DESC, j) AS r FROM cells
      WHERE (mi_out <> 0 OR mi_in <> 0) AND kp >= 4 AND (kp >= 10 OR dist < 0.1)) WHERE r = 1""",
    "histogram256": f"{_HIST} SELECT * FROM h",
    "entropy": f"{_HIST} SELECT vec_id, round(-sum(s * log2(s)), 6) AS entropy FROM (SELECT vec_id, n / sum(n) OVER (PARTITION BY vec_id) AS s FROM h) GROUP BY vec_id",
    "mutual_information": f"""WITH {SQL_PAIRS}, r AS (
      SELECT *, min(a) OVER w AS la, max(a) OVER w AS ha, min(b) OVER w AS lb, max(b) OVER w AS hb FROM pr WINDOW w AS (PARTITION BY i, j)
    ), t AS (SELECT i, j, (ha - la) * (1 + 1.0::DOUBLE / 15) <= 1 OR (hb - lb) * (1 + 1.0::DOUBLE / 15) <= 1 AS flat,
      least(floor((a - (la - 0.5::DOUBLE * (ha - la) / 15)) / (ha - la + 2 * (0.5::DOUBLE * (ha - la) / 15)) * 16), 15)::BIGINT AS ba,
      least(floor((b - (lb - 0.5::DOUBLE * (hb - lb) / 15)) / (hb - lb + 2 * (0.5::DOUBLE * (hb - lb) / 15)) * 16), 15)::BIGINT AS bb FROM r
    ), jt AS (SELECT i, j, flat, ba, bb, count(*) / 64 AS s FROM t GROUP BY ALL
    ), e1 AS (SELECT i, j, -sum(s * log2(s)) AS h FROM (SELECT i, j, ba, sum(s) AS s FROM jt GROUP BY ALL) GROUP BY ALL
    ), e2 AS (SELECT i, j, -sum(s * log2(s)) AS h FROM (SELECT i, j, bb, sum(s) AS s FROM jt GROUP BY ALL) GROUP BY ALL
    ), e3 AS (SELECT i, j, bool_or(flat) AS flat, -sum(s * log2(s)) AS h FROM jt GROUP BY ALL)
    SELECT i, j, round(if(flat, 0, e1.h + e2.h - e3.h), 6) AS mi FROM e1 JOIN e2 USING (i, j) JOIN e3 USING (i, j)""",
    "mse": f"WITH {SQL_PAIRS} SELECT i, j, round(avg((a - b) ^ 2), 6) AS mse FROM pr GROUP BY ALL",
    "histogram_match": f"""WITH {SQL_P}, c AS (SELECT vec_id, v, count(*) AS n FROM p GROUP BY ALL
    ), q AS (SELECT vec_id, v, sum(n) OVER (PARTITION BY vec_id ORDER BY v) / sum(n) OVER (PARTITION BY vec_id) AS q FROM c
    ), t AS (SELECT *, lead(q) OVER w AS nq, lead(v) OVER w AS nv, first_value(q) OVER w AS fq, first_value(v) OVER w AS fv FROM q WINDOW w AS (PARTITION BY vec_id ORDER BY v))
    SELECT s.vec_id AS source, t.vec_id AS template, s.v, round(if((s.q < fq AND t.v = fv) OR nq IS NULL, t.v, t.v + (s.q - t.q) / (nq - t.q) * (nv - t.v)), 6) AS matched
    FROM q s JOIN t ON t.vec_id = s.vec_id + 1 AND s.vec_id % 20 < 19 WHERE (t.q <= s.q AND (nq IS NULL OR s.q < nq)) OR (s.q < fq AND t.v = fv)""",
    "histogram_intersection": f"""{_HIST}, g AS (SELECT vec_id, bin // 16 AS bin, sum(n) AS n FROM h GROUP BY ALL), ids AS (SELECT DISTINCT vec_id FROM p WHERE vec_id % 20 < 19)
    SELECT ids.vec_id AS a, ids.vec_id + 1 AS b, round(coalesce(sum(if(y.n IS NULL, 0, least(x.n, y.n))), 0) / 64, 6) AS score FROM ids LEFT JOIN g x ON x.vec_id = ids.vec_id LEFT JOIN g y ON y.vec_id = ids.vec_id + 1 AND y.bin = x.bin GROUP BY ALL""",
    "psnr_decision": f"""WITH {SQL_PAIRS}, d AS (SELECT i, j, abs(a - b) AS d, max(abs(a - b)) OVER w AS top, greatest(abs(max(a) OVER w - min(b) OVER w), abs(max(b) OVER w - min(a) OVER w)) AS most FROM pr WINDOW w AS (PARTITION BY i, j)
    ), l AS (SELECT *, d > top - most * 0.06::DOUBLE * 3.5::DOUBLE AS near, round(10 * log10(65025.0::DOUBLE / (if(top <> 0, d / top, d) ^ 2 + 1)), 9) AS lev FROM d
    ), m AS (SELECT *, min(lev) OVER (PARTITION BY i, j) AS low FROM l
    ), s AS (SELECT i, j, top, most, count(*) FILTER (near) AS n, avg((lev < low * 1.065::DOUBLE)::INT) AS share FROM m GROUP BY ALL)
    SELECT i, j, top >= most * 0.06::DOUBLE AND n >= 6 AS modified, round(if(top >= most * 0.06::DOUBLE AND n >= 6, share, -1), 6) AS global_share FROM s""",
    "scale_image_sigma": f"""WITH {SQL_P}, r AS (SELECT *, greatest(min(v) OVER w, avg(v) OVER w - stddev_pop(v) OVER w * 1.5::DOUBLE) AS lo, least(max(v) OVER w, avg(v) OVER w + stddev_pop(v) OVER w * 1.5::DOUBLE) AS hi FROM p WINDOW w AS (PARTITION BY vec_id))
    SELECT vec_id, y, x, v, round((greatest(lo, least(hi, v)) - lo) / if(hi = lo, 1, hi - lo) * 255, 6) AS scaled FROM r""",
    "scale_image_plain": f"WITH {SQL_P} SELECT vec_id, y, x, v, round((v - min(v) OVER (PARTITION BY vec_id)) * 2, 6) AS scaled FROM p",
    "otsu_threshold": f"""{_HIST}, r AS (SELECT vec_id, bin, sum(n) OVER u AS w0, sum(n * bin) OVER u AS s0, sum(n) OVER a AS w, sum(n * bin) OVER a AS s FROM h WINDOW u AS (PARTITION BY vec_id ORDER BY bin), a AS (PARTITION BY vec_id)
    ), b AS (SELECT vec_id, bin, round(w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)), 6) AS between_ FROM r WHERE w > w0)
    SELECT vec_id, bin AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY between_ DESC, bin) AS k FROM b) WHERE k = 1""",
    "mean_mask": f"WITH {SQL_P} SELECT vec_id // 20 AS family, y, x, round(avg(v), 6) AS v FROM p GROUP BY ALL",
    "flip_vertical": f"WITH {SQL_P} SELECT vec_id, 7 - y AS y, x, v FROM p",
    "rotate_90": f"WITH {SQL_P} SELECT vec_id, 7 - x AS y, y AS x, v FROM p",
    "patch_extraction": f"""{matching.SQL_RATIO}, b AS (
      SELECT m.i, m.j, min(vec_id * 37 % 640) AS x, min(vec_id * 53 % 480) AS y, max(vec_id * 37 % 640) - min(vec_id * 37 % 640) + 1 AS w, max(vec_id * 53 % 480) - min(vec_id * 53 % 480) + 1 AS h
      FROM m JOIN d ON d.image_id = m.query AND d.kp_idx = m.q_kp GROUP BY ALL) SELECT * FROM b WHERE w >= 9 AND h >= 9""",
}
