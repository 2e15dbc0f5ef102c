"""Queries of search, votes and index construction, with their SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinmap.operators import knn, training, votes
from kinmap.operators.ordering import dense_ids
from kinmap.plans.fixtures import SQL_D, SQL_E, base, descriptors, probes, vectors
from kinmap.session import checkpointed
from kinmap.streaming.ingest import merge_lists

K = 10


def hits(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    """q_id, q_image, rank, b_id, image_id, dist."""
    found = knn.knn_exact(probes(spark, sf), base(spark, sf), k)
    return found.select("q_id", F.expr("q_id div 100").alias("q_image"), F.col("rank").cast("long").alias("rank"), "b_id", F.expr("b_id div 100").alias("image_id"), "dist")


SQL_HITS = f"""WITH {SQL_D}, pairs AS (
  SELECT q_id, q_image, b_id, image_id, round(list_distance(p.vec, b.vec), 9) AS dist FROM probes p, base b
), all_hits AS (
  SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, b_id) AS rank FROM pairs
), hits AS (SELECT * FROM all_hits WHERE rank <= {K})"""
SQL_TALLY = SQL_HITS + """, tally AS (
  SELECT q_image, image_id, round(sum(1.0::DOUBLE / rank), 6) AS votes FROM hits GROUP BY ALL
), pos AS (SELECT *, row_number() OVER (PARTITION BY q_image ORDER BY votes DESC, image_id DESC) AS pos FROM tally)"""
#: Images whose number is divisible by 5 have no name.
SQL_NAMES = ", names AS (SELECT DISTINCT image_id, 'world/' || image_id || '.jpg' AS name FROM base WHERE image_id % 5 <> 0)"


def names(spark: SparkSession, sf: str) -> DataFrame:
    return base(spark, sf).filter("image_id % 5 <> 0").select("image_id", F.expr("concat('world/', image_id, '.jpg')").alias("name")).distinct()


def knn_exact_topk(spark, sf):
    return hits(spark, sf)


def _tally(spark, sf, weighted=True):
    return votes.tally(hits(spark, sf), ["q_image"], weighted=weighted)


def vote_tally_weighted(spark, sf):
    return votes.positions(_tally(spark, sf), ["q_image"]).withColumn("pos", F.col("pos").cast("long"))


def vote_tally_unweighted(spark, sf):
    return _tally(spark, sf, False)


def score_normalize_max(spark, sf):
    most = votes.max_vote(probes(spark, sf), ["q_image"], K)
    return _tally(spark, sf).join(most, "q_image").select("q_image", "image_id", F.round(F.col("votes") / F.col("max_vote"), 6).alias("score"))


def topn_before_name_join(spark, sf):
    top = votes.top_images(_tally(spark, sf), ["q_image"], 5)
    return votes.name_images(top, names(spark, sf)).select("q_image", "name", "votes", F.col("pos").cast("long").alias("pos"))


def score_normalize_first(spark, sf):
    return votes.normalize_by_first(votes.top_images(_tally(spark, sf), ["q_image"], 5), ["q_image"]).select("q_image", "image_id", "norm")


def pair_down(spark, sf):
    return votes.top_images(_tally(spark, sf), ["q_image"], 3).select("q_image", "image_id", "votes")


def _ignored(df):
    return df.filter("pos = 1").select("q_image", "image_id")


def ignore_list_filter(spark, sf):
    ranked = votes.positions(_tally(spark, sf), ["q_image"])
    return votes.ignore(ranked, _ignored(ranked), ["q_image", "image_id"]).select("q_image", "image_id", "votes")


def shard_merge_topk(spark, sf):
    k, found = 6, None
    for shard in range(3):
        own = knn.knn_exact(probes(spark, sf), base(spark, sf).filter(f"image_id % 3 = {shard}"), k).withColumn("shard_id", F.lit(shard).cast("long"))
        found = own if found is None else found.unionByName(own)
    merged = votes.merge_shards(found.drop("rank"), k)
    return merged.select("q_id", "shard_id", "b_id", "dist", F.col("rank").cast("long").alias("rank"))


def heuristic_score_merge(spark, sf):
    ranked = votes.positions(_tally(spark, sf), ["q_image"])
    second = votes.tally(hits(spark, sf).filter("rank <= 3"), ["q_image"])
    return votes.merge_scores(ranked.filter("pos <= 6"), second, ["q_image", "image_id"])


def object_vote_tally(spark, sf):
    own = hits(spark, sf).withColumn("object_id", F.expr("(q_id % 100) div 8"))
    return votes.top_images(votes.tally(own, ["q_image", "object_id"]), ["q_image", "object_id"], 2).select("q_image", "object_id", "image_id", "votes")


#: Neighbours of a probe's keypoint in the second search.
K2 = 15


def two_tier_filter(spark, sf):
    """Tier 1: top 5 of each probe. Where its best normalised score is over the gate, tier 2 searches again with each of the probe's objects,
    deeper and without tier 1's images, and keeps the best two of each object; of objects that name one image the last counts, and
    tier 2's score replaces tier 1's. Scores are then relative to the first."""
    found = hits(spark, sf)
    most = votes.max_vote(probes(spark, sf), ["q_image"], K)
    tier1 = votes.top_images(votes.tally(found, ["q_image"]), ["q_image"], 5)
    passed = tier1.filter("pos = 1").join(most, "q_image").filter("votes / max_vote > 0.03").select("q_image")
    again = knn.knn_exact(probes(spark, sf).join(passed, "q_image", "left_semi"), base(spark, sf), K2)
    second = again.select(F.expr("q_id div 100").alias("q_image"), F.expr("(q_id % 100) div 8").alias("object_id"), F.expr("b_id div 100").alias("image_id"), "rank")
    rest = votes.ignore(second, tier1, ["q_image", "image_id"])
    tier2 = votes.top_images(votes.tally(rest, ["q_image", "object_id"]), ["q_image", "object_id"], 2).groupBy("q_image", "image_id").agg(F.max_by("votes", "object_id").alias("votes"))
    merged = votes.positions(votes.merge_scores(tier1, tier2, ["q_image", "image_id"]), ["q_image"])
    return votes.normalize_by_first(merged, ["q_image"]).select("q_image", "image_id", F.col("pos").cast("long").alias("pos"), "norm")


def flip_query_concat(spark, sf):
    """Each probe's vectors and those of its mirror image (reversed here) vote together."""
    own = probes(spark, sf)
    both = own.withColumn("flip", F.lit(0).cast("long")).unionByName(own.withColumn("vec", F.reverse("vec")).withColumn("flip", F.lit(1).cast("long")))
    found = knn.knn_exact(both.select((F.col("q_id") * 2 + F.col("flip")).alias("q_id"), "vec"), base(spark, sf), 3)
    return votes.tally(found.select(F.expr("q_id div 200").alias("q_image"), F.expr("b_id div 100").alias("image_id"), "rank"), ["q_image"])


def knn_graph(spark, sf):
    own = vectors(spark, sf)
    found = knn.knn_exact(own.select(F.col("vec_id").alias("q_id"), F.col("e").alias("vec")), own.select(F.col("vec_id").alias("b_id"), F.col("e").alias("vec")), 5)
    return found.select("q_id", "b_id", "dist", F.col("rank").cast("long").alias("rank"))


def centroids(spark, sf):
    parts = vectors(spark, sf).select("label", F.posexplode("e").alias("i", "c")).groupBy("label", "i").agg(F.round(F.avg("c"), 9).alias("c"))
    return parts.groupBy("label").agg(F.expr("transform(array_sort(collect_list(struct(i, c))), x -> x.c)").alias("centroid")).select(F.col("label").cast("long").alias("list_id"), "centroid")


SQL_CENTROIDS = ", cs AS (SELECT label::BIGINT AS list_id, list(c ORDER BY i) AS centroid FROM (SELECT label, i, round(avg(e[i]), 9) AS c FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY label)"


def coarse_assign(spark, sf):
    return knn.closest_lists(base(spark, sf), centroids(spark, sf), "b_id").select("b_id", "list_id", "list_dist")


#: Lists that the registered search looks at, of ten; ``recall_at_k`` tells what it finds.
NPROBE = 9


def ivf_probe_search(spark, sf, nprobe=NPROBE):
    cs = centroids(spark, sf)
    found = knn.knn_ivf(probes(spark, sf), knn.build_lists(base(spark, sf), cs), cs, K, nprobe)
    return found.select("q_id", "b_id", "dist", F.col("rank").cast("long").alias("rank"))


SQL_IVF = f"""WITH {SQL_D}{SQL_CENTROIDS}, lists AS (
  SELECT b_id, list_id, vec FROM (SELECT b_id, list_id, vec, row_number() OVER (PARTITION BY b_id ORDER BY round(list_distance(vec, centroid), 9), list_id) AS r FROM base, cs) WHERE r = 1
), wanted AS (
  SELECT q_id, list_id, vec, r FROM (SELECT q_id, list_id, vec, row_number() OVER (PARTITION BY q_id ORDER BY round(list_distance(vec, centroid), 9), list_id) AS r FROM probes, cs)
)"""


def pq_codebook(spark, sf):
    """256 codes for each of 8 slices: the offsets of the first vectors from the centroids of their lists."""
    near = knn.closest_lists(vectors(spark, sf).select("vec_id", F.col("e").alias("vec")).filter("vec_id < 256"), centroids(spark, sf), "vec_id", residuals=True)
    rows = near.withColumn("sub", F.explode(F.expr("sequence(0, 7)")))
    return rows.select("sub", F.col("vec_id").alias("code"), F.expr("slice(residual, sub * 8 + 1, 8)").alias("centroid"))


SQL_PQ = SQL_IVF + """, off AS (
  SELECT vec_id, list_transform(range(64), lambda i: e[i + 1] - centroid[i + 1]) AS res
  FROM (SELECT vec_id, e, centroid, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_distance(e, centroid), 9), list_id) AS r FROM e, cs WHERE vec_id < 256) WHERE r = 1
), book AS (SELECT sub, vec_id AS code, res[sub * 8 + 1 : sub * 8 + 8] AS centroid FROM off, (SELECT unnest(range(8)) AS sub)
), left_ AS (SELECT b_id, list_id, list_transform(range(64), lambda i: vec[i + 1] - centroid[i + 1]) AS res FROM lists JOIN cs USING (list_id)
), coded AS (
  SELECT b_id, list_id, sub, code FROM (SELECT b_id, list_id, sub, code, row_number() OVER (PARTITION BY b_id, sub ORDER BY round(list_distance(res[sub * 8 + 1 : sub * 8 + 8], centroid), 9), code) AS r FROM left_, book) WHERE r = 1
)"""


def pq_encode(spark, sf):
    """Inverted lists of coded residuals."""
    coded = knn.build_pq_lists(base(spark, sf), centroids(spark, sf), pq_codebook(spark, sf), 8)
    return coded.select("b_id", "list_id", F.posexplode("codes").alias("sub", "code")).select("b_id", "list_id", F.col("sub").cast("long").alias("sub"), F.col("code").cast("long").alias("code"))


def ivfpq_search(spark, sf):
    """Search over the codes of the four closest lists."""
    cs, book = centroids(spark, sf), pq_codebook(spark, sf)
    found = knn.knn_ivfpq(probes(spark, sf), knn.build_pq_lists(base(spark, sf), cs, book, 8), cs, book, 5, 4, 8)
    return found.select("q_id", "b_id", "dist", F.col("rank").cast("long").alias("rank"))


def adc_search(spark, sf):
    """Search over all codes, of whole vectors."""
    book = vectors(spark, sf).filter("vec_id < 256").withColumn("sub", F.explode(F.expr("sequence(0, 7)"))).select("sub", F.col("vec_id").alias("code"), F.expr("slice(e, sub * 8 + 1, 8)").alias("centroid"))
    found = knn.adc_search(probes(spark, sf), knn.pq_encode(base(spark, sf), book, "b_id", 8), book, 5, 8)
    return found.select("q_id", "b_id", "dist", F.col("rank").cast("long").alias("rank"))


def trained_index(spark, sf, lists=8, codes=256, subs=16):
    """(rotated queries, rotated base, centroids, code books): an index whose rotation, lists and codes are trained on the world's vectors."""
    rows = checkpointed(base(spark, sf))
    codes, lists = min(codes, rows.count()), min(lists, training.most_lists(rows.count()))
    rotation = training.optimized_rotation(rows, subs, codes, rounds=3)
    turn = lambda df, key: training.transformed(df, key, np.zeros(len(rotation)), rotation.T)
    q, b = (checkpointed(df) for df in (turn(probes(spark, sf), "q_id"), turn(rows, "b_id")))
    cs = training.coarse_centroids(b, lists)
    near = knn.closest_lists(b, cs, "b_id", residuals=True)
    return q, b, cs, checkpointed(training.code_books(near.select(F.col("residual").alias("vec")), subs, codes))


def ivfpq_recall(spark, sf):
    """Share of the 10 exact neighbours that a trained index finds: candidates by code from the closest lists (50; half the root of
    the number of vectors, if that is more, as codes tell less among more), ranked anew by their vectors."""
    q, b, cs, books = trained_index(spark, sf)
    exact = checkpointed(hits(spark, sf).select("q_id", "b_id"))
    total, nprobes = exact.agg(F.count("*").alias("total")), [2, 4, 8]
    near = knn.ivfpq_refined(q, knn.build_pq_lists(b, cs, books, 16, residuals=True), cs, books, max(50, math.isqrt(b.count()) // 2), K, nprobes, 16)
    found = near.join(exact, ["q_id", "b_id"]).groupBy("nprobe").agg(F.count("*").alias("found"))
    every = spark.createDataFrame([(n,) for n in nprobes], "nprobe long").join(found, "nprobe", "left").crossJoin(total)
    return every.select("nprobe", F.round(F.coalesce("found", F.lit(0)) / F.col("total"), 6).alias("recall"))


def invlist_merge_counts(spark, sf):
    """Lists of three index shards, merged list by list."""
    cs = centroids(spark, sf)
    shards = [knn.closest_lists(base(spark, sf).filter(f"image_id % 3 = {shard}"), cs, "b_id").select("b_id", "list_id", F.lit(shard).alias("shard_id")) for shard in range(3)]
    return merge_lists(*shards).groupBy("list_id").agg(F.count("*").alias("n"), F.countDistinct("shard_id").alias("shards"), F.min("b_id").alias("first"), F.max("b_id").alias("last"))


def recall_at_k(spark, sf):
    """Share of the exact neighbours that a search over the closest 1, 2, 4 and 9 lists finds, from one search over nine."""
    cs = centroids(spark, sf)
    exact = hits(spark, sf).select("q_id", "b_id")
    found = checkpointed(knn.ivf_hits(probes(spark, sf), knn.build_lists(base(spark, sf), cs), cs, K, NPROBE))
    each = found.withColumn("nprobe", F.explode(F.array(*(F.lit(n).cast("long") for n in (1, 2, 4, NPROBE))))).filter("place <= nprobe")
    order = Window.partitionBy("nprobe", "q_id").orderBy("dist", "b_id")
    top = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= K)
    total = exact.count()
    return top.join(exact, ["q_id", "b_id"]).groupBy("nprobe").agg(F.round(F.count("*") / total, 6).alias("recall"))


def rebatch(spark, sf):
    """Descriptors in batches of 64 rows, in order of image and keypoint."""
    rows = descriptors(spark, sf).select("image_id", "kp_idx")
    return dense_ids(rows, "image_id", ["kp_idx"], "at").groupBy(F.expr("at div 64").alias("batch")).agg(F.count("*").alias("n"), F.min("image_id").alias("first_image"), F.max("image_id").alias("last_image"))


QUERIES = {
    f.__name__: f
    for f in (
        knn_exact_topk, vote_tally_weighted, vote_tally_unweighted, score_normalize_max, topn_before_name_join, score_normalize_first, pair_down, ignore_list_filter,
        shard_merge_topk, heuristic_score_merge, object_vote_tally, two_tier_filter, flip_query_concat, knn_graph, coarse_assign, ivf_probe_search, pq_encode, ivfpq_search, adc_search, ivfpq_recall,
        invlist_merge_counts, recall_at_k, rebatch,
    )
}

_H = sum(1.0 / r for r in range(1, K + 1))
ORACLES = {
    "knn_exact_topk": f"{SQL_HITS} SELECT q_id, q_image, rank, b_id, image_id, dist FROM hits",
    "vote_tally_weighted": f"{SQL_TALLY} SELECT * FROM pos",
    "vote_tally_unweighted": f"{SQL_HITS} SELECT q_image, image_id, count(*)::DOUBLE AS votes FROM hits GROUP BY ALL",
    "score_normalize_max": f"{SQL_TALLY}, m AS (SELECT q_image, count(*) * {_H!r}::DOUBLE AS max_vote FROM probes GROUP BY ALL) SELECT q_image, image_id, round(votes / max_vote, 6) AS score FROM tally JOIN m USING (q_image)",
    "topn_before_name_join": f"{SQL_TALLY}{SQL_NAMES} SELECT q_image, name, votes, pos FROM pos JOIN names USING (image_id) WHERE pos <= 5",
    "score_normalize_first": f"{SQL_TALLY} SELECT q_image, image_id, round(votes / first_value(votes) OVER (PARTITION BY q_image ORDER BY pos), 6) AS norm FROM pos WHERE pos <= 5",
    "pair_down": f"{SQL_TALLY} SELECT q_image, image_id, votes FROM pos WHERE pos <= 3",
    "ignore_list_filter": f"{SQL_TALLY} SELECT q_image, image_id, votes FROM pos WHERE pos > 1",
    "shard_merge_topk": f"""WITH {SQL_D}, s AS (
      SELECT q_id, b_id, image_id % 3 AS shard_id, round(list_distance(p.vec, b.vec), 9) AS dist FROM probes p, base b
    ), own AS (SELECT *, row_number() OVER (PARTITION BY q_id, shard_id ORDER BY dist, b_id) AS r FROM s)
    SELECT q_id, shard_id, b_id, dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, shard_id, b_id) AS rank FROM own WHERE r <= 6) WHERE rank <= 9""",
    "heuristic_score_merge": f"""{SQL_TALLY}, t AS (SELECT q_image, image_id, round(sum(1.0::DOUBLE / rank), 6) AS votes FROM hits WHERE rank <= 3 GROUP BY ALL)
    SELECT coalesce(a.q_image, t.q_image) AS q_image, coalesce(a.image_id, t.image_id) AS image_id, coalesce(t.votes, a.votes) AS votes
    FROM (SELECT * FROM pos WHERE pos <= 6) a FULL JOIN t ON a.q_image = t.q_image AND a.image_id = t.image_id""",
    "object_vote_tally": f"""{SQL_HITS}, t AS (SELECT q_image, q_id % 100 // 8 AS object_id, image_id, round(sum(1.0::DOUBLE / rank), 6) AS votes FROM hits GROUP BY ALL)
    SELECT q_image, object_id, image_id, votes FROM (SELECT *, row_number() OVER (PARTITION BY q_image, object_id ORDER BY votes DESC, image_id DESC) AS r FROM t) WHERE r <= 2""",
    "two_tier_filter": f"""{SQL_TALLY}, m AS (SELECT q_image, count(*) * {_H!r}::DOUBLE AS max_vote FROM probes GROUP BY ALL
    ), tier1 AS (SELECT * FROM pos WHERE pos <= 5
    ), passed AS (SELECT q_image FROM tier1 JOIN m USING (q_image) WHERE pos = 1 AND votes / max_vote > 0.03
    ), again AS (SELECT q_image, q_id % 100 // 8 AS object_id, image_id, rank FROM all_hits h WHERE rank <= {K2} AND q_image IN (FROM passed)
      AND NOT EXISTS (FROM tier1 t WHERE t.q_image = h.q_image AND t.image_id = h.image_id)
    ), t2 AS (SELECT q_image, object_id, image_id, round(sum(1.0::DOUBLE / rank), 6) AS votes FROM again GROUP BY ALL
    ), tier2 AS (SELECT q_image, image_id, arg_max(votes, object_id) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY q_image, object_id ORDER BY votes DESC, image_id DESC) AS r FROM t2) WHERE r <= 2 GROUP BY ALL
    ), merged AS (SELECT q_image, image_id, votes FROM tier1 UNION ALL SELECT q_image, image_id, votes FROM tier2
    ), final AS (SELECT *, row_number() OVER (PARTITION BY q_image ORDER BY votes DESC, image_id DESC) AS pos FROM merged)
    SELECT q_image, image_id, pos, round(votes / first_value(votes) OVER (PARTITION BY q_image ORDER BY pos), 6) AS norm FROM final""",
    "flip_query_concat": f"""WITH {SQL_D}, q AS (SELECT q_id * 2 AS q_id, vec FROM probes UNION ALL SELECT q_id * 2 + 1, list_reverse(vec) FROM probes
    ), r AS (SELECT q_id, b_id, row_number() OVER (PARTITION BY q_id ORDER BY round(list_distance(q.vec, b.vec), 9), b_id) AS rank FROM q, base b)
    SELECT q_id // 200 AS q_image, b_id // 100 AS image_id, round(sum(1.0::DOUBLE / rank), 6) AS votes FROM r WHERE rank <= 3 GROUP BY ALL""",
    "knn_graph": f"""WITH {SQL_E}, r AS (SELECT a.vec_id AS q_id, b.vec_id AS b_id, round(list_distance(a.e, b.e), 9) AS dist FROM e a, e b)
    SELECT q_id, b_id, dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, b_id) AS rank FROM r) WHERE rank <= 5""",
    "coarse_assign": f"""WITH {SQL_D}{SQL_CENTROIDS} SELECT b_id, list_id, list_dist FROM (
      SELECT b_id, list_id, list_dist, row_number() OVER (PARTITION BY b_id ORDER BY list_dist, list_id) AS r FROM (SELECT b_id, list_id, round(list_distance(vec, centroid), 9) AS list_dist FROM base, cs)) WHERE r = 1""",
    "ivf_probe_search": f"""{SQL_IVF}, x AS (SELECT q_id, b_id, round(list_distance(w.vec, l.vec), 9) AS dist FROM wanted w JOIN lists l USING (list_id) WHERE r <= {NPROBE})
    SELECT q_id, b_id, dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, b_id) AS rank FROM x) WHERE rank <= {K}""",
    "pq_encode": f"{SQL_PQ} SELECT b_id, list_id, sub, code FROM coded",
    "ivfpq_search": f"""{SQL_PQ}, wr AS (SELECT q_id, list_id, list_transform(range(64), lambda i: vec[i + 1] - centroid[i + 1]) AS res FROM wanted JOIN cs USING (list_id) WHERE r <= 4
    ), t AS (SELECT q_id, list_id, sub, code, list_distance(res[sub * 8 + 1 : sub * 8 + 8], centroid) ^ 2 AS d FROM wr, book
    ), x AS (SELECT q_id, b_id, round(sqrt(sum(d)), 9) AS dist FROM coded JOIN t USING (list_id, sub, code) GROUP BY ALL)
    SELECT q_id, b_id, dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, b_id) AS rank FROM x) WHERE rank <= 5""",
    "adc_search": f"""WITH {SQL_D}, book AS (SELECT sub, vec_id AS code, e[sub * 8 + 1 : sub * 8 + 8] AS centroid FROM e, (SELECT unnest(range(8)) AS sub) WHERE vec_id < 256
    ), coded AS (
      SELECT b_id, sub, code FROM (SELECT b_id, sub, code, row_number() OVER (PARTITION BY b_id, sub ORDER BY round(list_distance(vec[sub * 8 + 1 : sub * 8 + 8], centroid), 9), code) AS r FROM base, book) WHERE r = 1
    ), t AS (SELECT q_id, sub, code, list_distance(vec[sub * 8 + 1 : sub * 8 + 8], centroid) ^ 2 AS d FROM probes, book
    ), x AS (SELECT q_id, b_id, round(sqrt(sum(d)), 9) AS dist FROM coded JOIN t USING (sub, code) GROUP BY ALL)
    SELECT q_id, b_id, dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, b_id) AS rank FROM x) WHERE rank <= 5""",
    "invlist_merge_counts": f"{SQL_IVF} SELECT list_id, count(*) AS n, count(DISTINCT b_id // 100 % 3) AS shards, min(b_id) AS first, max(b_id) AS last FROM lists GROUP BY list_id",
    "recall_at_k": f"""{SQL_IVF}, ex AS (SELECT q_id, b_id FROM (SELECT q_id, b_id, row_number() OVER (PARTITION BY q_id ORDER BY round(list_distance(p.vec, b.vec), 9), b_id) AS k FROM probes p, base b) WHERE k <= {K}
    ), x AS (SELECT n, q_id, b_id, round(list_distance(w.vec, l.vec), 9) AS dist FROM wanted w JOIN lists l USING (list_id), (SELECT unnest([1, 2, 4, {NPROBE}]) AS n) WHERE r <= n
    ), f AS (SELECT n, q_id, b_id FROM (SELECT *, row_number() OVER (PARTITION BY n, q_id ORDER BY dist, b_id) AS k FROM x) WHERE k <= {K})
    SELECT n::BIGINT AS nprobe, round(count(*) / (SELECT count(*) FROM ex), 6) AS recall FROM f JOIN ex USING (q_id, b_id) GROUP BY n""",
    "rebatch": f"""WITH {SQL_D} SELECT nr // 64 AS batch, count(*) AS n, min(image_id) AS first_image, max(image_id) AS last_image
    FROM (SELECT image_id, row_number() OVER (ORDER BY image_id, kp_idx) - 1 AS nr FROM d) GROUP BY ALL""",
}
