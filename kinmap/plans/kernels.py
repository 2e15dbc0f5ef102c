"""Queries of operators that SQL cannot express: geometry, features, masks, training."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinmap.operators import adjacency, features, geometry, graphs, knn, masks, pixels, tier2, training
from kinmap.plans import matching
from kinmap.plans.fixtures import base, patches, vectors
from kinmap.session import checkpointed


def _matched(spark, sf):
    """Matches with the positions of both keypoints; the train side is scaled and moved by a known map."""
    own = matching.points(spark, sf)
    q = own.select(F.col("image_id").alias("query"), F.col("kp_idx").alias("q_kp"), F.col("x").cast("double").alias("qx"), F.col("y").cast("double").alias("qy"))
    t = own.select(F.col("kp_idx").alias("t_kp"), F.col("image_id").alias("train"), F.expr("0.5D * x + 20").alias("tx"), F.expr("0.5D * y + 30").alias("ty"))
    found = matching.ratio_test_matches(spark, sf).withColumn("train", F.expr("i + j - query"))
    return found.join(q, ["query", "q_kp"]).join(t, ["train", "t_kp"]).select("i", "j", "q_kp", "t_kp", "qx", "qy", "tx", "ty")


def geometric_consistency(spark, sf):
    return geometry.geometric_consistency(_matched(spark, sf))


def homography_warp(spark, sf):
    return geometry.homographies(_matched(spark, sf)).select("i", "j", F.expr("transform(h, x -> round(x, 4))").alias("h"), F.round("error", 4).alias("error"))


def affine_rcond(spark, sf):
    return geometry.affine_maps(_matched(spark, sf)).select("i", "j", F.expr("transform(m, x -> round(x, 4))").alias("m"), "rcond")


def pictures(spark, sf):
    """40 x 40 images: each patch, every pixel five times wide."""
    wide = F.expr("flatten(transform(sequence(0, 39), y -> transform(sequence(0, 39), x -> least(255, greatest(0, floor((e[cast((y div 5) * 8 + x div 5 AS int)] + 1) * 127.5D))))))")
    images = vectors(spark, sf).select(F.col("vec_id").alias("image_id"), F.lit(40).alias("height"), F.lit(40).alias("width"), F.lit(1).alias("channels"), wide.alias("pixels"))
    return images.withColumn("data", F.unhex(F.expr("concat_ws('', transform(pixels, p -> lpad(hex(cast(p AS bigint)), 2, '0')))")))


def scenes(spark, sf):
    """120 x 120 images: nine pictures of a family side by side and blurred; of each family four versions, of which later ones are moved and
    hold a change. image_id, height, width, channels, data."""
    tiles = vectors(spark, sf).filter("vec_id % 20 < 9").select(F.expr("vec_id div 20").alias("family"), F.expr("cast(vec_id % 20 AS int)").alias("tile"), "e")

    def run(rows):
        import numpy as np
        import pandas as pd

        rows = rows.sort_values("tile")
        patches = [np.kron((np.asarray(e).reshape(8, 8) + 1) * 127.5, np.ones((5, 5))) for e in rows["e"]]
        whole = np.vstack([np.hstack(patches[k : k + 3]) for k in range(0, 9, 3)]) if len(patches) == 9 else np.zeros((120, 120))
        out = []
        for version in range(4):
            image = np.roll(masks.blur((whole - whole.mean()) * 3 + 128, 2.0), (2 * version, 3 * version), axis=(0, 1))
            if version == 3:
                image[20:50, 60:95] = 255 - image[20:50, 60:95]
            out.append((4 * int(rows["family"].iloc[0]) + version, 120, 120, 1, np.clip(image, 0, 255).astype(np.uint8).tobytes()))
        return pd.DataFrame(out, columns=["image_id", "height", "width", "channels", "data"])

    return tiles.groupBy("family").applyInPandas(run, "image_id long, height int, width int, channels int, data binary")


def image_adjacency(spark, sf):
    """Measures of the pairs of each family's scenes, from their pixels: features, matches, warps both ways, likeness of what is matched."""
    images = checkpointed(scenes(spark, sf))
    found = checkpointed(features.extract_features(images, "SURF4", "SURF", spark.sparkContext.defaultParallelism).select("image_id", "kp_idx", "x", "y", "vec"))
    ids = images.select("image_id")
    pairs = ids.select(F.col("image_id").alias("i"), F.explode(F.expr("sequence(image_id + 1, 4 * (image_id div 4) + 3)")).alias("j")).filter("i < j AND j div 4 = i div 4")
    return adjacency.adjacency(pairs, images, found)


def image_graph(spark, sf):
    """From images to the edges of each family's graph, grown from its second version."""
    cells = adjacency.as_cells(checkpointed(image_adjacency(spark, sf)))
    node = lambda c: F.when(F.col(c) % 4 == 1, 0).otherwise(F.col(c) % 4 + 1)  # noqa: E731  node 0 is the probe
    own = cells.select(F.expr("i div 4").alias("probe_id"), node("i").cast("long").alias("i"), node("j").cast("long").alias("j"), "kp", "dist", "mi")
    return graphs.cluster_graph(own, "probe_id")


def rcond_order(spark, sf):
    """Maps of each query image in order of their condition."""
    found = affine_rcond(spark, sf)
    return tier2.by_condition(found.select(F.col("i").alias("probe_id"), F.col("j").alias("result_id"), "rcond")).withColumn("pos", F.col("pos").cast("long"))


def surf_features(spark, sf):
    images = pictures(spark, sf)
    found = features.extract_features(images, "SURF3", "SURF", spark.sparkContext.defaultParallelism)
    return found.select("image_id", "kp_idx", "x", "y", "size", F.round("response", 3).alias("response"), F.size("vec").alias("dims"))


def mask_components(spark, sf):
    own = patches(spark, sf)
    limit = pixels.otsu(pixels.histogram(own, ["vec_id"]), ["vec_id"])
    return masks.mask_components(own.join(limit, "vec_id"), "vec_id", 8, 8, "threshold")


def pca_transform(spark, sf):
    rows = vectors(spark, sf).select("vec_id", F.col("e").alias("vec"))
    mean, axes = training.principal_axes(rows, 8)
    return training.transformed(rows, "vec_id", mean, axes).select("vec_id", F.expr("transform(vec, x -> round(x, 5))").alias("vec"))


def kmeans_lists(spark, sf):
    cs = training.coarse_centroids(vectors(spark, sf).select(F.col("e").alias("vec")), 8)
    return knn.closest_lists(base(spark, sf), cs, "b_id").groupBy("list_id").agg(F.count("*").alias("n"))



def tier2_pairs(spark, sf):
    """The first scene of each family with each other version, and the points that a shift by the version's known offset matches."""
    images = checkpointed(scenes(spark, sf)).select("image_id", "height", "data")
    left = images.filter("image_id % 4 = 0").select(F.col("image_id").alias("probe_id"), F.col("height").alias("probe_height"), F.col("data").alias("probe"))
    right = images.filter("image_id % 4 > 0").select(F.expr("image_id - image_id % 4").alias("probe_id"), F.col("image_id").alias("result_id"), F.col("height").alias("result_height"), F.col("data").alias("result"), F.expr("image_id % 4").alias("v"))
    xs, ys = (F.array(*(F.lit(float(a)) for a in own)) for own in ((20, 90, 20, 90, 55, 40), (20, 20, 90, 90, 60, 75)))
    points = [xs.alias("px"), ys.alias("py"), F.transform(xs, lambda a: a + 3 * F.col("v")).alias("rx"), F.transform(ys, lambda a: a + 2 * F.col("v")).alias("ry")]
    return left.join(right, "probe_id").select("probe_id", "result_id", "probe_height", "result_height", "probe", "result", *points)


def tier2_masks(spark, sf):
    """Where each version of a family differs from the first, registered to it."""
    return tier2.change_masks(tier2_pairs(spark, sf)).drop("mask")


QUERIES = {f.__name__: f for f in (geometric_consistency, homography_warp, affine_rcond, rcond_order, surf_features, mask_components, pca_transform, kmeans_lists, tier2_masks, image_adjacency, image_graph)}
ORACLES: dict[str, str] = {}
