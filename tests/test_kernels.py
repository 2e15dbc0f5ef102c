"""Kernels on small inputs with known answers."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from kinmap.operators import features, geometry, graphs, knn, masks


@given(st.integers(1, 40), st.integers(1, 30), st.integers(1, 12), st.integers(0, 99))
@settings(max_examples=60, deadline=None)
def test_nearest_is_exact(nq, nb, k, seed):
    rng = np.random.default_rng(seed)
    q, b = rng.integers(0, 3, (nq, 4)).astype(float), rng.integers(0, 3, (nb, 4)).astype(float)
    ids = rng.permutation(nb) * 7
    r, found, d = knn.nearest(q, b, ids, k)
    for i in range(nq):
        dist = np.round(np.sqrt(((b - q[i]) ** 2).sum(axis=1)), knn.DIGITS)
        order = np.lexsort((ids, dist))[:k]
        assert found[r == i].tolist() == ids[order].tolist()
        assert d[r == i].tolist() == dist[order].tolist()


def test_ivf_over_all_lists_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    base = spark.createDataFrame(rows, "b_id long, vec array<double>")
    queries = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(20)], "q_id long, vec array<double>")
    centroids = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(5)], "list_id long, centroid array<double>")
    exact = {tuple(r) for r in knn.knn_exact(queries, base, 4).collect()}
    blocks = {tuple(r) for r in knn.knn_exact(queries, base, 4, query_block=7).collect()}
    ivf = {tuple(r) for r in knn.knn_ivf(queries, knn.build_lists(base, centroids), centroids, 4, 5).collect()}
    assert exact == blocks == ivf and len(exact) == 80
    book = spark.createDataFrame([(s, c, rng.normal(size=4).tolist()) for s in range(2) for c in range(6)], "sub int, code long, centroid array<double>")
    encoded = knn.pq_encode(base, book, "b_id", 2)
    coded = [{tuple(r) for r in knn.adc_search(queries, encoded, book, 4, 2, query_block=n).collect()} for n in (6, 100)]
    assert coded[0] == coded[1] and len(coded[0]) == 80


def test_homography_of_a_known_map():
    rng = np.random.default_rng(1)
    h = np.array([[1.1, 0.2, 5], [-0.1, 0.9, 7], [1e-4, 2e-4, 1]])
    a = rng.uniform(0, 300, (40, 2))
    b = geometry.project(h, a)
    b[:12] += rng.uniform(50, 90, (12, 2))  # outliers
    assert np.allclose(geometry.least_median_homography(a, b), h, atol=1e-6)
    assert geometry.least_median_homography(a[:3], b[:3]) is None


def test_affine_and_its_failure():
    rng = np.random.default_rng(2)
    a = rng.uniform(0, 100, (9, 2))
    m = np.array([[0.5, -0.3, 4], [0.3, 0.5, -2]])
    assert np.allclose(geometry.affine(a, a @ m[:, :2].T + m[:, 2]), m)
    assert geometry.inverse_condition(geometry.affine(a[:4], a[:4])) < 1e-9


def test_consistent_matches_of_a_shift():
    rng = np.random.default_rng(4)
    q = rng.uniform(0, 500, (2, 20))
    t = q + np.array([[30.0], [-12.0]])
    t[:, 15:] += 200
    assert geometry.largest_consistent(q, t).tolist() == list(range(15))


def test_warp_by_a_shift():
    image = np.arange(30.0).reshape(5, 6)
    out = geometry.warp(image, np.array([[1.0, 0, 1], [0, 1, 2]]), 5, 6)
    assert (out[2:, 1:] == image[:3, :5]).all() and (out[:2] == 0).all()


def test_spanning_tree():
    w = np.zeros((5, 5))
    for i, j, v in ((0, 1, 3), (1, 2, 5), (0, 2, 4), (2, 3, 1)):
        w[i, j] = w[j, i] = v
    assert graphs.spanning_tree(w) == [(1, 2), (0, 2), (2, 3)]  # node 4 has no positive cell


def test_cluster_grows_a_chain_from_the_probe():
    kp = np.array([[0, 20, 4, 0], [20, 0, 15, 0], [4, 15, 0, 12], [0, 0, 12, 0]], float)
    mi = np.triu(np.ones((4, 4)), 1) * 2 + np.tril(np.ones((4, 4)), -1)
    edges = graphs.Cluster(kp, np.full((4, 4), 0.05), mi).run()
    assert set(edges) == {(0, 1), (1, 2), (2, 3)}


def test_near_duplicate_gate_passes_small_sets():
    c = graphs.Cluster(np.array([[0, 9, 1], [9, 0, 1], [1, 1, 0]], float), np.zeros((3, 3)), np.ones((3, 3)))
    assert c.fits(2, [0, 1])
    big = graphs.Cluster(np.array([[0, 9, 9, 1], [9, 0, 9, 1], [9, 9, 0, 1], [1, 1, 1, 0]], float), np.zeros((4, 4)), np.ones((4, 4)))
    assert not big.fits(3, [0, 1, 2])


def test_components_and_boxes():
    mask = np.array([[1, 1, 0, 0], [0, 1, 0, 1], [0, 0, 1, 1]], bool)
    assert masks.components(mask).tolist() == [[1, 1, 0, 0], [0, 1, 0, 2], [0, 0, 2, 2]]
    assert masks.component_boxes(mask)["area"].tolist() == [3, 3]


def test_morphology():
    mask = np.zeros((9, 9), bool)
    mask[2:7, 2:7] = True
    mask[4, 4] = False
    assert masks.closing(mask, 3)[4, 4]
    lone = np.zeros((9, 9), bool)
    lone[4, 4] = True
    assert not masks.opening(lone, 3).any()
    assert masks.blur(np.full((12, 12), 7.0), 2.0) == pytest.approx(7.0)
    assert masks.resized(np.full((4, 6), 3.0), 9, 5) == pytest.approx(3.0)


def test_surf_finds_a_moved_blob():
    y, x = np.mgrid[:80, :80]
    blob = lambda cx, cy: 200 * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / 30.0)
    first, second = features.detect_surf(blob(30, 40)), features.detect_surf(blob(37, 45))
    assert first[0, :2].tolist() == [30, 40] and second[0, :2].tolist() == [37, 45]
    a, b = features.describe_surf(blob(30, 40), first[:1]), features.describe_surf(blob(37, 45), second[:1])
    assert np.allclose(a, b, atol=1e-3) and np.isclose(np.linalg.norm(a), 1)
    assert features.local_binary_patterns(blob(30, 40), first[:1]).sum() == pytest.approx(1)


def test_spread_out_keeps_distance():
    rng = np.random.default_rng(0)
    points = np.c_[rng.uniform(0, 400, (300, 2)), np.ones((300, 3))]
    kept = features.spread_out(points, top=10, most=100)
    assert kept[:10].tolist() == points[:10].tolist()
    for i in range(10, len(kept)):
        assert np.hypot(*(kept[:i, :2] - kept[i, :2]).T).min() > 50


def test_unreadable_images_give_an_error_row(spark):
    images = spark.createDataFrame([(1, 5, 5, 1, bytearray(b"short")), (2, 30, 30, 3, bytearray(2700))], "image_id long, height int, width int, channels int, data binary")
    out = {r["image_id"]: r for r in features.extract_features(images).collect()}
    assert out[1]["error"] and out[1]["vec"] is None and 2 not in out


def test_a_moved_copy_with_an_edit_is_seen():
    from kinmap.operators import tier2

    rng = np.random.default_rng(3)
    probe = masks.blur(rng.uniform(0, 255, (120, 140)), 3.0) * 4 - 380
    m = np.array([[1.0, 0, -6], [0, 1.0, 4]])  # result to probe
    result = geometry.warp(probe, np.linalg.inv(np.r_[m, [[0, 0, 1]]]), 120, 140)
    points = rng.uniform(20, 100, (12, 2))
    moved = points @ m[:, :2].T + m[:, 2]
    same = tier2.compare(probe, result, moved, points)
    assert same["rcond"] > 0.1 and same["modified"] is False
    edited = result.copy()
    edited[40:75, 40:75] += 200
    seen = tier2.compare(probe, edited, moved, points)
    assert seen["modified"] and not seen["everywhere"]
    assert tier2.compare(probe, result, moved[:3], points[:3])["modified"] is None


def test_patch_likeness():
    from kinmap.operators import tier2

    rng = np.random.default_rng(4)
    image = rng.integers(0, 255, (40, 40)).astype(float)
    corners = np.array([[5, 5], [30, 28]])
    own = tier2.patch_likeness(image, corners, image, corners)
    other = tier2.patch_likeness(image, corners, rng.integers(0, 255, (40, 40)).astype(float), corners)
    assert own["mean_squared_error"] == pytest.approx(0) and own["mutual_information"] > other["mutual_information"]
    assert tier2.patch_likeness(image, corners[:1], image, corners[:1]) is None
    assert (tier2.histogram_matched(image, image) == image).all()


def test_sql_names(spark):
    from kinmap.functions import sql
    from kinmap.sources.vectors import encode_set

    sql.register(spark)
    assert spark.sql("SELECT l2_distance(array(0D, 3D), array(4D, 0D)) + vote_weight(4)").first()[0] == 5.25
    spark.createDataFrame([(bytearray(encode_set(np.ones((2, 3)))),)], "c binary").createOrReplaceTempView("sets")
    assert spark.sql("SELECT f.* FROM sets, LATERAL decode_features(c) f").count() == 2
