"""Operators on whole images, indexes and graphs, on small inputs with known answers or against plain versions."""

import io
import json
import time
import zlib

import numpy as np
import pytest
from kinmap.functions import sql
from kinmap.operators import adjacency, catalogs, features, geometry, graphs, index, knn, masks, match, matrices, tier2
from kinmap.sources import images, vectors
from kinmap.streaming import ingest
from pyspark.sql import functions as F


def picture(seed, size=110, sigma=2.5):
    rng = np.random.default_rng(seed)
    return np.clip(masks.blur(rng.uniform(0, 255, (size, size)), sigma) * 6 - 640, 0, 255)


def as_rows(spark, pictures):
    rows = [(i, f"p{i}.png", *p.shape, 1, bytearray(p.astype(np.uint8).tobytes())) for i, p in pictures.items()]
    return spark.createDataFrame(rows, "image_id long, name string, height int, width int, channels int, data binary")


# walks and matrices


def test_walks_have_no_limit(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(300, 301), (301, 300)], "source long, target long")
    starts = spark.createDataFrame([(0,), (150,), (300,), (999,)], "start long")
    out = {(r["start"], r["step"]): r["node"] for r in graphs.follow_chain(links, starts).collect()}
    assert out == {(0, k): k for k in range(201)} | {(150, k): 150 + k for k in range(51)} | {(300, 0): 300, (300, 1): 301, (999, 0): 999}
    edges = spark.createDataFrame([(i, i + 1) for i in range(56)] + [(3, 1), (80, 81)], "u long, v long")
    levels = {r["node"]: r["level"] for r in match.bfs_levels(edges, spark.createDataFrame([(0,)], "start long")).collect()}
    assert levels == {0: 0, 1: 1, 2: 2, **{i: i - 1 for i in range(3, 57)}}


@pytest.mark.parametrize("dissimilar", [False, True])
def test_min_max_is_that_of_the_dense_matrix(spark, dissimilar):
    rng = np.random.default_rng(4)
    dense = np.where(rng.uniform(size=(6, 6)) < 0.5, rng.integers(3, 20, (6, 6)), -1 if dissimilar else 0).astype(float)
    np.fill_diagonal(dense, -1 if dissimilar else 0)
    m = -dense if dissimilar else dense
    seen = m[m != 1.0] if dissimilar else m
    wanted = np.where((m == 1.0) if dissimilar else (m == 0.0), -1.0, (m - seen.min()) / (seen.max() - seen.min()))
    there = np.argwhere(dense != (-1 if dissimilar else 0))
    cells = spark.createDataFrame([(1, int(i), int(j), float(dense[i, j])) for i, j in there], "p long, i long, j long, value double")
    for r in matrices.min_max(cells, ["p"], dissimilar).collect():
        assert r["norm"] == pytest.approx(wanted[r["i"], r["j"]], abs=1e-6)


def test_matrix_archives_round_trip(spark):
    rows = [(7, 0, 1, 5.0, 0.2, 1.5, 30.0), (7, 1, 0, 5.0, 0.2, 1.25, 31.0), (8, 2, 0, 9.0, 0.1, 0.0, -1.0)]
    cells = spark.createDataFrame(rows, "probe long, i long, j long, kp double, dist double, mi double, mse double")
    files = vectors.matrix_archives(cells, "probe")
    held = np.load(io.BytesIO(files.filter("probe = 7").first()["content"]))
    assert held["arr_1"].tolist() == [[-1.0, 0.2], [0.2, -1.0]] and held["arr_2"].tolist() == [[0.0, 1.5], [1.25, 0.0]]
    assert sorted(map(tuple, vectors.explode_archives(files, "probe").collect())) == sorted(rows)


def test_graph_query_is_a_forest_around_each_probe(spark):
    from kinmap.plans import catalog

    sf = "/root/testdata/sf0.001"
    found = catalog.queries()["graph_query"](spark, sf).toPandas()
    levels = catalog.queries()["bfs_levels"](spark, sf).toPandas()
    for probe, own in found.groupby("probe_id"):
        nodes = set(own["source"]) | set(own["target"])
        assert f"world/{probe}.jpg" in nodes and len(own) == len(nodes) - 1
        assert nodes <= {f"world/{n}.jpg" for n in levels[levels["start"] == probe]["node"]}
    cells = catalog.queries()["image_graph"](spark, sf)
    assert cells.groupBy("probe_id").count().filter("count > 4").count() == 0


# search


def test_exact_search_in_block_pairs(spark):
    rng = np.random.default_rng(9)
    base = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(300)], "b_id long, vec array<double>")
    queries = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(50)] + [(99, None)], "q_id long, vec array<double>")
    whole = sorted(map(tuple, knn.knn_exact(queries, base, 5).collect()))
    assert whole == sorted(map(tuple, knn.knn_exact(queries, base, 5, 7, 40).collect())) and len(whole) == 250


def test_large_models_meet_rows_block_by_block(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "b_id long, vec array<double>")
    centroids = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(7)], "list_id long, centroid array<double>")
    near = lambda: sorted((r["b_id"], r["place"], r["list_id"], [round(x, 9) for x in r["residual"]]) for r in knn.closest_lists(rows, centroids, "b_id", 2, residuals=True).collect())
    here = near()
    monkeypatch.setattr(knn, "MODEL_VALUES", 1)
    assert near() == here and len(here) == 120


def test_coded_search_of_exact_codes_is_exact(spark, monkeypatch):
    """A book that holds every residual: distances by code are those of the vectors."""
    rng = np.random.default_rng(3)
    data = rng.normal(size=(40, 4))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "b_id long, vec array<double>")
    queries = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(9)], "q_id long, vec array<double>")
    centroids = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(3)], "list_id long, centroid array<double>")
    left = knn.closest_lists(base, centroids, "b_id", residuals=True)
    book = left.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("sub"), F.col("b_id").alias("code"), "residual").selectExpr("sub", "code", "slice(residual, sub * 2 + 1, 2) AS centroid")
    lists = knn.build_pq_lists(base, centroids, book, 2)
    exact = {tuple(r)[:3]: r["dist"] for r in knn.knn_exact(queries, base, 6).collect()}
    for block in (50_000, 5):
        monkeypatch.setattr(knn, "BASE_BLOCK", block)
        coded = {tuple(r)[:3]: r["dist"] for r in knn.knn_ivfpq(queries, lists, centroids, book, 6, 3, 2).collect()}
        assert coded.keys() == exact.keys() and all(coded[k] == pytest.approx(exact[k], abs=1e-8) for k in exact)


def test_refined_search_equals_searches_one_by_one(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = spark.createDataFrame([(7 * i, v.tolist()) for i, v in enumerate(np.repeat(rng.normal(size=(60, 8)), 2, axis=0))], "b_id long, vec array<double>")
    queries = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(12)], "q_id long, vec array<double>")
    cs = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(5)], "list_id long, centroid array<double>")
    book = spark.createDataFrame([(s, c, (rng.normal(size=4) * 2).tolist()) for s in range(2) for c in range(9)], "sub int, code long, centroid array<double>")
    lists = knn.build_pq_lists(base, cs, book, 2, residuals=True)
    for block in (50_000, 7):
        monkeypatch.setattr(knn, "BASE_BLOCK", block)
        found = {tuple(r)[:3] for r in knn.ivfpq_refined(queries, lists, cs, book, 9, 4, [1, 2, 5], 2).collect()}
        own = {(n, r["q_id"], r["b_id"]) for n in (1, 2, 5) for r in knn.reranked(knn.knn_ivfpq(queries, lists, cs, book, 9, n, 2), queries, base, 4).collect()}
        assert found == own and len(found) > 100


def test_recall_is_measured_by_one_search(spark):
    from kinmap.plans import catalog

    plan = catalog.queries()["ivfpq_recall"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().logical().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1


def test_nearest_in_parts_with_copies_and_bad_values():
    rng = np.random.default_rng(2)
    b, q, ids = np.repeat(rng.normal(size=(9000, 5)) + 100, 2, axis=0), rng.normal(size=(600, 5)) + 100, rng.permutation(18_000)
    d = np.round(np.sqrt(((q[:, None] - b[None]) ** 2).sum(axis=2)), knn.DIGITS)
    expected = np.concatenate([ids[np.lexsort((ids, x))[:7]] for x in d])
    assert (knn.nearest(q, b, ids, 7)[1] == expected).all()
    best = knn.Best(7)
    for part in np.array_split(np.arange(18_000), 5):
        best.add(*knn.nearest(q, b[part], ids[part], 7, best.within(len(q))))
    assert (best.ids == expected).all()
    bad = np.concatenate((b, np.full((1, 5), np.nan), np.full((1, 5), np.inf)))
    assert (knn.nearest(q, bad, np.append(ids, (18_000, 18_001)), 7)[1] == expected).all()


def test_trained_index_finds_the_neighbours(spark):
    from kinmap.plans import catalog

    recall = {r["nprobe"]: r["recall"] for r in catalog.queries()["ivfpq_recall"](spark, "/root/testdata/sf0.001").collect()}
    assert recall[2] < recall[4] < recall[8] and recall[8] >= 0.9
    plain = {r["nprobe"]: r["recall"] for r in catalog.queries()["recall_at_k"](spark, "/root/testdata/sf0.001").collect()}
    assert plain[9] >= 0.9


def test_index_of_images_finds_the_moved_one(spark, tmp_path):
    pictures = {i: picture(i) for i in range(6)}
    found = index.index_images(as_rows(spark, pictures), str(tmp_path / "ix"), lists=4, subs=8, codes=64, detector="SURF4")
    probes = {50: np.roll(pictures[2], (3, 5), axis=(0, 1)), 51: pictures[4][::-1]}
    points = features.extract_features(as_rows(spark, probes), "SURF4").filter("vec IS NOT NULL")
    queries = points.select(F.col("image_id").alias("probe_id"), (F.col("image_id") * 100_000 + F.col("kp_idx")).alias("q_id"), "vec")
    best = {r["probe_id"]: r["name"] for r in found.rank_images(queries, 5, 4, 1).collect()}
    assert best[50] == "p2.png"
    assert found.table("lists").count() == found.table("vectors").count()


# images


def test_measures_of_a_moved_copy():
    a = picture(1)
    b = np.roll(a, (4, 7), axis=(0, 1))
    (pa_, va), (pb, vb) = features.masked_surf(a, scaled=False), features.masked_surf(b, scaled=False)
    got = adjacency.measures(a, pa_[:, :2], va, b, pb[:, :2], vb)
    other = picture(2)
    po, vo = features.masked_surf(other, scaled=False)
    unlike = adjacency.measures(a, pa_[:, :2], va, other, po[:, :2], vo)
    same = adjacency.measures(a, pa_[:, :2], va, a, pa_[:, :2], va)
    assert got["kp"] >= 10 and same["kp"] == len(pa_) and same["mse_out"] < 1 and same["mi_out"] > got["mi_out"] > 0.5
    assert unlike is None or unlike["kp"] < got["kp"] / 2
    assert adjacency.measures(a, pa_[:3, :2], va[:3], b, pb[:, :2], vb) is None
    forth = adjacency.warped_both_ways(a, pa_[:8, :2], b, pa_[:8, :2] + [7, 4])
    assert np.allclose(forth[1], pa_[:8, :2] + [7, 4], atol=0.1) and np.allclose(forth[3], pa_[:8, :2], atol=0.1)


def test_detector_policies():
    flat = np.zeros((70, 140))
    points = features._detectors["SURF"](flat)
    assert len(points) == 35 * 35 and set(points[:, 2]) == {4.0} and len(np.unique(points[:, :2], axis=0)) == 35 * 35
    assert len(features.topped_up(flat, np.zeros((0, 6)), most=800)) == 400
    assert len(features.topped_up(flat, np.zeros((600, 6)))) == 600
    rng = np.random.default_rng(1)
    many = np.c_[rng.uniform(0, 300, (200, 2)), rng.uniform(5, 30, 200), np.zeros((200, 3))]
    kept = features.without_collisions(many, top=5, most=60)
    assert kept[:5].tolist() == many[:5].tolist()
    for i in range(5, len(kept)):
        apart = np.hypot(*(kept[:i, :2] - kept[i, :2]).T)
        assert apart.min() > (kept[apart.argmin(), 2] + kept[i, 2]) / 2
    bordered = np.pad(picture(3, 60), 20)
    inside, _ = features.masked_surf(bordered, scaled=False)
    assert len(inside) and (inside[:, :2] >= 19).all() and (inside[:, :2] <= 80).all()
    wide = masks.resized(picture(4), 200, 1024)
    assert features.masked_surf(wide)[0][:, 0].max() > 512


def test_uniform_patterns():
    level = np.full((9, 9), 7.0)
    assert (features.uniform_patterns(level, 8, 2)[3:6, 3:6] == 8).all()
    half = np.tile(np.where(np.arange(11) < 5, 0.0, 9.0), (11, 1))
    assert features.uniform_patterns(half, 8, 1)[5, 5] in (3, 5)  # an arc
    checks = np.indices((9, 9)).sum(axis=0) % 2 * 9.0
    assert features.uniform_patterns(checks, 8, 1)[4, 4] in (8, 9)
    rows = features.local_binary_patterns(picture(5), np.array([[50.0, 50, 12, 0, 0, 0]]))
    assert rows.shape == (1, 64) and rows.sum() == pytest.approx(1)


def test_upside_down_and_smaller(spark):
    own = as_rows(spark, {1: picture(6)})
    plain, turned = (features.extract_features(own, "SURF4", flip=f).orderBy("kp_idx").collect() for f in (False, True))
    assert {(round(r["x"]), 109 - round(r["y"])) for r in plain} >= {(round(r["x"]), round(r["y"])) for r in turned[:20]}
    assert features.shrunk(np.zeros((2000, 3000))).shape == (1176, 1764) and features.shrunk(np.zeros((10, 10))).shape == (10, 10)


def test_extraction_is_resumed(spark, tmp_path):
    folder = str(tmp_path / "x")
    broken = spark.createDataFrame([(9, "bad", 5, 5, 1, bytearray(b"short"))], "image_id long, name string, height int, width int, channels int, data binary")
    first = features.extract_pending(as_rows(spark, {1: picture(1)}).unionByName(broken), folder, "a", detector="SURF4")
    assert {r["name"]: r["status"] for r in first.collect()} == {"p1.png": "completed", "bad": "unable"}
    both = as_rows(spark, {1: picture(1), 2: picture(2)}).unionByName(broken)
    second = features.extract_pending(both, folder, "b", detector="SURF4")
    assert [r["name"] for r in second.collect()] == ["p2.png"]
    assert {r["image_id"] for r in features.read_features(spark, folder).select("image_id").distinct().collect()} == {1, 2}
    assert features.extract_pending(both, folder, "a", detector="SURF4").count() == 0
    assert features.merged_ledgers(spark, folder).count() == 3


def test_png_files_are_read_back(spark, tmp_path):
    gray, colour = picture(7, 33).astype(np.uint8), np.random.default_rng(1).integers(0, 255, (9, 13, 3)).astype(np.uint8)
    rows = [(1, 33, 33, 1, bytearray(gray.tobytes())), (2, 9, 13, 3, bytearray(colour.tobytes())), (3, -1, -1, -1, bytearray(b""))]
    done = images.convert_to_png(spark.createDataFrame(rows, "image_id long, height int, width int, channels int, data binary"), f"file://{tmp_path}/png").collect()
    assert {r["image_id"]: (r["file"], r["error"] is None) for r in done} == {1: ("1.png", True), 2: ("2.png", True), 3: (None, False)}
    back = {r["name"].rpartition("/")[2]: r for r in images.read_images(spark, f"{tmp_path}/png").collect()}
    assert bytes(back["1.png"]["data"]) == gray.tobytes() and bytes(back["2.png"]["data"]) == colour.tobytes()
    mask = spark.createDataFrame([(1, 2, 3, bytearray(range(6))), (2, 2, 3, None)], "probe long, height int, width int, mask binary")
    out = {r["probe"]: json.loads(r["json"]) for r in images.localization(mask, "probe", 0.5).collect()}
    assert out[2] == {"mask_threshold": 0.5} and out[1].keys() == {"mask", "mask_threshold"}
    assert zlib.crc32(images.encode_png(1, 1, 1, b"\0")) and images.encode_png(1, 1, 1, b"\0").startswith(b"\x89PNG")


def test_objects_of_the_second_tier(spark):
    probe = picture(8, 160)
    edited = probe.copy()
    edited[60:100, 50:95] = picture(9, 160)[60:100, 50:95]
    rows = [(1, k, 160, 160, bytearray(probe.astype(np.uint8).tobytes()), bytearray(r.astype(np.uint8).tobytes())) for k, r in ((5, edited), (6, probe))]
    xs, ys = [10.0, 150.0, 10.0, 150.0, 80.0, 30.0], [10.0, 10.0, 150.0, 150.0, 20.0, 120.0]
    pairs = spark.createDataFrame([(*r, xs, ys, xs, ys) for r in rows], "probe_id long, result_id long, probe_height int, result_height int, probe binary, result binary, px array<double>, py array<double>, rx array<double>, ry array<double>")
    found = tier2.change_masks(pairs).select("result_id", "modified", "mask").collect()
    assert {r["result_id"]: r["modified"] for r in found} == {5: True, 6: False}
    mask = np.zeros((300, 300), bool)
    mask[50:200, 40:200] = True
    mask[0:5, 0:5] = True
    assert tier2.objects_of(mask) == [(40, 50, 160, 150)] and tier2.objects_of(np.ones((300, 300), bool)) == []
    image = picture(10, 300)
    got = tier2.object_features(image, [(5, image, mask), (6, image, mask)])
    assert {(g[0], g[2]) for g in got} == {(5, "q"), (5, "r"), (6, "r")}  # the second finds the probe covered
    assert tier2.second_tier_queries(pairs).columns == ["probe_id", "result_id", "object_id", "side", "q", "vec"]


def test_maps_in_order_of_their_condition(spark):
    rows = spark.createDataFrame([(1, 5, 0.3), (1, 6, 0.9), (1, 7, 0.05), (1, 4, 0.3), (2, 1, 0.2)], "probe_id long, result_id long, rcond double")
    assert sorted((r["probe_id"], r["pos"], r["result_id"]) for r in tier2.by_condition(rows).collect()) == [(1, 1, 6), (1, 2, 4), (1, 3, 5), (2, 1, 1)]


# the rest


def test_references_of_any_depth(spark):
    deep = {"a": [{"b": {"c": {"$resource": "r1"}}}, {"$indirect": "r2"}], "d": {"$resource": 5}, "e": {"$resource": "r1", "more": 1}}
    tree = spark.createDataFrame([(1, json.dumps(deep)), (2, "no json"), (3, None), (4, '{"$resource":"r1"}')], "k long, t string")
    found = sorted((r["k"], r["key"], r["ref"], r["kind"]) for r in catalogs.references(tree, "k", "t").collect())
    assert found == [(1, "a.0.b.c", "r1", "resource"), (1, "a.1", "r2", "indirect"), (4, "", "r1", "resource")]
    out = {r["k"]: r["json"] for r in catalogs.replace_references(tree, "k", "t", spark.createDataFrame([("r1", "é")], "ref string, content string")).collect()}
    assert json.loads(out[1])["a"] == [{"b": {"c": "é"}}, {"$indirect": "r2"}] and out[2] == "no json" and out[3] is None and out[4] == '"é"'


def test_votes_in_sql(spark):
    sql.register(spark)
    got = spark.sql("SELECT g, vote_tally(p) AS v FROM VALUES (1, 1L), (1, 2L), (1, 4L), (2, 5L), (2, NULL) AS t(g, p) GROUP BY g ORDER BY g").collect()
    assert [(r["g"], r["v"]) for r in got] == [(1, 1.75), (2, 0.2)]


def test_actions_end_in_time(spark):
    assert ingest.within(spark, 60, lambda: spark.range(5).count()) == 5
    began = time.time()
    slow = F.udf(lambda x: time.sleep(30) or x, "long")
    with pytest.raises(Exception):
        ingest.within(spark, 3, lambda: spark.range(2).select(slow("id")).collect())
    assert time.time() - began < 25


def test_affine_and_warp_agree():
    m = np.array([[1.0, 0.1, 3], [-0.1, 1.0, 5]])
    image = picture(11, 60)
    there = geometry.warp(image, m, 60, 60)
    back = geometry.warp(there, np.linalg.inv(np.r_[m, [[0, 0, 1]]]), 60, 60)
    assert np.abs(back - image)[20:40, 20:40].mean() < 12
