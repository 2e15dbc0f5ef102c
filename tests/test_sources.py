"""Sources, sinks, training and streaming: round trips and properties."""

import json
import struct

import numpy as np
import pytest
from kinmap.functions import scalars
from kinmap.operators import catalogs, knn, ordering, training
from kinmap.sources import images, tables, vectors
from kinmap.streaming import ingest
from pyspark.sql import functions as F


def test_descriptor_sets_round_trip(spark):
    m = np.arange(12, dtype=np.float32).reshape(3, 4)
    assert (vectors.decode_set(vectors.encode_set(m)) == m).all()
    rows = [("a", bytearray(vectors.encode_set(m))), ("b", bytearray(vectors.encode_set(np.zeros((0, 4))))), ("c", bytearray(b"xx"))]
    out = vectors.explode_sets(spark.createDataFrame(rows, "name string, content binary"), "name", "content").collect()
    assert [(r["name"], r["kp_idx"]) for r in out if r["vec"]] == [("a", 0), ("a", 1), ("a", 2)]
    assert [r["name"] for r in out if r["error"]] == ["c"]


@pytest.mark.parametrize(("kind", "code", "width"), [("fvecs", "<f4", 4), ("ivecs", "<i4", 4), ("bvecs", "u1", 1)])
def test_vector_files(spark, tmp_path, monkeypatch, kind, code, width):
    m = np.arange(40).reshape(10, 4).astype(code)
    path = tmp_path / f"x.{kind}"
    path.write_bytes(b"".join(struct.pack("<i", 4) + r.tobytes() for r in m))
    out = sorted((r["vec_id"], r["vec"]) for r in vectors.read_vectors(spark, str(path)).collect())
    assert out == [(i, [float(x) for x in r]) for i, r in enumerate(m.tolist())]


def test_npy_refuses_pickles(spark, tmp_path):
    np.save(tmp_path / "good.npy", np.ones((2, 3), np.float32))
    np.save(tmp_path / "bad.npy", np.array([{"a": 1}], dtype=object), allow_pickle=True)
    files = images.read_binary(spark, str(tmp_path))
    out = vectors.explode_sets(files, "key", "content", "npy").collect()
    assert sum(r["vec"] == [1.0, 1.0, 1.0] for r in out) == 2 and sum(r["error"] is not None for r in out) == 1


def test_index_and_manifest(spark, tmp_path):
    (tmp_path / "world.csv").write_text("TaskID|WorldFileID|WorldFileName|WorldWidth|WorldHeight\nprovenance|ab|world/ab.jpg|10|20\nprovenance|cd|world/cd.png|x|5")
    rows = tables.read_index(spark, str(tmp_path / "world.csv"), tables.WORLD, "WorldFileName", "/data").orderBy("WorldFileID").collect()
    assert [(r["WorldHeight"], r["WorldWidth"], r["path"]) for r in rows] == [(20, 10, "/data/world/ab.jpg"), (5, None, "/data/world/cd.png")]
    probes = spark.createDataFrame([("p1",), ("p2",)], "probe string")
    lines = catalogs.manifest(probes, probes.filter("probe = 'p1'"), "probe")
    tables.write_manifest(lines.coalesce(1), str(tmp_path / "out"))
    text = sorted(line for f in (tmp_path / "out").glob("*.csv") for line in f.read_text().splitlines())
    assert "p1|1.0|json/p1.json|Processed" in text and "p2|1.0||NonProcessed" in text


def test_ranks_and_journals(spark, tmp_path):
    (tmp_path / "ranks.txt").write_text("p,a,b,c\nq\n")
    assert sorted((r["probe"], r["pos"], r["name"]) for r in tables.read_ranks(spark, str(tmp_path / "ranks.txt"), 2).collect()) == [("p", 1, "a"), ("p", 2, "b")]
    (tmp_path / "j.json").write_text(json.dumps({"nodes": [{"file": "x"}, {"file": "y"}], "links": [{"source": 0, "target": 1}]}))
    nodes, links = tables.read_journals(spark, str(tmp_path / "j.json"))
    assert nodes.count() == 2 and links.select("source", "target").collect() == [(0, 1)]


def test_read_images(spark, tmp_path):
    import zlib

    def png(width: int, height: int) -> bytes:
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        raw = b"".join(b"\0" + bytes([y * 9] * width) for y in range(height))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    (tmp_path / "a.png").write_bytes(png(7, 5))
    (tmp_path / "b.png").write_bytes(b"no image")
    out = images.read_images(spark, str(tmp_path)).orderBy("image_id").collect()
    assert [(r["height"], r["width"]) for r in out] == [(5, 7), (-1, -1)]


def test_running_sum_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 10)
    rows = [(f"k{i % 23:02d}", i) for i in range(100)] + [(None, 100)]
    out = ordering.running_sum(spark.createDataFrame(rows, "k string, v int").repartition(3), "k", ["v"], F.col("v"), "before").collect()
    expected, total = {}, 0
    for k, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        expected[(k, v)] = total
        total += v
    assert {(r["k"], r["v"]): r["before"] for r in out} == expected


def test_training(spark, tmp_path):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(400, 6)) * np.array([5, 3, 2, 1, 0.5, 0.1]) + 4
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, vec array<double>").repartition(3)
    mean, axes = training.principal_axes(rows, 3)
    assert np.allclose(mean, data.mean(axis=0)) and np.allclose(axes @ axes.T, np.eye(3))
    assert np.allclose(np.abs(np.diag(axes)), 1, atol=0.1)
    turned = training.principal_axes(rows, 3, rotate_seed=1)[1]
    assert np.allclose(turned @ turned.T, np.eye(3)) and not np.allclose(turned, axes)
    rotation = training.optimized_rotation(rows, 2, 8)
    assert np.allclose(rotation @ rotation.T, np.eye(6))
    cs, books = training.coarse_centroids(rows, 4), training.code_books(rows, 2, 4)
    assert training.most_lists(400) == 10 and training.coarse_centroids(rows, 10).count() == 10
    with pytest.raises(ValueError, match="39 training rows"):
        training.coarse_centroids(rows, 11)
    training.save_model(spark, str(tmp_path / "m"), mean, axes, cs, books)
    m2, a2, c2, b2 = training.load_model(spark, str(tmp_path / "m"))
    assert np.allclose(m2, mean) and np.allclose(a2, axes) and c2.count() == cs.count() and b2.count() == 8


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "b_id long, vec array<double>")
    cs = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(3)], "list_id long, centroid array<double>")
    source, lists, check = (str(tmp_path / n) for n in ("in", "lists", "check"))
    for half in (rows.filter("b_id < 30"), rows.filter("b_id >= 30")):
        half.repartition(2).write.mode("append").parquet(source)
        q = ingest.ingest(spark, source, lists, cs, check, files_per_batch=1)
        q.awaitTermination()
    streamed = sorted((r["b_id"], r["list_id"]) for r in ingest.read_lists(spark, lists).collect())
    batch = sorted((r["b_id"], r["list_id"]) for r in knn.build_lists(rows, cs).collect())
    assert streamed == batch
    merged = ingest.merge_lists(ingest.read_lists(spark, lists), knn.build_lists(rows, cs))
    assert merged.count() == 120


def test_scalars_on_odd_values(spark):
    df = spark.createDataFrame([("/a/b.JPG",), ("noext",), ("x.tar.gz",), (".hidden",), (None,)], "path string")
    out = df.select(scalars.stem("path").alias("s"), scalars.extension("path").alias("e"), scalars.is_image("path").alias("i")).collect()
    assert [(r["s"], r["e"]) for r in out] == [("b", "jpg"), ("noext", ""), ("x.tar", "gz"), (".hidden", "hidden"), (None, None)]


def test_copy_referenced(spark, tmp_path):
    for name in ("a.jpg", "b.jpg"):
        (tmp_path / "world").mkdir(exist_ok=True)
        (tmp_path / "world" / name).write_bytes(name.encode())
    rows = spark.createDataFrame([("world/a.jpg",), ("world/a.jpg",), ("world/c.jpg",)], "file string")
    out = dict(map(tuple, images.copy_referenced(rows, f"file://{tmp_path}", f"file://{tmp_path}/out").collect()))
    assert out == {"world/a.jpg": True, "world/c.jpg": False} and (tmp_path / "out/world/a.jpg").read_bytes() == b"a.jpg"
    assert not any(r["copied"] for r in images.copy_referenced(rows, f"file://{tmp_path}", f"file://{tmp_path}/out").collect())
