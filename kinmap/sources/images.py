"""Images and binary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmap.functions import scalars
from kinmap.operators.catalogs import image_ids


def read_binary(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """key, content, mimetype, length of files; content is only read if it is selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return files.select(F.col("path").alias("key"), "content", scalars.media_type("path").alias("mimetype"), "length")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """image_id, name, height, width, channels, data of the images in a folder; ids are gapless in order of names. Files that cannot be
    decoded keep their row, with channels -1 and empty data."""
    rows = spark.read.format("image").option("recursiveFileLookup", True).load(path).select("image.*")
    return rows.join(image_ids(rows, "origin"), F.col("origin") == F.col("name")).select("image_id", "name", "height", "width", F.col("nChannels").alias("channels"), "data")


def encode_png(height: int, width: int, channels: int, data: bytes) -> bytes:
    """A PNG file of gray (1 channel) or BGR pixels (3), rows unfiltered."""
    import struct
    import zlib

    import numpy as np

    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    pixels = pixels[:, :, ::-1] if channels == 3 else pixels[:, :, :1]
    rows = np.concatenate((np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)), axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def convert_to_png(images: DataFrame, target: str) -> DataFrame:
    """image_id, file, width, height, error: writes every decoded image to ``target``/<image_id>.png (a URI) where the tasks run; an image that
    could not be decoded gives an error instead. A repeated attempt writes the same file again."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                name, error = f"{r['image_id']}.png", None
                try:
                    system, path = fs.FileSystem.from_uri(f"{target}/{name}")
                    png = encode_png(r["height"], r["width"], r["channels"], r["data"])
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    with system.open_output_stream(path, compression=None) as f:
                        f.write(png)
                except Exception as x:
                    name, error = None, repr(x)
                done.append((r["image_id"], name, r["width"], r["height"], error))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=["image_id", "file", "width", "height", "error"])

    return images.select("image_id", "height", "width", "channels", "data").mapInArrow(run, "image_id long, file string, width int, height int, error string")


def localization(masks: DataFrame, by: str, threshold: float | None = None) -> DataFrame:
    """``by``, json: a localization of each mask (height, width and gray bytes in ``mask``; null: none) and of opted-out pixels (``optout``, if there
    is such a column): PNG files in base64, and the threshold, each only where it is given."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def png(height, width, data):  # noqa: ANN001, ANN202
        import base64

        return data.combine(height.combine(width, lambda h, w: (h, w)), lambda d, s: None if d is None else base64.b64encode(encode_png(*s, 1, d)).decode())

    parts = [png("height", "width", "mask").alias("mask"), F.lit(threshold).alias("mask_threshold")]
    if "optout" in masks.columns:
        parts.append(png("height", "width", "optout").alias("mask_optout"))
    return masks.select(by, F.to_json(F.struct(*parts)).alias("json"))


def copy_referenced(results: DataFrame, source: str, target: str, file: str = "file") -> DataFrame:
    """file, copied: copies every file that results name from ``source`` to ``target`` (URIs), once each; present and missing files are
    left out. Copies are made where the tasks run, to a temporary name that is then moved."""
    import uuid
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            done = []
            for name in batch.column("file").to_pylist():
                a, path = fs.FileSystem.from_uri(f"{source}/{name}")
                b, goal = fs.FileSystem.from_uri(f"{target}/{name}")
                wanted = a.get_file_info(path).type == fs.FileType.File and b.get_file_info(goal).type == fs.FileType.NotFound
                if wanted:
                    part = f"{goal}.{uuid.uuid4().hex}"
                    b.create_dir(goal.rpartition("/")[0], recursive=True)
                    fs.copy_files(path, part, source_filesystem=a, destination_filesystem=b)
                    b.move(part, goal)
                done.append(wanted)
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(done, pa.bool_())], names=["file", "copied"])

    return results.select(F.col(file).alias("file")).distinct().mapInArrow(run, "file string, copied boolean")
