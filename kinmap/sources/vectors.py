"""Vector files (.npy, .fvecs, .ivecs, .bvecs) and serialised descriptor sets, read in ranges and in Arrow batches."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Element types of the formats whose rows begin with their length (int32).
KINDS = {"fvecs": ("<f4", 4), "ivecs": ("<i4", 4), "bvecs": ("u1", 1)}
RANGE_BYTES = 32 << 20


def encode_set(vectors: np.ndarray) -> bytes:
    """float32 values row by row, then the number of rows and columns as float32."""
    n, d = vectors.shape if vectors.size else (0, 0)
    return np.concatenate((np.asarray(vectors, "<f4").ravel(), np.array([n, d], "<f4"))).tobytes()


def decode_set(data: bytes) -> np.ndarray:
    flat = np.frombuffer(data, "<f4")
    n, d = int(flat[-2]), int(flat[-1])
    return flat[:-2].reshape(n, d)


def parse_npy(data: bytes) -> np.ndarray:
    """An array file; pickled objects are refused."""
    return np.load(io.BytesIO(data), allow_pickle=False)


def explode_sets(files: DataFrame, key: str, content: str, kind: str = "set") -> DataFrame:
    """``key``, kp_idx, vec, error: a row for each descriptor of each file, or one with an error for a file that cannot be read."""
    parse = {"set": decode_set, "npy": parse_npy}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("k").to_pylist(), batch.column("c").to_pylist()):
                try:
                    m = np.atleast_2d(parse(data)).astype(np.float64)
                    vecs, error = list(m) if m.size else [], None
                except Exception as x:
                    vecs, error = [None], repr(x)
                n = len(vecs)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(vecs, pa.list_(pa.float64())), pa.array([error] * n, pa.string())], names=[key, "kp_idx", "vec", "error"])

    return files.select(F.col(key).alias("k"), F.col(content).alias("c")).mapInArrow(run, f"{key} string, kp_idx long, vec array<double>, error string")


#: Matrices of an adjacency archive in their order, and the value of a cell that is not there.
MATRICES = {"kp": 0.0, "dist": -1.0, "mi": 0.0, "mse": -1.0}


def matrix_archives(cells: DataFrame, by: str) -> DataFrame:
    """``by``, content: for each probe an .npz archive of its matrices (arr_0, ...) from cells (i, j and ``MATRICES``), nodes numbered from 0. A probe
    has some hundred nodes at most."""

    def run(rows: pa.Table) -> pa.Table:
        i, j = (rows.column(c).to_numpy() for c in "ij")
        n = int(max(i.max(), j.max())) + 1
        arrays = []
        for name, absent in MATRICES.items():
            m = np.full((n, n), absent)
            m[i, j] = rows.column(name).to_numpy()
            arrays.append(m)
        held = io.BytesIO()
        np.savez(held, *arrays)
        return pa.table({by: rows.column(by)[:1], "content": pa.array([held.getvalue()], pa.binary())})

    kind = cells.schema[by].dataType.simpleString()
    return cells.select(by, "i", "j", *(F.col(m).cast("double").alias(m) for m in MATRICES)).groupBy(by).applyInArrow(run, f"{by} {kind}, content binary")


def explode_archives(files: DataFrame, by: str, content: str = "content") -> DataFrame:
    """``by``, i, j and ``MATRICES`` from .npz archives: the cells in which any matrix has a value. Pickled objects are refused."""
    kind = files.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data in enumerate(batch.column("c").to_pylist()):
                held = np.load(io.BytesIO(data), allow_pickle=False)
                arrays = [held[f"arr_{k}"] for k in range(len(MATRICES))]
                i, j = np.nonzero(np.any([m != absent for m, absent in zip(arrays, MATRICES.values())], axis=0))
                own = batch.column("k").take(pa.array([at] * len(i), pa.int64()))
                yield pa.RecordBatch.from_arrays([own, pa.array(i), pa.array(j), *(pa.array(m[i, j].astype(float)) for m in arrays)], names=[by, "i", "j", *MATRICES])

    schema = f"{by} {kind}, i long, j long, " + ", ".join(f"{m} double" for m in MATRICES)
    return files.select(F.col(by).alias("k"), F.col(content).alias("c")).mapInArrow(run, schema)


class VectorSource(DataSource):
    """``spark.read.format("vecs")``, option path: (vec_id, vec) of an .fvecs, .ivecs or .bvecs file, in byte ranges."""

    @classmethod
    def name(cls) -> str:
        return "vecs"

    def schema(self) -> str:
        return "vec_id bigint, vec array<double>"

    def reader(self, schema) -> VectorReader:
        return VectorReader(self.options["path"])


class Range(InputPartition):
    def __init__(self, first: int, count: int) -> None:
        self.first, self.count = first, count


class VectorReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        from pyarrow import fs

        self.uri = path if "://" in path else f"file://{path}"
        self.kind, self.width = KINDS[path.rpartition(".")[2]]
        system, where = fs.FileSystem.from_uri(self.uri)
        with system.open_input_file(where) as f:
            size = f.size()
            self.dims = int(np.frombuffer(f.read(4), "<i4")[0]) if size else 0
        self.row = 4 + self.dims * self.width
        if size % self.row if size else False:
            raise ValueError(f"{path} does not hold whole rows")
        self.rows = size // self.row if size else 0

    def partitions(self) -> list[Range]:
        step = max(1, RANGE_BYTES // max(self.row, 1))
        return [Range(a, min(step, self.rows - a)) for a in range(0, self.rows, step)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if not partition.count:
            return
        system, where = fs.FileSystem.from_uri(self.uri)
        with system.open_input_file(where) as f:
            f.seek(partition.first * self.row)
            raw = np.frombuffer(f.read(partition.count * self.row), np.uint8).reshape(partition.count, self.row)
        values = raw[:, 4:].copy().view(self.kind).astype(np.float64)
        offsets = pa.array(np.arange(partition.count + 1) * self.dims, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.first, partition.first + partition.count)), pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))], names=["vec_id", "vec"])


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(VectorSource)
    return spark.read.format("vecs").option("path", path).load()
