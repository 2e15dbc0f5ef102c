"""What the training-data operators share: the shared folder, saved tables, skew-safe joins, prefix sums and batches."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinmap.session import shared_folder

#: Text bytes that a Python worker handles at a time.
SLICE_BYTES = 2_000_000

#: What Spark hands to a Python worker at a time.
BATCH_BYTES, BATCH_ROWS = 6_000_000, 4_000

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; where that is unset, a local one if all runs on this machine,
    else an error."""
    return shared_folder(spark).rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; it is removed when the driver's Python ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    path = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    path = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path  # a URI for all readers
    if not _scratch:
        atexit.register(_clean)
    _scratch.append((spark, path))
    return path


def _clean() -> None:
    try:
        drop_scratch(0, len(_scratch))
    except Exception:  # the session may be gone
        return


def scratch_mark() -> int:
    """How many scratch paths there are, to tell those made later."""
    return len(_scratch)


def drop_scratch(since: int, upto: int) -> None:
    """Removes the tables at the scratch paths made between two marks; nothing may read them any more. The marks of later paths stay."""
    for i in range(since, upto):
        spark, path = _scratch[i]
        if path:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            _scratch[i] = spark, ""


def saved(df: DataFrame, tag: str, by: list[str] | None = None) -> DataFrame:
    """``df`` as a table written to the shared folder and read again: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    writer = df.write
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def skew_join(rows: DataFrame, groups: DataFrame, key: str, n: str, total: int, hot_parts: int = 500) -> DataFrame:
    """Left join of ``rows`` with ``groups`` (one row for each ``key``, which has ``n`` rows) that no hot key can slow down.

    Keys with more than ``total / hot_parts`` rows number fewer than ``hot_parts``, so they are broadcast; what remains is
    shuffled, and no key of it has more than that share of the rows. Keys must not be null.
    """
    least = max(total // hot_parts, 1)
    values = [c for c in groups.columns if c not in (key, n)]
    hot = F.broadcast(groups.filter(F.col(n) > least).select(key, *values, F.lit(True).alias("_hot")))
    cold = groups.filter(F.col(n) <= least).select(key, *values)
    marked = rows.join(hot, key, "left")
    done = marked.filter("_hot").drop("_hot")
    rest = rows.join(hot.select(key), key, "left_anti").join(cold.hint("merge"), key, "left")
    return done.unionByName(rest)


def ranged_sums(df: DataFrame, order: list[str], value: str, name: str, parts: int, path: str | None = None) -> DataFrame:
    """A saved table (at ``path``, if given) of ``df`` cut into ``parts`` ranges of about equal numbers of rows in order of ``order``
    (nulls first): adds ``part``, the range's number, and ``name``, the sum of ``value`` over the rows before this one in its range.

    Ranges are cut by all of ``order``, so that a run of one key may be many ranges; a range is one partition and one sorted file.
    Rows are shuffled once.
    """
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in order]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        before, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            own = pc.fill_null(batch.column(value), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = before + np.cumsum(own)
            columns = [*batch.columns, pa.array(np.full(len(own), part, np.int64)), pa.array(upto - own)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", name])
            before = int(upto[-1]) if len(upto) else before

    placed = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(add, f"{ddl}, part long, `{name}` long")
    if path is None:
        return saved(placed, "ranged")
    placed.write.parquet(path)
    return df.sparkSession.read.schema(placed.schema).parquet(path)


def prefix_sum(df: DataFrame, order: list[str], value: str, name: str, parts: int) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before this one in order of ``order`` (nulls first). The ranges' sums, a row
    each, are added up apart; no task sees more than a range or those sums."""
    ranged = ranged_sums(df, order, value, name, parts)
    sums = ranged.groupBy("part").agg(F.sum(value).alias("_sum"))
    before = sums.select("part", (F.sum("_sum").over(Window.orderBy("part")) - F.col("_sum")).alias("_before"))
    return ranged.join(before, "part").withColumn(name, F.col(name) + F.col("_before")).drop("part", "_before")


def bounded_batches(df: DataFrame, n_bytes: int = BATCH_BYTES) -> DataFrame:
    """``df``, with the session's Arrow batches bounded in bytes, so that long texts do not fill the executors' memory on either side. Plans
    are made when they run, so the limits stay set in the session; all operators use the same ones."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(n_bytes))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def release() -> None:
    """Hands what a Python worker has freed back to the system; allocators keep it otherwise, and workers stay for the next stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library only
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice has at most ``limit`` bytes in ``column``, or one row. At the end what was freed is
    released."""
    for batch in batches:
        sizes = batch.column(column)
        lengths = pc.fill_null(pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if held and held + n > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n + 64
        if begin < batch.num_rows:
            yield batch.slice(begin)
    release()


class Carried:
    """Columns that pass through a Python stage unread, under names of their own (k0, k1, ...), so that none can clash."""

    def __init__(self, df: DataFrame, keep: list[str]) -> None:
        self.keep, self.names = keep, [f"k{i}" for i in range(len(keep))]
        self.columns = [F.col(f"`{c}`").alias(n) for c, n in zip(keep, self.names)]
        self.ddl = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for c, n in zip(keep, self.names))
        self.restored = [F.col(n).alias(c) for c, n in zip(keep, self.names)]
