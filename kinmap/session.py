"""The session that tests, bench and examples use; a cluster brings its own."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, as in tests, a temporary folder serves, but
    only while all tasks run on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append(f"file://{tempfile.mkdtemp(prefix='kinmap-')}")
    return _local[0]


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed and written to the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    builder = SparkSession.builder.master(f"local[{cores}]").appName("kinmap")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
