"""Pipe-separated indexes and manifests, rank files, journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORLD = "TaskID STRING, WorldFileID STRING, WorldFileName STRING, WorldWidth INT, WorldHeight INT"
PROBES = "TaskID STRING, ProvenanceProbeFileID STRING, ProvenanceProbeFileName STRING, ProvenanceProbeWidth INT, ProvenanceProbeHeight INT"


def read_index(spark: SparkSession, path: str, schema: str, name: str, folder: str) -> DataFrame:
    """An index with a header, and the path of each file; columns are found by their names in the header."""
    rows = spark.read.csv(path, sep="|", header=True)
    columns = [c.strip().split(" ") for c in schema.split(",")]
    typed = rows.select(*(F.trim(F.col(c)).try_cast(t).alias(c) for c, t in columns))
    return typed.withColumn("path", F.concat_ws("/", F.lit(folder), name))


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, sep="|", header=True, mode="overwrite", emptyValue="")


def read_ranks(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """probe, pos, name from lines ``probe,first,second,...``."""
    parts = spark.read.text(path).select(F.split("value", ",").alias("p"))
    rows = parts.select(F.col("p")[0].alias("probe"), F.posexplode(F.expr("slice(p, 2, greatest(size(p) - 1, 0))")).alias("pos", "name")).withColumn("pos", F.col("pos") + 1)
    return rows if n is None else rows.filter(F.col("pos") <= n)


def read_journals(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of journals: (journal, node, file) and (journal, source, target)."""
    schema = "nodes array<struct<file:string>>, links array<struct<source:bigint,target:bigint>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).withColumn("journal", F.input_file_name())
    nodes = rows.select("journal", F.posexplode("nodes").alias("node", "n")).select("journal", F.col("node").cast("long").alias("node"), "n.file")
    return nodes, rows.select("journal", F.explode("links").alias("l")).select("journal", "l.source", "l.target")
