"""Files, names and lists: what the pipeline reads, numbers, hands out, resumes and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinmap.functions import scalars
from kinmap.operators.ordering import dense_ids, running_sum

SKIPPED_DIRECTORY = r"(^|/)[^/]*thumb/"


def listed_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """name, path: of files with the same base name the first path; folders whose name ends in thumb are skipped."""
    rows = paths.filter(~F.col(path).rlike(SKIPPED_DIRECTORY)).select(scalars.basename(path).alias("name"), F.col(path).alias("path"))
    return rows.groupBy("name").agg(F.min("path").alias("path"))


def feature_offsets(files: DataFrame, name: str, size: str, dims: int, header: int = 80) -> DataFrame:
    """name, n, before, upto: features of a file of ``size`` bytes (4 for each dimension, after a header), and running totals."""
    n = F.floor((F.col(size) - header) / (4 * dims)).cast("long")
    placed = running_sum(files.select(F.col(name).alias("name"), n.alias("n")), "name", ["n"], F.col("n"), "before")
    return placed.select("name", "n", "before", (F.col("before") + F.col("n")).alias("upto"))


def image_ids(names: DataFrame, name: str) -> DataFrame:
    """name, image_id: gapless from 0, by name."""
    return dense_ids(names.select(F.col(name).alias("name")).distinct(), "name", [], "image_id")


def sampled_files(files: DataFrame, name: str, train_size: int, per_file: int, seed: int = 42) -> DataFrame:
    """The ``train_size / per_file`` files with the least hash of name and seed: a sample that every run repeats."""
    return files.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(name).cast("string"))), name).limit(train_size // per_file)


def strongest(points: DataFrame, by: list[str], k: int, response: str = "response", tie: str = "kp_idx") -> DataFrame:
    """The k keypoints of each image with the largest response."""
    return points.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(response).desc(), tie))).filter(F.col("_r") <= k).drop("_r")


def pending(files: DataFrame, ledgers: DataFrame, on: str) -> DataFrame:
    """Files that no machine's ledger (completed or unable) names."""
    return files.join(ledgers.filter("status IN ('completed', 'unable')").select(on).distinct(), on, "left_anti")


def manifest(probes: DataFrame, results: DataFrame, probe: str) -> DataFrame:
    """A line for each probe: processed ones name their file, with confidence 1."""
    done = results.select(probe).distinct().withColumn("_done", F.lit(True))
    rows = probes.select(probe).distinct().join(done, probe, "left")
    file = F.when(F.col("_done"), F.concat(F.lit("json/"), F.col(probe), F.lit(".json"))).otherwise("")
    return rows.select(
        F.col(probe).alias("ProvenanceProbeFileID"), F.lit(1.0).alias("ConfidenceScore"), file.alias("ProvenanceOutputFileName"), F.when(F.col("_done"), "Processed").otherwise("NonProcessed").alias("ProvenanceProbeStatus")
    )


def result_json(ranked: DataFrame, by: str) -> DataFrame:
    """``by``, json: a filtering result, nodes numbered from "1" by position, no links."""
    node = F.struct("pos", F.struct(F.col("pos").cast("string").alias("id"), F.concat(F.lit("world/"), F.col("name")).alias("file"), scalars.stem("name").alias("fileid"), F.col("score").alias("nodeConfidenceScore")).alias("node"))
    nodes = F.transform(F.array_sort(F.collect_list(node)), lambda x: x["node"])
    return ranked.groupBy(by).agg(nodes.alias("nodes")).select(by, F.to_json(F.struct(F.lit(True).alias("directed"), "nodes", F.expr("cast(array() AS array<int>)").alias("links"))).alias("json"))


RESULT_SCHEMA = "directed boolean, nodes array<struct<id:string,file:string,fileid:string,nodeConfidenceScore:double>>, links array<struct<source:int,target:int,relationshipConfidenceScore:double>>"


def result_nodes(results: DataFrame, by: str, json: str = "json") -> DataFrame:
    """``by``, pos, file, fileid, score: nodes of result JSON."""
    parsed = results.select(by, F.from_json(json, RESULT_SCHEMA).alias("r")).select(by, F.explode("r.nodes").alias("n"))
    return parsed.select(by, F.col("n.id").try_cast("long").alias("pos"), F.col("n.file").alias("file"), F.col("n.fileid").alias("fileid"), F.col("n.nodeConfidenceScore").alias("score"))


def folds(ranked: DataFrame, by: str, n: int) -> DataFrame:
    """Positions 2 to ``n`` + 1 of each ranking: the first is the probe itself."""
    return ranked.filter(F.col("pos").between(2, n + 1)).withColumn("fold_id", F.substring(F.col(by).cast("string"), 1, 32))


def find_by_prefix(ids: DataFrame, files: DataFrame) -> DataFrame:
    """id, path: the first path whose base name begins with the id. Names are cut to each length that ids have (a few, and never more than
    a name's), so the join is an equi-join."""
    lengths = sorted(r[0] for r in ids.select(F.length("id")).distinct().collect() if r[0])
    name = scalars.basename("path")
    keyed = files.select("path", F.explode(F.array(*(F.when(F.length(name) >= n, F.substring(name, 1, n)) for n in lengths))).alias("_key") if lengths else F.lit(None).cast("string").alias("_key"))
    return ids.distinct().join(keyed, F.col("id") == F.col("_key")).groupBy("id").agg(F.min("path").alias("path"))


_REFERENCES = ("$resource", "$indirect")


def _walk(node, path: str, found: list) -> None:
    """Entries of the tree that are references, with their paths, before what lies deeper."""
    if isinstance(node, dict):
        if len(node) == 1 and (kind := next(iter(node))) in _REFERENCES and isinstance(node[kind], str):
            found.append((path, node[kind], kind[1:]))
            return
        for name, child in node.items():
            _walk(child, f"{path}.{name}" if path else name, found)
    elif isinstance(node, list):
        for i, child in enumerate(node):
            _walk(child, f"{path}.{i}" if path else str(i), found)


def references(tree: DataFrame, by: str, json: str) -> DataFrame:
    """``by``, key, ref, kind: what refers to a resource ({"$resource": ..} or {"$indirect": ..}) in JSON trees, at any depth; key is the path
    to it. Text that is no JSON refers to nothing."""
    import json as parser
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            found: list[tuple[str, str, str]] = []
            for i, text in enumerate(batch.column("json").to_pylist()):
                try:
                    _walk(parser.loads(text or "null"), "", found)
                except (ValueError, RecursionError):
                    del found[len(rows) :]
                rows += [i] * (len(found) - len(rows))
            columns = [batch.column("by").take(pa.array(rows, pa.int64())), *(pa.array([f[k] for f in found], pa.string()) for k in range(3))]
            yield pa.RecordBatch.from_arrays(columns, names=[by, "key", "ref", "kind"])

    kind = tree.schema[by].dataType.simpleString()
    return tree.select(F.col(by).alias("by"), F.col(json).alias("json")).mapInArrow(run, f"{by} {kind}, key string, ref string, kind string")


def replace_references(tree: DataFrame, by: str, json: str, resources: DataFrame) -> DataFrame:
    """``by``, json: the trees (one for each ``by``) with references to ``resources(ref, content)`` replaced by their content; other references stay.
    References meet resources in a join, so no row holds more than what its own tree refers to. Keys come out sorted."""
    import json as parser
    from collections.abc import Iterator

    import pyarrow as pa

    def rebuilt(node, known: dict):
        if isinstance(node, dict):
            if len(node) == 1 and (kind := next(iter(node))) in _REFERENCES and node[kind] in known:
                return known[node[kind]]
            return {k: rebuilt(v, known) for k, v in node.items()}
        return [rebuilt(x, known) for x in node] if isinstance(node, list) else node

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, pairs in zip(batch.column("json").to_pylist(), batch.column("known").to_pylist()):
                known = {p["ref"]: p["content"] for p in pairs or ()}
                try:
                    out.append(None if text is None else parser.dumps(rebuilt(parser.loads(text), known), sort_keys=True, separators=(",", ":"), ensure_ascii=False))
                except (ValueError, RecursionError):
                    out.append(text)  # no tree, no references
            yield pa.RecordBatch.from_arrays([batch.column("by"), pa.array(out, pa.string())], names=[by, "json"])

    wanted = references(tree, by, json).select(by, "ref").distinct().join(resources, "ref")
    known = wanted.groupBy(by).agg(F.collect_list(F.struct("ref", "content")).alias("known"))
    rows = tree.join(known, by, "left").select(F.col(by).alias("by"), F.col(json).alias("json"), "known")
    kind = tree.schema[by].dataType.simpleString()
    return rows.mapInArrow(run, f"{by} {kind}, json string")

