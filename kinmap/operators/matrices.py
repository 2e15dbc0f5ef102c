"""Adjacency matrices as coordinate tables (probe, i, j, value): normalising, joining, near-duplicate gates, strongest links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def min_max(cells: DataFrame, by: list[str], dissimilar: bool) -> DataFrame:
    """``by``, i, j, norm of the cells that are there; the matrix is dense, so of a similarity its absent cells (0: the diagonal at least)
    take part in the range. Of a dissimilarity the sign is turned and absent cells (-1) take no part. Absent cells, and all if the
    range is empty, become -1."""
    value = -F.col("value") if dissimilar else F.col("value")
    absent = F.col("value") == (-1.0 if dissimilar else 0.0)
    all_ = Window.partitionBy(*by)
    low, high = (f(F.when(~absent, value)).over(all_) for f in (F.min, F.max))
    if not dissimilar:
        low, high = F.least(low, F.lit(0.0)), F.greatest(high, F.lit(0.0))  # least and greatest skip nulls
    ranged = cells.withColumn("_low", low).withColumn("_high", high)
    norm = F.when(absent | F.col("_low").isNull() | (F.col("_high") == F.col("_low")), -1.0).otherwise((value - F.col("_low")) / (F.col("_high") - F.col("_low")))
    return ranged.select(*by, "i", "j", F.round(norm, 6).alias("norm"))


def join_matrices(norms: DataFrame, by: list[str], n: int) -> DataFrame:
    """Mean of ``n`` normalised matrices, cell by cell; a cell that is -1 in any of them is -1 / n."""
    poisoned = F.max(F.col("norm") == -1.0)
    return norms.groupBy(*by, "i", "j").agg((F.when(poisoned, -1.0).otherwise(F.sum("norm")) / n).alias("value"))


def near_duplicate_gate(sets: DataFrame, counts: DataFrame, targets: DataFrame) -> DataFrame:
    """set_id, target, mean, std, outside, passes: whether ``targets(set_id, target)`` has about as many matches with the members of
    ``sets(set_id, node)`` as they have with each other. ``counts(i, j, kp)`` holds both directions; an absent pair counts 0. Sets of
    one or two pass everything."""
    a, b = sets.select("set_id", F.col("node").alias("i")), sets.select("set_id", F.col("node").alias("j"))
    inner = a.join(b, "set_id").filter("i < j").join(counts, ["i", "j"], "left").fillna({"kp": 0})
    stats = inner.groupBy("set_id").agg(F.avg("kp").alias("mean"), F.stddev_pop("kp").alias("std"))
    size = sets.groupBy("set_id").agg(F.count("*").alias("size"))
    linked = targets.join(a, "set_id").join(counts.withColumnRenamed("j", "target"), ["i", "target"], "left").fillna({"kp": 0}).join(stats, "set_id", "left").join(size, "set_id")
    out = (F.col("kp") < F.col("mean") - F.col("std")) | (F.col("kp") > F.col("mean") + F.col("std"))
    seen = linked.groupBy("set_id", "target", "size").agg(F.first("mean").alias("mean"), F.first("std").alias("std"), F.sum(F.coalesce(out.cast("long"), F.lit(0))).alias("outside"))
    passes = (F.col("size") <= 2) | (F.col("outside") <= F.col("size") / 2)
    return seen.select("set_id", "target", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "outside", passes.alias("passes"))


def strongest_link(cells: DataFrame, by: list[str]) -> DataFrame:
    """``by``, node, best, direction, kp: for each node the neighbour with most matches, then the larger mutual information in either
    direction, then the smaller id. Candidates have 4 matches or more, some mutual information, and 10 matches or a mean distance
    under 0.1. ``cells``: i, j, kp, dist, mi_out (i to j), mi_in. Direction 0 leads out of the node, 1 into it, -1 is undecided."""
    good = cells.filter("(mi_out <> 0 OR mi_in <> 0) AND kp >= 4 AND (kp >= 10 OR dist < 0.1)")
    order = Window.partitionBy(*by, "i").orderBy(F.col("kp").desc(), F.greatest("mi_out", "mi_in").desc(), "j")
    way = F.when(F.col("mi_out") > F.col("mi_in"), 0).when(F.col("mi_out") < F.col("mi_in"), 1).otherwise(-1).cast("long")
    return good.withColumn("r", F.row_number().over(order)).filter("r = 1").select(*by, F.col("i").alias("node"), F.col("j").alias("best"), way.alias("direction"), "kp")
