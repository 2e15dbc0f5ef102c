"""Connected components of an edge table: spanning forests inside tasks, merged vertex by vertex."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmap.llm.common import saved, skew_join

_ROUNDS = 60
#: Corrections that are broadcast (16 bytes each); more are joined by shuffle, hot ones apart.
BROADCAST_ROWS = 200_000


def labels_of(n: int, u: np.ndarray, v: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest index in each index's component under the links (u, v), joined to the components in ``labels``."""
    lab = np.arange(n) if labels is None else labels
    while True:
        a, b = lab[u], lab[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        differ = low != high
        if not differ.any():
            return lab
        np.minimum.at(lab, high[differ], low[differ])
        while (jumped := lab[lab]).tobytes() != lab.tobytes():
            lab = jumped


def _held(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    return tuple(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's edges as links of each vertex to the smallest it is joined to."""
    u, v = _held(batches)
    names, codes = np.unique(np.concatenate((u, v)), return_inverse=True)
    labels = labels_of(len(names), codes[: len(u)], codes[len(u) :])
    moved = np.flatnonzero(labels != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[labels[moved]])], names=["u", "v"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all links of a vertex u the smallest, and for each other one, ``more``, a link of its end to the smallest."""
    u, v = _held(batches)
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    first = np.ones(len(u), bool)
    first[1:] = u[1:] != u[:-1]
    least = v[np.maximum.accumulate(np.where(first, np.arange(len(u)), 0))] if len(u) else v
    more = np.unique(np.stack((v, least), axis=1)[v != least], axis=0)
    rows = np.concatenate((u[first], more[:, 0])), np.concatenate((v[first], more[:, 1]))
    flags = np.arange(len(rows[0])) >= first.sum()
    yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(flags)], names=["u", "v", "more"])


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, root) for every vertex of ``edges(u, v)`` (longs) that is not itself the smallest of its component, the root.

    Self links and repeated or mirrored edges are harmless; an empty table gives an empty result. A round is one shuffle of links by
    their larger end: tasks first turn what they hold into a forest, so no vertex has more links than there are tasks, however many
    edges it has. Links whose end has a smaller end are then moved there. Every round is a written table; rounds end when no vertex
    has two links and every link ends at a root.
    """
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    for _ in range(_ROUNDS):
        step = saved(now.mapInArrow(_forest, "u long, v long").repartition("u").mapInArrow(_merged, "u long, v long, more boolean"), "round")
        known = step.filter("NOT more").select("u", "v")
        ends = step.groupBy("v").agg(F.count("*").alias("n"))
        moves = saved(ends.join(known.select(F.col("u").alias("v"), F.col("v").alias("to")), "v"), "moves")
        size = moves.agg(F.count("*").alias("rows"), F.sum("n").alias("links")).first()
        if not size["rows"] and step.filter("more").isEmpty():
            return known.select(F.col("u").alias("id"), F.col("v").alias("root"))
        rows = step.select("u", "v")
        if not size["rows"]:
            now = rows
            continue
        moved = rows.join(F.broadcast(moves.drop("n")), "v", "left") if size["rows"] <= BROADCAST_ROWS else skew_join(rows, moves, "v", "n", size["links"])
        now = moved.select("u", F.coalesce("to", "v").alias("v"))
    raise RuntimeError("components did not settle")
