"""Provenance graphs: cluster expansion, maximum spanning trees, chains of journals, and their JSON."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinmap.session import checkpointed


class Cluster:
    """Greedy growth of a directed graph over the images of one probe (node 0), from matrices of match counts, mean distances and
    (directed) mutual information."""

    def __init__(self, counts: np.ndarray, dists: np.ndarray, mutual: np.ndarray) -> None:
        self.counts, self.dists, self.mutual = counts, dists, mutual
        self.used: list[int] = []
        self.edges: list[tuple[int, int]] = []
        self.ahead = self.back = 0.0

    def strongest(self, node: int, avoid: list[int]) -> tuple[int, int, float, float]:
        """(neighbour or -1, direction, matches, mutual information). Nodes in order; more matches win, then more information."""
        best, way, kp, mi = -1, -1, 0.0, -1.0
        avoided = set(avoid)
        for i in np.flatnonzero(self.counts[node] >= 4).tolist():
            own, out, into = self.counts[node, i], self.mutual[node, i], self.mutual[i, node]
            if i == node or i in avoided or (out == 0 and into == 0) or (own < 10 and self.dists[node, i] >= 0.1):
                continue
            if own > kp:
                best, kp, mi = i, own, out
                way = 0 if out > into else 1 if out < into else way
            elif own == kp:
                if out > mi:
                    best, way, mi = i, 0, out
                if into > mi:
                    best, way, mi = i, 1, into
        return best, way, kp, mi

    def fits(self, target: int, members: list[int]) -> bool:
        """Whether the target matches most members about as much as they match each other."""
        if len(members) <= 2:
            return True
        inner = self.counts[np.ix_(members, members)][np.triu_indices(len(members), 1)]
        with_target = self.counts[members, target]
        outside = (with_target < inner.mean() - inner.std()) | (with_target > inner.mean() + inner.std())
        return int(outside.sum()) <= len(members) / 2

    def count(self, way: int, weight: float) -> None:
        if way == 0:
            self.ahead += weight
        else:
            self.back += weight

    def chain(self, nodes: list[int]) -> None:
        """Edges along the nodes, in the direction that the votes favour."""
        forward = self.ahead > self.back
        self.edges += [(a, b) if forward else (b, a) for a, b in zip(nodes, nodes[1:])]

    def from_probe(self) -> None:
        """A chain with two ends; the end whose next link is stronger grows, as long as what it reaches fits the chain."""
        path, (node, way, _, _) = [0], self.strongest(0, [0])
        self.count(way, 0.5)
        at_end = True
        while node >= 0:
            self.count(way, 1.0)
            path = [*path, node] if at_end else [node, *path]
            tail, head = (self.strongest(end, path) for end in (path[-1], path[0]))
            ok_tail, ok_head = (x[0] >= 0 and self.fits(x[0], path) for x in (tail, head))
            if not ok_tail and not ok_head:
                break
            at_end = ok_tail and (not ok_head or tail[2] >= head[2])
            node, way = (tail if at_end else head)[:2]
        self.chain(path)
        self.used = path

    def from_used(self) -> None:
        """More chains, each from the used node with the best link; only links after a chain's second are held to the gate."""
        self.ahead = self.back = 0.0
        while True:
            links = [(n, *self.strongest(n, self.used)) for n in self.used]
            origin, node, way, *_ = max(links, key=lambda x: x[3] + x[4])
            if node < 0:
                return
            self.count(way, 0.5)
            branch = [node]
            self.used = [*self.used, node]
            self.count(way, 1.0)
            while True:
                inner, way, *_ = self.strongest(branch[-1], self.used)
                if inner < 0 or len(branch) > 1 and not self.fits(inner, branch):
                    break
                branch.append(inner)
                self.used = [*self.used, inner]
                self.count(way, 1.0)
            self.chain([origin, *branch])

    def run(self) -> list[tuple[int, int]]:
        self.from_probe()
        self.from_used()
        return self.edges


def spanning_tree(weights: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a maximum spanning tree over the nodes with any positive cell; heavier cells first, ties in row order. An edge has the
    direction of its cell; cells that are not positive join what is still apart."""
    nodes = np.flatnonzero((weights > 0).any(axis=0) | (weights > 0).any(axis=1))
    leader = {int(n): int(n) for n in nodes}

    def find(n: int) -> int:
        while leader[n] != n:
            leader[n] = leader[leader[n]]
            n = leader[n]
        return n

    i, j = (x.ravel() for x in np.meshgrid(nodes, nodes, indexing="ij"))
    out: list[tuple[int, int]] = []
    for k in np.argsort(-weights[i, j], kind="stable").tolist():
        a, b = find(int(i[k])), find(int(j[k]))
        if a != b:
            leader[b] = a
            out.append((int(i[k]), int(j[k])))
            if len(out) == len(nodes) - 1:
                break
    return out


def _dense(rows: pd.DataFrame, column: str, absent: float) -> tuple[np.ndarray, np.ndarray]:
    nodes = np.unique(np.concatenate((rows["i"], rows["j"], [0])))
    out = np.full((len(nodes), len(nodes)), absent)
    out[np.searchsorted(nodes, rows["i"]), np.searchsorted(nodes, rows["j"])] = rows[column]
    return nodes, out


def cluster_graph(cells: DataFrame, by: str) -> DataFrame:
    """``by``, src, dst: the grown graph of each probe from cells (i, j, kp, dist, mi), node 0 being the probe. A probe has some hundred
    images at most (its rank list is cut), so a group is small."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, counts = _dense(rows, "kp", 0.0)
        edges = Cluster(counts, _dense(rows, "dist", -1.0)[1], _dense(rows, "mi", 0.0)[1]).run()
        return pd.DataFrame([(rows[by].iloc[0], nodes[a], nodes[b]) for a, b in edges], columns=[by, "src", "dst"])

    return cells.groupBy(by).applyInPandas(run, f"{by} long, src long, dst long")


def kruskal_tree(cells: DataFrame, by: str, weight: str, absent: float = 0.0) -> DataFrame:
    """``by``, src, dst, weight: the maximum spanning tree of each probe's images; cells that are not there have the weight ``absent``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, cells_ = _dense(rows, weight, absent)
        return pd.DataFrame([(rows[by].iloc[0], nodes[a], nodes[b], cells_[a, b]) for a, b in spanning_tree(cells_)], columns=[by, "src", "dst", "weight"])

    return cells.groupBy(by).applyInPandas(run, f"{by} long, src long, dst long, weight double")


def associations(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """``by``, source, target, score: the edges between named nodes (``by``, node, name); both ends must have a name."""
    a, b = nodes.select(by, F.col("node").alias("src"), F.col("name").alias("source")), nodes.select(by, F.col("node").alias("dst"), F.col("name").alias("target"))
    return edges.join(a, [by, "src"]).join(b, [by, "dst"]).filter("weight > 0").select(by, "source", "target", F.col("weight").alias("score"))


def renumbered(edges: DataFrame, by: str) -> DataFrame:
    """``by``, node, number: nodes with an edge, and node 0, numbered from 0 in order."""
    ends = edges.select(by, F.col("src").alias("node")).unionByName(edges.select(by, F.col("dst").alias("node"))).unionByName(edges.select(by, F.lit(0).cast("long").alias("node"))).distinct()
    return ends.withColumn("number", (F.row_number().over(Window.partitionBy(by).orderBy("node")) - 1).cast("long"))


def first_seen(pairs: DataFrame, by: str) -> DataFrame:
    """``by``, name, number: names numbered from 0 as they first occur in pairs (pos, source, target), sources before targets."""
    ends = pairs.select(by, (2 * F.col("pos")).alias("at"), F.col("source").alias("name")).unionByName(pairs.select(by, (2 * F.col("pos") + 1).alias("at"), F.col("target").alias("name")))
    return ends.groupBy(by, "name").agg(F.min("at").alias("at")).select(by, "name", (F.row_number().over(Window.partitionBy(by).orderBy("at")) - 1).cast("long").alias("number"))


def graph_json(nodes: DataFrame, links: DataFrame, by: str) -> DataFrame:
    """``by``, graph: JSON of nodes (number, file, fileid, confidence) and links (source, target, confidence), both in order."""
    node = F.struct("number", F.struct(F.concat(F.lit("id"), F.col("number")).alias("id"), "file", "fileid", F.col("confidence").alias("nodeConfidenceScore")).alias("node"))
    link = F.struct("source", "target", F.col("confidence").alias("relationshipConfidenceScore"))
    inner: Column = F.transform(F.array_sort(F.collect_list(node)), lambda x: x["node"])
    n = nodes.groupBy(by).agg(inner.alias("nodes"))
    e = links.groupBy(by).agg(F.array_sort(F.collect_list(link)).alias("links"))
    return n.join(e, by, "left").select(by, F.to_json(F.struct(F.lit(True).alias("directed"), "nodes", F.coalesce("links", F.array()).alias("links"))).alias("graph"))


def follow_chain(links: DataFrame, starts: DataFrame) -> DataFrame:
    """start, step, node: from each start along the first link (smallest target) of each node until there is none, or a node returns.

    Each node has one way on, so chains are walked by doubling: after k rounds the table holds every node up to 2^k steps ahead of each
    node that a chain can reach. Rounds end when no chain goes on or all that do have come back to a node of theirs.
    """
    first = checkpointed(links.groupBy("source").agg(F.min("target").alias("target")))
    jump = first.select(F.col("source").alias("node"), F.col("target").alias("far"))
    seen = checkpointed(starts.select("start", F.lit(0).cast("long").alias("step"), F.col("start").alias("node")).distinct())
    width = 1
    while True:
        # every known place and the place ``width`` steps ahead of it
        ahead = seen.join(jump, "node").select("start", (F.col("step") + width).alias("step"), F.col("far").alias("node"))
        both = seen.unionByName(ahead).groupBy("start", "node").agg(F.min("step").alias("step")).select("start", "step", "node")
        grown = checkpointed(both)
        if grown.count() == seen.count():
            return seen
        seen, width = grown, 2 * width
        twice = jump.select("node", F.col("far").alias("via")).join(jump.select(F.col("node").alias("via"), "far"), "via")
        jump = checkpointed(twice.select("node", "far"))
