"""SimHash near-duplicates: whole-text fingerprints, a self-join of a binary trie of them, and components of the links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmap.llm.common import bounded_batches, saved, skew_join, slices
from kinmap.llm.components import components, labels_of
from kinmap.llm.words import LOWER, listed, text_column, translated, words_of

#: Fingerprints that a task of the join holds (about), and tasks at most.
PART_ROWS, MOST_TASKS = 50_000, 50_000
#: The largest subtrie that is not cut further, and bits that a part of a cut has at least.
SUBTRIE, LEAST_SHARE = 1 << 19, 6
#: Node pairs that the traversal expands at a time.
FRONTIER = 1 << 17


def majority_bits(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """An unsigned 64-bit number for each row: the bits that are set in over half of its hashes (``rows`` ascending); 0 without any."""
    ones, sizes = np.zeros((n_rows, 64), np.int64), np.bincount(rows, minlength=n_rows)
    for at in range(0, len(rows), 1 << 16):  # so that one very long text needs no more memory than many short ones
        own = rows[at : at + (1 << 16)]
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(len(own), -1), axis=1, bitorder="little")
        begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))).tolist()
        for a, b in zip(begin, [*begin[1:], len(own)]):
            ones[own[a]] += bits[a:b].sum(axis=0, dtype=np.int32)
    return np.packbits((2 * ones > sizes[:, None]).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).reshape(n_rows)


def fingerprints(texts: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each text: lower-cased A-Z, word shingles with repeats, XXH64; 0 without words."""
    words = words_of(translated(texts, LOWER))
    spelled = listed(words.vocabulary.cast(pa.binary()))
    flat = [spelled[c] for c in words.codes.tolist()]
    joined = b" ".join(flat)
    lengths = np.fromiter(map(len, flat), np.int64, len(flat))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = words.counts
    per_row = np.where(n >= shingle, n - shingle + 1, (n > 0).astype(np.int64))
    rows = np.repeat(np.arange(len(n)), per_row)
    first = words.offsets[rows] + (np.arange(len(rows)) - np.repeat(np.cumsum(per_row) - per_row, per_row))
    last = np.minimum(first + shingle, words.offsets[rows + 1]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[first].tolist(), ends[last].tolist())), np.uint64, len(rows))
    return majority_bits(hashes, rows, len(n))


def fingerprint_table(docs: DataFrame, key: str, text: str, shingle: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            got = fingerprints(text_column(batch.column("_text")), shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(got.view(np.int64))], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return bounded_batches(docs.selectExpr(f"`{key}` AS _key", f"`{text}` AS _text")).mapInArrow(run, f"{key} {kind}, fp long")


class TrieJoin:
    """The join of a binary trie over sorted fingerprints with itself.

    A node is a range of the sorted array and a depth. Node pairs are expanded together, bit by bit; a pair keeps the number
    of bits in which its two prefixes differ and is dropped as soon as that exceeds ``errors``. A pair with few leaves left on
    either side is compared at once. A pair whose leaves already are all in one component can add nothing and is dropped too,
    so dense groups of near copies do not cost the square of their size.
    """

    def __init__(self, prints: np.ndarray, errors: int) -> None:
        self.prints, self.errors = prints, errors
        self.labels = np.arange(len(prints))
        # neighbours in sorted order that are close already make up most of a dense group
        near = np.flatnonzero(self.close(np.arange(len(prints) - 1), np.arange(1, len(prints))))
        self.link(near, near + 1)

    def close(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.prints[u] ^ self.prints[v]) <= self.errors

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        self.labels = labels_of(len(self.prints), u, v, self.labels)
        change = self.labels[1:] != self.labels[:-1]
        self.changes = np.concatenate(([0], np.cumsum(change), [0]))[: len(self.prints)]

    def settled(self, lo1, hi1, lo2, hi2) -> np.ndarray:
        same = lambda lo, hi: self.changes[hi - 1] == self.changes[lo]
        return same(lo1, hi1) & same(lo2, hi2) & (self.labels[lo1] == self.labels[lo2])

    def split(self, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        """Where the leaves with bit ``depth`` (from the top) set begin in each node."""
        if not len(lo):
            return lo
        shift = np.uint64(63 - depth)
        middle = ((self.prints[lo] >> shift) | np.uint64(1)) << shift  # the node's prefix, then a one
        return np.clip(np.searchsorted(self.prints, middle), lo, hi)

    def run(self, nodes: tuple, depth: int, spent: np.ndarray) -> None:
        stack = [(*nodes, spent, depth)]
        while stack:
            lo1, hi1, lo2, hi2, spent, depth = stack.pop()
            keep = (hi1 > lo1) & (hi2 > lo2) & (spent <= self.errors)
            keep &= ~((lo1 == lo2) & (hi1 - lo1 < 2))
            lo1, hi1, lo2, hi2, spent = (x[keep] for x in (lo1, hi1, lo2, hi2, spent))
            open_ = ~self.settled(lo1, hi1, lo2, hi2)
            lo1, hi1, lo2, hi2, spent = (x[open_] for x in (lo1, hi1, lo2, hi2, spent))
            small = ((hi1 - lo1) * (hi2 - lo2) <= 16) | (depth >= 64)
            if small.any():
                self.compare(*(x[small] for x in (lo1, hi1, lo2, hi2)))
            lo1, hi1, lo2, hi2, spent = (x[~small] for x in (lo1, hi1, lo2, hi2, spent))
            if not len(lo1):
                continue
            if len(lo1) > FRONTIER:
                half = len(lo1) // 2
                stack += [tuple(x[s] for x in (lo1, hi1, lo2, hi2, spent)) + (depth,) for s in (slice(half, None), slice(0, half))]
                continue
            m1, m2 = self.split(lo1, hi1, depth), self.split(lo2, hi2, depth)
            other = lo1 != lo2  # of a node with itself, one of the two mixed pairs is enough
            stack.append(
                (
                    np.concatenate((lo1, m1, lo1, m1[other])),
                    np.concatenate((m1, hi1, m1, hi1[other])),
                    np.concatenate((lo2, m2, m2, lo2[other])),
                    np.concatenate((m2, hi2, hi2, m2[other])),
                    np.concatenate((spent, spent, spent + 1, spent[other] + 1)),
                    depth + 1,
                )
            )

    def compare(self, lo1: np.ndarray, hi1: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> None:
        """All pairs of two small nodes' leaves."""
        upto = np.cumsum((hi1 - lo1) * (hi2 - lo2))
        at = 0
        while at < len(lo1):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 18))))
            a1, b1, a2, b2 = (x[at:stop] for x in (lo1, hi1, lo2, hi2))
            at = stop
            n2 = b2 - a2
            pairs = (b1 - a1) * n2
            which = np.repeat(np.arange(len(pairs)), pairs)
            k = np.arange(len(which)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            u, v = a1[which] + k // n2[which], a2[which] + k % n2[which]
            ok = self.close(u, v)
            u, v = u[ok], v[ok]
            apart = self.labels[u] != self.labels[v]
            if apart.any():
                self.link(u[apart], v[apart])


def join_subtries(prints: np.ndarray, depth: int, errors: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Links (places a, b in ``prints``: sorted, distinct, unsigned) that join up all fingerprints that share their ``depth`` highest bits
    and differ in ``errors`` others at most."""
    if len(prints) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    trie = TrieJoin(prints, errors)
    top = prints >> np.uint64(64 - depth) if depth else np.zeros(len(prints), np.uint64)
    lo = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
    hi = np.append(lo[1:], len(prints))
    trie.run((lo, hi, lo, hi), depth, np.zeros(len(lo), np.int64))
    child = np.flatnonzero(trie.labels != np.arange(len(prints)))
    return child, trie.labels[child]


def cut(rows: DataFrame, left: int, share: int, parts: int) -> DataFrame:
    """Each row (fp, r, trie) ``parts`` times: the lowest ``left`` bits of r are turned so that another ``share`` of them is on top."""
    mask = F.lit((1 << left) - 1 if left < 64 else -1)
    low = F.col("r").bitwiseAND(mask)
    turned = [F.shiftleft(low, i * share).bitwiseAND(mask).bitwiseOR(F.shiftrightunsigned(low, left - i * share)) for i in range(parts)]
    each = [F.struct(F.col("r").bitwiseAND(F.bitwise_not(mask)).bitwiseOR(t).alias("r"), (F.col("trie") * parts + i).alias("trie")) for i, t in enumerate(turned)]
    return rows.select("fp", F.explode(F.array(*each)).alias("x")).select("fp", "x.r", "x.trie")


def joined(rows: DataFrame, n: int, depth: int, errors: int) -> DataFrame:
    """Links (u, v) of the tries in ``rows`` (fp, r, trie), each joined with itself below its nodes at ``depth``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        fp, r, trie = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("fp", "r", "trie"))
        r = r.view(np.uint64)
        for one in np.unique(trie).tolist():
            own = np.flatnonzero(trie == one)
            own = own[np.argsort(r[own])]
            u, v = join_subtries(r[own], depth, errors)
            yield pa.RecordBatch.from_arrays([pa.array(fp[own[u]]), pa.array(fp[own[v]])], names=["u", "v"])

    tasks = min(max(8, n // PART_ROWS), MOST_TASKS)
    return rows.repartition(tasks, "trie", F.shiftrightunsigned("r", 64 - depth)).mapInArrow(run, "u long, v long")


def near_links(distinct: DataFrame, n: int, errors: int = 3) -> DataFrame:
    """Links (u, v) that connect all fingerprints of ``distinct(fp)`` within ``errors`` bits of each other.

    The 64 bits are cut into ``errors + 1`` parts, one of which two close fingerprints have in common. So a fingerprint goes into as many
    tries, in each with another part at the top, and a trie is joined with itself below its nodes at that depth. These subtries are
    dealt to tasks; those of more than ``SUBTRIE`` leaves are cut again, by the bits that their leaves do not share. A task's links
    are those of a spanning forest: fewer than its rows, however dense its groups.
    """
    rows = distinct.select("fp", F.col("fp").alias("r"), F.lit(0).alias("trie"))
    depth, left, links = 0, 64, None
    while True:
        share = left // (errors + 1)
        rows, n, depth, left = cut(rows, left, share, errors + 1), n * (errors + 1), depth + share, left - share
        large = None
        if n > SUBTRIE and left // (errors + 1) >= LEAST_SHARE:
            rows = rows.withColumn("top", F.shiftrightunsigned("r", 64 - depth))
            large = saved(rows.groupBy("trie", "top").agg(F.count("*").alias("n")).filter(F.col("n") > SUBTRIE), "large")
            n_large = large.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not large or not n_large:
            found = joined(rows.select("fp", "r", "trie"), n, depth, errors)
            return links.unionByName(found) if links else found
        found = joined(rows.join(large, ["trie", "top"], "left_anti").select("fp", "r", "trie"), n, depth, errors)
        links = links.unionByName(found) if links else found
        rows, n = rows.join(large, ["trie", "top"], "left_semi").select("fp", "r", "trie"), n_large


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, errors: int = 3, seed: int = 42) -> DataFrame:
    """``key``, fingerprint (16 hex digits) and component_id, the smallest key reachable over links of ``errors`` bits or fewer.

    Keys are integers. Texts without words (null, empty) have fingerprint 0 and link like any other. Repeated rows and keys
    come back as often as they are given; a null key never becomes a component's id unless all its keys are null. An empty
    table gives an empty result; extra columns are not read. Copies are folded into one fingerprint before the join.
    """
    prints = saved(fingerprint_table(docs, key, text, shingle, seed), "fingerprints")
    groups = saved(prints.groupBy("fp").agg(F.min(key).alias("first"), F.count("*").alias("n")), "groups")
    sizes = groups.agg(F.count("*").alias("distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    links = saved(near_links(groups.select("fp"), sizes["distinct"], errors), "links")  # a stage has one Python step, so one worker a task
    roots = components(links)
    named = groups.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = saved(named, "roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n_prints"))
    final = saved(skew_join(named, least, "root", "n_prints", sizes["distinct"]).select("fp", "n", "component_id"), "components")
    joined = skew_join(prints, final, "fp", "n", sizes["rows"])
    return joined.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
