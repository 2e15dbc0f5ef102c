"""Packing of documents into fixed-length token sequences: bin completion, a branch and bound with best-fit incumbents."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmap.llm.common import bounded_batches, saved, slices
from kinmap.llm.tokens import encoder, tokenizer_path
from kinmap.llm.words import text_column

CAPACITY = 2048
#: Pieces that one search packs; their number grows with the input, not their size.
GROUP = 4096
#: Candidate fillings that a group's search may look at before it settles for its incumbent.
STEPS = 150_000


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of sizes: each size, largest first, goes where the least room remains."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, []  # rooms: bit r is set if a bin has room r
    for size in sorted(sizes, reverse=True):
        if fitting := rooms >> size:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(size)
        by_room[room - size].append(b)
        rooms |= 1 << (room - size)
    return bins


def waste_bound(sizes: list[int], capacity: int) -> int:
    """Fewest bins that any packing needs: for each threshold k, sizes over capacity - k stand alone, those over half the
    capacity don't share a bin, and what sizes of k or more do not fit beside these needs room of its own."""
    counts = np.bincount(np.asarray(sizes, np.int64), minlength=capacity + 1)
    number, volume = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * np.arange(capacity + 1))))
    k = np.arange(0, capacity // 2 + 1)
    half, whole = capacity // 2 + 1, capacity - k + 1  # first size over half, first size that nothing of size k fits beside
    alone = number[-1] - number[whole]
    large, large_volume = number[whole] - number[half], volume[whole] - volume[half]
    small_volume = volume[half] - volume[k]
    more = np.maximum(0, -(-(small_volume - (large * capacity - large_volume)) // capacity))
    return int((alone + large + more).max())


def covered(items: tuple[int, ...], by: tuple[int, ...]) -> bool:
    """Whether ``items`` can be placed inside the slots ``by``: then the filling ``by`` dominates."""
    if not items:
        return True
    head, rest = items[0], items[1:]
    return any(slot >= head and covered(rest, (*by[:i], slot - head, *by[i + 1 :])) for i, slot in enumerate(by))


class Search:
    """Depth-first search over bins; each level completes the bin of the largest size that is left."""

    def __init__(self, sizes: list[int], capacity: int, steps: int) -> None:
        self.capacity, self.steps, self.total = capacity, steps, sum(sizes)
        self.best = best_fit_decreasing(sizes, capacity)
        self.least = waste_bound(sizes, capacity)
        self.left = [0] * (capacity + 1)
        for s in sizes:
            self.left[s] += 1
        self.present = sum(1 << s for s in set(sizes))

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        if self.left[size]:
            self.present |= 1 << size
        else:
            self.present &= ~(1 << size)

    def largest(self, upto: int) -> int:
        return (self.present & ((2 << upto) - 1)).bit_length() - 1 if upto > 0 else -1

    def exact(self, target: int, upto: int) -> Iterator[tuple[int, ...]]:
        """Fillings of exactly ``target`` from what is left, of sizes up to ``upto``, larger sizes first."""
        size = self.largest(min(target, upto))
        while size > 0:
            self.steps -= 1
            if self.steps < 0:
                return
            if size == target:
                yield (size,)
            elif self.largest(target - size) > 0:
                self.take(size, 1)
                for rest in self.exact(target - size, size):
                    self.take(size, -1)
                    yield (size, *rest)
                    self.take(size, 1)
                self.take(size, -1)
            size = self.largest(size - 1)

    def fillings(self, room: int, waste: int) -> Iterator[tuple[int, ...]]:
        """Undominated fillings of ``room`` that waste at most ``waste``, the fullest first."""
        single = self.largest(room)
        if single <= 0:
            if room <= waste:
                yield ()
            return
        given: list[tuple[int, ...]] = []
        for target in range(room, max(single, room - waste) - 1, -1):  # what one size holds dominates all smaller sums
            for filling in [(single,)] if target == single else self.exact(target, room):
                if not any(covered(filling, g) for g in given):
                    given.append(filling)
                    yield filling
                if self.steps < 0:
                    return

    def run(self) -> list[list[int]]:
        bins: list[list[int]] = []
        levels: list[Iterator[tuple[int, ...]]] = []
        spare = lambda: (len(self.best) - 1) * self.capacity - self.total  # noqa: E731  what a better packing may waste
        wasted = [0]

        def descend() -> None:
            head = self.largest(self.capacity)
            self.take(head, 1)
            bins.append([head])
            levels.append(self.fillings(self.capacity - head, spare() - wasted[-1]))

        def undo() -> None:
            for size in bins[-1][1:]:
                self.take(size, -1)
            del bins[-1][1:]

        if len(self.best) > self.least:
            descend()
        while levels and self.steps > 0 and len(self.best) > self.least:
            undo()
            del wasted[len(levels) :]
            filling = next(levels[-1], None)
            lost = self.capacity - bins[-1][0] - sum(filling or ())
            if filling is None or wasted[-1] + lost > spare():
                if filling is None:
                    levels.pop()
                    self.take(bins.pop()[0], -1)
                continue
            for size in filling:
                self.take(size, 1)
            bins[-1].extend(filling)
            wasted.append(wasted[-1] + lost)
            if self.present:
                descend()
            elif len(bins) < len(self.best):
                self.best = [list(b) for b in bins]
        return self.best


def fill_bins(sizes: list[int], capacity: int = CAPACITY, steps: int = STEPS) -> list[list[int]]:
    """Bins of indices into ``sizes`` (each from 1 to ``capacity``), as few as the search finds. Full sizes take no part."""
    whole = [[i] for i, s in enumerate(sizes) if s == capacity]
    rest = [s for s in sizes if s < capacity]
    by_size: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        if s < capacity:
            by_size.setdefault(s, []).append(i)
    return whole + [[by_size[s].pop() for s in b] for b in (Search(rest, capacity, steps).run() if rest else [])]


def piece_table(docs: DataFrame, key: str, text: str, capacity: int, end_id: int, path: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in slices(batches, "_text", 6_000_000):
            offsets, ids = encode(text_column(batch.column("_text")))
            rows, number, start, length, crc = [], [], [], [], []
            end = np.array([end_id], np.uint32).tobytes()
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                stream = np.frombuffer(ids[a:b].tobytes() + end, np.uint32)
                for k, at in enumerate(range(0, len(stream), capacity)):
                    part = stream[at : at + capacity]
                    rows.append(i)
                    number.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            columns = [batch.column("_key").take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "piece", "start", "length", "ids_crc32"])

    return bounded_batches(docs.selectExpr(f"`{key}` AS _key", f"`{text}` AS _text")).mapInArrow(run, f"{key} {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0, path: str | None = None) -> DataFrame:
    """One row a piece: ``key``, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; only longer ones than ``capacity`` are cut. Null and empty texts are the end id
    alone. Null keys, repeated keys and repeated rows are packed as rows of their own. Pieces are dealt by hash into groups
    of about ``GROUP``, whose packings waste less than a sequence each beyond the group's bound. An empty table gives an
    empty result; extra columns are not read.
    """
    pieces = saved(piece_table(docs, key, text, capacity, end_id, path or tokenizer_path()), "pieces")
    groups = max(1, math.ceil(pieces.count() / GROUP))
    dealt = pieces.withColumn("_group", F.expr(f"pmod(xxhash64(`{key}`, piece, ids_crc32), {groups})"))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), (key, "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sizes = rows.column("length").to_numpy()
        bins = fill_bins(sizes.tolist(), capacity)
        order = np.fromiter(chain.from_iterable(bins), np.int64, len(sizes))
        counts = np.fromiter(map(len, bins), np.int64, len(bins))
        numbers = np.repeat(np.arange(len(bins)), counts)
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.repeat(before[np.cumsum(counts) - counts], counts)
        rows = rows.take(pa.array(order))
        group = rows.column("_group").to_numpy()
        out = rows.drop_columns(["_group"]).append_column("sequence_id", pa.array((group << 32) + numbers))
        return out.append_column("offset", pa.array(before - first))

    kind = docs.schema[key].dataType.simpleString()
    return dealt.groupBy("_group").applyInArrow(run, f"{key} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
