"""Sharding by best-fit decreasing: indivisible groups, largest first, enter the bin with the least room that fits them."""

from __future__ import annotations

import math
from bisect import bisect_right, insort
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmap.llm.common import prefix_sum, saved, skew_join

#: Pallets (small bins that groups are packed into where they are) for each shard.
PALLETS = 512
#: Groups of a part that packs its pallets in one task, until there are so many parts; each may leave a pallet half empty.
PART_GROUPS, MOST_PARTS = 4096, 32_768
#: Rows of a range in which rows are numbered (about).
RANGE_ROWS = 100_000


class RoomTree:
    """An AA tree (balanced) of bins by (room, bin): insert, remove, and the least room that is large enough."""

    class _Node:
        __slots__ = ("key", "left", "level", "right")

        def __init__(self, key: tuple[int, int]) -> None:
            self.key, self.level, self.left, self.right = key, 1, None, None

    def __init__(self) -> None:
        self.root = None

    @staticmethod
    def _skew(t):
        if t and t.left and t.left.level == t.level:
            s = t.left
            t.left, s.right = s.right, t
            return s
        return t

    @staticmethod
    def _split(t):
        if t and t.right and t.right.right and t.right.right.level == t.level:
            s = t.right
            t.right, s.left = s.left, t
            s.level += 1
            return s
        return t

    def insert(self, key: tuple[int, int]) -> None:
        def put(t):
            if t is None:
                return self._Node(key)
            if key < t.key:
                t.left = put(t.left)
            else:
                t.right = put(t.right)
            return self._split(self._skew(t))

        self.root = put(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def drop(t, key):
            if t is None:
                raise KeyError(key)
            if key < t.key:
                t.left = drop(t.left, key)
            elif key > t.key:
                t.right = drop(t.right, key)
            elif t.left is None:
                return t.right
            elif t.right is None:
                return t.left
            else:
                near = t.left
                while near.right:
                    near = near.right
                t.key = near.key
                t.left = drop(t.left, near.key)
            level = min(t.left.level if t.left else 0, t.right.level if t.right else 0) + 1
            if level < t.level:
                t.level = level
                if t.right and t.right.level > level:
                    t.right.level = level
            t = self._skew(t)
            t.right = self._skew(t.right)
            if t.right:
                t.right.right = self._skew(t.right.right)
            t = self._split(t)
            t.right = self._split(t.right)
            return t

        self.root = drop(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The smallest (room, bin) with room for ``size``."""
        t, best = self.root, None
        while t:
            if t.key[0] >= size:
                best, t = t.key, t.left
            else:
                t = t.right
        return best


def best_fit_decreasing(sizes: list[int], capacity: int, limit: int | None = None) -> list[int] | None:
    """The bin of each size. Larger sizes than ``capacity`` get a bin of their own. None if more than ``limit`` bins are needed."""
    tree, bins, out = RoomTree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.tightest(sizes[i])
        if found:
            tree.remove(found)
            room, b = found
        else:
            if bins == limit:
                return None
            room, b = max(capacity, sizes[i]), bins
            bins += 1
        out[i] = b
        if room > sizes[i]:
            tree.insert((room - sizes[i], b))
    return out


def even_shards(sizes: list[int], shards: int) -> list[int]:
    """The shard of each size, sizes of shards as near to equal as best fit makes them.

    A size of an even share or more has a shard to itself; the least capacity at which the others fit the shards that are left is
    found by halving.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    out, left, total, alone = [0] * len(sizes), shards, sum(sizes), 0
    while order[alone:] and left > 1 and sizes[order[alone]] * left >= total:
        out[order[alone]] = alone
        total -= sizes[order[alone]]
        left -= 1
        alone += 1
    rest = order[alone:]
    own = [sizes[i] for i in rest]
    low, high = max([-(-total // left), *own[:1]]), max([total, 1])
    best = best_fit_decreasing(own, high, left)
    while low < high and best is not None:
        middle = (low + high) // 2
        tried = best_fit_decreasing(own, middle, left)
        if tried is None:
            low = middle + 1
        else:
            best, high = tried, middle
    for i, b in zip(rest, best or []):
        out[i] = alone + b
    return levelled(sizes, out, shards)


def levelled(sizes: list[int], homes: list[int], shards: int) -> list[int]:
    """Moves sizes from the fullest to the emptiest shard, the one nearest to half their gap first, until none makes them more equal."""
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for i, (s, h) in enumerate(zip(sizes, homes)):
        held[h].append((s, i))
    loads = [sum(s for s, _ in h) for h in held]
    for h in held:
        h.sort()
    while True:
        full, bare = loads.index(max(loads)), loads.index(min(loads))
        gap = loads[full] - loads[bare]
        at = bisect_right(held[full], (gap // 2, len(sizes))) - 1
        if at < 0 or held[full][at][0] == 0:
            at += 1
            if at >= len(held[full]) or not 0 < held[full][at][0] < gap:
                break
        moved = held[full].pop(at)
        insort(held[bare], moved)
        loads[full] -= moved[0]
        loads[bare] += moved[0]
    return [h for _, h in sorted((i, h) for h, own in enumerate(held) for _, i in own)]


@dataclass(frozen=True)
class Packed:
    """rows: the given columns with pallet; pallets: (pallet, bytes), on the driver; their number is bounded (see ``pack_pallets``)."""

    rows: DataFrame
    pallets: list[tuple[int, int]]


def pack_pallets(rows: DataFrame, group: str, size: str, capacity: int, n_rows: int) -> Packed:
    """Packs the groups of rows with equal ``group`` (not null) into pallets of ``capacity`` bytes by best fit decreasing.

    Groups are counted with a partial aggregation, dealt by hash into parts, and packed part by part; so a pallet has groups of one
    part. A group over the capacity is a pallet of its own. Two pallets of a part never fit into one, so there are fewer than
    2 * bytes / capacity + parts of them.
    """
    groups = saved(rows.groupBy(group).agg(F.sum(size).alias("_bytes"), F.count("*").alias("_n")), "groups")
    parts = min(max(1, math.ceil(groups.count() / PART_GROUPS)), MOST_PARTS)
    dealt = groups.withColumn("_part", F.expr(f"pmod(xxhash64(`{group}`), {parts})"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(group)
        bins = best_fit_decreasing(table.column("_bytes").to_pylist(), capacity)
        part = table.column("_part")[0].as_py()
        pallet = pa.array([(part << 32) + b for b in bins], pa.int64())
        return pa.table({group: table.column(group), "_bytes": table.column("_bytes"), "_n": table.column("_n"), "pallet": pallet})

    kind = rows.schema[group].dataType.simpleString()
    placed = saved(dealt.groupBy("_part").applyInArrow(run, f"{group} {kind}, _bytes long, _n long, pallet long"), "pallets")
    pallets = [(r["pallet"], r["b"]) for r in placed.groupBy("pallet").agg(F.sum("_bytes").alias("b")).orderBy("pallet").toLocalIterator()]
    return Packed(skew_join(rows, placed.drop("_bytes"), group, "_n", n_rows), pallets)


def shard_rows(rows: DataFrame, group: str, size: str, shards: int = 8, order: list[str] | None = None) -> DataFrame:
    """The columns of ``rows`` with shard (0 to ``shards`` - 1, sizes near equal in bytes) and slot (gapless from 0 in a shard).

    Rows with equal ``group`` (not null) share a shard. Groups go into pallets, pallets into shards, both by best fit decreasing; the
    capacity of a pallet is an even share's 1 / ``PALLETS``, so that shards differ by less than that unless a group is larger. A
    group that is an even share or more has a shard to itself. An empty table gives an empty result. A shard's rows are
    numbered in order of the hash of the columns ``order``, range by range.
    """
    kept = saved(rows, "rows")
    total = kept.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    packed = pack_pallets(kept, group, size, max(1, -(-total["b"] // (shards * PALLETS))), total["n"])
    homes = even_shards([b for _, b in packed.pallets], shards)
    spark = rows.sparkSession
    mapped = spark.createDataFrame([(p, s) for (p, _), s in zip(packed.pallets, homes)], "pallet long, shard int")
    placed = packed.rows.join(F.broadcast(mapped), "pallet").drop("pallet")  # pallets are bounded in number, see pack_pallets
    parts = max(1, math.ceil(total["n"] / RANGE_ROWS))
    ordered = placed.select("*", F.xxhash64(*(order or [group])).alias("_order"), F.lit(1).alias("_one"))
    numbered = saved(prefix_sum(ordered, ["shard", "_order", *(order or [group])], "_one", "_at", parts), "numbered")
    begins = numbered.groupBy("shard").agg(F.min("_at").alias("_first"))  # a row for each shard
    return numbered.join(F.broadcast(begins), "shard").withColumn("slot", F.col("_at") - F.col("_first")).drop("_order", "_one", "_at", "_first")


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8) -> DataFrame:
    """``key``, size (UTF-8 bytes and 1), text_crc32, shard, slot for each row; equal texts share a shard.

    Null texts count as empty; null and repeated keys are rows of their own; extra columns are not read. Texts are hashed where they
    are read; what is shuffled are rows of some 60 bytes.
    """
    full = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(key, (F.octet_length(full) + 1).cast("long").alias("size"), F.crc32(full.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(full, 256)).alias("_group"))
    return shard_rows(rows, "_group", "size", shards, [key, "_group"]).drop("_group")
