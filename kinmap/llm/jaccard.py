"""Near copies by the Jaccard similarity of their word-shingle sets: candidates from the SimHash trie join, completed by a prefix-filter
self-join so that no link is lost, each confirmed by the whole sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmap.llm.common import Carried, bounded_batches, drop_scratch, release, saved, scratch_mark, skew_join, slices
from kinmap.llm.components import components, labels_of
from kinmap.llm.simhash import majority_bits, near_links
from kinmap.llm.words import LOWER, listed, text_column, translated, words_of

#: Least bits of a document's parity sketch; two sketches differ in no more bits than the sets differ in shingles.
SKETCH = 512
#: Documents that show which shingles are common: every ``SAMPLE_SHARE``-th, ``SAMPLE`` at least; the common ones kept at most.
SAMPLE, SAMPLE_SHARE, MOST_COMMON = 4000, 50, 100_000
#: Groups of a shingle of this size or less are compared pair by pair at once.
SMALL_GROUP = 8
#: Prefix rows of a task of the join, and of a piece of a larger group of one shingle.
PART_ROWS = 400_000
#: Members of a block of a group that is compared in full; blocks meet in pairs.
CROWD_ROWS = 10_000
PAIRS_AT_A_TIME = 1 << 16
#: Names of sets (16 bytes each) that go to all tasks; more meet the texts by shuffle.
BROADCAST_ROWS = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # fixed values of the splitmix64 finaliser
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and 64-bit hashes of the distinct word shingles (lower-cased A-Z) of each text, ascending; a text of fewer words has one."""
    words = words_of(translated(texts, LOWER))
    spelled = listed(words.vocabulary.cast(pa.binary()))
    own = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in spelled), np.uint64, len(spelled))[words.codes]
    rows, n = words.rows, len(words.codes)
    at = np.arange(n)
    hashes = np.zeros(n, np.uint64)
    for k in range(shingle):
        inside = at + k < words.offsets[rows + 1]
        word = np.where(inside, own[np.minimum(at + k, max(n - 1, 0))], np.uint64(0))
        hashes = np.where(inside, mix(hashes + word * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)), hashes)
    begins = (at == words.offsets[rows]) | (at + shingle <= words.offsets[rows + 1])
    rows, hashes = rows[begins], hashes[begins]
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def set_keys(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    return mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64)


def sketches(rows: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> pa.Array:
    """Parities of the shingles by their hash modulo a power of two that is at least twice their number."""
    width = SKETCH << np.ceil(np.log2(np.maximum(2 * n / SKETCH, 1))).astype(np.int64)
    begins = np.concatenate(([0], np.cumsum(width)))
    place = begins[rows] + (mix(hashes) & (width[rows] - 1).astype(np.uint64)).astype(np.int64)
    return cut(np.packbits((np.bincount(place, minlength=begins[-1]) & 1).astype(np.uint8)), begins // 8)


def folded(sketch: np.ndarray, n_bytes: int) -> np.ndarray:
    """A sketch at a smaller width."""
    return sketch if len(sketch) == n_bytes else np.bitwise_xor.reduce(sketch.reshape(-1, n_bytes), axis=0)


def differing(one: bytes, other: bytes) -> int:
    n_bytes = min(len(one), len(other))
    return int(np.bitwise_count(folded(np.frombuffer(one, np.uint8), n_bytes) ^ folded(np.frombuffer(other, np.uint8), n_bytes)).sum(dtype=np.int64))


def offsets_of(rows: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))).astype(np.int64)


def cut(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary for each range of ``data``."""
    raw = data.tobytes()
    ends = (offsets * data.itemsize).tolist()
    return pa.array([raw[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary())


class Likeness:
    """The threshold as a fraction, so that pairs exactly at it are kept."""

    def __init__(self, similarity: float) -> None:
        share = Fraction(str(similarity))
        self.p, self.q = share.numerator, share.denominator

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """Sets alike share one of so many first elements of each, in any one order of all elements."""
        return np.where(n > 0, n - -(-self.p * n // self.q) + 1, 0)

    def lengths(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.q * np.minimum(a, b) >= self.p * np.maximum(a, b)

    def possible(self, a: np.ndarray, b: np.ndarray, differing: np.ndarray) -> np.ndarray:
        """Whether sets of ``a`` and ``b`` elements may be alike that differ in ``differing`` or more."""
        return (self.q + self.p) * differing <= (self.q - self.p) * (a + b)

    def alike(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return self.q * both >= self.p * (len(a) + len(b) - both)


def blocks(n: np.ndarray, likeness: Likeness) -> np.ndarray:
    """Sizes of one block are near enough to be alike."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(likeness.q / likeness.p) + 1e-9).astype(np.int64)


def gathered(batches: Iterator[pa.RecordBatch], *names: str) -> list[np.ndarray] | None:
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return None
    return [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in names]


def first_pairs(sig: np.ndarray, fp: np.ndarray, n: np.ndarray, likeness: Likeness) -> Iterator[tuple[np.ndarray, ...]]:
    """(sig, u, v, n): in small groups of a shingle all pairs, in large ones each member with the smallest of its size class; of large
    groups also the members, with v = u."""
    order = np.lexsort((fp, n, sig))
    sig, fp, n = sig[order], fp[order], n[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1])
    sig, fp, n = sig[new], fp[new], n[new]
    starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    size = np.repeat(np.diff(np.append(starts, len(sig))), np.diff(np.append(starts, len(sig))))
    small = size <= SMALL_GROUP
    for d in range(1, SMALL_GROUP):
        i = np.flatnonzero((sig[d:] == sig[:-d]) & small[d:])
        i = i[likeness.lengths(n[i], n[i + d])]
        yield sig[i], fp[i], fp[i + d], n[i]
    large = np.flatnonzero(~small)
    sig, fp, n = sig[large], fp[large], n[large]
    yield sig, fp, fp, n
    u, v = led(sig, n, likeness)
    yield sig[u], fp[u], fp[v], n[u]


def led(sig: np.ndarray, n: np.ndarray, likeness: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """Indices of each member and of the first of its shingle and size class, for members in order of shingle and size: what members share
    is the largest part of the smallest."""
    block = blocks(n, likeness)
    first = np.ones(len(sig), bool)
    first[1:] = (sig[1:] != sig[:-1]) | (block[1:] != block[:-1])
    leader = np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0)) if len(sig) else np.zeros(0, np.int64)
    return np.flatnonzero(~first), leader[~first]


class Crowd:
    """Members of one shingle's group, or of two blocks of it, sorted by size: pairs that join up what is in different components, as many as
    that takes. With sketches they are what length and sketch allow, with whole sets (``exact``) what is alike."""

    def __init__(self, n: np.ndarray, root: np.ndarray, block: np.ndarray, raw: list[bytes], likeness: Likeness, exact: bool) -> None:
        self.n, self.block, self.raw, self.likeness, self.exact = n, block, raw, likeness, exact
        self.bits = np.zeros((len(raw), SKETCH // 8), np.uint8)
        for i, x in enumerate(raw):
            if exact:
                places = (mix(np.frombuffer(x, np.uint64)) & np.uint64(SKETCH - 1)).astype(np.int64)
                self.bits[i] = np.packbits((np.bincount(places, minlength=SKETCH) & 1).astype(np.uint8))
            else:
                self.bits[i] = folded(np.frombuffer(x, np.uint8), SKETCH // 8)
        self.two = len(np.unique(block)) > 1
        _, codes = np.unique(root, return_inverse=True)
        first = np.zeros(codes.max() + 1, np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        self.labels = first[codes]

    def joins(self, i: int, j: int) -> bool:
        if self.exact:
            return self.likeness.alike(np.frombuffer(self.raw[i], np.uint64), np.frombuffer(self.raw[j], np.uint64))
        return bool(self.likeness.possible(self.n[i], self.n[j], differing(self.raw[i], self.raw[j])))

    def pairs(self) -> Iterator[tuple[int, int]]:
        upto = np.searchsorted(self.n, self.n * self.likeness.q // self.likeness.p, side="right")
        for i, end in enumerate(upto.tolist()):
            others = np.arange(i + 1, end)
            others = others[(self.labels[others] != self.labels[i]) & ((self.block[others] != self.block[i]) | (not self.two))]
            for at in range(0, len(others), PAIRS_AT_A_TIME):
                part = others[at : at + PAIRS_AT_A_TIME]
                apart = np.bitwise_count(self.bits[i] ^ self.bits[part]).sum(axis=1, dtype=np.int64)
                for j in part[self.likeness.possible(self.n[i], self.n[part], apart)].tolist():
                    if self.labels[i] != self.labels[j] and self.joins(i, j):
                        yield i, j
                        self.labels = labels_of(len(self.n), np.array([i]), np.array([j]), self.labels)

    def suspects(self) -> np.ndarray:
        """Members that length and sketch allow to be alike with some member of another component; no pair of others is alike."""
        found = np.zeros(len(self.n), bool)
        upto = np.searchsorted(self.n, self.n * self.likeness.q // self.likeness.p, side="right")
        for i, end in enumerate(upto.tolist()):
            others = np.arange(i + 1, end)
            others = others[(self.labels[others] != self.labels[i]) & ((self.block[others] != self.block[i]) | (not self.two))]
            for at in range(0, len(others), PAIRS_AT_A_TIME):
                part = others[at : at + PAIRS_AT_A_TIME]
                apart = np.bitwise_count(self.bits[i] ^ self.bits[part]).sum(axis=1, dtype=np.int64)
                for j in part[self.likeness.possible(self.n[i], self.n[part], apart)].tolist():
                    if not (found[i] and found[j]) and self.joins(i, j):
                        found[i] = found[j] = True
        return np.flatnonzero(found)


def first_of(column: str) -> Callable:
    """Rows with the first occurrence of each value in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            new = []
            for i, x in enumerate(batch.column(column).to_pylist()):
                if x not in seen:
                    seen.add(x)
                    new.append(i)
            yield batch.take(pa.array(new, pa.int64()))
        release()

    return run


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, errors: int = 3, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (``key`` alone by default) and component_id, the smallest key reachable over links of texts whose
    ``shingle``-word sets are ``similarity`` alike or more; a row for each row with a key.

    Candidates are sets whose SimHash fingerprints differ in at most ``errors`` bits, from the trie join, and, as most that are just
    alike enough differ in more, sets that share a shingle of their prefixes. A set's prefix is its rarest shingles (as a sample
    tells; any order would do); sets alike share one of their prefixes. So no link is lost but by collisions of 64-bit hashes, and
    every link is confirmed by the whole sets. Of a shingle that many texts share, members are first compared with leaders, then
    with all that are still in other components. Texts with equal sets are one vertex. Keys are integers; rows of one key may have
    different texts, and rows without a key are left out. Texts without words (null, empty) are alike. An empty table gives an
    empty result; further columns are not read.
    """
    likeness = Likeness(similarity)
    carried = Carried(docs, [key] if keep is None else keep)
    kept = carried.names
    rows = docs.filter(F.col(f"`{key}`").isNotNull()).select(*carried.columns, F.col(f"`{key}`").cast("long").alias("_key"), F.col(f"`{text}`").alias("_text"))

    def hashed(found: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "_text"):
                own, hashes = shingle_sets(text_column(batch.column("_text")), shingle, seed)
                yield found(batch, own, hashes, offsets_of(own, batch.num_rows))

        return run

    # common shingles go last in the order, so that they are in few prefixes
    every = max(1, rows.count() // SAMPLE)
    some = bounded_batches(rows.filter(F.pmod(F.xxhash64("_key"), F.lit(min(every, SAMPLE_SHARE))) == 0).select("_text"))
    seen = some.mapInArrow(hashed(lambda batch, own, hashes, offsets: pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["sig"])), "sig long")
    common = seen.groupBy("sig").count().filter("count > 2").orderBy(F.desc("count"), "sig").limit(MOST_COMMON)
    hot = np.sort(np.array([r["sig"] for r in common.select("sig").collect()], np.int64).view(np.uint64))

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()  # sets of this task so far: only the first row of each carries what follows from it

        def facts_of(batch: pa.RecordBatch, own: np.ndarray, hashes: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
            n, names = np.diff(offsets), set_keys(hashes, offsets)
            again = []
            for x in names.tolist():
                again.append(x in met)
                met.add(x)
            order = np.lexsort((hashes, np.isin(hashes, hot), own))
            short = np.arange(len(own)) - offsets[own] < likeness.prefix(n)[own]
            ends = offsets_of(own[short], len(n))
            prefix = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(hashes[order][short].view(np.int64)))
            first = pa.array(np.arange(len(n)), mask=np.array(again, bool))
            told = [x.take(first) for x in (prefix, sketches(own, hashes, n))]
            prints = majority_bits(hashes, own, len(n)).view(np.int64)
            columns = [*map(batch.column, kept), batch.column("_key"), pa.array(names), pa.array(n), pa.array(prints), *told]
            return pa.RecordBatch.from_arrays(columns, names=[*kept, "doc", "fp", "n", "print", "prefix", "bits"])

        yield from hashed(facts_of)(batches)

    known = saved(bounded_batches(rows).mapInArrow(facts, f"{carried.ddl}, doc long, fp long, n long, print long, prefix array<long>, bits binary"), "sets")
    vertices = saved(known.groupBy("fp").agg(F.min("doc").alias("doc"), F.count("*").alias("copies")), "vertices")
    told = known.filter("prefix IS NOT NULL")
    sketched = saved(told.select("fp", "n", "print", "bits").repartition("fp").mapInArrow(first_of("fp"), "fp long, n long, print long, bits binary"), "sketches")
    distinct, n_prefix = sketched.count(), told.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]

    # candidates by SimHash: sets of one fingerprint with the first of them, and first ones whose fingerprints are linked
    prints = saved(sketched.groupBy("print").agg(F.min("fp").alias("first"), F.count("*").alias("n")), "prints")
    named = lambda side: prints.select(F.col("print").alias(f"p{side}"), F.col("first").alias(side))
    linked = near_links(prints.select(F.col("print").alias("fp")), prints.count(), errors).toDF("pu", "pv")
    twins = sketched.select("print", F.col("fp").alias("u")).join(prints.filter("n > 1").select("print", F.col("first").alias("v")), "print")
    close = linked.join(named("u"), "pu").join(named("v"), "pv").select("u", "v").unionByName(twins.select("u", "v"))

    # and by a shared shingle of the prefixes; a shingle's larger group is dealt in pieces, each with leaders of its own
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := gathered(batches, "sig", "fp", "n"):
            for columns in first_pairs(*held, likeness):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sig", "u", "v", "n"])
            del held, columns
            release()

    prefixes = told.select(F.explode("prefix").alias("sig"), "fp", "n")
    piece = F.lit(0)
    if n_prefix > PART_ROWS:  # groups that may be over a quarter of a task, as a 64th of the sets tells
        some = prefixes.filter(F.pmod(F.xxhash64("fp"), F.lit(64)) == 0).groupBy("sig").agg((64 * F.count("*")).alias("rows"))
        large = saved(some.filter(F.col("rows") > PART_ROWS // 6), "large")  # fewer than 6 * rows / PART_ROWS
        if not large.isEmpty():
            prefixes = prefixes.join(F.broadcast(large), "sig", "left")
            piece = F.when(F.col("rows").isNotNull(), F.pmod(F.xxhash64("fp"), F.ceil(F.col("rows") / (PART_ROWS // 4)))).otherwise(0)
    parts = max(8, n_prefix // PART_ROWS)
    met = saved(prefixes.repartition(parts, "sig", piece).select("sig", "fp", "n").mapInArrow(join, "sig long, u long, v long, n long"), "met")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                apart = np.array([*map(differing, b.column("bits").to_pylist(), b.column("bits_v").to_pylist())])
                n, m = (b.column(c).to_numpy() for c in ("n", "n_v"))
                ok = likeness.lengths(n, m) & likeness.possible(n, m, apart)
                yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["u", "v"]).filter(pa.array(ok))

    def with_sides(pairs: DataFrame, side: DataFrame) -> DataFrame:
        """``pairs(u, v)`` with the columns of ``side(fp, ...)`` for u and, under names with _v, for v. A leader, v, may have many pairs: what
        remains to be joined by shuffle is dealt anew by adaptive execution."""
        left = pairs.join(side.withColumnRenamed("fp", "u"), "u")
        return left.join(side.select(F.col("fp").alias("v"), *(F.col(c).alias(f"{c}_v") for c in side.columns if c != "fp")), "v")

    def set_of(batch: pa.RecordBatch, own: np.ndarray, hashes: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        named = pa.RecordBatch.from_arrays([batch.column("_fp"), cut(hashes, offsets)], names=["fp", "elements"])
        return named.filter(pa.array(set_keys(hashes, offsets) == batch.column("_fp").to_numpy()))  # a repeated key may have other texts too

    def elements(wanted: DataFrame) -> DataFrame:
        """fp, elements of the sets in ``wanted(fp)``, from the text of one of their documents."""
        named = saved(vertices.join(wanted, "fp", "left_semi").select(F.col("fp").alias("_fp"), F.col("doc").alias("_key")), "wanted")
        few = named.count() <= BROADCAST_ROWS
        texts = rows.select("_key", "_text").join(F.broadcast(named) if few else named, "_key").select("_fp", "_text")
        begin, found = scratch_mark(), saved(bounded_batches(texts).mapInArrow(hashed(set_of), "fp long, elements binary"), "texts")
        upto, first = scratch_mark(), saved(found.repartition("fp").mapInArrow(first_of("fp"), "fp long, elements binary"), "elements")
        drop_scratch(begin, upto)
        return first

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "elements"):
            sets = ([np.frombuffer(x, np.uint64) for x in b.column(c).to_pylist()] for c in ("elements", "elements_v"))
            ok = [likeness.alike(x, y) for x, y in zip(*sets)]
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    pairs = met.select("u", "v").unionByName(close).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    likely = saved(with_sides(saved(pairs, "pairs"), sketched.select("fp", "n", "bits")).mapInArrow(sift, "u long, v long"), "likely")

    def confirmed(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp"))).distinct()
        begin = scratch_mark()
        sets = elements(wanted)
        upto, links = scratch_mark(), saved(bounded_batches(with_sides(pairs, sets)).mapInArrow(confirm, "u long, v long"), "links")
        drop_scratch(begin, upto)
        return links

    # one pair of each set first: most others are then of one component, and their sets need not be brought together
    first = saved(likely.groupBy("u").agg(F.min("v").alias("v")), "first")
    links = confirmed(first)
    roots = saved(components(links), "roots")
    root = lambda side: roots.select(F.col("id").alias(side), F.col("root").alias(f"root_{side}"))
    apart = likely.join(root("u"), "u", "left").join(root("v"), "v", "left").filter(F.coalesce("root_u", "u") != F.coalesce("root_v", "v"))
    rest = saved(apart.select("u", "v").join(first, ["u", "v"], "left_anti"), "rest")
    if not rest.isEmpty():
        links = links.unionByName(confirmed(rest))
        roots = saved(components(links), "roots")

    # groups whose members are still in several components are compared in full, block by block: first by sketches, and what joins them up is
    # confirmed; groups in which some of that fails are compared by whole sets
    crowd = met.filter("u = v").select("sig", F.col("u").alias("fp"), "n")

    def compare(exact: bool, suspects: bool = False) -> Callable:
        """sig, u, v of the pairs of each crowd; or its suspects, with v = u."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = gathered(batches, "sig", "a", "b", "block", "fp", "n", "root", "raw")
            if not held:
                return
            sig, a, b, block, fp, n, root, raw = held
            order = np.lexsort((fp, n, b, a, sig))
            new = np.flatnonzero(np.concatenate(([True], (np.diff(sig[order]) != 0) | (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0))))
            for begin, end in zip(new.tolist(), [*new[1:].tolist(), len(order)]):
                own = order[begin:end]
                crowd = Crowd(n[own], root[own], block[own], [raw[i] for i in own.tolist()], likeness, exact)
                pairs = ((i, i) for i in crowd.suspects().tolist()) if suspects else crowd.pairs()
                found = [(sig[own[i]], fp[own[i]], fp[own[j]]) for i, j in pairs]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["sig", "u", "v"])
            del held, raw, crowd, pairs
            release()

        return run

    def compared(open_: DataFrame, side: DataFrame, n_open: int, run: Callable) -> DataFrame:
        """``run`` on the groups of ``open_(sig, fp, n, root, members)``, cut into blocks, with the column raw of ``side(fp, raw)``."""
        dealt = open_.withColumn("blocks", F.ceil(F.col("members") / CROWD_ROWS).cast("int")).withColumn("block", F.expr("cast(pmod(xxhash64(fp), blocks) AS int)"))
        dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("sig", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "fp", "n", "root")
        spread = dealt.join(side, "fp").repartition(max(8, n_open // CROWD_ROWS), "sig", "a", "b")
        return saved(bounded_batches(spread).mapInArrow(run, "sig long, u long, v long"), "near")

    def still_open() -> DataFrame:
        """Members of groups in several components, without groups that lie in a wider one: where the widest group of all members of a group is
        one and the same other, that holds all of its pairs."""
        rooted = crowd.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        several = rooted.groupBy("sig").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("members")).filter("a <> b").select("sig", "members")
        found = saved(rooted.join(several, "sig"), "open")
        widest = found.groupBy("fp").agg(F.max(F.struct("members", "sig")).alias("w")).select("fp", F.col("w.sig").alias("widest"))
        covered = found.join(widest, "fp").groupBy("sig").agg(F.min("widest").alias("a"), F.max("widest").alias("b")).filter("a = b AND a <> sig").select("sig")
        return saved(found.join(covered, "sig", "left_anti"), "open")

    for exact in (False, True):
        open_ = still_open()
        n_open = open_.count()
        if not n_open:
            break
        side = sketched.select("fp", F.col("bits").alias("raw"))
        if exact:  # whole sets are large and each is in many groups: only those that sketches cannot tell apart are brought together
            left = compared(open_, side, n_open, compare(False, suspects=True)).select("sig", F.col("u").alias("fp")).distinct()
            open_ = open_.drop("members").join(left, ["sig", "fp"], "left_semi")
            open_ = saved(open_.join(open_.groupBy("sig").agg(F.count("*").alias("members")), "sig"), "open")
            n_open = open_.count()
            if not n_open:
                break
            side = elements(open_.select("fp").distinct()).withColumnRenamed("elements", "raw")
        near = compared(open_, side, n_open, compare(exact)).select("sig", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        if exact:
            links = links.unionByName(near.select("u", "v"))
            roots = saved(components(links), "roots")
            break
        fresh = saved(near.select("u", "v").distinct().join(likely, ["u", "v"], "left_anti"), "fresh")  # what was likely before has been judged
        if not fresh.isEmpty():
            links = links.unionByName(confirmed(fresh))
            roots = saved(components(links), "roots")
        failed = saved(near.join(links, ["u", "v"], "left_anti").select("sig").distinct(), "failed")
        if failed.isEmpty():
            break
        crowd = crowd.join(failed, "sig", "left_semi")

    named = saved(vertices.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "named")
    least = named.groupBy("root").agg(F.min("doc").alias("component_id"), F.count("*").alias("n_sets"))
    final = saved(skew_join(named, least, "root", "n_sets", distinct).select("fp", "copies", "component_id"), "final")
    n_rows = final.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    joined = skew_join(known.select(*kept, "fp"), final, "fp", "copies", n_rows)
    return joined.select(*carried.restored, F.col("component_id").cast(docs.schema[key].dataType).alias("component_id"))
