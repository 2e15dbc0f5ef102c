"""A content-addressed store of token ids: chunks cut by a rolling hash and kept once, recipes of documents, Merkle roots.

Layout of a store, a folder: ``packs/*.ids`` hold Zstandard frames of chunks (little-endian ids of 2 or 4 bytes); ``index`` (Parquet)
maps a chunk's key, the BLAKE2b-128 of its bytes, to pack, frame and place; ``recipes`` (Parquet, ascending by document) hold for each
document its part, its place there, its chunk keys and the Merkle root over them; ``manifest`` (Parquet) has each part's place in the
stream, its number of documents and the Merkle root over theirs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinmap.llm.common import bounded_batches, ranged_sums, saved, scratch_path, skew_join, slices
from kinmap.llm.files import create, open_file
from kinmap.llm.tokens import encoder, tokenizer_path
from kinmap.llm.words import text_column

#: Ids of a chunk: at least, on average beyond that, at most; and ids that the rolling hash sees.
LEAST, AVERAGE, MOST, WINDOW = 64, 256, 1024, 8
#: Text that is encoded at a time.
TEXT_BYTES = 6_000_000
FRAME_BYTES = 1 << 17
PACK_BYTES = 1 << 26
#: Documents of a part of the recipes.
PART = 50_000


def cut_points(ids: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each stream ids[offsets[i]:offsets[i + 1]] the ends of its chunks.

    A chunk ends where the hash of the last ``WINDOW`` ids is zero in its low bits; windows lie inside the stream, as no chunk is
    shorter than one.
    """
    spread = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(32)
    rolled = spread.copy()
    for j in range(1, WINDOW):
        rolled[j:] = rolled[j:] + (spread[:-j] << np.uint64(j)) + (spread[:-j] >> np.uint64(64 - j))
    marks = np.flatnonzero((rolled * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40) & np.uint64(AVERAGE - 1) == 0) + 1
    first = np.searchsorted(marks, offsets[:-1], side="right").tolist()
    last = np.searchsorted(marks, offsets[1:], side="left").tolist()
    places = marks.tolist()
    out = []
    for a, b, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first, last):
        ends, begin = [], a
        for mark in places[i:j]:
            while mark - begin > MOST:
                begin += MOST
                ends.append(begin)
            if mark - begin >= LEAST:
                begin = mark
                ends.append(begin)
        while b - begin > MOST:
            begin += MOST
            ends.append(begin)
        if begin < b:
            ends.append(b)
        out.append(ends)
    return out


def key_of(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Leaves and inner nodes are hashed under different first bytes; the last node of an odd level goes up as it is."""
    level = [key_of(b"\0" + x) for x in leaves] or [key_of(b"")]
    while len(level) > 1:
        level = [key_of(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


#: Columns of the index's files: a row is a document (kind 0) or a chunk (kind 1).
_DOCUMENT, _CHUNK = "n_tokens long, root binary, keys array<binary>, after array<long>", "chunk binary, pack string, frame long, frame_bytes long, at long, n long"


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str
    width: int
    key: str
    kind: str

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(f"doc {self.kind}, {_DOCUMENT}, {_CHUNK}, kind int").parquet(f"{self.path}/index")

    @property
    def index(self) -> DataFrame:
        return self._rows().filter("kind = 1").select("chunk", "pack", "frame", "frame_bytes", "at", "n")

    def _recipes(self) -> DataFrame:
        return self.spark.read.schema(f"doc {self.kind}, {_DOCUMENT}, part long, inside long").parquet(f"{self.path}/recipes")

    @property
    def recipes(self) -> DataFrame:
        """``doc``, n_tokens, root, keys, after (ids of the document after each chunk), start, part."""
        joined = self._recipes().join(self.manifest.select("part", "first"), "part")
        return joined.select("doc", "n_tokens", "root", "keys", "after", (F.col("first") + F.col("inside")).alias("start"), "part")

    @property
    def manifest(self) -> DataFrame:
        return self.spark.read.schema("part long, documents long, tokens long, root binary, first long").parquet(f"{self.path}/manifest")

    def verify(self) -> None:
        """Raises an error unless every document's Merkle root is that of its chunk keys, and every part's that of its documents."""

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for place, keys, root in zip(b.column("inside").to_pylist(), b.column("keys").to_pylist(), b.column("root").to_pylist()):
                    if merkle_root(keys) != root:
                        raise ValueError(f"the document at {place} of its part does not have its Merkle root")
                yield b.drop_columns(["keys"])

        own = self._recipes().select("part", "inside", "n_tokens", "root", "keys").mapInArrow(check, "part long, inside long, n_tokens long, root binary")
        found, told = part_roots(own), self.manifest.drop("first")
        odd = found.exceptAll(told).unionByName(told.exceptAll(found)).select("part").first()
        if odd:
            raise ValueError(f"part {odd[0]} of the recipes does not have its Merkle root in the manifest")

    def chunks(self, with_data: bool = False) -> DataFrame:
        """Every chunk as its pack has it: key, number of ids, crc32 of its ids as uint32, and, if asked for, its bytes. A chunk whose
        bytes do not have its key raises an error."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from zlib import crc32

            opened, held, file, data = None, None, None, b""
            for batch in batches:
                ns, crcs, texts = [], [], []
                for row in batch.to_pylist():
                    if opened != row["pack"]:
                        file, opened, held = open_file(row["pack"]), row["pack"], None
                    if held != row["frame"]:
                        file.seek(row["frame"])
                        data, held = zstandard.ZstdDecompressor().decompress(file.read(row["frame_bytes"])), row["frame"]
                    own = data[row["at"] : row["at"] + row["n"] * width]
                    if key_of(own) != row["chunk"]:
                        raise ValueError(f"a chunk of {opened} does not have the bytes of its key")
                    ns.append(len(own) // width)
                    crcs.append(crc32(np.frombuffer(own, f"<u{width}").astype("<u4").tobytes()))
                    texts.append(own)
                columns = [batch.column("chunk"), pa.array(ns, pa.int64()), pa.array(crcs, pa.int64()), *[pa.array(texts, pa.binary())] * with_data]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "n", "crc", *["data"] * with_data])

        return self.index.mapInArrow(run, "chunk binary, n long, crc long" + ", data binary" * with_data)

    def references(self) -> DataFrame:
        """A row for each chunk of each document: its document's place, its key, and the ids of the document after it."""
        return self.recipes.select("start", F.explode(F.arrays_zip("keys", "after")).alias("r")).select("start", F.col("r.keys").alias("chunk"), F.col("r.after").alias("after"))

    def read_digests(self) -> DataFrame:
        """``key``, start, n_tokens, ids_crc32 of every document, from the files, whose roots are verified first: chunks are read once,
        where they are; what is shuffled is their lengths and checksums, which add up to those of documents."""
        self.verify()
        refs = saved(self.references(), "references")
        counts = refs.groupBy("chunk").agg(F.count("*").alias("refs"))
        facts = saved(counts.join(self.chunks(), "chunk"), "facts")
        placed = skew_join(refs, facts, "chunk", "refs", refs.count())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                part = shifted(b.column("crc").to_numpy(zero_copy_only=False).astype(np.uint32), 4 * b.column("after").to_numpy())
                yield pa.RecordBatch.from_arrays([b.column("start"), b.column("n"), pa.array(part.astype(np.int64))], names=["start", "n", "part"])

        found = placed.select("start", "n", "crc", "after").mapInArrow(run, "start long, n long, part long")
        summed = found.groupBy("start").agg(F.sum("n").alias("n_read"), F.bit_xor("part").alias("ids_crc32"))
        joined = self.recipes.select("doc", "start", "n_tokens").join(summed, "start", "left")
        ok = F.col("n_read").eqNullSafe(F.col("n_tokens"))
        return joined.select(F.col("doc").alias(self.key), "start", F.when(ok, F.col("n_read")).otherwise(F.raise_error(F.lit("a document's chunks are missing"))).alias("n_tokens"), "ids_crc32")

    def read_documents(self) -> DataFrame:
        """``key``, start and ids (array of ints) of every document, put together from its chunks and checked against its Merkle root."""
        width, key, kind = self.width, self.key, self.kind
        refs = self.references()
        data = self.chunks(with_data=True).select("chunk", "data")
        parts = refs.join(data, "chunk").groupBy("start").agg(F.array_sort(F.collect_list(F.struct(-F.col("after"), "chunk", "data"))).alias("parts"))
        joined = self.recipes.select("doc", "start", "root").join(parts, "start")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for row in b.to_pylist():
                    pieces = [list(p.values()) for p in row["parts"]]
                    if merkle_root([key_of(p[2]) for p in pieces]) != row["root"]:
                        raise ValueError(f"document at {row['start']} does not have its Merkle root")
                    out.append(np.frombuffer(b"".join(p[2] for p in pieces), f"<u{width}").astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("start"), pa.array(out, pa.list_(pa.int32()))], names=["doc", "start", "ids"])

        return joined.mapInArrow(run, f"doc {kind}, start long, ids array<int>").withColumnRenamed("doc", key)


_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials over GF(2) modulo that of crc32, the bits in its (reflected) order."""
    out, b = np.zeros(np.broadcast(a, b).shape, np.uint32), b.astype(np.uint32)
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(k)) & np.uint32(1) == 1, b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1) == 1, _POLY, np.uint32(0))
    return out


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What a part with ``crc`` adds (by xor) to the crc32 of a whole in which ``n_bytes`` bytes follow it."""
    power, out, bits = np.array([1 << 30], np.uint32), crc.astype(np.uint32), n_bytes.astype(np.uint64) * np.uint64(8)
    while bits.any():
        odd = bits & np.uint64(1) == 1
        out[odd] = _times(power, out[odd])
        power, bits = _times(power, power), bits >> np.uint64(1)
    return out


def part_roots(rows: DataFrame) -> DataFrame:
    """part, documents, tokens, root of rows (part, inside, n_tokens, root): the Merkle root over a part's documents in order."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("inside")
        root = merkle_root(group.column("root").to_pylist())
        sums = pa.array([group.num_rows], pa.int64()), pa.array([pc.sum(group.column("n_tokens")).as_py()], pa.int64())
        return pa.table({"part": group.column("part")[:1], "documents": sums[0], "tokens": sums[1], "root": pa.array([root], pa.binary())})

    return rows.groupBy("part").applyInArrow(run, "part long, documents long, tokens long, root binary")


def write_store(docs: DataFrame, key: str = "doc_id", text: str = "text", end_id: int = 2, tokenizer: str | None = None, width: int = 2, path: str | None = None) -> Store:
    """Encodes every whole text, ends it with ``end_id`` and writes the store, documents ascending by ``key`` (an integer).

    Null and empty texts are the end id alone; null keys come first; repeated keys and rows are documents of their own, in order of
    their roots; an empty table gives an empty store; extra columns are not read. Texts are encoded once; each task hands on a chunk
    once, and chunks meet by key, so each is stored once. A pack belongs to the store only if ``index`` names it, so that repeated
    attempts of a task leave nothing behind that is read.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or tokenizer_path()
    path = path or scratch_path(spark, "tokens")
    kind = docs.schema[key].dataType.simpleString()
    if key in ("start", "n_tokens", "ids_crc32", "ids"):
        raise ValueError("the key may not have the name of a result")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(tokenizer).encode, set()
        for batch in slices(batches, "_text", TEXT_BYTES):
            ends, ids = encode(text_column(batch.column("_text")))
            if len(ids) and int(ids.max()) >> (8 * width):
                raise ValueError("ids do not fit the store's width")
            number = np.arange(len(ends) - 1)
            stream = np.insert(ids, ends[1:], end_id)
            offsets = np.concatenate((ends[:-1] + number, [ends[-1] + len(number)]))
            raw = stream.astype(f"<u{width}").tobytes()
            keys, afters, roots, new = [], [], [], []
            for a, b, cuts in zip(offsets[:-1].tolist(), offsets[1:].tolist(), cut_points(stream, offsets)):
                own = []
                for x, y in pairwise((a, *cuts)):
                    data = raw[x * width : y * width]
                    own.append(key_of(data))
                    if own[-1] not in seen:
                        seen.add(own[-1])
                        new.append((own[-1], data))
                keys.append(own)
                afters.append([b - y for y in cuts])
                roots.append(merkle_root(own))
            if len(seen) > 1_000_000:
                seen.clear()
            n, m = len(keys), len(new)
            none = pa.nulls
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([0] * n + [1] * m, pa.int32()),
                    pa.concat_arrays([batch.column("_key"), none(m, batch.column("_key").type)]),
                    pa.array([*np.diff(offsets).tolist(), *[None] * m], pa.int64()),
                    pa.array([*roots, *[None] * m], pa.binary()),
                    pa.array([*keys, *[None] * m], pa.list_(pa.binary())),
                    pa.array([*afters, *[None] * m], pa.list_(pa.int64())),
                    pa.array([*[None] * n, *(k for k, _ in new)], pa.binary()),
                    pa.array([*[None] * n, *(d for _, d in new)], pa.binary()),
                ],
                names=["kind", "doc", "n_tokens", "root", "keys", "after", "chunk", "data"],
            )

    columns = f"kind int, doc {kind}, {_DOCUMENT}"
    cut_rows = bounded_batches(docs.selectExpr(f"`{key}` AS _key", f"`{text}` AS _text"), TEXT_BYTES).mapInArrow(cut, f"{columns}, chunk binary, data binary")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        file, uri, written = None, None, 0
        frame: list[tuple[bytes, bytes]] = []
        squeeze = zstandard.ZstdCompressor(level=1)

        def flush() -> pa.RecordBatch:
            nonlocal file, uri, written
            if file is None:
                (file, uri), written = create(f"{path}/packs", ".ids"), 0
            packed = squeeze.compress(b"".join(d for _, d in frame))
            file.write(packed)
            sizes = np.array([len(d) for _, d in frame], np.int64)
            m = len(frame)
            rows = pa.RecordBatch.from_arrays(
                [pa.array([1] * m, pa.int32()), pa.nulls(m, key_type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.list_(pa.binary())), pa.nulls(m, pa.list_(pa.int64())), pa.array([k for k, _ in frame], pa.binary()), pa.array([uri] * m), pa.array([written] * m, pa.int64()), pa.array([len(packed)] * m, pa.int64()), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes // width)],
                names=names,
            )
            written += len(packed)
            frame.clear()
            if written >= PACK_BYTES:
                file.close()
                file = None
            return rows

        names = ["kind", "doc", "n_tokens", "root", "keys", "after", "chunk", "pack", "frame", "frame_bytes", "at", "n"]
        size = 0
        for batch in batches:
            key_type = batch.column("doc").type
            rows = batch.filter(pc.equal(batch.column("kind"), 0)).drop_columns(["data"])
            n = rows.num_rows
            if n:
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.nulls(n, pa.string()), *[pa.nulls(n, pa.int64())] * 4], names=names)
            for k, d in zip(batch.column("chunk").to_pylist(), batch.column("data").to_pylist()):
                if k is not None and k not in seen:
                    seen.add(k)
                    frame.append((k, d))
                    size += len(d)
                    if size >= FRAME_BYTES:
                        yield flush()
                        size = 0
        if frame:
            yield flush()
        if file is not None:
            file.close()

    met = cut_rows.repartition(F.xxhash64("chunk", "root", "doc"))
    bounded_batches(met, TEXT_BYTES).mapInArrow(store, f"{columns}, {_CHUNK}").write.partitionBy("kind").parquet(f"{path}/index")
    written = Store(spark, path, width, key, kind)
    rows = written._rows().filter("kind = 0").select("doc", "n_tokens", "root", "keys", "after")
    parts = max(1, math.ceil(rows.count() / PART))
    ranged_sums(rows, ["doc", "root"], "n_tokens", "inside", parts, f"{path}/recipes")
    sums = saved(part_roots(written._recipes().select("part", "inside", "n_tokens", "root")), "parts")
    sums.withColumn("first", F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).write.parquet(f"{path}/manifest")
    return written
