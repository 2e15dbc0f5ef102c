"""WARC bundles of independent Zstandard frames with a seek table, and an index from records to their places in frames."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmap.llm.common import bounded_batches, saved, scratch_path, skew_join, slices
from kinmap.llm.files import create, open_file

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
#: Pages that revisit another, up to this number, go to all tasks.
BROADCAST_ROWS = 100_000
#: Fixed values of the seekable format: a skippable frame that holds a size pair for each frame, then a footer of 9 bytes.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: Fixed header values of WARC 1.1.
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD_ID = "urn:kinmap:page:"
_LENGTH_FIELD = "X-Payload-Length"


def digest_of(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<{_RECORD_ID}{'null' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    value = name.strip("<>").removeprefix(_RECORD_ID)
    return None if value == "null" else int(value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A response record with its payload, or a revisit record without."""
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Date", date),
        *([("WARC-Target-URI", "".join(c for c in url if c not in "\r\n"))] if url is not None else []),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        (_LENGTH_FIELD, str(len(payload))),
        *([("WARC-Profile", _REVISIT_PROFILE), ("WARC-Refers-To", _name(refers_to))] if revisit else []),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(0 if revisit else len(payload))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + (b"" if revisit else payload) + b"\r\n\r\n"


@dataclass(frozen=True)
class Record:
    fields: dict[str, str]
    payload: bytes
    at: int
    size: int

    @property
    def page_id(self) -> int | None:
        return _page(self.fields["WARC-Record-ID"])


def parse_records(data: bytes) -> Iterator[Record]:
    """The records of a frame's content; damaged ones raise an error."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at {at}")
        lines = data[at:end].decode().split("\r\n")[1:]
        fields = dict(line.split(": ", 1) for line in lines)
        begin = end + 4
        stop = begin + int(fields["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where it says")
        payload = data[begin:stop]
        if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha1:{digest_of(payload)}":
            raise ValueError(f"the record at {at} does not have its digest")
        yield Record(fields, payload, at, stop + 4 - at)
        at = stop + 4


class BundleWriter:
    """Writes records into frames of about ``FRAME_BYTES``; ``close`` adds the seek table."""

    def __init__(self, file) -> None:
        self.file, self.frames, self.held, self.size, self.written = file, [], [], 0, 0
        self.squeeze = zstandard.ZstdCompressor(level=3)

    def add(self, data: bytes) -> tuple[int, int]:
        """Number of the record's frame and its place there."""
        if self.held and self.size + len(data) > FRAME_BYTES:
            self.flush()
        self.held.append(data)
        self.size += len(data)
        return len(self.frames), self.size - len(data)

    def flush(self) -> None:
        if self.held:
            packed = self.squeeze.compress(b"".join(self.held))
            self.file.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.file.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.file.close()


class BundleReader:
    """Random access to the frames of a bundle by its seek table."""

    def __init__(self, file) -> None:
        self.file, size = file, file.size()
        if size < 17:
            raise ValueError("no seek table")
        n, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags & 0x7C:
            raise ValueError("no seek table")
        step = 12 if flags & 0x80 else 8  # a table may hold checksums
        table = self._read(size - 9 - n * step, n * step)
        sizes = [struct.unpack_from("<II", table, i * step) for i in range(n)]
        self.frames, at = [], 0
        for packed, plain in sizes:
            self.frames.append((at, packed, plain))
            at += packed

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.frames[i]
        data = zstandard.ZstdDecompressor().decompress(self._read(at, packed), max_output_size=plain)
        if len(data) != plain:
            raise ValueError("a frame is not as long as the seek table says")
        return data


@dataclass(frozen=True)
class Archive:
    """Bundles in a folder, and ``index``: page_id, bundle, frame, offset (in the frame's content), length."""

    spark: SparkSession
    path: str
    kind: str

    @property
    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/index")

    def read(self, with_payload: bool = False) -> DataFrame:
        """All records, from whole bundles: page_id, payload_bytes, payload_digest, record_type, refers_to, frame, offset, and the stored
        payload (revisits: null) if asked for. The bundles are those that the index names; each is read frame by frame."""
        schema = f"page_id {self.kind}, payload_bytes long, payload_digest string, record_type string, refers_to {self.kind}, frame long, offset long" + ", payload binary" * with_payload
        id_type = {"int": pa.int32(), "smallint": pa.int16()}.get(self.kind, pa.int64())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for uri in batch.column("bundle").to_pylist():
                    with open_file(uri) as file:
                        bundle = BundleReader(file)
                        for i in range(len(bundle.frames)):
                            rows = list(parse_records(bundle.frame(i)))
                            refers = [r.fields.get("WARC-Refers-To") for r in rows]
                            columns = [
                                pa.array([r.page_id for r in rows], id_type),
                                pa.array([int(r.fields[_LENGTH_FIELD]) for r in rows], pa.int64()),
                                pa.array([r.fields["WARC-Payload-Digest"].removeprefix("sha1:") for r in rows], pa.string()),
                                pa.array([r.fields["WARC-Type"] for r in rows], pa.string()),
                                pa.array([None if x is None else _page(x) for x in refers], id_type),
                                pa.array([i] * len(rows), pa.int64()),
                                pa.array([r.at for r in rows], pa.int64()),
                            ]
                            if with_payload:
                                columns.append(pa.array([r.payload if r.fields["WARC-Type"] == "response" else None for r in rows], pa.binary()))
                            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

        bundles = saved(self.index.select("bundle").distinct(), "bundles")
        return bundles.repartition(max(1, bundles.count())).mapInArrow(run, schema)  # a task for each bundle

    def seek(self, wanted: DataFrame) -> DataFrame:
        """The records of the pages in ``wanted(page_id)``, each from its frame alone: page_id, record_type, payload (revisits: null)."""
        found = self.index.join(wanted.select("page_id").distinct(), "page_id").repartition("bundle").sortWithinPartitions("bundle", "frame", "offset")
        id_type = {"int": pa.int32(), "smallint": pa.int16()}.get(self.kind, pa.int64())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            uri, bundle, held, data = None, None, None, b""
            for batch in batches:
                got = []
                for row in batch.to_pylist():
                    if uri != row["bundle"]:
                        if bundle is not None:
                            bundle.file.close()
                        uri, bundle, held = row["bundle"], BundleReader(open_file(row["bundle"])), None
                    if held != row["frame"]:
                        held, data = row["frame"], bundle.frame(row["frame"])
                    got.append(next(parse_records(data[row["offset"] : row["offset"] + row["length"]])))
                kinds = [r.fields["WARC-Type"] for r in got]
                yield pa.RecordBatch.from_arrays([pa.array([r.page_id for r in got], id_type), pa.array(kinds, pa.string()), pa.array([r.payload if k == "response" else None for r, k in zip(got, kinds)], pa.binary())], names=["page_id", "record_type", "payload"])
            if bundle is not None:
                bundle.file.close()

        return found.mapInArrow(run, f"page_id {self.kind}, record_type string, payload binary")


def write_archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = 0, date: str = "2020-01-01T00:00:00Z", path: str | None = None) -> Archive:
    """Writes a WARC record for each row into seekable bundles.

    Of rows with equal payloads of at least ``revisit_bytes`` bytes, that with the largest key is a response and the others revisit
    it; rows that tie for it (repeated rows) are all responses. Keys are integers; a null key is below all others; if a payload has
    only null keys, all are responses. Null html is an empty payload, a null url gives no target field. An empty table gives an empty
    archive; extra columns are not read.

    Payloads are hashed where they are read into slim rows (key, SHA-256), which are grouped with a partial aggregation. Only keys of
    repeated payloads are joined back to the pages, by key and digest: broadcast up to ``BROADCAST_ROWS`` of them (some 60 bytes
    each), else by shuffle. So pages that repeat nothing are not shuffled unless copies are more than that. A bundle belongs to the
    archive only if the index names it: what a failed attempt of a task wrote is never read.
    """
    spark, path = pages.sparkSession, path or scratch_path(pages.sparkSession, "warc")
    kind = pages.schema[key].dataType.simpleString()
    html_column = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").alias("url"), html_column.alias("html"))
    slim = saved(rows.filter(F.octet_length("html") >= revisit_bytes).select("page_id", F.unhex(F.sha2("html", 256)).alias("digest")), "digests")
    groups = slim.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1 AND last IS NOT NULL")
    groups = saved(groups, "payloads")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if total:
        # only pages that revisit another: a row for each key and digest
        copies = skew_join(slim, groups, "digest", "n", slim.count()).filter("last IS NOT NULL AND NOT page_id <=> last").distinct()
        copies = saved(copies, "revisits")
        named = copies.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "last")
        if copies.count() <= BROADCAST_ROWS:
            named = F.broadcast(named)
        own = F.when(F.octet_length("html") >= revisit_bytes, F.unhex(F.sha2("html", 256)))
        rows = rows.withColumn("digest", own).join(named, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    else:
        rows = rows.withColumn("last", F.lit(None).cast(kind))
    rows = rows.withColumn("revisit", F.col("last").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, uri = None, None
        for batch in slices(batches, "html"):
            out = []
            for row in batch.to_pylist():
                if bundle is None:
                    file, uri = create(f"{path}/bundles", ".warc.zst")
                    bundle = BundleWriter(file)
                data = record(row["page_id"], row["url"], row["html"].encode(), row["last"], row["revisit"], date)
                out.append((row["page_id"], uri, *bundle.add(data), len(data)))
                if bundle.written >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            columns = [batch.column("page_id"), *(pa.array([x[i] for x in out], t) for i, t in ((1, pa.string()), (2, pa.int64()), (3, pa.int64()), (4, pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "bundle", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    chosen = rows.select("page_id", "url", "html", "last", "revisit")
    bounded_batches(chosen).mapInArrow(run, f"page_id {kind}, bundle string, frame long, offset long, length long").write.parquet(f"{path}/index")
    return Archive(spark, path, kind)
