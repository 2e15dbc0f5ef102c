"""k nearest neighbours: exact, over inverted lists, and over product-quantised codes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries that go to all tasks; more meet the base block by block. Base vectors of such a block, and of a piece of an inverted list.
QUERY_BLOCK, BASE_BLOCK = 65_536, 50_000
#: Values of a model (centroids times dimensions, 4 bytes each) that go to all tasks; a larger one is searched block by block.
MODEL_VALUES = 64_000_000
#: Hits of a task that ranks them.
HIT_ROWS = 2_000_000
#: Distances are compared after rounding, so that ties are ties in every engine; the smaller id wins.
DIGITS = 9


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as a dense matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


#: Queries and base vectors of a block of the matrix product. Vectors with larger values than this are multiplied in double precision.
PRODUCT_ROWS, PRODUCT_COLUMNS, SINGLE_VALUES = 512, 16_384, 1e15


def first_of_each(rows: np.ndarray, ids: np.ndarray, dists: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k least distances of each row, in order; ties to the smaller id."""
    order = np.lexsort((ids, dists, rows))
    own = rows[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def nearest(queries: np.ndarray, base: np.ndarray, ids: np.ndarray, k: int, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of the k nearest base vectors of each query, in order: candidates by a matrix product, then exact. ``within``:
    a distance for each query that what is farther need not be found at.

    The product is in single precision and the bound for candidates is wider by its largest error. After the first block of base vectors
    the bound is the distance of the k-th so far.
    """
    if not len(queries) or not len(base):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if k >= len(base):
        r, b = (x.ravel() for x in np.indices((len(queries), len(base))))
        d = np.concatenate([np.round(np.sqrt(((q[:, None, :] - base[None]) ** 2).sum(axis=2)), DIGITS).ravel() for q in np.array_split(queries, 1 + queries.size * len(base) // 4_000_000)])
        top = first_of_each(r, ids[b], d, k)
        return r[top], ids[b[top]], d[top]
    most = max(np.abs(queries).max(), np.abs(base).max())
    kind = np.float32 if most < SINGLE_VALUES else np.float64
    norms, turned = (base * base).sum(axis=1), np.ascontiguousarray(base.T, kind)
    error = (base.shape[1] + 8) * float(np.finfo(kind).eps)
    rows, found, dists = [], [], []
    for at in range(0, len(queries), PRODUCT_ROWS):
        q = queries[at : at + PRODUCT_ROWS]
        doubled, own = (-2 * q).astype(kind), (q * q).sum(axis=1)
        far = np.full(len(q), np.inf) if within is None else within[at : at + PRODUCT_ROWS]
        r, b, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for begin in range(0, len(base), PRODUCT_COLUMNS):
            end = min(begin + PRODUCT_COLUMNS, len(base))
            rough = doubled @ turned[:, begin:end]
            rough += norms[begin:end].astype(kind)
            finite = norms[begin:end][np.isfinite(norms[begin:end])]
            slack = error * (own + finite.max(initial=0)) + 1e-8 * (1 + own)
            bound = far * far * (1 + 1e-8) + 1e-8 - own + slack
            if not np.isfinite(bound).all() and k < end - begin:
                bound = np.fmin(bound, np.partition(rough, k - 1, axis=1)[:, k - 1].astype(np.float64) + 2 * slack + 1e-8 * (1 + own))
            near_r, near_b = np.nonzero(rough <= np.nextafter(bound.astype(kind), kind(np.inf))[:, None])
            if not len(near_r):
                continue
            near_b += begin
            r, b = np.concatenate((r, near_r)), np.concatenate((b, near_b))
            d = np.concatenate((d, np.round(np.sqrt(((q[near_r] - base[near_b]) ** 2).sum(axis=1)), DIGITS)))
            top = first_of_each(r, ids[b], d, k)
            r, b, d = r[top], b[top], d[top]
            last = np.searchsorted(r, np.arange(len(q))) + k - 1
            full = np.bincount(r, minlength=len(q)) == k
            far = np.where(full, np.fmin(far, d[np.minimum(last, max(len(d) - 1, 0))]), far)
        rows.append(r + at)
        found.append(ids[b])
        dists.append(d)
    return np.concatenate(rows), np.concatenate(found), np.concatenate(dists)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k nearest of each q_id, with rank from 1."""
    order = Window.partitionBy("q_id").orderBy("dist", "b_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class Best:
    """The k nearest hits of each query (by row) so far."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.rows, self.ids, self.dists = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, rows: np.ndarray, ids: np.ndarray, dists: np.ndarray) -> None:
        r, b, d = np.concatenate((self.rows, rows)), np.concatenate((self.ids, ids)), np.concatenate((self.dists, dists))
        top = first_of_each(r, b, d, self.k)
        self.rows, self.ids, self.dists = r[top], b[top], d[top]

    def within(self, n: int) -> np.ndarray:
        """The distance of the k-th hit of each of ``n`` queries; infinite where there are fewer."""
        full = np.bincount(self.rows, minlength=n) == self.k
        out = np.full(n, np.inf)
        out[full] = self.dists[(np.searchsorted(self.rows, np.arange(n)) + self.k - 1)[full]]
        return out


_HITS = "q_id long, b_id long, dist double"


def _no_hits() -> pa.Table:
    return pa.table({"q_id": pa.array([], pa.int64()), "b_id": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})


def knn_exact(queries: DataFrame, base: DataFrame, k: int, query_block: int | None = None, base_block: int | None = None) -> DataFrame:
    """q_id, rank, b_id, dist: the k nearest rows of ``base(b_id, vec)`` for each of ``queries(q_id, vec)``.

    Up to a block of queries go to all tasks; the base is read once, where it is, and a task keeps k rows for a query. More queries and
    the base are dealt into blocks by hash, every pair of blocks is a task, and its k rows for a query are merged: nothing passes
    through the driver, and a task's size does not depend on either side's. Rows with a null vector are no neighbours and have none.
    """
    query_block, base_block = query_block or QUERY_BLOCK, base_block or BASE_BLOCK
    queries, base = queries.filter("vec IS NOT NULL").select("q_id", "vec"), base.filter("vec IS NOT NULL").select("b_id", "vec")
    n = queries.count()
    if n > query_block:
        return ranked(_block_pairs(queries, base, k, math.ceil(n / query_block), max(1, math.ceil(base.count() / base_block))), k)
    block = queries.collect()
    held = queries.sparkSession.sparkContext.broadcast((np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = held.value
        best = Best(k)
        for batch in batches:
            best.add(*nearest(q, matrix(batch.column("vec")), batch.column("b_id").to_numpy(), k, best.within(len(q))))
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[best.rows]), pa.array(best.ids), pa.array(best.dists)], names=["q_id", "b_id", "dist"])

    return ranked(base.mapInArrow(run, _HITS), k)


def _block_pairs(queries: DataFrame, base: DataFrame, k: int, q_blocks: int, b_blocks: int) -> DataFrame:
    place = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("qb", place("q_id", q_blocks)).withColumn("bb", each(b_blocks))
    right = base.withColumn("bb", place("b_id", b_blocks)).withColumn("qb", each(q_blocks))

    def run(q: pa.Table, b: pa.Table) -> pa.Table:
        if not q.num_rows or not b.num_rows:
            return _no_hits()
        q_ids, q_vecs = q.column("q_id").to_numpy(), matrix(q.column("vec").combine_chunks())
        r, found, d = nearest(q_vecs, matrix(b.column("vec").combine_chunks()), b.column("b_id").to_numpy(), k)
        return pa.table({"q_id": q_ids[r], "b_id": found, "dist": d})

    return left.groupBy("qb", "bb").cogroup(right.groupBy("qb", "bb")).applyInArrow(run, _HITS)


def closest_lists(rows: DataFrame, centroids: DataFrame, id_column: str, k: int = 1, residuals: bool = False) -> DataFrame:
    """``id_column``, list_id, place (from 1), list_dist: the k lists of ``centroids(list_id, centroid)`` closest to each row's vec, and, if
    asked for, residual, the vector less the list's centroid.

    The model's size is counted first: up to ``MODEL_VALUES`` it goes to every task and rows stay where they are; a larger one meets the
    rows block by block, as in an exact search.
    """
    kind = rows.schema[id_column].dataType.simpleString()
    rows, centroids = rows.select(id_column, "vec").filter("vec IS NOT NULL"), centroids.select("list_id", "centroid")
    size = centroids.agg(F.count("*").alias("n"), F.max(F.size("centroid")).alias("d")).first()
    more = ", residual array<double>" if residuals else ""
    if size["n"] * (size["d"] or 0) > MODEL_VALUES:
        found = knn_exact(rows.select(F.col(id_column).cast("long").alias("q_id"), "vec"), centroids.select(F.col("list_id").alias("b_id"), F.col("centroid").alias("vec")), k, 1)
        out = found.select(F.col("q_id").cast(kind).alias(id_column), F.col("b_id").alias("list_id"), F.col("rank").cast("long").alias("place"), F.col("dist").alias("list_dist"))
        if not residuals:
            return out
        return out.join(rows, id_column).join(centroids, "list_id").select(id_column, "list_id", "place", "list_dist", F.expr("zip_with(vec, centroid, (x, y) -> x - y)").alias("residual"))
    model = centroids.collect()
    held = rows.sparkSession.sparkContext.broadcast((np.array([r[0] for r in model], np.int64), np.array([r[1] for r in model], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, centers = held.value
        at = {x: i for i, x in enumerate(lists.tolist())}
        for batch in batches:
            vecs = matrix(batch.column("vec"))
            r, found, d = nearest(vecs, centers, lists, k)
            place = np.arange(len(r)) - np.searchsorted(r, r) + 1
            columns = [batch.column(id_column).take(pa.array(r)), pa.array(found), pa.array(place), pa.array(d)]
            if residuals:
                left = vecs[r] - centers[[at[x] for x in found.tolist()]] if len(r) else np.zeros((0, 1))
                columns.append(rows_of(left))
            yield pa.RecordBatch.from_arrays(columns, names=[id_column, "list_id", "place", "list_dist", *["residual"] * residuals])

    return rows.mapInArrow(run, f"{id_column} {kind}, list_id long, place long, list_dist double{more}")


def rows_of(m: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def build_lists(base: DataFrame, centroids: DataFrame) -> DataFrame:
    """Inverted lists: b_id, list_id, vec."""
    return base.select("b_id", "vec").join(closest_lists(base, centroids, "b_id").select("b_id", "list_id"), "b_id")


def _in_lists(wanted: DataFrame, lists: DataFrame, column: str, payload: str, run, schema: str) -> DataFrame:
    """``run`` on every list's probes (q_id, place, ``column``) and vectors (b_id, ``payload``), as co-groups. A list of more than
    ``BASE_BLOCK`` vectors, or of as many probes, is cut into pieces by hash, and every piece of one side meets every piece of the other.
    The pieces are a row for each list, of which there are as many as centroids."""
    pieces = lambda df, name: df.groupBy("list_id").agg(F.ceil(F.count("*") / BASE_BLOCK).cast("int").alias(name))
    both = pieces(lists, "b_pieces").join(pieces(wanted, "q_pieces"), "list_id")
    each = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    left = wanted.join(both, "list_id").withColumn("qp", F.expr("cast(pmod(xxhash64(q_id), q_pieces) AS int)")).withColumn("bp", each("b_pieces"))
    right = lists.join(both, "list_id").withColumn("bp", F.expr("cast(pmod(xxhash64(b_id), b_pieces) AS int)")).withColumn("qp", each("q_pieces"))
    key = ["list_id", "qp", "bp"]
    return left.select(*key, "q_id", "place", column).groupBy(*key).cogroup(right.select(*key, "b_id", payload).groupBy(*key)).applyInArrow(run, schema)


def ivf_hits(queries: DataFrame, lists: DataFrame, centroids: DataFrame, k: int, nprobe: int) -> DataFrame:
    """q_id, place, b_id, dist: the k nearest of each of the ``nprobe`` lists closest to each query, and the list's place among them."""
    wanted = closest_lists(queries, centroids, "q_id", nprobe).select("q_id", "list_id", "place").join(queries.select("q_id", "vec"), "q_id")

    def run(q: pa.Table, b: pa.Table) -> pa.Table:
        if not q.num_rows or not b.num_rows:
            return _no_hits().append_column("place", pa.array([], pa.int64()))
        q_ids, ids, place = q.column("q_id").to_numpy(), b.column("b_id").to_numpy(), q.column("place").to_numpy()
        r, found, d = nearest(matrix(q.column("vec").combine_chunks()), matrix(b.column("vec").combine_chunks()), ids, k)
        return pa.table({"q_id": q_ids[r], "b_id": found, "dist": d, "place": place[r]})

    return _in_lists(wanted, lists, "vec", "vec", run, f"{_HITS}, place long")


def knn_ivf(queries: DataFrame, lists: DataFrame, centroids: DataFrame, k: int, nprobe: int) -> DataFrame:
    """Like ``knn_exact``, but only over the ``nprobe`` lists closest to each query: an equi-join of probes and lists."""
    return ranked(ivf_hits(queries, lists, centroids, k, nprobe).drop("place"), k)


def pq_encode(rows: DataFrame, codebook: DataFrame, id_column: str, subs: int, keep: str | None = None) -> DataFrame:
    """``id_column``, codes: for each of ``subs`` sub-vectors the nearest code of ``codebook(sub, code, centroid)`` (ties: the smaller); and
    the columns ``keep`` (their names and types), if given."""
    books = _books(codebook, subs)
    held = rows.sparkSession.sparkContext.broadcast(books)
    kind = rows.schema[id_column].dataType.simpleString()
    kept = [column.split()[0] for column in keep.split(", ")] if keep else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = np.split(matrix(batch.column("vec")), subs, axis=1) if batch.num_rows else []
            codes = [nearest(p, b, np.arange(len(b)), 1)[1] for p, b in zip(parts, held.value)]
            table = np.stack(codes, axis=1) if codes else np.zeros((0, subs), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(id_column), *map(batch.column, kept), rows_of(table.astype(np.int32))], names=[id_column, *kept, "codes"])

    ddl = f"{id_column} {kind}, " + (f"{keep}, " if keep else "") + "codes array<int>"
    return rows.select(id_column, *kept, "vec").filter("vec IS NOT NULL").mapInArrow(run, ddl)


def _books(codebook: DataFrame, subs: int) -> list[np.ndarray]:
    rows = sorted((r["sub"], r["code"], r["centroid"]) for r in codebook.collect())
    return [np.array([c for s, _, c in rows if s == i], np.float64) for i in range(subs)]


def build_pq_lists(base: DataFrame, centroids: DataFrame, codebook: DataFrame, subs: int, residuals: bool = False) -> DataFrame:
    """b_id, list_id, codes: inverted lists of product-quantised residuals, every vector's offset from its list's centroid; and, if asked for,
    residual."""
    near = closest_lists(base, centroids, "b_id", residuals=True).withColumn("vec", F.col("residual"))
    return pq_encode(near, codebook, "b_id", subs, keep="list_id bigint" + ", residual array<double>" * residuals)


def ivfpq_refined(queries: DataFrame, lists: DataFrame, centroids: DataFrame, codebook: DataFrame, candidates: int, k: int, nprobes: list[int], subs: int) -> DataFrame:
    """nprobe, q_id, b_id, dist: for each of ``nprobes`` the k nearest, by their vectors, of the ``candidates`` nearest by code over so many
    lists closest to each query; ``knn_ivfpq`` and ``reranked`` in one search for all of them. ``lists`` hold residuals, so that a list's
    task measures its candidates by their vectors too and no vector is joined to a hit."""
    held = queries.sparkSession.sparkContext.broadcast(_books(codebook, subs))
    wanted = closest_lists(queries, centroids, "q_id", max(nprobes), residuals=True)

    def run(q: pa.Table, b: pa.Table) -> pa.Table:
        if not q.num_rows or not b.num_rows:
            return _no_hits().append_column("place", pa.array([], pa.int64())).append_column("coded", pa.array([], pa.float64()))
        vecs = matrix(q.column("residual").combine_chunks())
        own = b.column("payload").combine_chunks()
        ids, codes, left = b.column("b_id").to_numpy(), matrix(own.field("codes")).astype(np.int64), matrix(own.field("residual"))
        r, at, coded = nearest_codes(vecs, held.value, np.argsort(np.argsort(ids, kind="stable"), kind="stable"), codes, candidates)
        at = np.argsort(ids, kind="stable")[at]
        steps = range(0, len(r), 500_000)
        d = np.concatenate([np.zeros(0), *(np.sqrt(((vecs[r[i : i + 500_000]] - left[at[i : i + 500_000]]) ** 2).sum(axis=1)) for i in steps)])
        return pa.table({"q_id": q.column("q_id").to_numpy()[r], "b_id": ids[at], "dist": np.round(d, DIGITS), "place": q.column("place").to_numpy()[r], "coded": coded})

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = list(batches)
        if not sum(t.num_rows for t in tables):
            return
        columns = [np.concatenate([t.column(c).to_numpy() for t in tables]) for c in ("q_id", "b_id", "dist", "place", "coded")]
        tables.clear()
        for nprobe in nprobes:
            q, b, d, _, coded = (c[columns[3] <= nprobe] for c in columns)
            top = first_of_each(q, b, coded, candidates)
            top = top[first_of_each(q[top], b[top], d[top], k)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), nprobe)), pa.array(q[top]), pa.array(b[top]), pa.array(d[top])], names=["nprobe", "q_id", "b_id", "dist"])

    payload = lists.select("b_id", "list_id", F.struct("codes", "residual").alias("payload"))
    met = _in_lists(wanted, payload, "residual", "payload", run, f"{_HITS}, place long, coded double")
    parts = max(queries.sparkSession.sparkContext.defaultParallelism, math.ceil(queries.count() * candidates * max(nprobes) / HIT_ROWS))
    return met.repartition(parts, "q_id").mapInArrow(best, f"nprobe long, {_HITS}")


def knn_ivfpq(queries: DataFrame, lists: DataFrame, centroids: DataFrame, codebook: DataFrame, k: int, nprobe: int, subs: int) -> DataFrame:
    """q_id, rank, b_id, dist: over the ``nprobe`` lists closest to each query, the distance of the query's residual to the residual that a
    code stands for, by table lookup."""
    books = _books(codebook, subs)
    held = queries.sparkSession.sparkContext.broadcast(books)
    wanted = closest_lists(queries, centroids, "q_id", nprobe, residuals=True)

    def run(q: pa.Table, b: pa.Table) -> pa.Table:
        if not q.num_rows or not b.num_rows:
            return _no_hits()
        q_ids = q.column("q_id").to_numpy()
        best = Best(k)
        best.add(*nearest_codes(matrix(q.column("residual").combine_chunks()), held.value, b.column("b_id").to_numpy(), matrix(b.column("codes").combine_chunks()).astype(np.int64), k))
        return pa.table({"q_id": q_ids[best.rows], "b_id": best.ids, "dist": best.dists})

    return ranked(_in_lists(wanted, lists, "residual", "codes", run, _HITS), k)


def reranked(hits: DataFrame, queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query's hits (q_id, b_id) by the exact distance of their vectors."""
    met = hits.select("q_id", "b_id").join(queries.select("q_id", F.col("vec").alias("_q")), "q_id").join(base.select("b_id", F.col("vec").alias("_b")), "b_id")
    dist = F.expr(f"round(sqrt(aggregate(zip_with(_q, _b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)), {DIGITS})")
    return ranked(met.select("q_id", "b_id", dist.alias("dist")), k)


def nearest_codes(queries: np.ndarray, books: list[np.ndarray], ids: np.ndarray, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of the k nearest codes of each query, ties to the smaller id: the nearest of the vectors that they stand for."""
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return nearest(queries, np.concatenate([book[codes[:, j]] for j, book in enumerate(books)], axis=1), ids, k)


def adc_search(queries: DataFrame, encoded: DataFrame, codebook: DataFrame, k: int, subs: int, query_block: int | None = None) -> DataFrame:
    """Like ``knn_exact`` on codes (b_id, codes) of whole vectors: the distance of a query to a code is that to the vector it stands for. A
    block of queries goes to all tasks; a task keeps k rows for a query, whatever it reads. More queries are taken block by block."""
    books, out = _books(codebook, subs), None
    blocks = max(1, math.ceil(queries.count() / (query_block or QUERY_BLOCK)))
    for i in range(blocks):
        own = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == i)
        block = own.select("q_id", "vec").filter("vec IS NOT NULL").collect()
        held = queries.sparkSession.sparkContext.broadcast((np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], np.float64).reshape(len(block), -1), books))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            q_ids, q, books = held.value
            best = Best(k)
            for batch in batches:
                if len(q) and batch.num_rows:
                    best.add(*nearest_codes(q, books, batch.column("b_id").to_numpy(), matrix(batch.column("codes")).astype(np.int64), k))
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[best.rows]), pa.array(best.ids), pa.array(best.dists)], names=["q_id", "b_id", "dist"])

        hits = encoded.select("b_id", "codes").mapInArrow(run, _HITS)
        out = hits if out is None else out.unionByName(hits)
    return ranked(out, k)
