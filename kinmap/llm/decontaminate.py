"""Benchmark decontamination by winnowing: fingerprints of test items are looked up in documents, and hits are extended."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmap.llm.common import bounded_batches, Carried, saved, slices
from kinmap.llm.words import ALNUM, Words, listed, text_column, translated, words_of

#: Words of a k-gram. With windows of ``span - K + 1`` k-grams, every shared span of ``span`` words shares a fingerprint.
K = 5
SPAN = 10
#: Words of the items that a task holds at a time; more items are taken block by block.
BLOCK_WORDS = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)  # an odd multiplier


def word_hashes(words: Words) -> np.ndarray:
    """64-bit hashes of the words in order, from the distinct words."""
    import xxhash

    spelled = listed(words.vocabulary.cast(pa.binary()))
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in spelled), np.uint64, len(spelled))[words.codes]


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of each k consecutive words (rows are not told apart)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _BASE + hashes[j : j + n]
    return out ^ (out >> np.uint64(29))


def window_minima(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least k-gram hash (the rightmost of ties) of each ``window`` consecutive k-grams, distinct."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, at = grams[:n].copy(), np.arange(n)
    for j in range(1, window):
        lower = grams[j : j + n] <= least
        least = np.where(lower, grams[j : j + n], least)
        at = np.where(lower, np.arange(j, j + n), at)
    return at[np.concatenate(([True], at[1:] != at[:-1]))]  # they never step back


class Index:
    """Fingerprints of a block of items: of long items (``SPAN`` words or more) those that winnowing selects; a shorter item is
    one window, found by the hash of all its words."""

    def __init__(self, items: list[tuple[str, list[str]]], k: int = K, span: int = SPAN) -> None:
        self.k, self.span = k, span
        self.names = [name for name, _ in items]
        self.words = [words for _, words in items]
        self.long: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item, words in enumerate(self.words):
            if not words:
                continue
            got = words_of(pa.array([" ".join(words)]))
            hashes = word_hashes(got)
            if len(words) >= span:
                grams = gram_hashes(hashes, k)
                for at in window_minima(grams, span - k + 1).tolist():
                    self.long[int(grams[at])].append((item, at))
            else:
                self.short[len(words)][int(gram_hashes(hashes, len(words))[0])].append(item)
        self.long_keys = np.sort(np.fromiter(self.long, np.uint64, len(self.long)))
        self.short_keys = {m: np.sort(np.fromiter(of, np.uint64, len(of))) for m, of in self.short.items()}

    @staticmethod
    def among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Positions of the values that are keys."""
        if not len(keys) or not len(values):
            return np.zeros(0, np.int64)
        return np.flatnonzero(keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values)

    def hits(self, words: Words, hashes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, from, to, item): word spans of the slice that hold an occurring window, extended as far as the words agree."""
        spelled = listed(words.vocabulary)
        codes, offsets, rows = words.codes, words.offsets, words.rows
        if len(self.long_keys) and len(codes) >= self.k:
            grams = gram_hashes(hashes, self.k)
            chosen = window_minima(grams, self.span - self.k + 1)  # windows that cross rows only add to them
            chosen = chosen[rows[chosen] == rows[chosen + self.k - 1]]
            found = chosen[self.among(grams[chosen], self.long_keys)]
            done: dict[tuple[int, int], int] = {}  # (item, diagonal): end of the last span
            for at in found.tolist():
                row = int(rows[at])
                begin, end = int(offsets[row]), int(offsets[row + 1])
                for item, q in self.long[int(grams[at])]:
                    if done.get((item, at - q), -1) > at:
                        continue
                    own = self.words[item]
                    a, b = 0, 0
                    while at - a > begin and q - a > 0 and spelled[codes[at - a - 1]] == own[q - a - 1]:
                        a += 1
                    while at + b < end and q + b < len(own) and spelled[codes[at + b]] == own[q + b]:
                        b += 1
                    done[(item, at - q)] = at + b
                    if a + b >= self.span:
                        yield row, at - a, at + b, item
        for m, keys in self.short_keys.items():
            grams = gram_hashes(hashes, m)
            for at in self.among(grams, keys).tolist():
                if rows[at] == rows[at + m - 1]:
                    for item in self.short[m][int(grams[at])]:
                        if [spelled[c] for c in codes[at : at + m].tolist()] == self.words[item]:
                            yield int(rows[at]), at, at + m, item


_built: dict[str, Index] = {}


def built_index(name: str, items: list[tuple[str, str]], k: int, span: int) -> Index:
    """The index of a block of items, built once in each worker process; the worker keeps the last one."""
    if name not in _built:
        _built.clear()
        _built[name] = Index(list(zip([n for n, _ in items], item_words(pa.array([w for _, w in items], pa.string())))), k, span) if items else Index([], k, span)
    return _built[name]


def item_words(column: pa.Array) -> list[list[str]]:
    words = words_of(translated(text_column(column), ALNUM))
    spelled = listed(words.vocabulary)
    return [[spelled[c] for c in words.codes[a:b].tolist()] for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist())]


def judge(texts: pa.Array, blocks: Iterator[Index]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text its number of words, the merged hit spans (word positions) and the names of the occurring items."""
    words = words_of(translated(texts, ALNUM))
    hashes = word_hashes(words)
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
    names: dict[int, set[str]] = defaultdict(set)
    for block in blocks:
        for row, a, b, item in block.hits(words, hashes):
            spans[row].append((a, b))
            names[row].add(block.names[item])
    out = []
    for row, (n, begin) in enumerate(zip(words.counts.tolist(), words.offsets[:-1].tolist())):
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans.get(row, ())):
            if merged and a - begin <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], b - begin))
            else:
                merged.append((a - begin, b - begin))
        out.append((n, merged, sorted(names.get(row, ()))))
    return out


def item_blocks(items: DataFrame, key: str, text: str, block_words: int) -> list[DataFrame]:
    """The items, cut by hash into tables small enough for a task: each about ``block_words`` words (by their characters)."""
    chosen = items.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("name"), F.coalesce(text, F.lit("")).alias("words")).distinct()
    size = chosen.agg(F.sum(F.length("words"))).first()[0] or 0
    n = max(1, -(-size // (6 * block_words)))
    return [chosen] if n == 1 else [chosen.filter(F.pmod(F.xxhash64("name", "words"), F.lit(n)) == i) for i in range(n)]


def find_contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = K, span: int = SPAN, block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """One row a document: the columns ``keep`` (``key`` alone by default), n_words, n_hit, n_items, items (their ids as strings, sorted), hit_spans (word positions).

    Words are runs of digits, A-Z lower-cased, and characters beyond ASCII. A word is hit if it lies in an occurrence of ``span``
    consecutive words of an item, or of a whole shorter item. Null and empty texts and items have no words and no hits; a null
    item id is called "null"; items that share an id count once; repeated rows come back as they are. An empty table of items
    leaves every document clean. Extra columns are not read.

    Documents are read once, without a shuffle. The items of one block (its size is counted first) go to the tasks; with more
    items than a block holds, every block gets a pass over the documents and the passes' spans are merged by row.
    """
    if not 1 <= k <= span:
        raise ValueError("a k-gram must fit into the span")
    carried = Carried(docs, [key] if keep is None else keep)
    own = carried.names
    found_ddl = "n_words long, n_hit long, n_items long, items array<string>, hit_spans array<struct<begin:long,end:long>>"
    added = ["n_words", "n_hit", "n_items", "items", "hit_spans"]
    blocks = item_blocks(items, item_key, item_text, block_words)

    def one_pass(docs: DataFrame, block: DataFrame, row: bool) -> DataFrame:
        held, name = docs.sparkSession.sparkContext.broadcast([(name, words) for name, words in block.collect()]), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = built_index(name, held.value, k, span)
            kinds = [pa.int64()] * 3 + [pa.list_(pa.string()), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))]
            for batch in slices(batches, "_text"):
                got = judge(text_column(batch.column("_text")), iter([index]))
                columns = [[g[0] for g in got], [sum(b - a for a, b in g[1]) for g in got], [len(g[2]) for g in got], [g[2] for g in got], [[{"begin": a, "end": b} for a, b in g[1]] for g in got]]
                yield pa.RecordBatch.from_arrays([*([batch.column("_row")] if row else [*map(batch.column, own)]), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=[*(["_row"] if row else own), *added])

        read = bounded_batches(docs.select("_row", "_text") if row else docs)
        return read.mapInArrow(run, f"{'_row long' if row else carried.ddl}, {found_ddl}")

    chosen = docs.select(*carried.columns, F.col(text).alias("_text"))
    if len(blocks) == 1:
        return one_pass(chosen, blocks[0], False).select(*carried.restored, *added)
    numbered = saved(chosen.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    passes = saved(one_pass(numbered, blocks[0], True), "pass")
    for block in blocks[1:]:
        passes = passes.unionByName(saved(one_pass(numbered, block, True).filter("n_hit > 0"), "pass"))
    merged = passes.groupBy("_row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("hit_spans"))).alias("spans"),
    )
    step = """aggregate(spans, cast(array() AS array<struct<begin:bigint,end:bigint>>), (done, x) ->
      if(size(done) > 0 AND element_at(done, -1).end >= x.begin,
         concat(slice(done, 1, size(done) - 1), array(named_struct('begin', element_at(done, -1).begin, 'end', greatest(element_at(done, -1).end, x.end)))),
         concat(done, array(x))))"""
    merged = merged.select("_row", "n_words", "items", F.expr(step).alias("hit_spans"))
    return numbered.join(merged, "_row").select(
        *carried.restored, "n_words", F.expr("aggregate(hit_spans, 0L, (n, x) -> n + x.end - x.begin)").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "hit_spans"
    )

