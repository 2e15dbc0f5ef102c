"""Language identification by Bayesian fusion: text likelihoods, the declared language, and host priors smoothed over suffix and world."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmap.llm.common import bounded_batches, Carried, saved, skew_join, slices
from kinmap.llm.words import text_column, translated

LANGUAGES = ("de", "en", "es", "fr")
UNKNOWN = "und"
#: Labelled rows that the text model is fitted on, for each language, each text once (about: they are chosen by hash).
SAMPLE = 500
BUCKETS = 1 << 15
#: Overlapping trigrams are no independent evidence: their log likelihoods count by this.
TEMPER = 1 / 3
#: Rows that the prior one level up is worth, and those that the assumption that declarations are right is worth.
SMOOTHING = 20.0
UNKNOWN_PRIOR = 0.01
HONEST = 0.9
#: Hosts up to this number are broadcast (a row is under 200 bytes); beyond, they are joined by shuffle.
BROADCAST_HOSTS = 50_000

#: A-Z lower-cased; ASCII other than letters is a space.
_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of each text that hold a letter, and the offsets of the texts in them."""
    clean = translated(texts, _LETTERS)
    ends = np.frombuffer(clean.buffers()[1], np.int32).astype(np.int64)
    data = np.frombuffer(clean.buffers()[2] or b"", np.uint8).astype(np.uint32)
    n = max(len(data) - 2, 0)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    a, b, c = data[:n], data[1 : n + 1], data[2 : n + 2]
    mixed = ((a << 16) | (b << 8) | c) * np.uint32(0x9E3779B1)
    buckets = (mixed >> np.uint32(17)).astype(np.int64)
    good = (b != 0x20) | ((a != 0x20) & (c != 0x20))  # one space side by side is a word's edge; more say nothing
    crossing = np.concatenate([ends[1:-1] - 1, ends[1:-1] - 2])
    good[crossing[(crossing >= 0) & (crossing < n)]] = False
    kept = np.concatenate(([0], np.cumsum(good)))
    return buckets[good], kept[np.minimum(ends, n)]


@dataclass(frozen=True)
class TextModel:
    """log_p[bucket, class]: the languages, then the unknown class, under which all buckets are alike."""

    languages: tuple[str, ...]
    log_p: np.ndarray

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log likelihood of each text in each class, and its number of trigrams."""
        buckets, offsets = grams(texts)
        out = np.zeros((len(texts), self.log_p.shape[1]))
        for at in range(0, len(buckets), 1 << 20):  # one very long text needs no more memory than many short ones
            part = self.log_p[buckets[at : at + (1 << 20)]]
            total = np.concatenate((np.zeros((1, part.shape[1])), np.cumsum(part, axis=0, dtype=np.float64)))
            cut = np.clip(offsets - at, 0, len(part))
            out += total[cut[1:]] - total[cut[:-1]]
        return TEMPER * out, np.diff(offsets)


def declared_class(column: Column, languages: tuple[str, ...]) -> Column:
    """Number of the declared language (``de``, ``de-AT``, ``de_AT``, any case; the whole first subtag); others and none share the last."""
    short = F.element_at(F.split(F.lower(F.trim(column)), "[-_]"), 1)
    out = F.lit(len(languages))
    for i, name in enumerate(languages):
        out = F.when(short == name, F.lit(i)).otherwise(out)
    return out


def fit(docs: DataFrame, text: str, declared: str, languages: tuple[str, ...] = LANGUAGES, sample: int = SAMPLE) -> TextModel:
    """Trigram counts of about ``sample`` texts of each declared language, chosen by their hash; copies count once, so that neither equal
    keys nor equal texts make the sample empty or large. All are taken where there are fewer."""
    named = docs.select(F.col(f"`{text}`").alias("_text"), declared_class(F.col(declared), languages).alias("_class")).filter((F.col("_class") < len(languages)) & F.col("_text").isNotNull())
    named = named.withColumn("_hash", F.xxhash64("_text"))
    n = {r["_class"]: r["n"] for r in named.groupBy("_class").agg(F.approx_count_distinct("_hash").alias("n")).collect()}
    chosen = F.lit(False)
    for i in range(len(languages)):
        share = min(1.0, sample / max(n.get(i, 0), 1))
        chosen = chosen | ((F.col("_class") == i) & (F.col("_hash") <= F.lit(int(-(2**63) + share * (2**64 - 1024))) if share < 1 else F.col("_class") == i))
    rows = named.filter(chosen).groupBy("_class", "_hash").agg(F.first("_text").alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(languages) * BUCKETS, np.int64)
        for batch in slices(batches, "_text"):
            buckets, offsets = grams(text_column(batch.column("_text")))
            held += np.bincount(np.repeat(batch.column("_class").to_numpy().astype(np.int64), np.diff(offsets)) * BUCKETS + buckets, minlength=len(held))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["cell", "n"])

    cells = bounded_batches(rows.select("_text", "_class")).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = np.full(len(languages) * BUCKETS, 0.05)
    for cell in cells:
        counts[cell["cell"]] += cell["n"]
    counts = counts.reshape(len(languages), BUCKETS)
    log_p = np.log(counts / counts.sum(axis=1, keepdims=True))
    return TextModel(tuple(languages), np.vstack((log_p, np.full(BUCKETS, -math.log(BUCKETS)))).T.astype(np.float32).copy())


def suffix_of(host: Column) -> Column:
    return F.when(F.instr(host, ".") > 0, F.lower(F.substring_index(host, ".", -1))).otherwise(F.lit(""))


def evidence(rows: DataFrame, model: TextModel, world: list[float]) -> DataFrame:
    """Votes of ``_text`` under the world's priors, counted by host, suffix, declared class and class: one row for each that occurs."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            scores, n = model.scores(text_column(batch.column("_text")))
            best = np.where(n > 0, np.argmax(scores + np.log(world), axis=1), len(model.languages))
            yield pa.RecordBatch.from_arrays([batch.column("_host"), batch.column("_suffix"), batch.column("_declared"), pa.array(best, pa.int32())], names=["host", "suffix", "declared", "class"])

    return bounded_batches(rows.select("_host", "_suffix", "_declared", "_text")).mapInArrow(vote, "host string, suffix string, declared int, class int").groupBy("host", "suffix", "declared", "class").agg(F.count("*").alias("n"))


def host_priors(votes: DataFrame, classes: int, broadcast_rows: int = BROADCAST_HOSTS) -> DataFrame:
    """(host, n, prior): a host's votes, smoothed by its suffix, whose votes are smoothed by all votes. Up to ``broadcast_rows`` suffixes are
    broadcast; more are joined by shuffle, those of many hosts apart."""
    each = [F.sum(F.when(F.col("class") == i, F.col("n")).otherwise(0)).cast("double").alias(f"c{i}") for i in range(classes)]
    names = [f"c{i}" for i in range(classes)]
    world = votes.agg(*each).first()
    total = sum(world[c] or 0.0 for c in names)
    base = [((world[c] or 0.0) + SMOOTHING / classes) / (total + SMOOTHING) for c in names]
    hosts = saved(votes.groupBy("host", "suffix").agg(*each, F.sum("n").alias("n")), "hosts")
    suffixes = hosts.groupBy("suffix").agg(*(F.sum(c).alias(c) for c in names), F.count("*").alias("_hosts"))
    mass = sum((F.col(c) for c in names), F.lit(0.0))
    above = F.array(*((F.col(c) + SMOOTHING * b) / (mass + SMOOTHING) for c, b in zip(names, base)))
    suffixes = saved(suffixes.select("suffix", "_hosts", above.alias("above")), "suffixes")
    size = suffixes.agg(F.count("*").alias("suffixes"), F.coalesce(F.sum("_hosts"), F.lit(0)).alias("hosts")).first()
    if size["suffixes"] <= broadcast_rows:
        hosts = hosts.join(F.broadcast(suffixes.drop("_hosts")), "suffix")
    else:
        hosts = skew_join(hosts, suffixes, "suffix", "_hosts", size["hosts"])
    return hosts.select("host", "n", F.array(*((F.col(c) + SMOOTHING * F.col("above")[i]) / (mass + SMOOTHING) for i, c in enumerate(names))).alias("prior"))


def declared_table(votes: DataFrame, classes: int) -> np.ndarray:
    """P(declared | class) from all votes; without votes, declarations are right in ``HONEST`` of all cases."""
    counts = np.zeros((classes, classes))
    for row in votes.groupBy("declared", "class").agg(F.sum("n").alias("n")).collect():
        counts[row["declared"], row["class"]] = row["n"]
    assumed = np.where(np.eye(classes, dtype=bool), HONEST, (1 - HONEST) / (classes - 1))
    return (counts + SMOOTHING * assumed) / (counts.sum(axis=0) + SMOOTHING)


def identify(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    declared: str = "lang",
    host: str = "source",
    languages: tuple[str, ...] = LANGUAGES,
    keep: list[str] | None = None,
    min_posterior: float = 0.5,
    model: TextModel | None = None,
    broadcast_hosts: int = BROADCAST_HOSTS,
) -> DataFrame:
    """The columns ``keep`` (``key`` alone by default) with language, posterior, text_language and accepted, a row for each row.

    A row is rejected (not accepted) if its class is ``und`` (no language of the list explains its text better than chance, as for
    null, empty or letterless texts) or its posterior is under ``min_posterior``. Null hosts and null declarations are values of
    their own; null keys and repeated rows come back as they are; an empty table gives an empty result. Columns named like the
    added ones may not be in ``keep``; further columns are not read.

    Texts are read three times: a bounded sample for the text model, all for the votes, all for the verdicts. Votes are grouped by
    host before they are shuffled, so that a hot host is a few rows; priors go back to rows by broadcast up to
    ``broadcast_hosts`` hosts, else by a join that takes hot hosts apart.
    """
    keep = [key] if keep is None else keep
    added = ["language", "posterior", "text_language", "accepted"]
    if set(keep) & set(added):
        raise ValueError(f"columns {added} are added")
    model = model or fit(docs, text, declared, languages)
    names = (*model.languages, UNKNOWN)
    world = [(1 - UNKNOWN_PRIOR) / (len(names) - 1)] * (len(names) - 1) + [UNKNOWN_PRIOR]
    where = F.lower(F.coalesce(F.col(host), F.lit("")))
    carried = Carried(docs, keep)
    own = carried.names
    rows = docs.select(*carried.columns, F.col(text).alias("_text"), where.alias("_host"), suffix_of(where).alias("_suffix"), declared_class(F.col(declared), model.languages).alias("_declared"))
    votes = saved(evidence(rows, model, world), "votes")
    claims = np.log(declared_table(votes, len(names)))
    priors = saved(host_priors(votes, len(names), broadcast_hosts).withColumnRenamed("host", "_host"), "priors")
    size = priors.agg(F.count("*").alias("hosts"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    if size["hosts"] <= broadcast_hosts:
        joined = rows.join(F.broadcast(priors.drop("n")), "_host", "left")
    else:
        joined = skew_join(rows, priors, "_host", "n", size["rows"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            texts = text_column(batch.column("_text"))
            scores, n = model.scores(texts)
            prior = np.log(batch.column("prior").flatten().to_numpy().reshape(-1, len(names)))
            fused = scores + claims[batch.column("_declared").to_numpy()] + prior
            fused -= fused.max(axis=1, keepdims=True)
            share = np.exp(fused)
            share /= share.sum(axis=1, keepdims=True)
            best = np.where(n > 0, share.argmax(axis=1), len(names) - 1)
            sure = np.where(n > 0, share[np.arange(len(best)), best], 1.0)
            alone = np.where(n > 0, np.argmax(scores + np.log(world), axis=1), len(names) - 1)
            accepted = (best < len(names) - 1) & (sure >= min_posterior)
            listed = pa.array(names)
            yield pa.RecordBatch.from_arrays([*map(batch.column, own), listed.take(pa.array(best)), pa.array(sure), listed.take(pa.array(alone)), pa.array(accepted)], names=[*own, *added])

    judged = bounded_batches(joined.select(*carried.names, "_text", "_declared", "prior")).mapInArrow(judge, f"{carried.ddl}, language string, posterior double, text_language string, accepted boolean")
    return judged.select(*carried.restored, *added)


def markup_language(html: Column) -> Column:
    """The language that a page's html element declares, or null."""
    return F.nullif(F.regexp_extract(html, r"(?i)<html\b[^>]*?(?<![\w:-])lang\s*=\s*[\"']?([A-Za-z_-]+)", 1), F.lit(""))


def host_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))
