"""A training corpus from ``documents``: language ID, near-dedup, decontamination, PII redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and hands it to the
next. All but the last return the columns of ``docs``, whatever they are named. A row's doc_id names its document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmap.llm.common import drop_scratch, saved, scratch_mark, skew_join, table
from kinmap.llm.decontaminate import find_contamination
from kinmap.llm.langid import identify
from kinmap.llm.packing import pack_documents
from kinmap.llm.pii import find_pii
from kinmap.llm.jaccard import similar_documents


#: Names of removed rows (16 bytes each) that go to all tasks; more meet the documents by shuffle.
BROADCAST_ROWS = 1_000_000


def _nested(docs: DataFrame, *read: str) -> DataFrame:
    """The row as one column, beside the columns that an operator reads."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(F.col(f"`{c}`").alias(f"r_{c}") for c in read))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is none of the known ones or is uncertain; null and letterless texts go."""
    found = identify(_nested(docs, "doc_id", "text", "lang", "source"), "r_doc_id", "r_text", "r_lang", "r_source", keep=["row"])
    return found.filter("accepted").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8 or more): that with the smallest doc_id (rows
    without one come last; of several texts under one doc_id, that with the least hash). Rows that are equal in all columns are one
    document. Nothing else goes: a row is told by its doc_id and the hash of all its columns (but maps), whatever others share its doc_id.
    """
    own = [F.col("row").getField(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = _nested(docs, "doc_id", "text").withColumn("id", F.xxhash64(*own))
    begin = scratch_mark()
    found = similar_documents(rows, key="id", text="r_text", keep=["id", "r_doc_id"])
    upto, found = scratch_mark(), saved(found, "near")
    drop_scratch(begin, upto)  # sets, sketches and links are not read again
    order = F.struct(F.col("r_doc_id").isNull().alias("last"), "r_doc_id", "id")
    groups = saved(found.groupBy("component_id").agg(F.min(order).alias("best"), F.count("*").alias("n")).filter("n > 1"), "groups")
    total = found.count()
    marked = skew_join(found, groups, "component_id", "n", total).filter("best IS NOT NULL")
    best = F.col("best.id").eqNullSafe(F.col("id")) & F.col("best.r_doc_id").eqNullSafe(F.col("r_doc_id"))
    told = saved(marked.groupBy("id", "r_doc_id").agg(F.max(best).alias("stays"), F.count("*").alias("n")), "told")
    same = lambda a, b: (a["id"] == b["id"]) & a["r_doc_id"].eqNullSafe(b["r_doc_id"])
    removed, repeated = told.filter("NOT stays").select("id", "r_doc_id"), told.filter("stays AND n > 1").select("id", "r_doc_id")
    if removed.count() <= BROADCAST_ROWS:
        removed = F.broadcast(removed)
    kept = rows.join(removed, same(rows, removed), "left_anti")
    if not repeated.isEmpty():
        once = kept.join(repeated, same(kept, repeated), "left_semi").dropDuplicates(["id", "r_doc_id"])
        kept = kept.join(repeated, same(kept, repeated), "left_anti").unionByName(once)
    return kept.select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold 10 consecutive words of a benchmark item, or a whole shorter item."""
    found = find_contamination(_nested(docs, "text"), table(spark, sf_dir, "benchmark"), text="r_text", keep=["row"])
    return found.filter("n_hit = 0").select("row.*")


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its personal data and secrets become ``<KIND>``, and n_chars, if there is one, follows the text."""
    found = find_pii(_nested(docs, "text"), text="r_text", keep=["row"])
    new = {"text": F.col("redacted_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("redacted_text").cast(docs.schema["n_chars"].dataType)
    return found.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_pii", redact_pii),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no tokenizer, and no fused language evidence; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
