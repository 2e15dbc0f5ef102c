"""The registered queries against DuckDB where SQL can express them, and the pipeline against its parts."""

import os
import random

import corpus_pipeline
import duckdb
import pytest
from kinmap.llm import queries
from pyspark.sql import functions as F

from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    ours = queries.QUERIES[name](spark, SF).toPandas()
    theirs = con.execute(queries.ORACLES[name]).fetch_df()[list(ours.columns)]
    assert sorted(map(tuple, ours.to_numpy().tolist()), key=repr) == sorted(map(tuple, theirs.to_numpy().tolist()), key=repr)


def test_each_operator_has_its_query():
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in queries.QUERIES)] == []


def test_pages_language(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    out = {r["page_id"]: r for r in queries.pages_language(spark, SF).collect()}
    assert len(out) == pages.count()
    declared = {r["page_id"]: r["html"].split('lang="')[1][:2] for r in pages.collect()}
    assert sum(out[k]["language"] == v for k, v in declared.items()) >= 0.95 * len(out)


def test_pipeline_stages(spark):
    passage = "the quick brown fox jumps over the lazy dog and then it rests for a long while"
    base = spark.read.parquet(f"{SF}/documents.parquet")
    added = brute.rows(spark, [(900_001, "See " * 3 + passage), (900_002, None), (900_003, "write to me at one.two@mail.example.com about the thing that was said for all of us")])
    docs = base.unionByName(added.select(base.columns)).withColumn("language", F.lit("extra")).withColumn("row", F.lit(1))
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "near_dedup", "decontaminate", "redact_pii", "best_fit_packing"]

    first = corpus_pipeline.saved(steps["language_id"](spark, docs, SF), "t")
    assert first.columns == columns and first.filter("doc_id = 900002").isEmpty() and first.count() >= base.count()

    second = corpus_pipeline.saved(steps["near_dedup"](spark, first.unionByName(first.filter("doc_id < 20")), SF), "t")
    groups = brute.alike_groups([(r["doc_id"], r["text"]) for r in first.select("doc_id", "text").collect()])
    assert second.columns == columns
    assert sorted(r[0] for r in second.select("doc_id").collect()) == sorted(set(groups.values()))

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    third = corpus_pipeline.saved(steps["decontaminate"](spark, second, SF), "t")
    clean = sorted(r["doc_id"] for r in second.collect() if not brute.contamination(r["text"], items)[1])
    assert third.columns == columns and sorted(r[0] for r in third.select("doc_id").collect()) == clean

    fourth = corpus_pipeline.saved(steps["redact_pii"](spark, third, SF), "t")
    texts = {r["doc_id"]: r for r in fourth.collect()}
    assert fourth.columns == columns and sorted(texts) == clean
    assert "<EMAIL>" in texts[900_003]["text"] and texts[900_003]["n_chars"] == len(texts[900_003]["text"])

    fifth = steps["best_fit_packing"](spark, fourth, SF)
    assert sorted({r[0] for r in fifth.select("doc_id").collect()}) == clean


def test_near_dedup_removes_only_copies(spark):
    """Rows that share a doc_id, repeat, have no doc_id, or have columns named like the stage's own."""
    rng = random.Random(2)
    text = {k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for k in "abcd"}
    near = {k: t.rsplit(" ", 1)[0] + " changed" for k, t in text.items()}
    rows = [(1, text["a"]), (5, near["a"]), (5, text["b"]), (8, near["b"]), (7, text["c"]), (7, text["d"]), (7, text["d"]), (None, near["c"]), (None, "alone here"), (None, "alone here"), (9, None), (9, "")]
    docs = spark.createDataFrame([(d, t, "x", i % 2) for i, (d, t) in enumerate(rows)], "doc_id long, text string, _again string, id long").repartition(3)
    out = corpus_pipeline.near_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    wanted = [(1, text["a"]), (5, text["b"]), (7, text["c"]), (7, text["d"]), (None, "alone here")]
    assert sorted(((d, t) for d, t in kept if d != 9), key=repr) == sorted(wanted, key=repr)
    assert sum(d == 9 for d, _ in kept) == 1
    plain = corpus_pipeline.redact_pii(spark, docs.filter("doc_id = 1"), SF)
    assert plain.columns == docs.columns and plain.count() == 1


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, SF), "none")
        assert docs.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_near_dedup_keeps_no_tables_but_its_own(spark):
    from kinmap.llm import common

    rows = [(i, f"{i % 7} one two three four five six seven eight nine {i % 5}") for i in range(40)]
    begin = common.scratch_mark()
    assert corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).count() == 35
    left = [path.rsplit("/", 1)[1].split("-")[0] for _, path in common._scratch[begin:] if path]
    assert left == ["near", "groups", "told"]


def test_near_dedup_decides_what_the_later_stages_read(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = docs.filter("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, name: docs.unionByName(copies) if name == "documents" else common_table(s, d, name))
    common_table = lambda s, d, name: s.read.parquet(f"{d}/{name}.parquet")
    with_it = corpus_pipeline.run(spark, SF).filter("doc_id >= 1000000").count()
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, f) for n, f in corpus_pipeline.STAGES if n != "near_dedup"])
    assert with_it == 0 < corpus_pipeline.run(spark, SF).filter("doc_id >= 1000000").count()
