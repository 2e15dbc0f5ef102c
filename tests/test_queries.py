"""Every query that has SQL against DuckDB, and the others for rows and stable columns."""

import os

import duckdb
import pandas as pd
import pytest
from kinmap.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def rows(df: pd.DataFrame) -> list:
    def plain(x):
        if isinstance(x, float) and x == int(x):
            return int(x)
        return x.item() if hasattr(x, "item") else x

    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_oracle(spark, con, name):
    ours = catalog.queries()[name](spark, SF).toPandas()
    theirs = con.execute(catalog.oracles()[name]).fetch_df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs) > 0
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracles())))
def test_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["q_image", "image_id", "pos", "norm"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_graph_json_rounds_as_its_sql(spark, con, monkeypatch):
    from kinmap.plans import files

    weights = [(0.710287 + 0.290713) / 2, 0.7484999999999999, 0.9984999999999999, 0.4995, 1.0, -0.5, -0.0005]
    edges = spark.createDataFrame([(i, 0, 1, w) for i, w in enumerate(weights)], "probe_id long, src long, dst long, weight double")
    monkeypatch.setattr(files, "kruskal_tree", lambda spark, sf: edges)
    ours = {r["probe_id"]: r["graph"].split('"relationshipConfidenceScore":')[1] for r in files.graph_json_text(spark, SF).collect()}
    theirs = con.execute("SELECT to_json({'w': round(unnest(?::DOUBLE[]), 3)})::VARCHAR", [weights]).fetchall()
    assert [ours[i] for i in range(len(weights))] == [r[0].split('"w":')[1] + "]}" for r in theirs]
