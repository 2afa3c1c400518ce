"""Registered graph queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from weft import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = [q for q in catalog.ORACLE_SQL if q.startswith(("sparql", "to_", "filter", "degree", "merge", "diff", "subgraph", "remove", "update", "trace", "validate", "all_simple", "read"))]


def rows(df):
    df = df[sorted(df.columns)].astype(object).where(lambda x: x.notna(), None)
    return sorted((tuple(r) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["graphml_round_trip", "gexf_round_trip", "adjacency_round_trip", "json_round_trip"])
def test_no_limit(spark, sf, duck, monkeypatch, name):
    """Whole tables of any size go round: no reader that refuses long text is in the way."""
    from weft.sources import documents

    monkeypatch.setattr(documents, "_capped", lambda data, limit, what: pytest.fail(f"bounded {what}"))
    assert rows(catalog.QUERIES[name](spark, sf).toPandas()) == rows(duck.sql(catalog.ORACLE_SQL[name]).df())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
