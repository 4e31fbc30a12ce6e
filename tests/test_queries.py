"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from matchlake.plans import flows, oracle, queries

QUERIES, SQL = queries.QUERIES | flows.QUERIES, oracle.SQL | flows.SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v).__name__), v) for v in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = ordered(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    theirs = ordered(tuple(row[i] for i in at) for row in rel.fetchall())
    assert ours == theirs
    assert ours or name == "first"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert rows and all(not isinstance(v, float) or math.isfinite(v) for r in rows for v in r)
