"""Each registered query with an SQL text equals DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from strataq.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, D).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(db.sql(ORACLES[name]).df())
    else:
        assert len(got)
