"""Queries with a SQL twin give the same rows as it."""

import duckdb
import pytest

from groundwork.llm import registry

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, data, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    answer = c.execute(registry.oracle_sql()[name])
    columns = [x[0] for x in answer.description]
    df = registry.queries()[name](spark, data)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, answer.fetchall()))
