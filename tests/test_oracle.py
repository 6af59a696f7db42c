"""Every query with a SQL twin gives the same rows as it."""

import duckdb
import pytest

from groundwork import registry
from groundwork.views import TABLES

registry.load_all()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, data, name):
    df = registry.queries()[name](spark, data)
    answer = duck.execute(SQL[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(answer.fetchall(), columns)
