"""Every registered query with SQL, over whole tables, against DuckDB."""

import os
from decimal import Decimal

import duckdb
import pytest

from patchmill.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    return repr(float(v)) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else repr(v)


def same(spark_df, relation):
    cols = sorted(spark_df.columns)
    assert cols == sorted(relation.columns)
    a = sorted(tuple(plain(r[c]) for c in cols) for r in spark_df.collect())
    at = [relation.columns.index(c) for c in cols]
    b = sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
    assert len(a) == len(b)
    assert a == b


@pytest.mark.parametrize("name", [n for n in registry.queries() if n in registry.oracle_sql()])
def test_query(spark, duck, name):
    same(registry.queries()[name](spark, SF), duck.sql(registry.oracle_sql()[name]))


def test_all_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in registry.oracle_sql()])
def test_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
