"""The registered queries of the training-data operators, over whole tables: against DuckDB, or their rows."""

import os

import duckdb
import pytest

from patchmill.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_against_sql(spark, duck, name):
    a, b = queries.queries()[name](spark, SF).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b) > 0
    key = lambda d: sorted(map(str, d[cols].astype(object).itertuples(index=False, name=None)))
    assert key(a) == key(b)


@pytest.mark.parametrize("name", ["p2_counts", "p3_percentiles", "p5_subset", "p6_clean", "p7_shares", "p7_records", "p8_shared"])
def test_rows(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


def test_subset_sizes(spark, duck):
    got = {(r.category, r.layer): r["count"] for r in queries.p5_subset(spark, SF).groupBy("category", "layer").count().collect()}
    want = duck.sql("""
        WITH v AS (SELECT DISTINCT lower(trim(category)) AS c, layer, embedding FROM prototype_embeddings
                   WHERE len(embedding) = 32 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 32 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
        SELECT c, v.layer, greatest(1, (count(*) * any_value(subset_permille) + 500) // 1000) FROM v JOIN subset_targets t ON t.category = c AND t.layer = v.layer GROUP BY ALL""").fetchall()
    assert got == {(c, layer): n for c, layer, n in want}
