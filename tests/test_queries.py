"""A selection of registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
NAMES = [
    "movements_keyed", "movements_minute", "correlation_spearman", "bucketize", "optimal_boundaries", "expanding_folds", "backtest", "walk_forward",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "lineitem", "orders"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(round(float(v), 5) if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, DIR).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
