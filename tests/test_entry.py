import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
QUERIES = entry_module.QUERIES
ORACLE_QUERIES = entry_module.queries()
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("events", "documents", "conversations", "pages", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(frame: pd.DataFrame):
    frame = frame[sorted(frame.columns)]
    cells = (["∅" if pd.isna(v) else str(v) for v in r] for r in frame.itertuples(index=False))
    return sorted(map(tuple, cells))


def test_every_query_has_sql():
    assert set(QUERIES) == set(entry_module.ORACLES) == set(ORACLES) & set(QUERIES)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["group_key", "label", "row_count", "first_ord"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, db, name):
    got = ORACLE_QUERIES[name](spark, SF).toPandas()
    want = db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
