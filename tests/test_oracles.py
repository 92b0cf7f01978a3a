"""Every query with an oracle against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from larkspur.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in TABLES.split():
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name not in catalogue.ORACLE_SQL:
        return
    want = duck.execute(catalogue.ORACLE_SQL[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    text = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert text(got).equals(text(want))


def test_entry(spark):
    assert entry.entry(spark).columns == ["idx", "depth", "test"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
