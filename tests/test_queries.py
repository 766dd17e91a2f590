import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tallyspark import queries as engine

from conftest import SAMPLES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SAMPLES}/{t}.parquet'")
    return con


def same(got, want):
    got, want = (f[sorted(f.columns)].sort_values(sorted(f.columns)).reset_index(drop=True) for f in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    same(engine.queries()[name](spark, SAMPLES).toPandas(), duck.sql(engine.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() == spark.read.parquet(f"{SAMPLES}/part.parquet").count()
    assert set(entry.oracle_sql()) <= set(entry.queries())
