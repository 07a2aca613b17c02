"""Every registered query against its SQL on the smallest tables."""

import numbers

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.plans import registry
from tessera.sources.tables import NAMES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]

    def cell(v):
        if pd.isna(v):
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return f"{float(v):.6f}" if isinstance(v, numbers.Number) else str(v)

    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, FOLDER).toPandas()
    want = duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_deadlock_cycles_of_any_length_and_late_events(spark, tmp_path):
    waits = [(1, 2), (2, 3), (3, 1), (5, 6), (6, 5), (7, 8)]
    rows = [(41 * 20 + y, x) for x, y in waits] * 2
    spark.createDataFrame(rows, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = registry.QUERIES["deadlock_cycles"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, False), (1, 3, False), (2, 3, False), (5, 6, True)]
