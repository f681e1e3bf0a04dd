import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return SF


def _plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    return v.item() if hasattr(v, "item") else v


def same_as_sql(df, sql: str, folder: str) -> None:
    """Rows of df are those of the SQL over the folder's tables, whatever the order."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    got = con.sql(sql)
    assert sorted(got.columns) == sorted(df.columns)
    at = [got.columns.index(c) for c in sorted(got.columns)]
    want = sorted(repr(tuple(_plain(r[i]) for i in at)) for r in got.fetchall())
    have = sorted(repr(tuple(map(_plain, r))) for r in df.select(*sorted(df.columns)).collect())
    assert have == want
