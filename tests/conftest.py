import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from palimpsest.session import local_session

    s = local_session(4, spark_sql_shuffle_partitions="4", spark_driver_memory="3g")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        p = f"{SF}/{f}"
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="session")
def same(spark, sf, duck):
    """Compares a query with its SQL, whatever the order of rows and columns."""

    def check(f, sql):
        df = f(spark, sf)
        names = sorted(df.columns)
        ours = sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=str)
        out = duck.sql(sql)
        at = [out.columns.index(c) for c in names]
        assert sorted(out.columns) == names
        assert ours == sorted((tuple(_plain(r[i]) for i in at) for r in out.fetchall()), key=str)

    return check
