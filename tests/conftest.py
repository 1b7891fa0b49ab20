import os

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    d = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    return d


@pytest.fixture(scope="session")
def duck(small):
    import glob

    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}{'/*' if os.path.isdir(p) else ''}')")
    return c


def cell(x):
    import pandas as pd

    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(cell, x)) + "]"
    if x is None or x is pd.NaT or x is pd.NA or x != x:
        return "NULL"
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return repr(round(float(x), 6) + 0.0)
    return str(x)


@pytest.fixture(scope="session")
def same_rows():
    def compare(df, relation):
        got, want = df.toPandas(), relation.df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        rows = lambda d: sorted(tuple(map(cell, r)) for r in d[cols].astype(object).itertuples(index=False, name=None))
        assert rows(got) == rows(want)

    return compare
