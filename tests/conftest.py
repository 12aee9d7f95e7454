import os
import sys

import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ.setdefault("PYTHONPATH", ROOT)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def small():
    return SMALL


def cell(v):
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, bool) or str(v) in ("True", "False"):
        return str(v)
    if isinstance(v, float):
        return repr(round(float(v), 6)) if v != int(v) else str(int(v))
    return str(int(v)) if hasattr(v, "__int__") and not isinstance(v, str) else str(v)


@pytest.fixture(scope="session")
def same_as_sql(spark, small):
    """Asserts that a registered query and its SQL give the same rows."""
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(small):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{small}/{t}'")

    def rows(frame):
        names = sorted(frame.columns)
        return names, sorted((tuple(cell(v) for v in r) for r in frame[names].itertuples(index=False)), key=str)

    def check(query, sql):
        got, want = rows(query(spark, small).toPandas()), rows(con.execute(sql).df())
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        assert got[1] == want[1]

    return check
