from __future__ import annotations

import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{folder}/shared").config("spark.sql.warehouse.dir", f"{folder}/warehouse").config("spark.local.dir", folder)
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows_of(df) -> list:
    """Rows as strings, by column name, in order: what two engines must agree on."""
    import pandas as pd

    def show(v):
        if v is None or (isinstance(v, float) and pd.isna(v)) or v is pd.NA or v is pd.NaT:
            return "null"
        if isinstance(v, float):
            return repr(float(v) + 0.0)
        if hasattr(v, "__len__") and not isinstance(v, str):
            return str([show(x) for x in v])
        return str(v)

    cols = sorted(df.columns)
    return [cols, *sorted(tuple(show(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))]
