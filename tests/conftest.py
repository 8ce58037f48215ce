"""One session for all tests, and the driver's tables as DuckDB views."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows_of(frame) -> list[tuple]:
    """Rows of a pandas frame in a form that both engines agree on, columns by name."""
    import pandas as pd

    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if hasattr(v, "tolist"):
            v = v.tolist()
        return float(f"{v:.9g}") if isinstance(v, float) else v

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=repr)


def same(spark_frame, sql_frame) -> None:
    assert sorted(spark_frame.columns) == sorted(sql_frame.columns)
    a, b = rows_of(spark_frame), rows_of(sql_frame)
    norm = lambda rows: sorted((tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in rows), key=repr)
    assert norm(a) == norm(b)
