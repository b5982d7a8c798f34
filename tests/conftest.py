"""One session for all tests and a way to compare a query with its SQL."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    conf = {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return DATA


def rows_of(df) -> list[str]:
    names = sorted(df.columns)
    return sorted(repr(tuple(r)) for r in df.select(*names).collect())


def sql_rows(sql: str, views: dict[str, str]) -> list[str]:
    """Rows of the SQL over Parquet views, columns by name."""
    import duckdb

    connection = duckdb.connect()
    for name, path in views.items():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())


@pytest.fixture(scope="session")
def views() -> dict[str, str]:
    return {t: f"{DATA}/{t}.parquet" for t in TABLES}
