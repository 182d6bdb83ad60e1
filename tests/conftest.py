"""One local session for all tests, and the comparison of a query with its SQL."""

from __future__ import annotations

import os
import sys
import tempfile

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
# Workers import what tests define.
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(HERE), HERE, os.environ.get("PYTHONPATH", "")])

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="spark-")
    builder = SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
    session = builder.config("spark.ui.enabled", "false").config("spark.checkpoint.dir", f"file://{folder}").config("spark.driver.memory", "6g").config("spark.sql.warehouse.dir", f"{folder}/warehouse").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    if isinstance(value, float):
        return round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(df: DataFrame) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def rows_of_sql(sql: str, folder: str = DATA) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)


def agree(df: DataFrame, sql: str, folder: str = DATA) -> int:
    """Asserts equal columns and rows; how many rows there are."""
    names, wanted = rows_of_sql(sql, folder)
    assert sorted(df.columns) == names
    found = rows_of(df)
    assert len(found) == len(wanted)
    odd = [(a, b) for a, b in zip(found, wanted) if a != b]
    assert not odd, f"{len(odd)} rows differ, first: {odd[0]}"
    return len(found)
