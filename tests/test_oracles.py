"""Every query with a DuckDB counterpart, side by side over the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.oracle_sql() if n.startswith("q_")]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def normal(value):
    if isinstance(value, float):
        return round(value, 5)
    return value


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    order = sorted(columns)
    theirs = sorted((tuple(normal(row[columns.index(c)]) for c in order) for row in cursor.fetchall()), key=repr)
    ours = sorted((tuple(normal(row[c]) for c in order) for row in frame.collect()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("q_") and n not in NAMES])
def test_runs_without_oracle(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
