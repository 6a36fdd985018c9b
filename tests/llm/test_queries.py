"""The registered queries: their columns, their rows and, where SQL can say the same, their values."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ("documents", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}),
    "op2": ("documents", {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"}),
    "op4": ("documents", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}),
    "op5": ("documents", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}),
    "op6": ("documents", {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}),
    "op7": ("pages", {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}),
    "op8": ("documents", {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}),
    "op9": ("pages", {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"}),
    "op10": ("documents", {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}),
}
COLUMNS["op13"] = ("documents", {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"})
#: Queries with rows of their own, which other tests count.
OTHERS = {
    "op11": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op12": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
}
OPS = [n for n in entry.queries() if n.startswith("op")]


def test_all_operators_and_the_pipeline_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in OPS) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", OPS)
def test_contract(spark, name):
    frame = entry.queries()[name](spark, SF)
    key = name.split("_")[0]
    if key in COLUMNS:
        table, columns = COLUMNS[key]
        assert dict(frame.dtypes) == columns
        assert frame.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
    elif key in OTHERS:
        assert dict(frame.dtypes) == OTHERS[key] and frame.count() > 0
    else:
        assert {"doc_id", "item_id"} <= set(frame.columns) and frame.count() > 0


@pytest.mark.parametrize("name", [n for n in OPS if n in entry.oracle_sql()])
def test_sql_agrees(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    theirs = duck.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, frame.select(columns).collect()), key=repr) == sorted(theirs, key=repr)
