"""Exact percentiles against numpy."""

from __future__ import annotations

import numpy as np
import pytest

from newsloom.operators import stats

SHARES = [0.0, 0.33, 0.5, 0.66, 1.0]


def test_percentiles_of_hard_groups(spark):
    rng = np.random.default_rng(1)
    groups = {
        "spread": rng.normal(size=3000), "one": [4.25], "equal": [7.0] * 2000, "two": [1.0, 2.0], "mostly equal": [0.0] * 900 + [1e-300, 5e-324, 1e300],
        "scales": 10.0 ** rng.uniform(-60, 60, 500), "ends": [-1.7e308, 1.7e308, 0.0], "close": 1 + np.arange(40) * 2.0**-52, None: rng.uniform(size=50),
    }
    rows = [(g, float(x)) for g, values in groups.items() for x in values] + [("one", None), ("one", float("nan")), ("one", float("inf")), ("none", None)]
    table = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r["g"]: r["p"] for r in stats.exact_percentiles(table, ["g"], "x", SHARES).collect()}
    assert set(got) == {*groups, "none"} and got["none"] is None
    for g, values in groups.items():
        ordered = np.sort(np.asarray(values, float))
        for share, p in zip(SHARES, got[g], strict=True):
            at = share * (len(ordered) - 1)
            low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
            with np.errstate(over="ignore"):
                assert p == pytest.approx(low + (high - low) * (at - np.floor(at)), rel=1e-12)


def test_percentiles_of_a_whole_table_and_of_nothing(spark):
    table = spark.range(101).selectExpr("cast(id as double) as x")
    assert stats.exact_percentiles(table, [], "x", [0.25, 0.999]).first()["p"] == pytest.approx([25.0, 99.9])
    assert stats.exact_percentiles(table.where("x < 0"), [], "x", [0.5]).first()["p"] is None
    assert stats.exact_percentiles(table.where("x < 0"), ["x"], "x", [0.5]).count() == 0
