"""Physical plans stay the ones we want."""

from __future__ import annotations

import contextlib
import io
import re

import pytest

from newsloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
PYTHON = {"q_d15_retrain", "q_d13_bias_scores", "q_d14_sentiment_scores", "q_d1_html_strip", "q_s3_main_text", "q_d21_summary", "q_d24_pull_quote", "q_d16_story_groups", "q_j10_dense_pairs", "q_s1_feed_xml"}


def plan(frame) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_products_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON:
        assert not re.search("EvalPython|InPandas|InArrow", text)


def test_feed_ranks_early_and_reads_few_columns(spark):
    text = plan(QUERIES["q_w1_feed_capped"](spark, SF))
    assert "WindowGroupLimit" in text and "TakeOrderedAndProject" in text
    assert "lang" not in " ".join(re.findall(r"ReadSchema: (.*)", text))


def test_scans_prune_and_push(spark):
    text = plan(QUERIES["q_f6_low_signal"](spark, SF))
    assert all("n_chars" not in schema for schema in re.findall(r"ReadSchema: (.*)", text))
    markets = plan(QUERIES["q_s19_prune"](spark, SF))
    assert re.search(r"PushedFilters: \[.*ts", markets)
