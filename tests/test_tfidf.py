"""The vocabulary by sketch against the plain one, and pairs under a hot term against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import tfidf
from newsloom.sources import fixtures as S

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("most", "counters"), [(5000, tfidf.COUNTERS), (300, 64), (10_000_000, 1000)])
def test_the_sketch_loses_no_frequent_term(spark, most, counters):
    docs = S.articles(spark, SF).select("id", F.concat_ws(" ", "title", "body").alias("text"))
    stop = tfidf.stop_words()
    plain = tfidf.vocabulary(tfidf.terms(docs, "id", "text", stop, bigrams=True), 2, most)
    got = tfidf.frequent_terms(docs, "text", stop, most, counters=counters)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def written(spark, frame):
    """Bytes that the shuffles of a frame write."""
    frame.collect()
    total = 0

    def walk(node):
        nonlocal total
        if node.nodeName() == "Exchange" and node.metrics().contains("shuffleBytesWritten"):
            total += node.metrics().apply("shuffleBytesWritten").value()
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            walk(node.plan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(frame._jdf.queryExecution().executedPlan())
    return total


def test_pairs_that_cannot_be_frequent_are_not_shuffled(spark):
    rng = np.random.default_rng(1)
    words = np.array([f"w{i:04}" for i in range(3000)])
    common = np.array([f"c{i:02}" for i in range(40)])
    rows = [(i, " ".join(np.where(rng.random(400) < 0.3, rng.choice(common, 400), rng.choice(words, 400)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(4).cache()
    plain = written(spark, tfidf.vocabulary(tfidf.terms(docs, "id", "text", bigrams=True), 2, 60))
    assert written(spark, tfidf.frequent_terms(docs, "text", most_terms=60)) < plain / 4
    docs.unpersist()


def test_a_term_in_half_the_documents(spark, monkeypatch):
    monkeypatch.setattr(tfidf, "PREFIX_ROWS", 7)
    rng = np.random.default_rng(2)
    x = np.where(rng.random((120, 30)) < 0.15, rng.random((120, 30)), 0)
    x[::2, 0] = rng.uniform(0.3, 2, 60)  # the hot term, heavy enough for prefixes
    x[:, 29] += 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(int(i), f"t{j:02}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    got = {(r["a"], r["b"]): r["cosine"] for r in tfidf.cosine_pairs(spark.createDataFrame(rows, "id long, term string, w double"), "id", 0.6).collect()}
    c = x @ x.T
    want = {(i, j): c[i, j] for i in range(120) for j in range(i + 1, 120) if c[i, j] > 0.6}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)
