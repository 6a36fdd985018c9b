"""Findings of round 4: pairs of articles and fits whose work was too much."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import logistic, models, tfidf
from newsloom.plans.queries import QUERIES
from tests.test_round3_rest import made_articles, shuffled


def test_article_pairs_shuffle_vectors_and_no_pairs(spark, tmp_path):
    rng = np.random.default_rng(4)
    phrases = np.array([f"left{i} mid{i} right{i}" for i in range(9)])
    sf = made_articles(spark, tmp_path, [" ".join(rng.choice(phrases, 9)) for _ in range(400)] + [None, ""])
    pairs = QUERIES["q_j10_article_pairs"](spark, sf)
    assert shuffled(pairs) < 20_000  # candidate pairs were, some 80,000, and the terms of each
    got = pairs.collect()
    assert len({(r.a, r.b) for r in got}) == len(got) > 1000 and all(r.a < r.b and 0.32 <= r.cosine <= 1 for r in got)


def test_long_pairs_lose_none(spark, monkeypatch):
    monkeypatch.setattr(tfidf, "LONG_BLOCK", 9)
    monkeypatch.setattr(tfidf, "STRIP", 4)
    rng = np.random.default_rng(3)
    x = np.where(rng.random((150, 30)) < 0.3, rng.random((150, 30)), 0)
    x[:, 29] += 0.01
    x[140:] = x[0]  # copies
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)] + [(None, 29, 1.0)]
    found = tfidf.long_pairs(spark.createDataFrame(rows, "id long, at int, w double"), "id", 0.4).collect()
    got, c = {(r["a"], r["b"]): r["cosine"] for r in found}, x @ x.T
    want = {(i, j): c[i, j] for i in range(150) for j in range(i + 1, 150) if c[i, j] > 0.4}
    assert len(found) == len(got) and set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    assert tfidf.long_pairs(spark.createDataFrame([], "id long, at int, w double"), "id", 0.4).count() == 0


@pytest.mark.parametrize("sublinear", [False, True])
def test_vectors_of_known_terms(spark, sublinear):
    rng = np.random.default_rng(7)
    words = np.array([f"w{i:03}" for i in range(200)])
    docs = spark.createDataFrame([(i % 90, " ".join(rng.choice(words, 60))) for i in range(100)] + [(None, "w001 w002"), (91, None), (92, "")], "id long, text string")
    every = tfidf.terms(docs, "id", "text", ["w005"], bigrams=True)
    known = tfidf.vocabulary(every, 2, 120).withColumn("at", 3 * F.row_number().over(tfidf.Window.orderBy(F.desc("term")))).localCheckpoint()
    plain = tfidf.weigh(every.join(known, "term"), "id", 100, sublinear).where("id is not null")
    want = {r["id"]: dict(r["v"]) for r in plain.groupBy("id").agg(F.collect_list(F.struct("at", "w")).alias("v")).collect()}
    got = tfidf.known_vectors(docs, "id", "text", ["w005"], known, 100, bigrams=True, sublinear=sublinear)
    rows = {r["id"]: r for r in got.collect()}
    assert len(rows) == 92 and all(r["at"] == sorted(want.get(i, {})) and r["w"] == pytest.approx([want[i][a] for a in r["at"]]) for i, r in rows.items())
    assert shuffled(got) <= 102  # a row a term, with its text


def test_texts_are_assembled_without_a_row_for_each_term(spark):
    rng = np.random.default_rng(8)
    words = np.array([f"w{i:03}" for i in range(60)])
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, 80))) for i in range(100)], "id long, text string")
    made = models.assemble_text(docs.withColumn("x", F.lit(1.0)), ["x"], docs, "id", "text", models.fit_text(docs, "text"))
    assert shuffled(made) <= 1000  # 11,518 were: each term of each text


def test_blocks_hold_rows_that_are_alike(spark):
    rng = np.random.default_rng(9)
    rows = [(i, i % 2, {"at": [0, *sorted((rng.choice(300, 200, replace=False) + 1 + 300 * (i % 5)).tolist())], "w": [1.0] * 201}) for i in range(1000)]
    frame = spark.createDataFrame(rows, "id long, label int, features struct<at:array<int>,w:array<double>>").coalesce(1)
    held = logistic.blocks(frame, "label", "id")
    cells = held.select(F.sum(F.octet_length("label") * F.octet_length("places") / 16)).first()[0]
    assert cells < 1000 * 1501 / 2 and logistic.class_counts(held, 2).tolist() == [[500, 500]]  # all places in all blocks


def test_blocks_do_not_follow_the_size_of_a_batch(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, "10000")
    spark.conf.set(name, "500")
    rows = models.assemble(spark.createDataFrame([(i, float(i % 7), i % 2) for i in range(6000)], "id long, x double, label int").coalesce(1), ["x"])
    held = logistic.blocks(rows, "label", "id")
    n, counts = held.count(), logistic.class_counts(held, 2, 3)
    spark.conf.set(name, before)
    assert n == 1 and counts.sum() == 6000  # 12
