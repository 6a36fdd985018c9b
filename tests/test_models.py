"""The block-wise regression against a small numpy twin, and the text features against plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from newsloom.operators import logistic, models, tfidf

SF = "/root/testdata/sf0.001"


def twin(x, y, classes, rounds=60):
    """Newton's method on the whole weighted loss; coefficients and intercepts of all classes."""
    n, d = x.shape
    counts = np.bincount(y, minlength=classes)
    weight = (n / ((counts > 0).sum() * counts[y])) / n
    x1 = np.column_stack([x, np.ones(n)])
    b = np.zeros((classes, d + 1))
    penalty = np.full((classes, d + 1), 1.0 / n)
    penalty[:, -1] = 0
    for _ in range(rounds):
        s = x1 @ b.T
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = ((p - np.eye(classes)[y]) * weight[:, None]).T @ x1 + penalty * b
        h = np.zeros((b.size, b.size))
        for i in range(n):
            h += weight[i] * np.kron(np.diag(p[i]) - np.outer(p[i], p[i]), np.outer(x1[i], x1[i]))
        h += np.diag(penalty.ravel() + 1e-9)
        b = b - np.linalg.solve(h, g.ravel()).reshape(b.shape)
    b[:, -1] -= b[:, -1].mean()
    return b


def rows_of(spark, x, y):
    data = [(i, *map(float, row), int(c)) for i, (row, c) in enumerate(zip(x, y, strict=True))]
    frame = spark.createDataFrame(data, "id long, " + ", ".join(f"x{i} double" for i in range(x.shape[1])) + ", label int")
    return models.assemble(frame, [f"x{i}" for i in range(x.shape[1])])


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4))
    return x, (x[:, 0] + rng.normal(size=90) > 0).astype(int) + (x[:, 1] > 0.5)


def test_coefficients_of_all_models(spark, sample):
    x, y = sample
    rows = rows_of(spark, x, y).repartition(5)
    held = logistic.blocks(rows, "label", "id")
    made = logistic.fit(held, 3, 3)
    deal = dict(rows.select("id", F.pmod(F.xxhash64("id"), F.lit(1 << 30)) % 3).collect())
    fold = np.array([deal[i] for i in range(len(y))])
    for m, chosen in enumerate([np.ones(len(y), bool), *[fold != i for i in range(3)]]):
        want = twin(x[chosen], y[chosen], 3)
        assert made[m].converged
        intercepts = made[m].intercepts - made[m].intercepts.mean()
        assert np.allclose(made[m].coefficients, want[:, :-1], atol=5e-3) and np.allclose(intercepts, want[:, -1], atol=5e-3)
    points = [np.column_stack([m.coefficients, m.intercepts]) for m in made]
    best = [np.argmax(np.column_stack([x, np.ones(len(y))]) @ p.T, axis=1) for p in points]
    accuracy, distance = logistic.quality(held, made, [0.0, 2.0, 7.0])
    assert accuracy == pytest.approx(np.mean([(best[i + 1] == y)[fold == i].mean() for i in range(3)]))
    values = np.array([0.0, 2.0, 7.0])
    assert distance == pytest.approx(np.abs(values[best[0]] - values[y]).mean())


def test_nulls_nan_and_missing_classes(spark):
    data = [(i, [1.0, None, float("nan"), float("inf")][i % 4] if i % 2 else 2.0, i % 2 * 2 if i < 38 else None) for i in range(40)]
    rows = models.assemble(spark.createDataFrame(data, "id long, x double, label int"), ["x"])
    got = models.train(rows, models.POLARITY_VALUES)
    assert got.model.known.tolist() == [True, False, True]
    scored = models.predict(got, rows, F.lit(0.0)).select("id", "score", "confidence").collect()
    assert len(scored) == 40 and all(math.isfinite(r.score) and 0 < r.confidence <= 1 for r in scored)
    assert models.train(rows.where("label is null"), models.POLARITY_VALUES).model is None


def test_a_small_step_of_cells_gives_the_same_model(spark, sample, monkeypatch):
    x, y = sample
    rows = rows_of(spark, x, y)
    first = models.train(rows, models.POLARITY_VALUES).model
    monkeypatch.setattr(logistic, "BLOCK_CELLS", 9)
    again = models.train(rows, models.POLARITY_VALUES).model
    assert np.allclose(first.coefficients, again.coefficients, atol=1e-6)


TEXTS = ["Storm warning for the northern coast", "storm warning lifted, northern roads open", None, "", "markets rise as storm fades markets", "the and of"]


def test_text_features(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    space = models.fit_text(docs, "text", most_terms=6)
    stop, held = set(tfidf.stop_words()), {}
    for i, t in enumerate(TEXTS):
        words = [w for w in re.findall(r"\b\w\w+\b", (t or "").lower()) if w not in stop]
        held[i] = Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)])
    df = Counter(t for c in held.values() for t in c)
    total = sum(held.values(), Counter())
    vocab = sorted(sorted((t for t in df if df[t] > 1), key=lambda t: (-total[t], t))[:6])
    assert [r["term"] for r in space.terms.orderBy("at").collect()] == vocab and space.documents == len(TEXTS)
    rows = models.assemble_text(docs.withColumn("x", F.lit(0.5)), ["x"], docs, "id", "text", space)
    for r in rows.collect():
        raw = {vocab.index(t) + 1: (1 + math.log(n)) * (math.log((1 + len(TEXTS)) / (1 + df[t])) + 1) for t, n in held[r["id"]].items() if t in vocab}
        length = math.sqrt(sum(v * v for v in raw.values()))
        assert r["features"]["at"] == [0, *sorted(raw)]
        assert r["features"]["w"] == pytest.approx([0.5, *[raw[k] / length for k in sorted(raw)]])


def test_saved_models_know_their_terms(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    space = models.fit_text(docs, "text")
    rows = models.assemble_text(docs.withColumns({"x": F.lit(1.0), "label": (F.col("id") % 2 * 4).cast("int")}), ["x"], docs, "id", "text", space)
    got = models.train(rows, models.BIAS_VALUES)
    models.save(spark, got, f"file://{tmp_path}", 3, space)
    back, terms = models.load(spark, f"file://{tmp_path}", 3), models.load_text(spark, f"file://{tmp_path}", 3)
    again = models.assemble_text(docs.withColumn("x", F.lit(1.0)), ["x"], docs, "id", "text", terms)
    same = [models.predict(m, r, F.lit(0.0)).orderBy("id").select("score", "confidence").collect() for m, r in ((got, rows), (back, again))]
    assert same[0] == same[1]


def test_registered_models(spark):
    scores = entry.queries()["q_d13_bias_scores"](spark, SF).collect()
    assert len(scores) == 200 and all(-5 <= r.score <= 5 and 0.2 <= r.confidence <= 1 for r in scores)
    metrics = entry.queries()["q_a23_metrics"](spark, SF).first()
    assert 0.5 < metrics["accuracy"] <= 1 and 0 <= metrics["mae"] < 2.5
    tones = entry.queries()["q_d14_sentiment_scores"](spark, SF).collect()
    assert len(tones) == 200 and all(-1 <= r.sentiment <= 1 and 0 <= r.intensity <= 1 for r in tones)
