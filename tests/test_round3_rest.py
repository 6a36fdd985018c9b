"""Findings of round 3 that were left: pairs of copies, features, summaries and pages whose work or memory grew too fast."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import emotions, logistic, models, tfidf
from newsloom.operators.summarize import summaries
from newsloom.plans.queries import QUERIES


def made_articles(spark, path, texts) -> str:
    """A folder with documents of these texts and no labels."""
    rows = [(i, t, f"src{i % 20}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def shuffled(frame) -> int:
    """Rows that the shuffles of a frame write."""
    frame.collect()

    def walk(node) -> int:
        own = node.metrics().apply("shuffleRecordsWritten").value() if node.nodeName() == "Exchange" and node.metrics().contains("shuffleRecordsWritten") else 0
        more = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else []
        return own + sum(map(walk, [*more, *(node.children().apply(i) for i in range(node.children().size()))]))

    return walk(frame._jdf.queryExecution().executedPlan())


def test_pairs_of_copies_are_not_shuffled(spark, tmp_path):
    sf = made_articles(spark, tmp_path, ["one more title here\nbody"] * 700 + ["quite another title\nbody"] * 3 + [None, ""])
    pairs = QUERIES["q_j10_cosine_pairs"](spark, sf)
    assert shuffled(pairs) < 10_000  # it was 15,468, with candidate pairs among them
    got = {(r.a, r.b): r.cosine for r in pairs.collect()}
    assert got == {(a, b): 1.0 for a in range(703) for b in range(a + 1, 703) if (a < 700) == (b < 700)}


def test_short_pairs_lose_none(spark, monkeypatch):
    monkeypatch.setattr(tfidf, "PREFIX_ROWS", 7)
    monkeypatch.setattr(tfidf, "COPIES", 2)
    rng = np.random.default_rng(2)
    x = np.where(rng.random((120, 30)) < 0.15, rng.random((120, 30)), 0)
    x[::2, 0] = rng.uniform(0.3, 2, 60)  # a hot term
    x[:, 29] += 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(int(i), f"t{j:02}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "id long, term string, w double")
    keys = {i: [i] + [1000 * (k + 1) + i for k in range(i % 6)] for i in range(120)}
    classes = spark.createDataFrame(list(keys.items()), "id long, keys array<long>")
    found = tfidf.short_pairs(rows, "id", 0.6, classes).collect()
    of = {k: i for i, own in keys.items() for k in own}
    c = x @ x.T
    want = {(a, b): c[of[a], of[b]] for a in of for b in of if a < b and c[of[a], of[b]] > 0.6}
    got = {(r["a"], r["b"]): r["cosine"] for r in found}
    assert len(found) == len(got) and set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    single = {(r["a"], r["b"]) for r in tfidf.short_pairs(rows, "id", 0.6).select("a", F.col("b")).collect()}
    assert single == {p for p in want if max(p) < 120}


def test_summaries_shuffle_no_text(spark):
    body = " ".join(f"Sentence number {i} speaks of trade, ports and tariff rule {i % 7} today." for i in range(40))
    docs = spark.createDataFrame([(i, "Trade and tariff", body) for i in range(50)] + [(60, None, None)], "doc_id long, title string, body string")
    made = summaries(docs, "doc_id", "title", "body")
    assert shuffled(made) == 0  # every term of every sentence was
    assert len({r.summary for r in made.where("doc_id < 60").collect()}) == 1 and made.count() == 51


def test_short_rows_make_few_blocks(spark):
    data = [(i, float(i % 7), float(i % 3), i % 2) for i in range(6000)]
    rows = models.assemble(spark.createDataFrame(data, "id long, x double, y double, label int").coalesce(1), ["x", "y"])
    held = logistic.blocks(rows, "label", "id")
    assert held.count() <= 2  # 24 of 256 rows
    assert logistic.class_counts(held, 2, 3).sum() == 6000


def test_lexicon_hits_shuffle_nothing(spark):
    rows = spark.createDataFrame([(1, ["bad", "good", "good", "it's", "x"]), (2, []), (3, ["x", "back\\slash"])], "id long, tokens array<string>")
    lists = {"positive": ["good"], "negative": ["bad", "it's"], "fear": ["it's", "back\\slash"], "joy": []}
    lexicon = spark.createDataFrame([(c, w) for c, words in lists.items() for w in words], "category string, word string")
    made, hits = emotions.counted(rows, "id", "tokens", lexicon, list(lists))
    frame = made.select("id", *[h.alias(c) for c, h in hits.items()])
    assert shuffled(frame) == 0  # rows with their texts were, to join counts
    assert sorted(map(tuple, frame.collect())) == [(1, 2, 2, 1, 0), (2, 0, 0, 0, 0), (3, 0, 0, 1, 0)]


def test_pages_come_in_bounded_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, "10000")
    spark.conf.set(name, "10000")
    pages = spark.createDataFrame([("<article>" + "a b &amp; " * 20 + "</article>",), (None,)], "html string")
    got = [r.text for r in T.with_main_text(pages, "html", "text").collect()]
    assert int(spark.conf.get(name)) <= 500  # 10,000 pages came at once
    spark.conf.set(name, before)
    assert got == [("a b & " * 20).strip(), None]
