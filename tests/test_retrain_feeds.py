"""Retraining jobs, XML feeds and dense pairs on small hand-made tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import models, retrain, tfidf
from newsloom.sources import feed_xml
from newsloom.streaming import ingest

NOW = "2024-02-01 00:00:00"
FEEDBACK = "id long, dimension string, user_score double, created_at timestamp"


def tables(spark, n=12):
    articles = spark.createDataFrame([(f"a{i}", f"Title {i}", None, None) for i in range(n)], "id string, title string, bias_score double, confidence double")
    rows = spark.createDataFrame([(f"a{i}", 1.0 if i % 2 else -1.0, 0.0, 3 if i % 2 else 1, 0.5) for i in range(n)], ["id", "x", "y", "label", "source_score"])
    return articles, models.assemble(rows, ["x", "y"]).drop("x", "y")


def feedback(spark, n, dimension="bias", day="2024-01-15"):
    return spark.range(n).select("id", F.lit(dimension).alias("dimension"), F.lit(1.0).alias("user_score"), F.to_timestamp(F.lit(f"{day} 00:00:00")).alias("created_at"))


def test_first_version_scores_all_articles(spark, tmp_path):
    articles, rows = tables(spark)
    got = retrain.bias(articles, rows, feedback(spark, 3), spark.createDataFrame([], retrain.BIAS_VERSION), NOW, f"file://{tmp_path}")
    assert got.version == 1
    scores = {r["id"]: (r["bias_score"], r["model_version"]) for r in got.articles.collect()}
    assert len(scores) == 12 and all(v == 1 for _, v in scores.values())
    assert all((scores[f"a{i}"][0] > 0) == bool(i % 2) for i in range(12))
    listed = got.versions.first()
    assert (listed["version"], listed["feedback_count"], str(listed["trained_at"])) == (1, 3, NOW)
    again = models.predict(models.load(spark, f"file://{tmp_path}", 1), rows, F.col("source_score"))
    assert {r["id"]: r["score"] for r in again.collect()} == {k: s for k, (s, _) in scores.items()}


@pytest.mark.parametrize(("n", "day", "version"), [(49, "2024-01-15", None), (50, "2024-01-15", 8), (80, "2024-01-01", None)])
def test_later_versions_wait_for_new_feedback(spark, n, day, version):
    articles, rows = tables(spark)
    versions = spark.sql(f"SELECT 7 AS version, timestamp'2024-01-10' AS trained_at, 5L AS feedback_count, 0.5D AS accuracy, 1D AS mae, 'x' AS path")
    other = feedback(spark, 90, "sentiment")  # counts for the other model only
    got = retrain.bias(articles, rows, feedback(spark, n, day=day).unionByName(other), versions, NOW)
    assert got.version == version
    assert sorted(r["version"] for r in got.versions.collect()) == ([7] if version is None else [7, 8])
    assert got.articles.where("bias_score is not null").count() == (0 if version is None else 12)


def test_not_while_training_nor_on_few_articles(spark):
    articles, rows = tables(spark, 9)
    none = spark.createDataFrame([], retrain.BIAS_VERSION)
    assert retrain.bias(articles, rows, feedback(spark, 0), none, NOW).version is None
    assert retrain.bias(*tables(spark), feedback(spark, 99), none, NOW, training=True).version is None


def test_tone_of_one_class_falls_back(spark):
    articles, rows = tables(spark)
    rows = rows.select("id", "features", F.lit(2).alias("p_class"), (F.col("label") - 1).alias("i_class"), F.lit(0.25).alias("polarity"), F.lit(0.01).alias("raw"))
    got = retrain.tone(articles, rows, feedback(spark, 0, "intensity"), spark.createDataFrame([], retrain.TONE_VERSION), NOW, F.col("raw"))
    seen = got.articles.select("sentiment_score", "sentiment_model_version").distinct().collect()
    assert [tuple(r) for r in seen] == [(0.25, 1)]
    assert got.articles.select("intensity_score").distinct().count() == 2


RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:media="m" xmlns:content="c" xmlns:atom="a"><channel><title>T</title><atom:link href="self"/>
<item><title><![CDATA[First & <b>best</b> story]]></title><link> https://x/1 </link><description>short</description><content:encoded><![CDATA[<p>Long body</p>]]></content:encoded>
<pubDate>Tue, 30 Jan 2024 10:00:00 GMT</pubDate><media:content url="m.png" medium="image"/></item>
<item><title>Second &amp; last story</title><link>https://x/2</link><description>&lt;p&gt;Body two&lt;/p&gt;</description><pubDate>Tue, 30 Jan 2024 12:00:00 +0200</pubDate><enclosure url="e.png" type="image/png"/></item>
<item><title>No link here at all</title></item><item><link>https://x/4</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>T</title><entry><title type="html">Atom story of today</title><link rel="self" href="https://y/self"/><link rel="alternate" href="https://y/1"/>
<link rel="enclosure" type="image/jpeg" href="y.jpg"/><summary type="html">Sum</summary><updated>2024-01-30T10:00:00Z</updated></entry></feed>"""


def land(folder):
    for name, text in (("r", RSS), ("a", ATOM), ("bad", "<rss><channel><item>"), ("empty", "")):
        (folder / name).mkdir(parents=True)
        (folder / name / "1.xml").write_text(text)


def test_xml_feeds(spark, tmp_path):
    land(tmp_path)
    rows = ingest.feed_articles(feed_xml.feed_rows(feed_xml.documents(spark.read, f"file://{tmp_path}")))
    got = sorted((r["source_id"], r["title"], r["body"], r["url"], r["image_url"], str(r["published"])) for r in rows.collect())
    assert got == [
        ("a", "Atom story of today", "Sum", "https://y/1", "y.jpg", "2024-01-30 10:00:00"),
        ("r", "First & best story", "Long body", "https://x/1", "m.png", "2024-01-30 10:00:00"),
        ("r", "Second & last story", "Body two", "https://x/2", "e.png", "2024-01-30 10:00:00"),
    ]


def test_xml_stream_writes_each_article_once(spark, tmp_path):
    land(tmp_path / "in")
    table = ingest.open_store(spark, f"file://{tmp_path}/t")
    for name in ("1", "2"):  # a poll lands the same entries again
        (tmp_path / "in" / "r" / f"again{name}.xml").write_text(RSS)
        ingest.ingest_feeds(spark, f"file://{tmp_path}/in", table, f"file://{tmp_path}/state", kind="xml").awaitTermination()
    assert sorted(r["url"] for r in table.read("articles").collect()) == ["https://x/1", "https://x/2", "https://y/1"]


@pytest.mark.parametrize(("cells", "block"), [(64, 2048), (5, 7), (1, 3)])
def test_dense_pairs_are_all_pairs(spark, cells, block):
    random = np.random.default_rng(3)
    centres = random.normal(size=(6, 8))
    v = centres[random.integers(6, size=150)] + 0.4 * random.normal(size=(150, 8))
    v[7] = v[8]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, [0.0] * 8), (901, None), (902, []), (None, [1.0] * 8)]
    got = tfidf.dense_pairs(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.5, cells, block).collect()
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = u @ u.T
    want = {(i, j): c[i, j] for i in range(150) for j in range(i + 1, 150) if c[i, j] > 0.5}
    assert len(got) == len(want) and all(abs(want[r["a"], r["b"]] - r["cosine"]) < 1e-9 for r in got)


def test_dense_pairs_of_nothing(spark):
    assert tfidf.dense_pairs(spark.createDataFrame([], "vec_id long, embedding array<double>"), 0.5).count() == 0
