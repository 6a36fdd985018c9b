"""The keyed store: what a commit writes, merging, atomic changes of several tables, replays, and streams on top of it."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from newsloom.operators import models, retrain, scoring
from newsloom.operators.keyed import Conflict, KeyedStore, Table
from newsloom.streaming import ingest

TABLES = {
    "first": Table("id string, title string, score double", ("id",), buckets=4),
    "latest": Table("id string, n long, at long, made long", ("id",), "latest", order="at", fixed=("made",), buckets=4),
    "sums": Table("source string, n long, last long", ("source",), "sum", counters=("n",), buckets=4),
    "pairs": Table("a long, b string, v double", ("a", "b"), buckets=4),
}


@pytest.fixture
def held(spark, tmp_path):
    return KeyedStore(spark, f"file://{tmp_path}/store", TABLES)


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def make(spark, table, *values):
    return spark.createDataFrame(list(values), TABLES[table].schema)


def compactions(held, table):
    """The table before and after folding; both must be the same."""
    before = rows(held.read(table))
    held.compact(table)
    assert rows(held.read(table)) == before
    return before


def test_first_insert_wins_and_updates_overlay(spark, held):
    held.commit({"first": make(spark, "first", ("a", "one", None), ("b", "two", 1.0), (None, "x", 1.0))})
    held.commit({"first": make(spark, "first", ("a", "late", 9.0), ("c", "three", None))}, {"first": spark.createDataFrame([("b", 5.0), ("zz", 1.0)], "id string, score double")})
    want = [("a", "one", None), ("b", "two", 5.0), ("c", "three", None)]
    assert compactions(held, "first") == want
    held.commit(updates={"first": spark.createDataFrame([("a", 2.0), ("b", None)], "id string, score double")})
    held.commit({"first": make(spark, "first", ("zz", "new", None))})  # the update before it was there is gone
    assert compactions(held, "first") == [("a", "one", 2.0), *want[1:], ("zz", "new", None)]
    assert rows(held.read("first", 1)) == [("a", "one", None), ("b", "two", 1.0)]


def test_latest_and_sums(spark, held):
    held.commit({"latest": make(spark, "latest", ("a", 1, 5, 100), ("b", 1, 5, 100)), "sums": make(spark, "sums", ("s", 2, 7), ("t", 1, 1))})
    held.commit({"latest": make(spark, "latest", ("a", 2, 4, 200), ("b", 2, 5, 200)), "sums": make(spark, "sums", ("s", 3, 5), ("u", 4, 9))})
    assert compactions(held, "latest") == [("a", 1, 5, 100), ("b", 2, 5, 100)]
    held.commit({"sums": make(spark, "sums", ("s", 1, None))})
    assert compactions(held, "sums") == [("s", 6, 7), ("t", 1, 1), ("u", 4, 9)]


def test_a_key_of_several_columns_may_be_null_in_part(spark, held):
    held.commit({"pairs": make(spark, "pairs", (1, None, 1.0), (None, "x", 2.0), (None, None, 3.0))})
    held.commit({"pairs": make(spark, "pairs", (1, None, 9.0), (1, "x", 4.0))})
    read = lambda: sorted((tuple(r) for r in held.read("pairs").collect()), key=lambda r: repr(r))
    before = read()
    held.compact("pairs")
    assert read() == before and len(before) == 3 and (1, None, 1.0) in before


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_bytes_written_follow_the_batch(spark, held, tmp_path):
    held.commit({"first": spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.lit("t").alias("title"), F.rand(1).alias("score"))})
    held.compact("first")
    whole = size(tmp_path)
    held.commit({"first": make(spark, "first", ("new", "n", 1.0))})
    assert size(tmp_path) - whole < 5_000 < whole / 100
    assert held.read("first").count() == 40_001


def test_a_job_that_dies_between_its_tables_changes_none(spark, held, monkeypatch):
    held.commit({"first": make(spark, "first", ("a", "one", None))})
    write = held._write
    monkeypatch.setattr(held, "_write", lambda name, *rest: write(name, *rest) if name == "first" else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        held.commit({"first": make(spark, "first", ("b", "two", None)), "sums": make(spark, "sums", ("s", 1, 1))})
    monkeypatch.undo()
    assert rows(held.read("first")) == [("a", "one", None)] and held.state().version == 1
    gone = held.vacuum()
    assert len(gone) == 1 and "/first/delta-" in gone[0]
    assert rows(held.read("first")) == [("a", "one", None)]


def test_of_two_jobs_from_one_entry_one_fails(spark, held):
    other = KeyedStore(spark, held.root, TABLES)
    since = held.state().version
    held.commit({"first": make(spark, "first", ("a", "one", None))}, since=since)
    with pytest.raises(Conflict):
        other.commit({"first": make(spark, "first", ("b", "two", None))}, since=since)
    assert rows(other.read("first")) == [("a", "one", None)]


def test_a_place_is_taken_once(spark, held, monkeypatch):
    """Two commits that saw the same entry: the one with a version to keep to fails, the other takes the next number."""
    old = held.state()
    held.commit({"first": make(spark, "first", ("a", "one", None))})
    monkeypatch.setattr(KeyedStore, "state", lambda self, version=None, real=KeyedStore.state, seen=[old, old]: seen.pop() if seen else real(self, version))
    with pytest.raises(Conflict):
        held.commit({"first": make(spark, "first", ("b", "two", None))}, since=0)
    assert held.commit({"first": make(spark, "first", ("c", "three", None))}) == 2
    assert rows(held.read("first")) == [("a", "one", None), ("c", "three", None)]


def test_a_batch_counts_once(spark, held):
    new = make(spark, "sums", ("s", 1, 1))
    assert held.commit({"sums": new}, batch=("feeds", 0)) == 1
    assert held.commit({"sums": new}, batch=("feeds", 0)) is None
    assert held.commit({"sums": new}, batch=("other", 0)) == 2
    assert held.commit({"sums": new}, batch=("feeds", 1)) == 3
    assert rows(held.read("sums")) == [("s", 3, 1)]


def test_vacuum_keeps_the_last_versions(spark, held):
    for i in range(3):
        held.commit({"sums": make(spark, "sums", ("s", 1, i))})
    held.compact("sums")
    assert held.vacuum(keep=2) == []  # the entry before compaction still names the deltas
    held.commit({"sums": make(spark, "sums", ("s", 1, 9))})
    assert len(held.vacuum(keep=2)) == 3
    assert held.versions() == [4, 5] and rows(held.read("sums")) == [("s", 4, 9)]


def scanned(frame):
    """Rows that the scans of an executed plan handed on, and files they read."""
    frame.collect()
    text = frame._jdf.queryExecution().executedPlan()
    found = []

    def walk(node):
        if node.nodeName().startswith("Scan parquet"):
            m = node.metrics()
            found.append((m.apply("numOutputRows").value(), m.apply("numFiles").value()))
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(text)
    return [sum(x) for x in zip(*found, strict=True)]


def test_lookup_reads_one_row_group(spark, tmp_path, monkeypatch):
    held = KeyedStore(spark, f"file://{tmp_path}/s", {"t": Table("id string, v long", ("id",), buckets=4)})
    spark.conf.set("parquet.block.size", str(64 << 10))
    try:
        held.commit({"t": spark.range(60_000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.col("id").alias("v"))})
        held.compact("t")
    finally:
        spark.conf.unset("parquet.block.size")
    key = held.read("t").where("v = 777").first()["id"]
    got = held.lookup("t", key)
    assert rows(got) == [(key, 777)]
    n_rows, n_files = scanned(held.lookup("t", key))
    assert n_rows < 6_000 and n_files < 6
    absent, _ = scanned(held.lookup("t", "f" * 64))
    assert absent <= n_rows


def test_empty_tables(spark, held):
    assert held.read("first").count() == 0 and held.lookup("first", "a").count() == 0
    held.commit({"first": make(spark, "first")})
    assert held.read("first").count() == 0 and held.compact("first") == 2 and held.read("first").count() == 0


RSS = '<rss><channel>{}</channel></rss>'
ITEM = "<item><title>{t} storm report {n}</title><link>https://x/{n}</link><description>Body {n}</description></item>"


def land(folder, source, name, text):
    (folder / source).mkdir(parents=True, exist_ok=True)
    (folder / source / f"{name}.xml").write_text(text)


def poll(spark, tmp_path, held, **more):
    ingest.ingest_feeds(spark, f"file://{tmp_path}/in", held, f"file://{tmp_path}/state", kind="xml", **more).awaitTermination()


def test_broken_feeds_are_kept_apart_and_counted_once(spark, tmp_path):
    held = ingest.open_store(spark, f"file://{tmp_path}/store")
    land(tmp_path / "in", "good", "1", RSS.format(ITEM.format(t="First", n=1) + ITEM.format(t="Second", n=2)))
    land(tmp_path / "in", "bad", "1", "<rss><channel><item>")
    land(tmp_path / "in", "bad", "2", " \n")
    land(tmp_path / "in", "page", "1", "<html><body>gone</body></html>")
    poll(spark, tmp_path, held)
    counted = {r["source_id"]: (r["fetch_count"], r["article_count"], r["error_count"]) for r in held.read("sources").collect()}
    assert counted == {"good": (1, 2, 0), "bad": (2, 0, 2), "page": (1, 0, 1)}
    assert sorted(r["problem"] for r in held.read("quarantine").collect()) == ["empty", "no feed", "not well-formed"]
    assert held.read("sources").where("last_fetched is null").count() == 0
    # the batch again, as after a loss between the commit and the stream's own record of it
    held.commit(ingest.feed_changes(spark.createDataFrame([("good", None)], f"{ingest.FEED}"), 0), batch=("feeds", 0))
    land(tmp_path / "in", "good", "2", RSS.format(ITEM.format(t="Second", n=2) + ITEM.format(t="Third", n=3)))
    poll(spark, tmp_path, held)
    after = {r["source_id"]: (r["fetch_count"], r["article_count"], r["error_count"]) for r in held.read("sources").collect()}
    assert after == counted | {"good": (2, 4, 0)} and held.read("articles").count() == 3


def train(spark, held, tmp_path, flip, day):
    """A version over the store's articles: labels by the title's first word."""
    articles = held.read("articles").withColumn("source_score", F.lit(0.5))
    read, space = scoring.bias_rows(articles, ["storm"], columns=("title",))
    low = F.col("title").startswith("First")
    rows_ = read.withColumn("label", F.when(~low if flip else low, 0).otherwise(4))
    feedback = spark.range(60).select("id", F.lit("bias").alias("dimension"), F.lit(1.0).alias("user_score"), F.to_timestamp(F.lit(f"{day} 12:00:00")).alias("created_at"))
    return retrain.run_bias(held, rows_, feedback, f"{day} 13:00:00", f"file://{tmp_path}/models", space)


def test_the_stream_scores_with_the_latest_version(spark, tmp_path):
    held = ingest.open_store(spark, f"file://{tmp_path}/store")
    words = ["First", "Second"]
    land(tmp_path / "in", "s", "0", RSS.format("".join(ITEM.format(t=words[i % 2], n=i) for i in range(16))))
    scorer = scoring.Scorer(held, ["storm"])
    poll(spark, tmp_path, held, scorer=scorer)
    assert held.read("articles").where("bias_score is null and model_version is null").count() == 16
    assert train(spark, held, tmp_path, False, "2024-01-10") == 1
    assert held.read("articles").where("model_version = 1 and bias_score is not null").count() == 16
    for flip, version, day in ((False, 1, None), (True, 2, "2024-01-20")):
        if day:
            assert train(spark, held, tmp_path, flip, day) == version
        n = 100 * version
        land(tmp_path / "in", "s", str(n), RSS.format("".join(ITEM.format(t=w, n=n + i) for i, w in enumerate(words))))
        poll(spark, tmp_path, held, scorer=scorer)  # the same scorer: it asks for the version with each batch
        got = {r["title"].split()[0]: (r["bias_score"], r["model_version"]) for r in held.read("articles").where(F.col("url").isin(f"https://x/{n}", f"https://x/{n + 1}")).collect()}
        assert {v for _, v in got.values()} == {version}
        assert (got["First"][0] < got["Second"][0]) != flip
    assert sorted(r["version"] for r in held.read("bias_versions").collect()) == [1, 2]


def test_retraining_changes_articles_and_versions_together(spark, tmp_path, monkeypatch):
    held = ingest.open_store(spark, f"file://{tmp_path}/store")
    land(tmp_path / "in", "s", "0", RSS.format("".join(ITEM.format(t=["First", "Second"][i % 2], n=i) for i in range(16))))
    poll(spark, tmp_path, held)
    before = held.state().version
    write = held._write
    monkeypatch.setattr(held, "_write", lambda name, *rest: write(name, *rest) if name == "bias_versions" else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        train(spark, held, tmp_path, False, "2024-01-10")
    monkeypatch.undo()
    assert held.state().version == before and held.read("bias_versions").count() == 0 and held.read("articles").where("bias_score is not null").count() == 0
    assert train(spark, held, tmp_path, False, "2024-01-10") == 1
    assert train(spark, held, tmp_path, False, "2024-01-09") is None  # no feedback since
    assert re.search(r"/models/[0-9a-f]{32}/version=00000001$", held.read("bias_versions").first()["path"])
    assert models.load(spark, held.read("bias_versions").first()["path"].rsplit("/version=", 1)[0], 1).model is not None
