"""Micro-batch ingest into a keyed store: landed feed and market files, cleaned, written by identity, and scored on arrival.

A batch is one commit: new articles with their scores, the counters of their sources, and the feeds that could not be read, by
the batch's number, so that a batch that is run again changes nothing. A broken feed never stops a batch or other sources; it is
kept in `quarantine` with what is wrong with it and counts as an error of its source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.functions.text import low_signal, stable_id, strip_html
from newsloom.operators import signals
from newsloom.operators.keyed import KeyedStore, Table
from newsloom.operators.retrain import BIAS_COLUMNS, VERSIONS
from newsloom.operators.scoring import Scorer
from newsloom.sources import feed_xml

LINK = "struct<href:string,url:string,type:string>"
FEED = f"""source_id string, entries array<struct<link:string,title:string,content:array<struct<value:string>>,summary:string,
    published:timestamp,updated:timestamp,media_content:array<struct<url:string>>,enclosures:array<{LINK}>,links:array<{LINK}>>>"""
ARTICLE = "id string, source_id string, title string, body string, url string, image_url string, published timestamp"
MARKET = """condition_id string, market_id string, question string, outcomes string, outcome_prices string, fee_type string,
    sports_market_type string, slug string, one_day_price_change double, volume_24hr double"""
SCORED = ", ".join(f"{c} {t}" for c, t in BIAS_COLUMNS.items())
SOURCE = "source_id string, fetch_count long, article_count long, error_count long, last_fetched timestamp"
QUARANTINE = "id string, source_id string, problem string, content string, landed timestamp, batch long"
SIGNAL = "id string, question string, category string, yes_price double, yes_change_24h double, volume_24h double, url string, batch long"

TABLES = {
    "articles": Table(f"{ARTICLE}, {SCORED}", ("id",)),
    "sources": Table(SOURCE, ("source_id",), "sum", counters=("fetch_count", "article_count", "error_count")),
    "quarantine": Table(QUARANTINE, ("id",)),
    "signals": Table(SIGNAL, ("id",), "latest", order="batch"),
    **VERSIONS,
}


def feed_articles(feeds: DataFrame, most_entries: int = 30, most_chars: int = 3000) -> DataFrame:
    """Articles of feeds (source_id, entries): the first entries that have a link and a title worth keeping.

    Body: the first content, else the summary. Time: published, else updated. Image: media, else an image
    enclosure (href before url), else an image link."""
    entries = feeds.select("source_id", F.posexplode("entries").alias("pos", "e")).where(F.col("pos") < most_entries)
    e = F.col("e")
    image_of = lambda links: F.get(F.filter(links, lambda x: F.startswith(F.coalesce(x["type"], F.lit("")), F.lit("image"))), F.lit(0))
    enclosure, link = image_of(e["enclosures"]), image_of(e["links"])
    body = F.coalesce(F.get(e["content"], F.lit(0))["value"], e["summary"], F.lit(""))
    made = entries.select(
        stable_id(F.col("source_id"), e["link"]).alias("id"), "source_id", strip_html(e["title"]).alias("title"), F.substring(strip_html(body), 1, most_chars).alias("body"), e["link"].alias("url"),
        F.coalesce(F.get(e["media_content"], F.lit(0))["url"], enclosure["href"], enclosure["url"], link["href"]).alias("image_url"), F.coalesce(e["published"], e["updated"]).alias("published"),
    )
    return made.where((F.coalesce("url", F.lit("")) != "") & (F.col("title") != "") & ~low_signal(F.col("title")))


def _start(source: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], every: str | None) -> StreamingQuery:
    writer = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def feed_changes(feeds: DataFrame, number: int) -> dict[str, DataFrame]:
    """The inserts that a batch of feeds (source_id, entries, and if they may be broken problem, xml, landed) makes in a store's tables."""
    lacks = {c: t for c, t in (("problem", "string"), ("xml", "string"), ("landed", "timestamp")) if c not in feeds.columns}
    rows = feeds.withColumns({c: F.lit(None).cast(t) for c, t in lacks.items()})
    good, broken = rows.where("problem is null"), rows.where("problem is not null")
    articles = feed_articles(good.select("source_id", "entries"))
    read = articles.groupBy("source_id").agg(F.count("*").alias("article_count"))
    polled = rows.groupBy("source_id").agg(F.count("*").alias("fetch_count"), F.count("problem").alias("error_count"), F.max("landed").alias("last_fetched"))
    sources = polled.join(read, "source_id", "left").withColumn("article_count", F.coalesce("article_count", F.lit(0)))
    identity = F.sha2(F.concat_ws("|", F.coalesce("source_id", F.lit("")), F.coalesce(F.col("landed").cast("string"), F.lit("")), F.coalesce("xml", F.lit(""))), 256)
    kept = broken.select(identity.alias("id"), "source_id", "problem", F.col("xml").alias("content"), "landed", F.lit(number).cast("long").alias("batch"))
    return {"articles": articles, "sources": sources, "quarantine": kept}


def ingest_feeds(spark: SparkSession, landing: str, held: KeyedStore, checkpoint: str, every: str | None = None, files_a_batch: int = 100, kind: str = "json", scorer: Scorer | None = None, source_scores: DataFrame | None = None) -> StreamingQuery:
    """Feed files from `landing` into a store; the first write of an id wins. every: as '15 minutes'; None: what is there now.

    kind: json rows as FEED has them, or xml for RSS and Atom documents as feed_xml.documents finds them. scorer: scores what
    arrives by the latest version that the store lists at that moment; source_scores (source_id, source_score) are the sources' own."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_a_batch)
    if kind == "xml":
        feeds = feed_xml.feed_rows(feed_xml.documents(reader, landing))
    else:
        feeds = reader.schema(f"{FEED}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(landing).select("source_id", "entries", F.when(F.col("_broken").isNotNull(), "not well-formed").alias("problem"), F.col("_broken").alias("xml"), F.col("_metadata.file_modification_time").alias("landed"))

    def handle(batch: DataFrame, number: int) -> None:
        rows = batch.persist()  # three tables are made of it
        changes = feed_changes(rows, number)
        if scorer is not None:
            priors = changes["articles"].withColumn("source_score", F.lit(0.0)) if source_scores is None else changes["articles"].join(source_scores, "source_id", "left").withColumn("source_score", F.coalesce("source_score", F.lit(0.0)))
            changes["articles"] = scorer.score(priors).drop("source_score")
        held.commit(inserts=changes, batch=("feeds", number))
        rows.unpersist()

    return _start(feeds, checkpoint, handle, every)


def ingest_signals(spark: SparkSession, landing: str, held: KeyedStore, checkpoint: str, every: str | None = None, files_a_batch: int = 100) -> StreamingQuery:
    """Market files, a file a poll, from `landing` into a store; the latest batch of an id wins."""
    raw = spark.readStream.schema(MARKET).option("maxFilesPerTrigger", files_a_batch).json(landing).select("*", F.col("_metadata.file_path").alias("poll"))

    def handle(batch: DataFrame, number: int) -> None:
        new = signals.normalize(signals.most_traded(batch, "poll")).withColumn("batch", F.lit(number).cast("long"))
        held.commit(inserts={"signals": new}, batch=("signals", number))

    return _start(raw, checkpoint, handle, every)


def open_store(spark: SparkSession, root: str) -> KeyedStore:
    return KeyedStore(spark, root, TABLES)
