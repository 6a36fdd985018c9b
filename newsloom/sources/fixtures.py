"""The domain's tables, derived from the given Parquet tables by fixed expressions.

Every expression is deterministic in the row's key, so the DuckDB views in newsloom.plans.views say the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions.constants import BUCKETS
from newsloom.session import read_table

#: When the derived times were generated, and the later moment at which feed and ranking queries ask.
ANCHOR, NOW = "2024-01-31 00:00:00", "2024-01-31 12:00:00"
LABELS = ["far_left", "left", "lean_left", "center", "lean_right", "right", "far_right"]
CATEGORIES = ["finance", "geopolitics", "science", "news"]
WMO_CODES = [0, 1, 2, 3, 45, 48, 51, 53, 55, 56, 57, 61, 63, 65, 66, 67, 71, 73, 75, 77, 80, 81, 82, 85, 86, 95, 96, 99]


def pick(values: list, index) -> F.Column:
    """The element of a literal list at a zero-based index column."""
    return F.get(F.lit(values), index.cast("int"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, active, category, allsides_label, allsides_score: one row a source."""
    n = F.expr("cast(substring(source, 4) as int)")
    return (
        read_table(spark, sf_dir, "documents").select("source").distinct().where("source is not null").select(
            F.col("source").alias("id"), F.concat(F.lit("Outlet "), n).alias("name"), (n % 10 != 9).alias("active"),
            pick(CATEGORIES, n % 4).alias("category"), pick(LABELS, n % 7).alias("allsides_label"), (n % 7 - 3).cast("double").alias("allsides_score"),
        )
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, with scores where labels has them."""
    doc = F.col("doc_id")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    labels = read_table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.substring(F.sha2(F.concat_ws(":", "source", doc.cast("string")), 256), 1, 16).alias("id"),
        F.col("source").alias("source_id"),
        F.substring(F.split_part(F.col("text"), F.lit("\n"), F.lit(1)), 1, 80).alias("title"),
        F.when(doc % 53 != 0, F.col("text")).alias("body"),
        F.concat(F.lit("https://news.example/a/"), doc).alias("url"),
        F.when(doc % 29 != 0, F.timestamp_seconds(F.unix_timestamp(F.lit(ANCHOR)) - (doc * 37 % 96) * 3600)).alias("published"),
        F.when(doc % 7 != 0, (doc % 101) / 10.0 - 5).alias("bias_score"),
        F.when(doc % 7 != 0, (doc % 10) / 10.0).alias("confidence"),
        (F.col("quality") * 2.0 - 1).alias("sentiment_score"),
        F.col("toxic").cast("double").alias("intensity_score"),
    )


def feed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, block, xml: a feed for each source and block of 96 neighbouring documents, RSS and Atom by turns, entries by doc_id."""
    block, title = F.floor(F.col("doc_id") / 96), F.concat(F.lit("Report "), "doc_id", F.lit(" &amp; more"))
    timed = lambda before, layout, after: F.coalesce(F.concat(F.lit(before), F.date_format("published", layout), F.lit(after)), F.lit(""))
    rss = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), "url", F.lit("</link>"), timed("<pubDate>", "EEE, dd MMM yyyy HH:mm:ss", " GMT</pubDate>"), F.lit("</item>"))
    atom = F.concat(F.lit('<entry><title type="html">'), title, F.lit('</title><link rel="self" href="x"/><link href="'), "url", F.lit('"/>'), timed("<updated>", "yyyy-MM-dd'T'HH:mm:ss", "Z</updated>"), F.lit("</entry>"))
    rows = articles(spark, sf_dir).where("source_id is not null").select("source_id", "doc_id", block.alias("block"), F.when(block % 2 == 0, rss).otherwise(atom).alias("entry"))
    held = rows.groupBy("source_id", "block").agg(F.array_sort(F.collect_list(F.struct("doc_id", "entry"))).alias("e"))
    entries = F.array_join("e.entry", "")
    whole = F.when(F.col("block") % 2 == 0, F.concat(F.lit('<rss version="2.0"><channel><title>Feed</title>'), entries, F.lit("</channel></rss>")))
    return held.select("source_id", "block", whole.otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>Feed</title>'), entries, F.lit("</feed>"))).alias("xml"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, turn, article_key, user_score, feedback_type, dimension, created_at: one row a conversation turn."""
    turns = read_table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "thumbs_up").when(F.col("role") == "assistant", "slider").otherwise("thumbs_down")
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "turn", F.col("conv_id").alias("article_key"),
        ((F.char_length("text") % 101) / 10.0 - 5).alias("user_score"), kind.alias("feedback_type"),
        pick(["bias", "sentiment", "intensity"], F.col("conv_id") % 3).alias("dimension"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(ANCHOR)) - (F.col("conv_id") * 11 + F.col("turn")) % 500 * 3600).alias("created_at"),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """version, trained_at, feedback_count, accuracy: a bias model for each day with bias feedback before 20 January, at six."""
    own = feedback(spark, sf_dir).where("dimension = 'bias' and created_at < '2024-01-20'")
    days = own.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").cast("int").alias("feedback_count"))
    number = F.row_number().over(Window.orderBy("day"))  # a row a day
    return days.select(number.alias("version"), (F.col("day").cast("timestamp") + F.expr("interval 6 hours")).alias("trained_at"), "feedback_count", (F.col("feedback_count") % 7 / 10.0 + 0.3).alias("accuracy"))


#: Symbols of the market page, by name.
SYMBOLS = sorted({s for listed in BUCKETS.values() for s in listed})


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, price, trades: of events, dealt to the market page's symbols by number; every fifth symbol has none."""
    at = F.col("event_id") % len(SYMBOLS)
    events = read_table(spark, sf_dir, "events").where(at % 5 != 3).select(pick(SYMBOLS, at).alias("symbol"), "event_id", "value")
    return events.groupBy("symbol").agg(F.max_by("value", "event_id").alias("price"), F.count("*").alias("trades"))


def trending_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """payload: the quote service's answer to what trends, the dearest quotes first; one row."""
    listed = F.reverse(F.array_sort(F.collect_list(F.struct("price", "symbol"))))  # a row a symbol
    named = F.transform(listed, lambda q: F.struct(q["symbol"].alias("symbol")))
    return quotes(spark, sf_dir).agg(named.alias("q")).select(F.to_json(F.struct(F.struct(F.array(F.struct(F.col("q").alias("quotes"))).alias("result")).alias("finance"))).alias("payload"))


def story_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, article_ids (by doc_id): groups of two or more from neighbouring documents, fixed by key."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    key = F.concat(F.floor(F.col("doc_id") / 96).cast("string"), F.lit("-"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 1))
    one = F.substring(F.sha2(F.concat_ws(":", "source", F.col("doc_id").cast("string")), 256), 1, 16)
    held = docs.groupBy(key.alias("group_id")).agg(F.array_sort(F.collect_list(F.struct("doc_id", one.alias("id")))).alias("m"))
    return held.where(F.size("m") > 1).select("group_id", F.col("m.id").alias("article_ids"))


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction markets: one row an event; the question is a benchmark text."""
    k = F.get_json_object("props", "$.k").cast("int")
    events = read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", k.alias("k"))
    questions = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("question"))
    event = F.col("event_id")
    return events.join(questions, F.col("q") == event % 40, "left").select(
        F.col("event_id").alias("id"), "question", F.col("event_type").alias("category"),
        (F.col("k") / 100.0).alias("yes_price"), ((F.col("k") - 50) / 100.0).alias("yes_change_24h"), F.col("value").alias("volume_24h"),
        F.when(event % 11 != 0, F.timestamp_seconds(F.unix_timestamp("ts") + F.col("k") * 3600)).alias("end_date"), F.col("ts").alias("last_updated"),
    )


def raw_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload rows that signal normalization reads: outcomes and prices as JSON text."""
    event = F.col("id")
    outcomes = F.when(event % 17 == 0, "[\"Yes\"").when(event % 13 == 0, '["No","Yes"]').otherwise('["Yes","No"]')
    prices = F.concat(F.lit('["'), F.col("yes_price").cast("string"), F.lit('","'), (1 - F.col("yes_price")).cast("string"), F.lit('"]'))
    return markets(spark, sf_dir).select(
        event.cast("string").alias("condition_id"), F.lit(None).cast("string").alias("market_id"), "question", outcomes.alias("outcomes"), prices.alias("outcome_prices"),
        F.when(event % 19 == 0, "sports_fee").alias("fee_type"), F.when(event % 23 == 0, "game").alias("sports_market_type"),
        F.concat(F.lit("m-"), event).alias("slug"), F.col("yes_change_24h").alias("one_day_price_change"), F.col("volume_24h").alias("volume_24hr"),
    )


def ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, t (day), o, h, l, c, v: a daily series a market segment; c is null on each 13th."""
    orders, customers = (read_table(spark, sf_dir, t) for t in ("orders", "customer"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    daily = joined.groupBy(F.col("c_mktsegment").alias("symbol"), F.to_date("o_orderdate").alias("t")).agg(
        F.min_by(price, key).alias("o"), F.max(price).alias("h"), F.min(price).alias("l"), F.max_by(price, key).alias("c"), F.count("*").alias("v")
    )
    return daily.withColumn("c", F.when(F.dayofmonth("t") != 13, F.col("c")))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly observations: one row an hour of events; the numbers follow from the hour's sum of k."""
    k = F.get_json_object("props", "$.k").cast("int")
    hour = F.date_trunc("hour", "ts")
    by = read_table(spark, sf_dir, "events").groupBy(hour.alias("time")).agg(F.round(F.avg("value"), 4).alias("temperature"), F.round(F.avg(k), 4).alias("precip_prob"), F.sum(k).alias("s"))
    s = F.col("s")
    return by.select(
        "time", "temperature", "precip_prob", "s", pick(WMO_CODES, s % 28).alias("code"), F.hour("time").between(6, 18).alias("is_day"),
        (s % 101).cast("double").alias("cover"), (s * 37 % 16000).cast("double").alias("visibility"), (s % 120 / 10.0).alias("uv"),
        (1000 + s % 40).cast("double").alias("pressure"), (40 + s % 45).cast("double").alias("dew_point"), (s * 7 % 360).cast("double").alias("wind_direction"),
        (s % 7 / 500.0).alias("precip"), (s % 60).cast("double").alias("gust"),
    )


def pollutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reading_id, ts, pollutant, value: one row an event, and carbon monoxide from even view events."""
    events = read_table(spark, sf_dir, "events")
    name = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "pm2_5", "click", "pm10", "error", "o3", "signup", "no2", "purchase", "so2")]), F.col("event_type"))
    first = events.select(F.col("event_id").alias("reading_id"), "ts", name.alias("pollutant"), "value")
    co = events.where("event_type = 'view' and event_id % 2 = 0").select(F.col("event_id").alias("reading_id"), "ts", F.lit("co").alias("pollutant"), (F.col("value") * 100).alias("value"))
    return first.unionByName(co)


#: Categories of the derived lexicon, and the words that it is chosen from: the most frequent ones.
LEXICON_CATEGORIES = ["positive", "negative", "anger", "fear", "joy", "sadness", "disgust", "trust", "anticipation", "surprise", "loaded_language"]
LEXICON_WORDS = 50_000


def lexicon(tokens: DataFrame) -> DataFrame:
    """category, word: of the most frequent words of tokens (an array column) those whose digest begins with 0, 1 or 2. The
    digest's second digit is the word's category, if there are so many; its third makes it positive (0 to 3) or negative (4 to 7) too."""
    ranked = tokens.select(F.explode(tokens.columns[0]).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(LEXICON_WORDS)
    digit = lambda i: F.instr(F.lit("0123456789abcdef"), F.substring(F.sha2("word", 256), i, 1)) - 1
    more = F.when(digit(3) < 4, "positive").when(digit(3) < 8, "negative")
    categories = F.array_distinct(F.array_compact(F.array(pick(LEXICON_CATEGORIES, digit(2)), more)))
    return ranked.where(digit(1) < 3).select(F.explode(categories).alias("category"), "word")
