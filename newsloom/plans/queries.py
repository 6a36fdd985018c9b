"""The queries over the derived tables, by inventory id. Each takes a session and a folder of Parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import constants as C
from newsloom.functions import features as X
from newsloom.functions import labels as L
from newsloom.functions import text as T
from newsloom.functions import weather as W
from newsloom.operators import cluster, emotions, feed, markets, models, retrain, scoring, signals, stats, store, stories, summarize, tfidf
from newsloom.operators import weather as hourly
from newsloom.session import read_table, settled, shared_folder
from newsloom.sources import fixtures as S
from newsloom.sources import feed_xml, payloads
from newsloom.sources.lexicon import read_tsv_lexicon, write_tsv_lexicon
from newsloom.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LEXICON = C.SMALL_LEXICON
FINANCE = tuple(f"src{n}" for n in range(20) if n % 4 == 0 and n % 10 != 9)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f"q_{f.__name__}"] = f
    return f


def stamp(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def six(column: Column) -> Column:
    return F.round(column, 6)


# Sources, feed and related


@query
def s8_active_sources(spark, sf):
    return S.sources(spark, sf).where("active").select("id", "name", "category", "allsides_label", "allsides_score")


@query
def s1_feed_xml(spark, sf):
    """Feeds as XML, parsed: 30 entries of each at most, as a poll takes them."""
    return ingest.feed_articles(feed_xml.feed_rows(S.feed_documents(spark, sf))).select("id", "source_id", "title", "url", stamp("published").alias("published"))


@query
def a21_sources_by_category(spark, sf):
    return S.sources(spark, sf).groupBy("category").agg(F.array_join(F.sort_array(F.collect_list("name")), "|").alias("names"))


@query
def f1_feed_filter(spark, sf):
    policy = feed.Policy(source_ids=FINANCE, lookback_hours=48)
    rows = feed.feed_filter(S.articles(spark, sf), policy, S.NOW, min_score=-2.0, max_score=3.0)
    return rows.select("id", "source_id", "title", stamp("published").alias("published"), "bias_score")


@query
def f2_null_range(spark, sf):
    rows = feed.feed_filter(S.articles(spark, sf), feed.Policy(), S.NOW, min_score=0.0)
    return rows.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.col("bias_score").isNull()).alias("n_null"))


@query
def f3_lookback_floor(spark, sf):
    return feed.feed_filter(S.articles(spark, sf), feed.Policy(lookback_hours=24), S.NOW).groupBy("source_id").agg(F.count("*").alias("n"))


@query
def f3_lookback_exact(spark, sf):
    return feed.feed_filter(S.articles(spark, sf), feed.Policy(lookback_hours=24), S.NOW, mode="exact").groupBy("source_id").agg(F.count("*").alias("n"))


@query
def f6_low_signal(spark, sf):
    padded = F.when(F.col("doc_id") % 17 == 0, F.concat("title", F.lit(" draft pick"))).when(F.col("doc_id") % 19 == 0, F.lit("")).otherwise(F.col("title"))
    return S.articles(spark, sf).select("doc_id", T.low_signal(padded).alias("low_signal"))


@query
def f7_paywall(spark, sf):
    wall = F.lit(" Subscribe to read. Cancel anytime.")
    text = F.when(F.col("doc_id") % 11 == 0, F.concat(F.coalesce("body", F.lit("")), wall)).when(F.col("doc_id") % 13 == 0, F.lit("cancel anytime")).otherwise(F.coalesce("body", F.lit("")))
    return S.articles(spark, sf).select("doc_id", T.paywall(text).alias("paywall"))


@query
def f10_short_bodies(spark, sf):
    tried = F.when(F.col("doc_id") % 3 == 0, F.lit(S.NOW).cast("timestamp") - F.make_dt_interval(F.lit(0), (F.col("doc_id") % 48).cast("int")))
    rows = feed.short_bodies(S.articles(spark, sf).withColumn("scrape_attempted_at", tried), S.NOW)
    return rows.select("id", "source_id", stamp("published").alias("published"))


@query
def f11_unscored(spark, sf):
    rows = S.articles(spark, sf).withColumn("summary", F.when(F.col("doc_id") % 5 != 0, F.lit("x")))
    return feed.unscored(rows, bias=True, sentiment=True).select("id", "source_id")


@query
def f12_feedback_dimension(spark, sf):
    return stats.of_dimensions(S.feedback(spark, sf), ["sentiment", "intensity"]).groupBy("dimension", "feedback_type").agg(F.count("*").alias("n"), six(F.avg("user_score")).alias("avg_score"))


@query
def f14_market_news(spark, sf):
    rows = feed.market_news(S.articles(spark, sf), ["the", "und", "les"], limit=10)
    return rows.select("id", "title", stamp("published").alias("published"))


@query
def f17_digest_usable(spark, sf):
    summary = F.when(F.col("doc_id") % 4 == 0, F.substring("body", 1, 150))
    return S.articles(spark, sf).select("doc_id", T.digest_text(F.col("title"), summary, F.col("body")).alias("digest")).where("digest is not null").select("doc_id", F.sha2("digest", 256).alias("digest_sha256"))


@query
def f18_excerpt(spark, sf):
    summary = F.when(F.col("doc_id") % 4 == 0, F.substring("body", 100, 150))
    return S.articles(spark, sf).select("doc_id", T.excerpt(F.col("title"), summary, F.col("body")).alias("excerpt"))


@query
def j1_enrich(spark, sf):
    known = S.sources(spark, sf).where("active")
    rows = feed.shown_scores(feed.enrich(S.articles(spark, sf), known))
    return rows.select("id", "source_name", "source_category", "source_label", "source_score", "shown_score", "shown_confidence")


@query
def f20_shown_scores(spark, sf):
    rows = feed.shown_scores(feed.enrich(S.articles(spark, sf), S.sources(spark, sf)))
    return rows.select("id", *[six(F.col(c)).alias(c) for c in ("shown_score", "shown_confidence", "shown_sentiment", "shown_intensity")])


@query
def s11_lookup(spark, sf):
    """All articles in a keyed store, and one of them by its id: a bucket, and of its files the row groups that may hold it."""
    rows = S.articles(spark, sf).select("doc_id", "id", "source_id", "title")
    one = rows.where("doc_id = 7").first()
    held = ingest.open_store(spark, f"{shared_folder(spark)}/lookup-{uuid.uuid4().hex}")
    held.commit({"articles": rows})
    held.compact("articles")
    return held.lookup("articles", one["id"] if one else "").select("id", "source_id", "title")


@query
def a5_has_version(spark, sf):
    return stats.has_version(S.versions(spark, sf))


@query
def j2_source_stats(spark, sf):
    fetches = read_table(spark, sf, "documents").groupBy(F.col("source").alias("source_id")).agg(F.count("*").alias("article_count"), F.count_if(F.col("doc_id") % 5 == 0).alias("error_count"))
    return feed.source_stats(S.sources(spark, sf).select("id", "name"), fetches.where("source_id <> 'src3'"))


@query
def j4_group_expand(spark, sf):
    rows = stories.expand(S.story_groups(spark, sf), S.articles(spark, sf).where("body is not null and bias_score is not null"))
    return rows.select("group_id", F.col("pos").cast("long").alias("pos"), "id", "title")


@query
def j5_containing_group(spark, sf):
    target = F.substring(F.sha2(F.concat_ws(":", "source", F.col("doc_id").cast("string")), 256), 1, 16)
    one = read_table(spark, sf, "documents").where("doc_id = 7").select(target.alias("id"))
    held = stories.members(S.story_groups(spark, sf))
    return held.join(one, "id", "left_semi").select("group_id", "id", F.col("group_size").cast("long").alias("group_size"))


@query
def j6_coverage(spark, sf):
    groups = S.story_groups(spark, sf)
    return stories.coverage(groups.select("group_id"), groups, S.articles(spark, sf), S.sources(spark, sf).where("active")).select("group_id", F.array_join("sources", "|").alias("sources"))


@query
def j7_market_signal(spark, sf):
    words = ["the", "of", "and", "que", "der", "les"]
    listed = signals.listed(S.markets(spark, sf), "movers", 80)
    ranked = listed.withColumn("rank", F.row_number().over(Window.orderBy(F.abs("yes_change_24h").desc(), "id")).cast("long"))  # 80 rows
    return stories.market_signals(S.articles(spark, sf), ranked, words).select("id", "signal_rank", "yes_price", "yes_change_24h")


@query
def j8_label_override(spark, sf):
    return stats.overrides(S.feedback(spark, sf).where("dimension = 'bias'")).select("article_key", six(F.col("user_score")).alias("user_score"))


@query
def j10_cosine_pairs(spark, sf):
    """Title pairs by cosine of their TF-IDF vectors; titles of the same words are one vector until pairs are given."""
    counts = tfidf.terms(S.articles(spark, sf).select("doc_id", "title").distinct(), "doc_id", "title")
    n = read_table(spark, sf, "documents").select("doc_id").distinct().count()
    classes = settled(tfidf.copies(counts, "doc_id"))
    held = classes.select("first", "n", F.inline("bag"))
    known = held.groupBy("term").agg(F.sum("n").alias("df")).where("df >= 2")
    weighted = tfidf.weigh(held.join(known, "term").select("first", "term", "tf", "df"), "first", n)
    return tfidf.short_pairs(weighted, "first", 0.5, classes.select("first", "keys")).select("a", "b", F.round("cosine", 4).alias("cosine"))


@query
def j10_article_pairs(spark, sf):
    """Article pairs by cosine over 0.32 of title twice and body, all articles; the reference's vocabulary and stop list."""
    docs = S.articles(spark, sf).where("title is not null").select("doc_id", cluster.cluster_text().alias("text"))
    known = settled(tfidf.frequent_terms(docs, "text", tfidf.stop_words(), 3000).withColumn("at", F.monotonically_increasing_id()))
    weighted = tfidf.weigh(tfidf.terms(docs, "doc_id", "text", tfidf.stop_words(), bigrams=True, known=known), "doc_id", docs.count())
    return tfidf.long_pairs(weighted, "doc_id", 0.32).select("a", "b", F.round("cosine", 4).alias("cosine"))


@query
def j10_dense_pairs(spark, sf):
    return tfidf.dense_pairs(read_table(spark, sf, "embeddings"), 0.5).select("a", "b", F.round("cosine", 4).alias("cosine"))


@query
def j14_related(spark, sf):
    first = S.articles(spark, sf).where("doc_id = 7").select("id", "source_id").first()
    rows = feed.related(S.articles(spark, sf), S.story_groups(spark, sf), *(first or ("", "")))
    return rows.select("kind", "id", "source_id", "title", stamp("published").alias("published"))


@query
def w1_feed_capped(spark, sf):
    policy = feed.curation_policy(category="finance", sources_of_category=FINANCE)
    rows = feed.page_of(feed.capped(feed.feed_filter(S.articles(spark, sf), policy, S.NOW), policy.per_source_cap))
    return feed.enrich(rows, S.sources(spark, sf)).select(F.col("pos").cast("long").alias("pos"), "id", "source_id", "source_name", "title", stamp("published").alias("published"))


@query
def t2_page(spark, sf):
    return feed.page_of(S.articles(spark, sf), page=3, per_page=15).select(F.col("pos").cast("long").alias("pos"), "id", stamp("published").alias("published"))


@query
def w3_dedupe(spark, sf):
    rows = S.articles(spark, sf).withColumn("pos", F.col("doc_id"))
    return feed.dedupe(rows).select("pos", "id", "source_id")


# Stories


@query
def w2_top_stories(spark, sf):
    scored = stories.ranked(S.articles(spark, sf), S.story_groups(spark, sf), S.NOW, prestige=["src2", "src6"])
    return stories.top_stories(scored, 12).select(F.col("pos").cast("long").alias("pos"), "id", "group_id", F.col("group_size").cast("long").alias("group_size"), "score", "title")


def _spots(spark, sf) -> DataFrame:
    rows = stories.expand(S.story_groups(spark, sf), S.articles(spark, sf).select("id", "source_id", "title", "bias_score"))
    return stories.blindspot(stories.outlet_lean(rows, S.sources(spark, sf)))


@query
def a8_outlet_lean(spark, sf):
    return _spots(spark, sf).select("group_id", "outlets", "left_n", "center_n", "right_n")


@query
def d18_blindspot(spark, sf):
    return _spots(spark, sf).select("group_id", "direction", six(F.col("skew")).alias("skew"))


@query
def t7_stories_by_skew(spark, sf):
    return stories.stories_of_side(_spots(spark, sf), "left").select("group_id", "outlets", six(F.col("skew")).alias("skew"))


@query
def a20_chip_counts(spark, sf):
    return stories.chip_counts(_spots(spark, sf))


@query
def l6_lean_shares(spark, sf):
    return _spots(spark, sf).select("group_id", *[six(F.col(c) / F.col("outlets")).alias(c.replace("_n", "_share")) for c in ("left_n", "center_n", "right_n")])


@query
def w9_headline(spark, sf):
    return stories.headline(stories.expand(S.story_groups(spark, sf), S.articles(spark, sf))).select("group_id", "id", "title")


# Signals and statistics


@query
def d19_signal_normalize(spark, sf):
    return signals.normalize(S.raw_markets(spark, sf)).select("id", "question", "category", "yes_price", "yes_change_24h", "volume_24h", "url")


@query
def d19_categorize(spark, sf):
    tails = ["", " bitcoin", " ceasefire", " fed decision", " senate vote", " nfl draft"]
    rows = read_table(spark, sf, "benchmark").select("item_id", F.concat("text", S.pick(tails, F.col("item_id") % 6)).alias("q"))
    return rows.select("item_id", signals.category(F.col("q")).alias("category"))


@query
def f8_binary_market(spark, sf):
    raw = S.raw_markets(spark, sf)
    return raw.select(F.col("condition_id").alias("id"), signals.is_binary(F.col("outcomes")).alias("is_binary"), signals.is_sports(F.col("fee_type"), F.col("sports_market_type")).alias("is_sports"))


@query
def f13_active_markets(spark, sf):
    return signals.active(S.markets(spark, sf), S.NOW, "view").select("id", stamp("end_date").alias("end_date"))


def _listed(spark, sf, sort):
    return signals.listed(signals.active(S.markets(spark, sf), "2024-01-15 12:00:00"), sort, 40).select("id", "category", "yes_change_24h", six(F.col("volume_24h")).alias("volume_24h"), stamp("end_date").alias("end_date"))


@query
def t3_signals_movers(spark, sf):
    return _listed(spark, sf, "movers")


@query
def t3_signals_volume(spark, sf):
    return _listed(spark, sf, "volume")


@query
def t3_signals_expiry(spark, sf):
    return _listed(spark, sf, "expiry")


@query
def a1_category_counts(spark, sf):
    return signals.category_counts(S.markets(spark, sf))


@query
def a2_meta(spark, sf):
    return signals.meta(S.markets(spark, sf)).select("total", stamp("last_updated").alias("last_updated"))


@query
def a4_since_retrain(spark, sf):
    return stats.since_last(S.feedback(spark, sf), S.versions(spark, sf))


@query
def a6_latest_version(spark, sf):
    return stats.latest_version(S.versions(spark, sf)).select(F.col("version").cast("long").alias("version"), F.col("feedback_count").cast("long").alias("feedback_count"), "accuracy")


@query
def a7_stats(spark, sf):
    return stats.summary(S.feedback(spark, sf), S.versions(spark, sf)).select("total", "pending", F.col("version").cast("long").alias("version"), "n_versions", six(F.col("progress")).alias("progress"))


@query
def a11_sentiment_summary(spark, sf):
    rows = markets.sentiment_summary(S.articles(spark, sf))
    return rows.select("n", "pos", "neg", "left_n", "right_n", "center_n", six(F.col("avg_sentiment")).alias("avg_sentiment"), six(F.col("avg_bias")).alias("avg_bias"), L.sentiment_label(F.col("avg_sentiment")).alias("label"))


# Text features


def _features(spark, sf) -> DataFrame:
    return X.feature_table(S.articles(spark, sf))


def _rounded(columns: dict[str, Column]) -> list[Column]:
    return [six(c).alias(name) for name, c in columns.items()]


def _lexicon_features(spark, sf) -> tuple[DataFrame, dict[str, Column]]:
    """Articles with text and tokens and their hits in a lexicon of thousands of words, which goes through its file layout."""
    rows = _features(spark, sf)
    path = write_tsv_lexicon(S.lexicon(rows.select("tokens")), f"{shared_folder(spark)}/lexicon-{uuid.uuid4().hex}")
    return emotions.counted(rows, "doc_id", "tokens", read_tsv_lexicon(spark, path, S.LEXICON_CATEGORIES), S.LEXICON_CATEGORIES)


@query
def a10_lexicon_density(spark, sf):
    rows, hits = _lexicon_features(spark, sf)
    return rows.select("doc_id", *_rounded({c: X.density(F.col("tokens"), w) for c, w in hits.items()}))


@query
def s9_lexicon(spark, sf):
    """Words of each category, as read from the file."""
    path = write_tsv_lexicon(S.lexicon(_features(spark, sf).select("tokens")), f"{shared_folder(spark)}/lexicon-{uuid.uuid4().hex}")
    return read_tsv_lexicon(spark, path, S.LEXICON_CATEGORIES).groupBy("category").agg(F.count("*").alias("n"), F.min("word").alias("first"), F.max("word").alias("last"))


@query
def d5_linguistic(spark, sf):
    rows, hits = _lexicon_features(spark, sf)
    return feed.enrich(rows, S.sources(spark, sf)).select("doc_id", *_rounded(X.bias_vector(F.col("full_text"), F.col("tokens"), F.col("source_score"), hits["negative"])))


@query
def d7_sentiment_vec(spark, sf):
    rows, hits = _lexicon_features(spark, sf)
    return rows.select("doc_id", *_rounded(X.sentiment_vector(F.col("full_text"), F.col("tokens"), hits)))


@query
def d8_emotions(spark, sf):
    rows, hits = _lexicon_features(spark, sf)
    return rows.select("doc_id", *_rounded(X.emotion_breakdown(F.col("tokens"), hits)))


def _bootstrapped(spark, sf) -> DataFrame:
    rows, hits = _lexicon_features(spark, sf)
    return rows.select("doc_id", "bias_score", X.bootstrap_polarity(F.col("tokens"), hits).alias("polarity"), X.bootstrap_intensity(F.col("full_text"), F.col("tokens"), hits).alias("intensity"))


@query
def d9_bootstrap(spark, sf):
    return _bootstrapped(spark, sf).select("doc_id", *_rounded({c: F.col(c) for c in ("polarity", "intensity")}))


@query
def d10_classes(spark, sf):
    as_long = lambda c: c.cast("long")
    return _bootstrapped(spark, sf).select("doc_id", as_long(X.polarity_class(F.col("polarity"))).alias("polarity_class"), as_long(X.intensity_class(six(F.col("intensity")), 0.02, 0.03)).alias("intensity_class"), as_long(X.bias_class(F.col("bias_score"))).alias("bias_class"))


@query
def d11_fallback(spark, sf):
    return _bootstrapped(spark, sf).select("doc_id", X.fallback_intensity(six(F.col("intensity")), 0.02).alias("intensity"))


@query
def a22_percentiles(spark, sf):
    events = read_table(spark, sf, "events").select("event_type", F.when(F.col("value") > 0, F.col("value")).alias("v"))
    p = stats.exact_percentiles(events, ["event_type"], "v", [0.33, 0.66])
    return p.select("event_type", F.round(F.get("p", F.lit(0)), 4).alias("p33"), F.round(F.get("p", F.lit(1)), 4).alias("p66"))


@query
def d2_norm_title(spark, sf):
    return S.articles(spark, sf).select("doc_id", T.norm_title(F.col("title")).alias("title_key"))


@query
def d3_ids(spark, sf):
    return S.articles(spark, sf).select("doc_id", T.stable_id(F.col("source_id"), F.col("url")).alias("article_id"))


@query
def d4_words(spark, sf):
    return S.articles(spark, sf).select("doc_id", F.greatest(F.lit(1), F.size(T.words(F.coalesce("body", F.lit(""))))).cast("long").alias("n_words"))


@query
def d6_tfidf(spark, sf):
    """Weights of the vocabulary of titles, single words and pairs, sublinear, two documents at least."""
    titles = S.articles(spark, sf).select("doc_id", "title")
    counts = tfidf.terms(titles, "doc_id", "title", bigrams=True)
    n = read_table(spark, sf, "documents").count()
    return tfidf.weights(counts, tfidf.vocabulary(counts), "doc_id", n, sublinear=True).select("doc_id", "term", F.round("w", 4).alias("w"))


@query
def d6_article_tfidf(spark, sf):
    """Weights of title and body of whole articles, as the bias model takes them: 5,000 terms, stop list, sublinear."""
    docs = S.articles(spark, sf).select("doc_id", F.concat_ws(" ", "title", "body").alias("text"))
    return _text_weights(docs, "doc_id", "text", 5000).select("doc_id", "term", F.round("w", 4).alias("w"))


@query
def d22_sentences(spark, sf):
    return S.articles(spark, sf).select("doc_id", F.size(T.sentences(F.col("body"))).cast("long").alias("n_sentences"))


@query
def d23_truncate(spark, sf):
    return S.articles(spark, sf).select("doc_id", T.truncate_words(T.norm_space(F.col("body")), 12).alias("short"))


@query
def d25_reading_time(spark, sf):
    return S.articles(spark, sf).select("doc_id", T.reading_minutes(F.col("body")).alias("minutes"), F.size(F.filter(F.split(F.coalesce("body", F.lit("")), "\n+"), lambda p: F.trim(p) != "")).cast("long").alias("n_paragraphs"))


@query
def d21_summary(spark, sf):
    return summarize.summaries(S.articles(spark, sf), "doc_id", "title", "body").select("doc_id", "summary")


@query
def d24_pull_quote(spark, sf):
    return S.articles(spark, sf).select("doc_id", summarize.pull_quote(F.col("title"), F.col("body")).alias("quote"))


@query
def d1_html_strip(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query
def s3_main_text(spark, sf):
    return T.with_main_text(read_table(spark, sf, "pages"), "html", "text").select("page_id", "text")


@query
def d16_story_groups(spark, sf):
    return cluster.story_clusters(S.articles(spark, sf)).select("group_id", F.array_join("article_ids", ",").alias("article_ids"))


# Models


def _text_weights(docs: DataFrame, key: str, text: str, most_terms: int) -> DataFrame:
    """Sublinear weights of words and pairs without stop words, in two documents at least."""
    known = settled(tfidf.frequent_terms(docs, text, tfidf.stop_words(), most_terms))
    return tfidf.weigh(tfidf.terms(docs, key, text, tfidf.stop_words(), bigrams=True, known=known), key, docs.count(), sublinear=True)


def _votes(spark, sf, dimension: str, name: str) -> DataFrame:
    """doc_id and, as `name`, the score of its last feedback of a dimension."""
    own = stats.overrides(S.feedback(spark, sf).where(F.col("dimension") == dimension))
    return own.withColumnRenamed("article_key", "doc_id").withColumnRenamed("user_score", name)


def _bias_rows(spark, sf) -> tuple[DataFrame, models.TextSpace]:
    """id, source_score, label and features, computed once, and the terms behind them. Sources, a row each, are sent to the texts, and votes
    join the features by id, so no text is shuffled."""
    articles = feed.enrich(S.articles(spark, sf), F.broadcast(S.sources(spark, sf)))
    votes = S.articles(spark, sf).select("doc_id", "id").join(_votes(spark, sf, "bias", "vote"), "doc_id").select("id", "vote").dropDuplicates(["id"])
    rows, space = scoring.bias_rows(articles, LEXICON["negative"])
    rows = rows.join(votes, "id", "left")
    return settled(rows.select("id", "source_score", X.bias_class(F.coalesce("vote", "source_score")).alias("label"), "features")), space


@query
def d13_bias_scores(spark, sf):
    rows, _ = _bias_rows(spark, sf)
    return models.predict(models.train(rows, models.BIAS_VALUES), rows, F.col("source_score")).select("id", "score", "confidence")


def _sentiment_rows(spark, sf) -> DataFrame:
    """Features and classes; feedback of a dimension overrides the class that the lexicon gives. Features are made before votes
    are joined, so no text is shuffled."""
    rows, hits = emotions.listed(_features(spark, sf), "tokens", LEXICON)
    vector = X.sentiment_vector(F.col("full_text"), F.col("tokens"), hits)
    made = rows.select("doc_id", "id", X.bootstrap_polarity(F.col("tokens"), hits).alias("polarity"), X.bootstrap_intensity(F.col("full_text"), F.col("tokens"), hits).alias("raw"), *[c.alias(n) for n, c in vector.items()])
    made = settled(made.join(_votes(spark, sf, "sentiment", "tone_vote"), "doc_id", "left").join(_votes(spark, sf, "intensity", "heat_vote"), "doc_id", "left").drop("doc_id"))
    return models.assemble(X.sentiment_classes(made, *models.intensity_thresholds(made, "raw")), list(vector))


@query
def d14_sentiment_scores(spark, sf):
    rows = _sentiment_rows(spark, sf)
    tone = models.train(rows.withColumnRenamed("p_class", "label"), models.POLARITY_VALUES)
    heat = models.train(rows.withColumnRenamed("i_class", "label"), models.INTENSITY_VALUES)
    scored = models.predict(tone, rows, F.col("polarity")).select("id", "features", "raw", F.col("score").alias("sentiment"))
    return models.predict(heat, scored, X.fallback_intensity(F.col("raw"))).select("id", "sentiment", F.col("score").alias("intensity"))


@query
def a23_metrics(spark, sf):
    got = models.train(_bias_rows(spark, sf)[0], models.BIAS_VALUES)
    return spark.createDataFrame([("bias", got.accuracy, got.mae)], "model string, accuracy double, mae double")


@query
def d15_retrain(spark, sf):
    """A store of all articles; the bias job's first version and its scores as one commit; the same job again finds nothing to do."""
    held = ingest.open_store(spark, f"{shared_folder(spark)}/retrain-{uuid.uuid4().hex}")
    held.commit({"articles": S.articles(spark, sf).select("id", "source_id", "title", "body", "url", "published")})
    rows, space = _bias_rows(spark, sf)
    feedback = S.feedback(spark, sf)
    made = [retrain.run_bias(held, rows, feedback, S.NOW, f"{held.root}/models", space) for _ in range(2)]
    counted = held.read("bias_versions").where(F.col("version") == F.lit(made[0])).select("version", "feedback_count")
    scored = held.read("articles").select("id", "bias_score", "confidence", "model_version")
    return scored.join(F.broadcast(counted), F.col("version") == F.col("model_version"), "left").drop("version").withColumn("again", F.lit(made[1]).cast("int"))


# Tables after a change


def _batches(spark, sf):
    """The labelled articles as the table, and all articles, with new titles, as what arrives."""
    rows = S.articles(spark, sf).select("id", "source_id", "title", "sentiment_score")
    return rows.where("sentiment_score is not null").drop("sentiment_score"), rows.withColumn("title", F.concat(F.lit("new "), "title")).drop("sentiment_score")


@query
def s12_insert_if_absent(spark, sf):
    return store.insert_absent(*_batches(spark, sf), "id").select("id", "title")


@query
def s13_upsert_latest(spark, sf):
    rows = S.feedback(spark, sf)
    keys = ["article_key", "feedback_type", "dimension"]
    old, new = rows.where("turn < 2"), rows.where("turn >= 2")
    first = store.upsert_latest(old.where("false"), old, keys, "created_at", "id")
    return store.upsert_latest(first, new, keys, "created_at", "id").select("id", *keys, six(F.col("user_score")).alias("user_score"))


@query
def s14_upsert_accumulate(spark, sf):
    counts = read_table(spark, sf, "documents").groupBy(F.col("source").alias("source_id"), (F.col("lang") == "en").alias("half")).agg(F.count("*").alias("article_count"), F.sum(F.col("doc_id") % 3).alias("error_count"), F.max("doc_id").alias("last_fetched"))
    old, new = (counts.where(F.col("half") == h).drop("half") for h in (False, True))
    return store.upsert_accumulate(old, new, "source_id", ["article_count", "error_count"], ["last_fetched"])


@query
def s14_source_counters(spark, sf):
    """Feeds in three batches, every seventh cut off, into a keyed store; the first batch is sent again. Counters of each source, and what stands in quarantine."""
    held = ingest.open_store(spark, f"{shared_folder(spark)}/feeds-{uuid.uuid4().hex}")
    feeds = S.feed_documents(spark, sf)
    broken = F.col("block") % 7 == 3
    landed = feeds.withColumn("xml", F.when(broken, F.substring("xml", 1, 60)).otherwise(F.col("xml"))).withColumn("landed", F.timestamp_seconds(F.unix_timestamp(F.lit(S.ANCHOR)) + F.col("block")))
    read = settled(feed_xml.feed_rows(landed))
    for number in (0, 1, 2, 0):
        held.commit(ingest.feed_changes(read.where(F.col("block") % 3 == number), number), batch=("feeds", number))
    kept = held.read("quarantine").groupBy("source_id").agg(F.count("*").alias("quarantined"))
    return held.read("sources").join(kept, "source_id", "left").select("source_id", "fetch_count", "article_count", "error_count", stamp("last_fetched").alias("last_fetched"), F.coalesce("quarantined", F.lit(0)).alias("quarantined"))


@query
def s12_keyed_store(spark, sf):
    """Articles into a keyed store in two commits that share a third of them, titles of the second changed; then scores as an update, folded."""
    held = ingest.open_store(spark, f"{shared_folder(spark)}/articles-{uuid.uuid4().hex}")
    rows = S.articles(spark, sf)
    first, second = rows.where("doc_id % 3 < 2"), rows.where("doc_id % 3 > 0").withColumn("title", F.concat(F.lit("new "), "title"))
    columns = ["id", "source_id", "title", "url", "published"]
    held.commit({"articles": first.select(columns)})
    held.commit({"articles": second.select(columns)}, {"articles": rows.where("bias_score is not null").select("id", "bias_score")})
    held.compact("articles")
    held.commit(updates={"articles": rows.where("doc_id % 5 = 0").select("id", F.lit(4.5).alias("bias_score"))})
    return held.read("articles").select("id", "source_id", "title", "bias_score")


@query
def s15_partial_update(spark, sf):
    rows = S.articles(spark, sf).select("id", "bias_score", F.lit("old").alias("summary"), "sentiment_score", "intensity_score")
    changes = rows.where("sentiment_score is not null").select("id", F.when(F.col("intensity_score") == 0, F.lit(1.5)).alias("bias_score"))
    return store.update_by_key(rows, changes, "id", ["bias_score"], reset=["summary"]).select("id", "bias_score", "summary")


@query
def s16_full_replace(spark, sf):
    return S.story_groups(spark, sf).select("group_id", F.array_join("article_ids", ",").alias("article_ids")).dropDuplicates(["group_id"])


@query
def s17_append_version(spark, sf):
    row = S.feedback(spark, sf).agg(F.count("*").cast("int").alias("feedback_count"))
    return store.append_version(S.versions(spark, sf).select("version", "feedback_count"), row).select(F.col("version").cast("long").alias("version"), F.col("feedback_count").cast("long").alias("feedback_count"))


@query
def s18_orphan_cleanup(spark, sf):
    return store.retain_members(S.articles(spark, sf), "source_id", S.sources(spark, sf).where("active"), "id").select("id", "source_id")


@query
def s19_prune(spark, sf):
    return signals.pruned(S.markets(spark, sf), S.ANCHOR, 2).select("id", "category")


@query
def s20_schema_evolution(spark, sf):
    old = S.feedback(spark, sf).select("id", "feedback_type")
    return store.with_columns(old, {"dimension": "string", "note": "string"}, {"dimension": "bias"})


# Price series


@query
def a12_range_perf(spark, sf):
    return markets.range_performance(S.ohlc(spark, sf)).select("symbol", "n", *[six(F.col(c)).alias(c) for c in ("first_c", "last_c", "high", "low", "change", "pct")])


@query
def a13_quote_change(spark, sf):
    rows = markets.with_previous(S.ohlc(spark, sf)).where("c is not null")
    return rows.select("symbol", F.col("t").cast("string").alias("t"), *[six(F.col(c)).alias(c) for c in ("previous_close", "change", "change_pct")])


@query
def a14_last40(spark, sf):
    return markets.last_closes(S.ohlc(spark, sf)).select("symbol", F.col("pos").cast("long").alias("pos"), F.col("t").cast("string").alias("t"), six(F.col("c")).alias("c"))


@query
def m6_sparkline(spark, sf):
    return markets.sparkline(markets.last_closes(S.ohlc(spark, sf))).select("symbol", F.col("pos").cast("long").alias("pos"), six(F.col("y")).alias("y"))


@query
def m4_baseline(spark, sf):
    made = markets.chart_extent(markets.baseline(markets.range_performance(S.ohlc(spark, sf)), None, False))
    return made.select("symbol", "direction", *[six(F.col(c)).alias(c) for c in ("baseline", "low_edge", "mid", "high_edge")])


def _payloads(spark, sf) -> DataFrame:
    """A chart payload a symbol, as the service would send it, with fewer volumes than points."""
    rows = S.ohlc(spark, sf)
    point = F.struct("t", "o", "h", "l", "c", F.col("v").cast("double").alias("v"))
    by = rows.groupBy("symbol").agg(F.array_sort(F.collect_list(point)).alias("p"))
    quote = F.struct(F.col("p.o").alias("open"), F.col("p.h").alias("high"), F.col("p.l").alias("low"), F.col("p.c").alias("close"), F.slice("p.v", 1, 80).alias("volume"))
    meta = F.struct(F.col("symbol"), F.concat(F.lit("Name "), "symbol").alias("longName"), F.array_max("p.h").alias("regularMarketPrice"), F.lit(0.0).alias("chartPreviousClose"), F.array_min("p.l").alias("previousClose"))
    result = F.struct(meta.alias("meta"), F.transform("p.t", lambda t: F.unix_date(t)).alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))
    return by.select("symbol", F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")), {"ignoreNullFields": "false"}).alias("payload"))


@query
def j12_ohlc_zip(spark, sf):
    rows = markets.chart_series(markets.parse_chart(_payloads(spark, sf)))
    return rows.select("symbol", F.date_from_unix_date(F.col("t").cast("int")).cast("string").alias("t"), six(F.col("c")).alias("c"), six(F.col("v")).alias("v"))


@query
def m1_compact_quote(spark, sf):
    rows = markets.compact_quote(markets.parse_chart(_payloads(spark, sf)))
    return rows.select("symbol", "name", *[six(F.col(c)).alias(c) for c in ("price", "previous_close", "change", "change_pct")], F.size("spark").cast("long").alias("n_spark"))


@query
def m3_buckets(spark, sf):
    trends = payloads.trending_symbols(S.trending_payload(spark, sf)).select(F.lit("trending").alias("bucket"), "pos", "symbol")
    return markets.bucketed(S.quotes(spark, sf), markets.bucket_table(spark).unionByName(trends)).groupBy("bucket").agg(F.count("*").alias("n"), F.count("price").alias("n_quotes"))


@query
def m5_formats(spark, sf):
    rows = read_table(spark, sf, "events").select("event_id", "value", (F.col("event_id") * 7919 % 100000).alias("n"))
    pct = (F.col("n") % 2000 - 1000) / 7.0
    return rows.select("event_id", L.volume_text(F.col("n") * F.col("n")).alias("volume"), L.signed_percent(pct).alias("pct"))


@query
def m7_time_ago(spark, sf):
    seconds = F.unix_timestamp(F.lit(S.NOW)) - F.unix_timestamp("published")
    return S.articles(spark, sf).select("doc_id", L.time_ago(seconds).alias("ago"))


@query
def l1_bias_label(spark, sf):
    return S.articles(spark, sf).select("doc_id", L.bias_label(F.col("bias_score")).alias("bias_label"), six(L.gauge_percent(F.col("bias_score"), -5, 5)).alias("gauge"))


@query
def l2_tone(spark, sf):
    s, i = F.col("sentiment_score"), F.col("intensity_score") * 0.5
    return S.articles(spark, sf).select("doc_id", L.tone_chip(s, i).alias("tone"), L.polarity_color(s).alias("polarity_color"), L.intensity_color(i).alias("intensity_color"))


@query
def d26_feedback_submit(spark, sf):
    rows = S.feedback(spark, sf)
    return rows.select("id", six(L.submitted_score(F.col("feedback_type"), F.lit(0.5), F.col("user_score"))).alias("score"))


# Weather and air quality


@query
def e1_wmo(spark, sf):
    c = F.col("code")
    return S.weather(spark, sf).select(stamp("time").alias("time"), W.describe(c).alias("label"), W.atmosphere(c, F.col("is_day")).alias("kind"), W.compass(F.col("wind_direction")).alias("wind"), W.is_precipitation(c).alias("wet"), W.precipitation_phrase(c).alias("phrase"))


@query
def e4_moon(spark, sf):
    phase, lit, name = W.moon(F.col("day"))
    days = read_table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select(F.col("day").cast("string").alias("day"), six(phase).alias("phase"), lit.cast("long").alias("illumination"), name.alias("name"))


@query
def e5_bands(spark, sf):
    miles, seen = W.visibility(F.col("visibility"))
    return S.weather(spark, sf).select(
        stamp("time").alias("time"), W.aqi_label((F.col("s") % 400).cast("double")).alias("aqi"), W.dew_comfort(F.col("dew_point")).alias("dew"), W.uv_band(F.col("uv")).alias("uv_band"),
        W.cloud_class(F.col("cover")).alias("cloud"), six(miles).alias("miles"), seen.alias("seen"), W.pollen_band(F.col("cover")).alias("pollen"),
    )


@query
def e6_subindex(spark, sf):
    return hourly.readings(S.pollutants(spark, sf)).select("reading_id", "pollutant", F.round("subindex", 6).alias("subindex"), F.round("fraction", 7).alias("fraction"), "band")


@query
def a19_aqi_driver(spark, sf):
    rows = hourly.drivers(hourly.readings(S.pollutants(spark, sf)), list(C.POLLUTANT_EDGES))
    return rows.select(stamp("hour").alias("hour"), "driver", F.round("subindex", 4).alias("subindex"))


@query
def a18_pollen_top(spark, sf):
    rows = read_table(spark, sf, "events").select(F.col("event_type").alias("species"), "value")
    return hourly.top_species(rows).select("species", F.round("peak", 4).alias("peak"))


@query
def w5_pressure_trend(spark, sf):
    return hourly.pressure_trends(S.weather(spark, sf)).select(stamp("time").alias("time"), "change", "trend")


@query
def w6_day_runs(spark, sf):
    rows = hourly.runs(S.weather(spark, sf), "is_day")
    return hourly.daylight(rows).select(F.col("day").cast("string").alias("day"), stamp("started").alias("started"), stamp("ended").alias("ended"), "n", "seconds", "trend", six(F.col("sun_fraction")).alias("sun_fraction"))


@query
def w7_next24(spark, sf):
    rows = hourly.from_now(S.weather(spark, sf), "2024-01-20 10:30:00", 24)
    return rows.select(F.col("pos").cast("long").alias("pos"), stamp("time").alias("time"), F.round("temperature", 4).alias("temperature"))


@query
def w8_nowcast(spark, sf):
    return hourly.nowcast(S.weather(spark, sf), "2024-01-20 10:30:00").select(F.col("code").cast("long").alias("code"), "rain_now", F.col("change_at").cast("long").alias("change_at"), "sentence")


@query
def a15_week_extremes(spark, sf):
    return hourly.day_extremes(S.weather(spark, sf)).select(F.col("day").cast("string").alias("day"), *[F.round(c, 4).alias(c) for c in ("hottest", "coldest", "spread")], "sun_hours")


@query
def e15_day_tags(spark, sf):
    rows = hourly.day_tags(hourly.day_extremes(S.weather(spark, sf)))
    return rows.select(F.col("day").cast("string").alias("day"), "tag", F.round("bar_left", 3).alias("bar_left"), F.round("bar_width", 3).alias("bar_width"))


@query
def a16_peaks(spark, sf):
    return hourly.peaks(S.weather(spark, sf)).select(F.col("day").cast("string").alias("day"), *[stamp(c).alias(c) for c in ("dew_peak", "uv_peak", "visibility_low")])


@query
def e16_day_strips(spark, sf):
    return hourly.day_strips(hourly.day_extremes(S.weather(spark, sf))).select(F.col("day").cast("string").alias("day"), "weekday", "gust", "uv", "uv_band", "sun_hours", F.col("gust_axis").cast("long").alias("gust_axis"))


@query
def e18_chart_extents(spark, sf):
    axes = hourly.value_axes(S.weather(spark, sf))
    return axes.select(F.col("day").cast("string").alias("day"), *[six(F.col(c).cast("double")).alias(c) for c in axes.columns[1:]])


# Payloads, views and small tables


@query
def s4_market_source(spark, sf):
    """The markets that each of 40 polls gives."""
    raw = S.raw_markets(spark, sf).withColumn("poll", F.col("condition_id").cast("long") % 40)
    return signals.most_traded(raw, "poll").select("condition_id", "poll", six(F.col("volume_24hr")).alias("volume"))


@query
def s5_weather_payload(spark, sf):
    """A day's hours as one payload and back; the air-quality call of some days has failed."""
    hours = hourly.with_day(S.weather(spark, sf))
    text = F.date_format("time", "yyyy-MM-dd'T'HH:mm")
    by = hours.groupBy(F.col("day").cast("string").alias("place")).agg(F.array_sort(F.collect_list(F.struct(text.alias("time"), "temperature", F.col("code").cast("int").alias("code"), "precip_prob", (F.col("s") % 300).cast("double").alias("aqi")))).alias("h"))
    forecast = by.select("place", F.to_json(F.struct(F.struct(*[F.col(f"h.{c}").alias(c) for c in ("time", "temperature", "code", "precip_prob")]).alias("hourly"))).alias("payload"))
    air = by.select("place", F.when(F.dayofmonth(F.col("place").cast("date")) % 5 != 0, F.to_json(F.struct(F.struct(F.col("h.time").alias("time"), F.col("h.aqi").alias("aqi")).alias("hourly")))).alias("payload"))
    rows = payloads.with_air_quality(payloads.weather_hours(forecast), air)
    return rows.select("place", F.col("pos").cast("long").alias("pos"), F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), F.round("temperature", 4).alias("temperature"), F.col("code").cast("long").alias("code"), "aqi")


@query
def s7_chart_requests(spark, sf):
    return payloads.chart_requests_of(S.quotes(spark, sf))


@query
def s6_trending(spark, sf):
    """The first symbols of the trending payload, with their quotes."""
    return payloads.trending_symbols(S.trending_payload(spark, sf)).join(S.quotes(spark, sf), "symbol").select("pos", "symbol", six(F.col("price")).alias("price"), "trades")


@query
def d20_symbol_keywords(spark, sf):
    return S.quotes(spark, sf).select("symbol", F.array_join(markets.symbol_keywords(F.col("symbol")), "|").alias("keywords"))


@query
def f19_nested(spark, sf):
    """The API's shape: a nested source and a parsed emotion breakdown."""
    rows = feed.enrich(S.articles(spark, sf), S.sources(spark, sf).where("active"))
    raw = F.when(F.col("doc_id") % 7 == 0, F.lit("{bad")).otherwise(F.to_json(F.create_map(F.lit("anger"), F.col("doc_id") % 10 / 10.0)))
    nested = feed.nested(rows.withColumn("emotion_breakdown", raw))
    return nested.select("id", F.col("source.name").alias("source_name"), F.col("source.allsides_label").alias("label"), six(F.try_element_at("emotion_breakdown", F.lit("anger"))).alias("anger"))


@query
def a3_counts(spark, sf):
    rows = S.articles(spark, sf)
    return rows.groupBy("source_id").agg(F.count("*").alias("total"), F.count("published").alias("dated"), F.count_if(F.col("title") != "").alias("titled"))


@query
def a9_group_sizes(spark, sf):
    rows = stories.members(S.story_groups(spark, sf)).join(S.articles(spark, sf).select("id", "source_id"), "id")
    by = rows.groupBy("group_id").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("outlets"))
    return by.where("n >= 2 and outlets >= 2")


@query
def j3_article_groups(spark, sf):
    held = stories.members(S.story_groups(spark, sf)).select("id", "group_id", F.col("group_size").cast("long").alias("group_size"))
    return S.articles(spark, sf).select("id").join(held, "id", "left")


@query
def w4_one_vote(spark, sf):
    rows = stories.expand(S.story_groups(spark, sf), S.articles(spark, sf).select("id", "source_id"))
    first = F.row_number().over(Window.partitionBy("group_id", "source_id").orderBy("pos"))
    return rows.withColumn("first", first).where("first = 1").select("group_id", "source_id", "id")


@query
def t9_home_slots(spark, sf):
    """The home page's slots of the top stories: carousel 0 to 6, hero 0, secondary 1 to 5, trending from 5 on."""
    scored = stories.ranked(S.articles(spark, sf), S.story_groups(spark, sf), S.NOW, prestige=["src2", "src6"])
    at = F.col("pos") - 1
    slots = F.array_compact(F.array(F.when(at < 6, "carousel"), F.when(at == 0, "hero"), F.when(at.between(1, 4), "secondary"), F.when(at >= 5, "trending")))
    return stories.top_stories(scored, 12).select(F.explode(slots).alias("slot"), F.col("pos").cast("long").alias("pos"), "id")


@query
def t10_version_history(spark, sf):
    return S.versions(spark, sf).orderBy(F.col("version").desc()).select(F.col("version").cast("long").alias("version"), stamp("trained_at").alias("trained_at"), "accuracy")


@query
def e17_day_labels(spark, sf):
    days = hourly.with_day(S.weather(spark, sf)).select("day").distinct()
    ahead = F.datediff("day", F.lit("2024-01-20"))
    label = F.when(ahead == 0, "Today").when(ahead == 1, "Tomorrow").otherwise(F.date_format("day", "E"))
    return days.select(F.col("day").cast("string").alias("day"), label.alias("label"))
