"""Stories: groups of articles, outlet balance, blindspots, ranking, ties to markets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import constants as C
from newsloom.functions.text import low_signal
from newsloom.operators.feed import cutoff, dedupe


def members(groups: DataFrame) -> DataFrame:
    """group_id, pos, id, group_size: one row a stored member."""
    return groups.select("group_id", F.size("article_ids").alias("group_size"), F.posexplode("article_ids").alias("pos", "id"))


def expand(groups: DataFrame, articles: DataFrame) -> DataFrame:
    """Members that exist, in stored order, of groups that keep more than one."""
    found = members(groups).join(articles, "id")
    kept = found.withColumn("_n", F.count("*").over(Window.partitionBy("group_id")))
    return kept.where("_n > 1").drop("_n", "group_size")


def side(label: Column) -> Column:
    return F.when(label.isin(*C.LEFT_LABELS), "left").when(label.isin(*C.RIGHT_LABELS), "right").otherwise("center")


def outlet_lean(expanded: DataFrame, sources: DataFrame) -> DataFrame:
    """group_id, outlets, left_n, center_n, right_n: a vote an outlet, the first in group order."""
    first = F.row_number().over(Window.partitionBy("group_id", "source_id").orderBy("pos"))
    votes = expanded.select("group_id", "source_id", "pos").withColumn("_first", first).where("_first = 1")
    labels = sources.select(F.col("id").alias("source_id"), "allsides_label")
    sided = votes.join(labels, "source_id", "left").withColumn("side", side(F.coalesce("allsides_label", F.lit("center"))))
    count = lambda s: F.count_if(F.col("side") == s)
    return sided.groupBy("group_id").agg(F.count("*").alias("outlets"), count("left").alias("left_n"), count("center").alias("center_n"), count("right").alias("right_n"))


def blindspot(lean: DataFrame, least_outlets: int = 4, share: float = 0.70) -> DataFrame:
    """lean with direction (the side that does not see the story) and skew."""
    partisan = F.col("left_n") + F.col("right_n")
    counts = (F.col("outlets") >= least_outlets) & (partisan > 0)
    right, left = F.col("right_n") / F.nullif(partisan, F.lit(0)), F.col("left_n") / F.nullif(partisan, F.lit(0))
    direction = F.when(counts & (right >= share), "left").when(counts & (left >= share), "right")
    skew = F.when(counts & (right >= share), right).when(counts & (left >= share), left).otherwise(0.0)
    return lean.withColumn("direction", direction).withColumn("skew", skew)


def stories_of_side(spots: DataFrame, direction: str, min_outlets: int = 4) -> DataFrame:
    return spots.where((F.col("direction") == direction) & (F.col("outlets") >= min_outlets)).orderBy(F.col("skew").desc(), "group_id")


def recency(published: Column, now: str) -> Column:
    hours = F.coalesce((F.unix_timestamp(F.lit(now)) - F.unix_timestamp(published)) / 3600.0, F.lit(24.0))
    return F.when(hours < 3, 3.0).when(hours < 12, 2.0).when(hours < 24, 1.0).otherwise(0.3)


def ranked(articles: DataFrame, groups: DataFrame, now: str, lookback_hours: int = 36, candidates: int = 500, prestige: list[str] = C.PRESTIGE_SOURCES) -> DataFrame:
    """The newest candidates with group and score: coverage, recency, prestige of single stories, intensity; to two places."""
    recent = articles.where(F.col("published") >= cutoff(now, lookback_hours)).orderBy(F.col("published").desc(), "id").limit(candidates)
    held = members(groups).select("id", "group_id", "group_size")
    joined = recent.join(held, "id", "left").withColumn("group_size", F.coalesce("group_size", F.lit(1)))
    bonus = F.when((F.col("group_size") == 1) & F.col("source_id").isin(*prestige), 2.0).otherwise(0.0)
    score = F.col("group_size") * 3.0 + recency(F.col("published"), now) + bonus + F.coalesce("intensity_score", F.lit(0.0)) * 0.6
    return joined.withColumn("score", F.bround(score, 2))


def top_stories(scored: DataFrame, limit: int = 12) -> DataFrame:
    """The best of each group, then over-fetched, freed of low-signal titles, cut, and deduplicated; with place."""
    order = [F.col("score").desc(), F.col("published").desc(), F.col("id")]
    one = F.row_number().over(Window.partitionBy(F.coalesce("group_id", "id")).orderBy(*order))
    best = scored.withColumn("_one", one).where("_one = 1").drop("_one").orderBy(*order).limit(3 * limit)
    kept = best.where(~low_signal(F.col("title"))).orderBy(*order).limit(limit)
    placed = kept.withColumn("pos", F.row_number().over(Window.orderBy(*order)))  # at most `limit` rows
    return dedupe(placed)


def coverage(stories: DataFrame, groups: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """group_id, sources: sorted names of the outlets that cover a story's group."""
    wanted = stories.select("group_id").where("group_id is not null").distinct()
    found = members(groups).where("group_size > 1").join(wanted, "group_id").join(articles.select("id", "source_id"), "id").select("group_id", "source_id").distinct()
    named = found.join(sources.select(F.col("id").alias("source_id"), "name"), "source_id")
    return named.groupBy("group_id").agg(F.sort_array(F.collect_set("name")).alias("sources"))


def keyword_rows(df: DataFrame, text: str, keywords: list[str]) -> DataFrame:
    """df by each keyword that column `text` contains."""
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    return df.withColumn("keyword", F.explode(F.filter(F.lit(keywords), lambda k: F.contains(lower, k))))


def market_signals(titles: DataFrame, signals: DataFrame, keywords: list[str] = C.CROSS_REFERENCE, least: float = 0.03) -> DataFrame:
    """titles (id, title) with the signal (rank, question, yes_change_24h) that moved most among those that share a
    keyword and moved more than `least`, the first on ties. Each keyword's best signal is found first, so the join is
    on keywords with a row each, and a title's best is the best of its keywords'."""
    moved = signals.where(F.abs("yes_change_24h") > least).select("rank", "question", "yes_price", "yes_change_24h")
    most = lambda: F.max_by("s", F.struct(F.abs("s.yes_change_24h"), -F.col("s.rank"))).alias("s")
    by_keyword = keyword_rows(moved, "question", keywords).select("keyword", F.struct("rank", "question", "yes_price", "yes_change_24h").alias("s")).groupBy("keyword").agg(most())
    best = keyword_rows(titles.select("id", "title"), "title", keywords).select("id", "keyword").join(by_keyword, "keyword").groupBy("id").agg(most())
    return titles.join(best.select("id", F.col("s.rank").alias("signal_rank"), "s.question", "s.yes_price", "s.yes_change_24h"), "id", "left")


def headline(expanded: DataFrame) -> DataFrame:
    """group_id, id, title of the member in the middle by bias score."""
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("bias_score", F.lit(0.0)).alias("score"), "pos", "id", "title")))
    by = expanded.groupBy("group_id").agg(order.alias("m"))
    return by.select("group_id", F.get("m", F.floor(F.size("m") / 2).cast("int")).alias("x")).select("group_id", "x.id", "x.title")


def chip_counts(spots: DataFrame) -> DataFrame:
    return spots.agg(F.count("*").alias("total"), F.count_if(F.col("direction") == "left").alias("left_blind"), F.count_if(F.col("direction") == "right").alias("right_blind"))
