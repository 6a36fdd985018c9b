"""Feed queries: curation policy, dynamic filters, capped pages, duplicates, related articles."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import constants as C
from newsloom.functions.text import contains_any, norm_title, paywall



def newest() -> list[Column]:
    """Newest first, undated last, by id on ties."""
    return [F.col("published").desc_nulls_last(), F.col("id").asc()]


@dataclass(frozen=True)
class Policy:
    """What a feed request resolves to before any data is touched."""

    source_id: str | None = None
    source_ids: tuple[str, ...] | None = None
    lookback_hours: int | None = None
    per_source_cap: int | None = None


def curation_policy(source_id: str | None = None, category: str | None = None, include_all: bool = False, lookback_hours: int | None = None,
                    sources_of_category: tuple[str, ...] = (), essential: tuple[str, ...] = tuple(sorted(C.ESSENTIAL_SOURCES))) -> Policy:
    """One source: its whole history; a category, or the essential sources: 24 hours and five a source; include_all: no curation."""
    if source_id:
        return Policy(source_id=source_id, lookback_hours=lookback_hours)
    if category or not include_all:
        chosen = tuple(sources_of_category) if category else essential
        return Policy(source_ids=chosen, lookback_hours=24 if lookback_hours is None else lookback_hours, per_source_cap=5)
    return Policy(lookback_hours=lookback_hours)


def cutoff(now: str, hours: int, mode: str = "date_floor") -> Column:
    """The least time that a lookback admits: by default the start of the cutoff's day, or the exact moment."""
    exact = F.timestamp_seconds(F.unix_timestamp(F.lit(now)) - hours * 3600)
    return F.date_trunc("day", exact) if mode == "date_floor" else exact


def at_least(column: Column, least: float | None) -> Column:
    """A lower bound that null passes."""
    return F.lit(True) if least is None else column.isNull() | (column >= least)


def at_most(column: Column, most: float | None) -> Column:
    return F.lit(True) if most is None else column.isNull() | (column <= most)


def feed_filter(articles: DataFrame, policy: Policy, now: str, min_score: float | None = None, max_score: float | None = None, mode: str = "date_floor") -> DataFrame:
    """The conjunction of what is asked for; an empty source list asks for nothing."""
    score = F.col("bias_score")
    tests = [at_least(score, min_score), at_most(score, max_score)]
    if policy.source_id:
        tests.append(F.col("source_id") == policy.source_id)
    if policy.source_ids:
        tests.append(F.col("source_id").isin(*policy.source_ids))
    if policy.lookback_hours is not None:
        since = cutoff(now, policy.lookback_hours, mode)
        tests.append(F.col("published") >= since if mode == "date_floor" else F.col("published") > since)
    return articles.where(reduce(lambda a, b: a & b, tests))


def capped(articles: DataFrame, cap: int | None) -> DataFrame:
    """The newest `cap` of each source."""
    if cap is None:
        return articles
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(*newest()))
    return articles.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")


def page_of(articles: DataFrame, page: int = 1, per_page: int = 20) -> DataFrame:
    """One page, newest first, with its position."""
    paged = articles.orderBy(*newest()).offset((page - 1) * per_page).limit(per_page)
    return paged.withColumn("pos", F.row_number().over(Window.orderBy(*newest())))  # a page of rows


def enrich(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """articles with the source's name, category, label and score, defaulted where the source is unknown."""
    dim = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("category").alias("source_category"), F.col("allsides_label").alias("source_label"), F.col("allsides_score").alias("source_score"))
    joined = articles.join(dim, "source_id", "left")
    return joined.withColumns({
        "source_name": F.coalesce("source_name", "source_id"), "source_category": F.coalesce("source_category", F.lit("general")),
        "source_label": F.coalesce("source_label", F.lit("center")), "source_score": F.coalesce("source_score", F.lit(0.0)),
    })


def dedupe(rows: DataFrame) -> DataFrame:
    """Of rows (pos, id, source_id, title, body, published) with one source and normalized title the one with the
    longest body, then the latest, then the first; at the place of the first of them. Untitled rows all stay."""
    title = norm_title(F.col("title"))
    keyed = rows.withColumn("_key", F.when(title == "", F.concat(F.lit("id:"), "id")).otherwise(F.concat(F.lit("t:"), title)))
    group = Window.partitionBy("source_id", "_key")
    best = group.orderBy(F.char_length(F.coalesce("body", F.lit(""))).desc(), F.col("published").desc_nulls_last(), "pos")
    ranked = keyed.withColumn("_best", F.row_number().over(best)).withColumn("pos", F.min("pos").over(group))
    return ranked.where("_best = 1").drop("_best", "_key")


def short_bodies(articles: DataFrame, now: str, least: int = 300, hours: int = 24, limit: int = 8) -> DataFrame:
    """Articles to fetch in full: short body, a url, not tried lately; newest first."""
    stale = F.col("scrape_attempted_at").isNull() | (F.col("scrape_attempted_at") < cutoff(now, hours, "exact"))
    short = F.char_length(F.coalesce("body", F.lit(""))) < least
    return articles.where(short & F.col("url").isNotNull() & stale).orderBy(*newest()).limit(limit)


def unscored(articles: DataFrame, bias: bool, sentiment: bool) -> DataFrame:
    """Articles that lack what the loaded models would give, or a summary."""
    tests = [F.col("summary").isNull()]
    tests += [F.col("bias_score").isNull()] * bias + [F.col("sentiment_score").isNull()] * sentiment
    return articles.where(reduce(lambda a, b: a | b, tests))


def usable_scrapes(pages: DataFrame, text: str) -> DataFrame:
    return pages.where((F.char_length(text) >= 50) & ~paywall(F.col(text)))


def market_news(articles: DataFrame, keywords: list[str], limit: int = 10) -> DataFrame:
    """The newest titles that hold a keyword as a word, out of the newest 4 * limit that hold one at all."""
    lower = F.lower("title")
    near = articles.where(contains_any(lower, [k.lower() for k in keywords])).orderBy(*newest()).limit(4 * limit)
    quoted = "|".join(f"\\b\\Q{k}\\E\\b" for k in keywords)
    return near.where(F.col("title").rlike(f"(?i){quoted}")).orderBy(*newest()).limit(limit)


def related(articles: DataFrame, groups: DataFrame, article_id: str, source_id: str, limit: int = 6) -> DataFrame:
    """kind, id, pos: the others of the first group that holds the article, and the newest others of its source."""
    group = groups.where(F.array_contains("article_ids", article_id)).orderBy("group_id").limit(1)
    members = group.select(F.explode("article_ids").alias("id")).where(F.col("id") != article_id)
    columns = ["id", "source_id", "title", "published"]
    same_story = articles.join(members, "id", "left_semi").orderBy(*newest()).limit(limit).select(F.lit("story").alias("kind"), *columns)
    same_source = articles.where((F.col("source_id") == source_id) & (F.col("id") != article_id)).orderBy(*newest()).limit(limit).select(F.lit("source").alias("kind"), *columns)
    return same_story.unionByName(same_source)


def source_stats(sources: DataFrame, fetches: DataFrame) -> DataFrame:
    """Sources with their fetch statistics."""
    return sources.join(fetches.withColumnRenamed("source_id", "id"), "id", "left")


def nested(enriched: DataFrame) -> DataFrame:
    """Enriched articles in the shape that is served: a source struct, and the emotion breakdown parsed (null if malformed)."""
    source = F.struct(F.col("source_id").alias("id"), F.col("source_name").alias("name"), F.col("source_category").alias("category"), F.col("source_label").alias("allsides_label"), F.col("source_score").alias("allsides_score"))
    parsed = F.from_json("emotion_breakdown", "map<string,double>")
    return enriched.withColumn("source", source).withColumn("emotion_breakdown", parsed).drop("source_name", "source_category", "source_label", "source_score")


#: What a page shows of an article that no model has scored.
UNSCORED_CONFIDENCE = 0.3


def shown_scores(articles: DataFrame) -> DataFrame:
    """articles with the scores a page shows: bias falls back to the source's, confidence to a fixed one, tone to none."""
    return articles.withColumns({
        "shown_score": F.coalesce("bias_score", "source_score"), "shown_confidence": F.coalesce("confidence", F.lit(UNSCORED_CONFIDENCE)),
        "shown_sentiment": F.coalesce("sentiment_score", F.lit(0.0)), "shown_intensity": F.coalesce("intensity_score", F.lit(0.0)),
    })
