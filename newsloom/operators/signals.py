"""Prediction-market signals: normalization, lists, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import constants as C
from newsloom.functions.text import contains_any
from newsloom.operators.feed import cutoff


def json_strings(text: Column) -> Column:
    """A JSON array of strings; null if it is none."""
    return F.from_json(text, "array<string>")


def is_binary(outcomes: Column) -> Column:
    """Whether outcomes are exactly Yes and No, in that order."""
    return F.coalesce(F.transform(json_strings(outcomes), lambda o: F.lower(o)) == F.array(F.lit("yes"), F.lit("no")), F.lit(False))


def is_sports(fee_type: Column, market_type: Column) -> Column:
    return F.startswith(F.lower(F.coalesce(fee_type, F.lit(""))), F.lit("sports")) | (F.coalesce(market_type, F.lit("")) != "")


def category(question: Column) -> Column:
    """Null for questions to skip, else the first category with a keyword in the question, else finance."""
    lower = F.lower(question)
    out = F.when(contains_any(lower, C.SKIP_KEYWORDS), None)
    for name, keywords in C.CATEGORY_KEYWORDS.items():
        out = out.when(contains_any(lower, keywords), name)
    return out.otherwise("finance")


def yes_price(outcomes: Column, prices: Column) -> Column:
    o, p = json_strings(outcomes), json_strings(prices)
    place = F.array_position(F.transform(o, lambda x: F.lower(x)), "yes")
    return F.when((F.size(o) == 2) & (F.size(p) == 2) & (place > 0), F.get(p, (place - 1).cast("int")).try_cast("double"))


def most_traded(raw: DataFrame, poll: str, most: int = 200) -> DataFrame:
    """Payload rows as the market source gives them: of each poll the `most` with the largest volume, by condition_id on ties."""
    rank = F.row_number().over(Window.partitionBy(poll).orderBy(F.col("volume_24hr").desc_nulls_last(), "condition_id"))
    return raw.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def normalize(raw: DataFrame) -> DataFrame:
    """Markets worth keeping, from payload rows (condition_id, market_id, question, outcomes, outcome_prices, ...)."""
    question = F.trim(F.coalesce("question", F.lit("")))
    wanted = raw.where(is_binary(F.col("outcomes")) & ~is_sports(F.col("fee_type"), F.col("sports_market_type")))
    made = wanted.select(
        F.coalesce(F.nullif("condition_id", F.lit("")), F.nullif("market_id", F.lit(""))).alias("id"), question.alias("question"), category(question).alias("category"),
        F.bround(yes_price(F.col("outcomes"), F.col("outcome_prices")), 4).alias("yes_price"),
        F.coalesce("one_day_price_change", F.lit(0.0)).alias("yes_change_24h"), F.coalesce("volume_24hr", F.lit(0.0)).alias("volume_24h"),
        F.concat(F.lit("https://polymarket.com/event/"), F.nullif("slug", F.lit(""))).alias("url"),
    )
    return made.where("question <> '' and category is not null and yes_price is not null and id is not null")


def active(markets: DataFrame, now: str, wanted: str | None = None) -> DataFrame:
    """Markets without an end, or whose end is on the day of `now` or later; of one category if asked."""
    rows = markets.where(F.col("end_date").isNull() | (F.col("end_date") >= cutoff(now, 0)))
    return rows if wanted is None else rows.where(F.col("category") == wanted)


def listed(markets: DataFrame, sort: str = "movers", limit: int = 80) -> DataFrame:
    """The first `limit` by size of move, volume, or end (undated first); an unknown order is by move."""
    key = {"volume": F.coalesce("volume_24h", F.lit(0.0)).desc(), "expiry": F.col("end_date").asc_nulls_first()}.get(sort, F.abs(F.coalesce("yes_change_24h", F.lit(0.0))).desc())
    return markets.orderBy(key, "id").limit(limit)


def category_counts(markets: DataFrame) -> DataFrame:
    return markets.where("category is not null").groupBy("category").agg(F.count("*").alias("n"))


def meta(markets: DataFrame) -> DataFrame:
    return markets.agg(F.count("*").alias("total"), F.max("last_updated").alias("last_updated"))


def pruned(markets: DataFrame, now: str, days: int = 2) -> DataFrame:
    """Markets refreshed within `days`."""
    return markets.where(F.col("last_updated") >= cutoff(now, 24 * days, "exact"))
