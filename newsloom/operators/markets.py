"""Price series: quotes, ranges, sparklines, chart payloads, buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import constants as C

CHART = """struct<chart:struct<result:array<struct<
    meta:struct<symbol:string,shortName:string,longName:string,regularMarketPrice:double,chartPreviousClose:double,previousClose:double,
        regularMarketDayHigh:double,regularMarketDayLow:double,regularMarketVolume:double,currency:string,fullExchangeName:string,exchangeName:string,instrumentType:string>,
    timestamp:array<bigint>,
    indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>>>>>>"""


def truthy(value: Column) -> Column:
    """Null for zero, so that zero falls through to the next choice."""
    return F.nullif(value, F.lit(0.0))


def range_performance(series: DataFrame) -> DataFrame:
    """By symbol over points with a close: first, last, high, low, change, pct, n."""
    by = series.where("c is not null").groupBy("symbol").agg(
        F.min_by("c", "t").alias("first_c"), F.max_by("c", "t").alias("last_c"), F.max(F.coalesce("h", "c")).alias("high"), F.min(F.coalesce("l", "c")).alias("low"), F.count("*").alias("n")
    )
    change = F.col("last_c") - F.col("first_c")
    return by.withColumn("change", change).withColumn("pct", change / truthy(F.col("first_c")) * 100)


def with_previous(series: DataFrame) -> DataFrame:
    """Each point with the last close before it, the change and the change in percent."""
    before = Window.partitionBy("symbol").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    prev = truthy(F.last("c", ignorenulls=True).over(before))
    with_prev = series.withColumn("previous_close", prev)
    change = F.col("c") - F.col("previous_close")
    return with_prev.withColumn("change", change).withColumn("change_pct", change / F.col("previous_close") * 100)


def last_closes(series: DataFrame, n: int = 40) -> DataFrame:
    """symbol, pos, t, c: the last n points with a close, in order."""
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("t").desc()))
    kept = series.where("c is not null").withColumn("_back", rank).where(F.col("_back") <= n)
    return kept.select("symbol", F.row_number().over(Window.partitionBy("symbol").orderBy("t")).alias("pos"), "t", "c")


def baseline(performance: DataFrame, previous_close: str | None, one_day: bool) -> DataFrame:
    """The level a chart compares with (the previous close in a one-day view, else the first), and the direction from it."""
    base = F.coalesce(F.col(previous_close), F.col("first_c")) if one_day and previous_close else F.col("first_c")
    return performance.withColumn("baseline", base).withColumn("direction", F.when(F.col("last_c") > base, "up").when(F.col("last_c") < base, "down").otherwise("flat"))


def chart_extent(performance: DataFrame, pad: float = 0.06) -> DataFrame:
    """low_edge, mid, high_edge of an axis that shows the range and the baseline."""
    low, high = F.least("low", "baseline"), F.greatest("high", "baseline")
    margin = F.coalesce(truthy(high - low), F.lit(1.0)) * pad
    return performance.withColumn("low_edge", low - margin).withColumn("high_edge", high + margin).withColumn("mid", (low + high) / 2)


def sparkline(closes: DataFrame) -> DataFrame:
    """closes with y, the close's place between the symbol's least (0) and largest (1)."""
    whole = Window.partitionBy("symbol")
    low, high = F.min("c").over(whole), F.max("c").over(whole)
    return closes.withColumn("y", (F.col("c") - low) / F.coalesce(truthy(high - low), F.lit(1.0)))


def parse_chart(payloads: DataFrame) -> DataFrame:
    """symbol, meta, t, quote of payload rows (symbol, payload); rows whose payload has no result are dropped."""
    parsed = payloads.withColumn("_r", F.get(F.from_json("payload", CHART)["chart"]["result"], F.lit(0))).where("_r is not null")
    r = F.col("_r")
    return parsed.select(F.coalesce(r["meta"]["symbol"], F.col("symbol")).alias("symbol"), r["meta"].alias("meta"), r["timestamp"].alias("t"), F.get(r["indicators"]["quote"], F.lit(0)).alias("quote"))


def compact_quote(charts: DataFrame, n: int = 40) -> DataFrame:
    """A row a symbol: name, price, change and the last n closes."""
    meta = F.col("meta")
    price, prev = meta["regularMarketPrice"], F.coalesce(truthy(meta["chartPreviousClose"]), truthy(meta["previousClose"]))
    closes = F.filter(F.coalesce(F.col("quote")["close"], F.array().cast("array<double>")), lambda c: c.isNotNull())
    spark = F.slice(closes, F.greatest(F.lit(1), F.size(closes) - n + 1), F.lit(n))
    return charts.select("symbol", F.coalesce(meta["shortName"], meta["longName"], "symbol").alias("name"), price.alias("price"), prev.alias("previous_close"),
                         (price - prev).alias("change"), ((price - prev) / prev * 100).alias("change_pct"), spark.alias("spark"))


def chart_series(charts: DataFrame) -> DataFrame:
    """symbol, pos, t, o, h, l, c, v: the payload's parallel arrays by position; points without a close are dropped."""
    q = F.col("quote")
    held = lambda name: F.coalesce(q[name], F.array().cast("array<double>"))
    zipped = F.arrays_zip(F.col("t").alias("t"), *[held(name).alias(short) for name, short in (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"), ("volume", "v"))])
    points = charts.select("symbol", F.size("t").alias("_n"), F.posexplode(zipped).alias("pos", "p")).where(F.col("pos") < F.col("_n"))
    return points.select("symbol", "pos", "p.t", "p.o", "p.h", "p.l", "p.c", "p.v").where("c is not null")


def bucket_table(spark: SparkSession, trending: list[str] = ()) -> DataFrame:
    """bucket, pos, symbol: the market page's universe, and what trends."""
    buckets = C.BUCKETS | {"trending": list(trending)[:12]}
    return spark.createDataFrame([(b, i, s) for b, symbols in buckets.items() for i, s in enumerate(symbols)], "bucket string, pos int, symbol string")


def bucketed(quotes: DataFrame, buckets: DataFrame) -> DataFrame:
    """Quotes of each bucket's symbols, in order; symbols without a quote stay, empty."""
    return buckets.join(quotes, "symbol", "left")


def keywords_of(symbol: str) -> list[str]:
    """A symbol's news keywords; its base name if none are listed."""
    if symbol in C.SYMBOL_KEYWORDS:
        return C.SYMBOL_KEYWORDS[symbol]
    base = symbol.split("=")[0].lstrip("^")
    return [base] if base else []


def symbol_keywords(symbol: Column) -> Column:
    """keywords_of as an expression."""
    listed = F.create_map(*[x for s, words in C.SYMBOL_KEYWORDS.items() for x in (F.lit(s), F.array(*map(F.lit, words)))])
    base = F.ltrim(F.split_part(symbol, F.lit("="), F.lit(1)), F.lit("^"))
    return F.coalesce(F.try_element_at(listed, symbol), F.when(base != "", F.array(base)).otherwise(F.array().cast("array<string>")))


def sentiment_summary(articles: DataFrame) -> DataFrame:
    """Counts and averages of tone and bias over articles."""
    s, b = F.col("sentiment_score"), F.col("bias_score")
    return articles.agg(
        F.count(s).alias("n"), F.count_if(s >= 0.3).alias("pos"), F.count_if(s <= -0.3).alias("neg"), F.avg(s).alias("avg_sentiment"),
        F.count_if(b <= -0.5).alias("left_n"), F.count_if(b >= 0.5).alias("right_n"), F.count_if((b > -0.5) & (b < 0.5)).alias("center_n"), F.avg(b).alias("avg_bias"),
    )
