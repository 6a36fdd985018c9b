"""Hourly weather and air quality: next hours, runs, trends, peaks, nowcasts, strips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import weather as W


def from_now(hours: DataFrame, now: str, n: int = 24) -> DataFrame:
    """pos and the next n hours from the first at or after `now`; from the start if there is none."""
    start = hours.agg(F.coalesce(F.min(F.when(F.col("time") >= F.lit(now).cast("timestamp"), F.col("time"))), F.min("time"))).scalar()
    ahead = hours.where(F.col("time") >= start).orderBy("time").limit(n)
    return ahead.withColumn("pos", F.row_number().over(Window.orderBy("time")) - 1)  # n rows


def by_place(*order: str) -> Window:
    return Window.partitionBy("day").orderBy(*order)


def with_day(hours: DataFrame) -> DataFrame:
    return hours.withColumn("day", F.to_date("time"))


def pressure_trends(hours: DataFrame, back: int = 3) -> DataFrame:
    """time, change and trend of the pressure against the value `back` hours before, within a day."""
    change = F.col("pressure") - F.lag("pressure", back).over(by_place("time"))
    return with_day(hours).withColumn("change", change).select("time", "change", W.pressure_trend(F.col("change")).alias("trend"))


def runs(hours: DataFrame, flag: str) -> DataFrame:
    """day, started, ended, n of each unbroken run of hours whose flag is set."""
    number = F.row_number().over(by_place("time"))
    numbered = with_day(hours).select("day", "time", flag, number.alias("i")).where(flag)
    island = F.col("i") - F.row_number().over(by_place("i"))
    return numbered.withColumn("island", island).groupBy("day", "island").agg(F.min("time").alias("started"), F.max("time").alias("ended"), F.count("*").alias("n")).drop("island")


def day_extremes(hours: DataFrame) -> DataFrame:
    """day, hottest, coldest, range of its temperature, and how many sunny hours it has."""
    sunny = F.col("is_day") & (F.col("cover") <= 25)
    by = with_day(hours).groupBy("day").agg(F.max("temperature").alias("hottest"), F.min("temperature").alias("coldest"), F.count_if(sunny).alias("sun_hours"), F.max("precip_prob").alias("wet"), F.max("gust").alias("gust"), F.max("uv").alias("uv"))
    return by.withColumn("spread", F.col("hottest") - F.col("coldest"))


def day_tags(days: DataFrame) -> DataFrame:
    """day, tag by rank in its week: warmest, coldest, then wet; the first day has none. left and width place its bar."""
    week = Window.partitionBy(F.trunc("day", "week"))
    first = F.row_number().over(week.orderBy("day")) == 1
    hottest, coldest = F.max("hottest").over(week), F.min("coldest").over(week)
    made = days.select("day", "hottest", "coldest", "wet", first.alias("first"), hottest.alias("week_hot"), coldest.alias("week_cold"))
    span = F.coalesce(F.nullif(F.col("week_hot") - F.col("week_cold"), F.lit(0.0)), F.lit(1.0))
    tag = F.when(F.col("first"), None).when(F.col("hottest") == F.col("week_hot"), "warmest").when(F.col("coldest") == F.col("week_cold"), "coldest").when(F.col("wet") >= 70, "wet")
    return made.select("day", tag.alias("tag"), ((F.col("coldest") - F.col("week_cold")) / span).alias("bar_left"), ((F.col("hottest") - F.col("coldest")) / span).alias("bar_width"))


def peaks(hours: DataFrame) -> DataFrame:
    """By day the first hour of the highest dew point, of the highest UV (null if none), and of the lowest visibility."""
    first_max = lambda c: F.max_by("time", F.struct(c, -F.unix_timestamp("time")))
    first_min = F.min_by("time", F.struct("visibility", F.unix_timestamp("time")))
    uv = F.when(F.max("uv") > 0, first_max("uv"))
    return with_day(hours).groupBy("day").agg(first_max("dew_point").alias("dew_peak"), uv.alias("uv_peak"), first_min.alias("visibility_low"))


def nowcast(hours: DataFrame, now: str, horizon: int = 12) -> DataFrame:
    """code, rain_now, change_at, sentence: what the next hours bring. Only the `horizon` hours ahead are gathered."""
    ahead = from_now(hours, now, horizon)
    dry = ~W.is_precipitation(F.col("code")) & (F.col("precip_prob") < 30) & (F.col("precip") < 0.005)
    wet = W.is_precipitation(F.col("code")) | ((F.col("precip_prob") >= 50) & (F.col("precip") >= 0.005))
    first = lambda test, value: F.min_by(value, F.when(test & (F.col("pos") > 0), F.col("pos")))
    at_first = F.col("pos") == 0
    row = ahead.agg(
        F.max(F.when(at_first, F.col("code"))).alias("code"), F.max(F.when(at_first, F.col("precip_prob"))).alias("prob"), F.count("*").alias("n"),
        first(dry, F.col("pos")).alias("stop_at"), first(wet, F.col("pos")).alias("start_at"), first(wet, F.col("code")).alias("next_code"), first(wet, F.hour("time")).alias("next_hour"),
    )
    rain = W.is_precipitation(F.col("code")) | (F.col("prob") >= 50)
    row = row.withColumn("rain_now", rain).withColumn("change_at", F.when(rain, F.col("stop_at")).otherwise(F.col("start_at")))
    at, left = F.col("change_at"), F.col("n") - 1
    falling = _capital(W.precipitation_phrase(F.col("code")))
    wet_text = (
        F.when(at.isNull(), F.concat(falling, F.lit(" through the next "), W.hours_phrase(left), F.lit(".")))
        .when(at == 1, F.concat(falling, F.lit(", easing in about an hour."))).otherwise(F.concat(falling, F.lit(" for about "), W.hours_phrase(at), F.lit(", then easing.")))
    )
    sky, coming = W.sky_now(F.col("code")), W.precipitation_phrase(F.col("next_code"))
    dry_text = (
        F.when(at.isNull(), F.concat(sky, F.lit(" for the next "), W.hours_phrase(left), F.lit(".")))
        .when(at <= 1, F.concat(sky, F.lit(" now, "), coming, F.lit(" starting within the hour.")))
        .when(at <= 3, F.concat(sky, F.lit(" for the next "), W.hours_phrase(at), F.lit(", then "), coming, F.lit(".")))
        .otherwise(F.concat(sky, F.lit(" for a few hours, then "), coming, F.lit(" by "), W.part_of_day(F.col("next_hour")), F.lit(".")))
    )
    return row.select("code", "rain_now", "change_at", F.when(F.col("rain_now"), wet_text).otherwise(dry_text).alias("sentence"))


def _capital(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def day_strips(days: DataFrame) -> DataFrame:
    """day, label, gust, uv, sun_hours, gust_axis: what the week's strips show."""
    return days.select("day", F.date_format("day", "E").alias("weekday"), "gust", "uv", W.uv_band(F.col("uv")).alias("uv_band"), "sun_hours", (F.ceil(F.col("gust") / 5) * 5).alias("gust_axis"))


def value_axes(hours: DataFrame) -> DataFrame:
    """day, dew_low, dew_range, pressure_low, pressure_range: the extents of the day's charts, null where fewer than two
    values are finite. Dew points (°F) go by fives within 20 to 85; the pressure's axis holds the standard pressure."""
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.col(c))
    by = with_day(hours).groupBy("day").agg(*[f(finite(c)).alias(f"{c}_{n}") for c in ("dew_point", "pressure") for n, f in (("n", F.count), ("min", F.min), ("max", F.max))])
    dew_low = F.greatest(F.lit(20), F.floor((F.col("dew_point_min") - 4) / 5) * 5)
    dew_high = F.least(F.lit(85), F.ceil((F.col("dew_point_max") + 4) / 5) * 5)
    pad = F.greatest(F.lit(1.0), (F.col("pressure_max") - F.col("pressure_min")) * 0.25)
    low = F.least(F.col("pressure_min") - pad, F.lit(W.STANDARD_PRESSURE - 1))
    high = F.greatest(F.col("pressure_max") + pad, F.lit(W.STANDARD_PRESSURE + 1))
    dew, pressure = F.col("dew_point_n") > 1, F.col("pressure_n") > 1
    return by.select(
        "day", F.when(dew, dew_low).alias("dew_low"), F.when(dew, F.greatest(F.lit(10), dew_high - dew_low)).alias("dew_range"),
        F.when(pressure, low).alias("pressure_low"), F.when(pressure, high - low).alias("pressure_range"),
    )


def daylight(days: DataFrame) -> DataFrame:
    """day, started, ended, seconds of light, change to the next day; fraction of it passed at noon, between 0 and 1."""
    lit = days.withColumn("seconds", F.unix_timestamp("ended") - F.unix_timestamp("started"))
    after = F.lead("seconds").over(Window.partitionBy(F.trunc("day", "month")).orderBy("day", "started"))
    noon = F.unix_timestamp(F.col("day").cast("timestamp")) + 12 * 3600
    passed = (noon - F.unix_timestamp("started")) / F.nullif(F.col("seconds"), F.lit(0))
    return lit.withColumn("trend", after - F.col("seconds")).withColumn("sun_fraction", F.greatest(F.lit(0.0), F.least(F.lit(1.0), passed)))


def readings(pollutants: DataFrame) -> DataFrame:
    """Readings with sub-index, its fraction of the unhealthy ceiling (2 at most) and its band; without a value dropped."""
    made = pollutants.withColumn("subindex", W.subindex(F.col("pollutant"), F.col("value"))).where("subindex is not null")
    return made.withColumn("fraction", F.least(F.lit(2.0), F.col("subindex") / 100)).withColumn("band", W.band(F.col("subindex")))


def drivers(made: DataFrame, order: list[str]) -> DataFrame:
    """hour, driver, subindex: the pollutant that sets each hour's index, the first of `order` on ties."""
    rank = F.array_position(F.lit(order), F.col("pollutant"))
    by = made.groupBy(F.date_trunc("hour", "ts").alias("hour"), "pollutant").agg(F.max("subindex").alias("subindex"))
    best = by.groupBy("hour").agg(F.max_by(F.struct("pollutant", "subindex"), F.struct("subindex", -rank)).alias("b"))
    return best.select("hour", F.col("b.pollutant").alias("driver"), "b.subindex")


def top_species(by_species: DataFrame, least: float = 1.0, n: int = 4) -> DataFrame:
    """species, peak of the n highest peaks above `least`."""
    return by_species.groupBy("species").agg(F.max("value").alias("peak")).where(F.col("peak") > least).orderBy(F.col("peak").desc(), "species").limit(n)
