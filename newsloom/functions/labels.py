"""Labels and formats of scores, prices and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.weather import ladder


def bias_label(score: Column) -> Column:
    return ladder(score, [(-3.5, "Far left"), (-1, "Left"), (1, "Center"), (3.5, "Right")], "Far right", inclusive=True)


def tone_chip(polarity: Column, intensity: Column) -> Column:
    """Null without scores; how charged it is comes before which way it leans."""
    return (
        F.when(polarity.isNull() | intensity.isNull(), None).when(intensity >= 0.66, "Charged").when(intensity >= 0.4, "Heated")
        .when(polarity >= 0.3, "Positive").when(polarity <= -0.3, "Negative").otherwise("Neutral")
    )


def polarity_color(polarity: Column) -> Column:
    return F.when(polarity >= 0.3, "green").when(polarity <= -0.3, "red").otherwise("gray")


def intensity_color(intensity: Column) -> Column:
    return F.when(intensity >= 0.66, "red").when(intensity >= 0.33, "amber").otherwise("green")


def gauge_percent(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (value - low) / (high - low) * 100))


def sentiment_label(average: Column, edge: float = 0.15) -> Column:
    return F.when(average > edge, "Positive").when(average < -edge, "Negative").otherwise("Neutral")


def price_text(price: Column, fine_below: float = 1.0) -> Column:
    return F.when(F.abs(price) < fine_below, F.format_number(price, 4)).otherwise(F.format_number(price, 2))


def _fixed(value: Column, places: int) -> Column:
    """So many places of the value as it is held, ties to even, as C prints it; format_string rounds its shortest decimals half up."""
    return F.call_function("format_number", value, F.lit("0" + "." * (places > 0) + "0" * places))


def volume_text(volume: Column) -> Column:
    v = volume.cast("double")
    scaled = lambda size, places, unit: F.concat(_fixed(v / size, places), F.lit(unit))
    return F.when(v >= 1e9, scaled(1e9, 2, "B")).when(v >= 1e6, scaled(1e6, 2, "M")).when(v >= 1e3, scaled(1e3, 1, "K")).otherwise(_fixed(v, 0))


def signed_percent(pct: Column) -> Column:
    return F.concat(F.when(pct >= 0, "+").otherwise(""), _fixed(pct, 2), F.lit("%"))


def time_ago(seconds: Column) -> Column:
    minutes, hours, days = (F.floor(seconds / n).cast("string") for n in (60, 3600, 86400))
    return F.when(seconds < 60, "just now").when(seconds < 3600, F.concat(minutes, F.lit("m ago"))).when(seconds < 86400, F.concat(hours, F.lit("h ago"))).otherwise(F.concat(days, F.lit("d ago")))


def submitted_score(kind: Column, predicted: Column, chosen: Column) -> Column:
    """The score a feedback carries: the predicted one on agreement."""
    return F.when(kind == "thumbs_up", predicted).otherwise(chosen)
