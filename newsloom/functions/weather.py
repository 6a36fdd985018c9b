"""Weather and air-quality expressions: ladders of labels, bands, indices, phases."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import constants as C

#: Fixed value: hPa at sea level.
STANDARD_PRESSURE = 1013.25


def ladder(value: Column, steps: list[tuple[float, str]], above: str, inclusive: bool = False, missing: str | None = None) -> Column:
    """The label of the first step that value is under (or at, if inclusive); `above` past the last."""
    out = F.when(value.isNull(), F.lit(missing))
    for edge, label in steps:
        out = out.when(value <= edge if inclusive else value < edge, label)
    return out.otherwise(above)


def js_round(value: Column) -> Column:
    return F.floor(value + 0.5)


def describe(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in C.WMO_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.lit("Unknown"))


def compass(degrees: Column) -> Column:
    names = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
    return F.coalesce(F.get(F.lit(names), (js_round(degrees / 45) % 8).cast("int")), F.lit(""))


def atmosphere(code: Column, is_day: Column) -> Column:
    c = F.coalesce(code, F.lit(0))
    part = F.when(is_day, "day").otherwise("night")
    return (
        F.when(c >= 95, "thunder").when(c.between(71, 77) | c.isin(85, 86), "snow").when(c.between(51, 67) | c.between(80, 82), "rain").when(c.isin(45, 48), "fog")
        .when(c.isin(1, 2, 3), F.concat(F.lit("cloudy-"), part)).otherwise(F.concat(F.lit("clear-"), part))
    )


def moon(day: Column) -> tuple[Column, Column, Column]:
    """Phase (age in days over 29.53), illumination in percent, name, of a date."""
    y, m, d = F.year(day), F.month(day), F.dayofmonth(day)
    golden = y % 100 % 19
    golden = F.when(golden > 9, golden - 19).otherwise(golden)
    age = golden * 11 % 30 + m + d + F.when(m < 3, 2).otherwise(0) - F.when(y < 2000, 4.0).otherwise(8.3)
    age = F.floor(age + 0.5) % 30
    phase = F.when(age < 0, age + 30).otherwise(age) / 29.53
    lit = js_round(50 * (1 - F.cos(2 * math.pi * phase)))
    steps = [(0.22, "Waxing Crescent"), (0.28, "First Quarter"), (0.47, "Waxing Gibbous"), (0.53, "Full Moon"), (0.72, "Waning Gibbous"), (0.78, "Last Quarter")]
    name = F.when((phase < 0.03) | (phase > 0.97), "New Moon").otherwise(ladder(phase, steps, "Waning Crescent"))
    return phase, lit, name


def aqi_label(aqi: Column) -> Column:
    return ladder(aqi, list(zip(C.AQI_EDGES, C.AQI_LABELS, strict=False))[:5], C.AQI_LABELS[5], inclusive=True, missing="Unknown")


def subindex(pollutant: Column, value: Column) -> Column:
    """Piecewise-linear index of a concentration between the edges of its pollutant; 500 above the last; null without a value."""
    out = None
    for name, edges in C.POLLUTANT_EDGES.items():
        own, low, low_aqi = None, 0.0, 0
        for edge, aqi in zip(edges, C.AQI_EDGES, strict=True):
            line = low_aqi + (value - low) / (edge - low) * (aqi - low_aqi)
            own = F.when(value <= edge, line) if own is None else own.when(value <= edge, line)
            low, low_aqi = float(edge), aqi
        own = own.otherwise(500.0)
        out = F.when(pollutant == name, own) if out is None else out.when(pollutant == name, own)
    return F.when(value.isNotNull() & ~F.isnan(value), out)


def band(index: Column) -> Column:
    return ladder(index, list(zip(C.AQI_EDGES, C.BAND_LABELS, strict=False))[:5], C.BAND_LABELS[5], inclusive=True)


def dew_comfort(dew_point: Column) -> Column:
    return ladder(dew_point, [(55, "Dry"), (60, "Comfortable"), (65, "Sticky"), (70, "Muggy"), (75, "Oppressive")], "Miserable")


def uv_band(uv: Column) -> Column:
    return ladder(uv, [(3, "Low"), (6, "Moderate"), (8, "High"), (11, "Very high")], "Extreme")


def visibility(metres: Column) -> tuple[Column, Column]:
    """Miles and their band."""
    miles = metres / 1609.34
    return miles, ladder(miles, [(0.25, "Dense fog"), (1, "Poor"), (3, "Moderate"), (6, "Good")], "Excellent")


def cloud_class(cover: Column) -> Column:
    return ladder(cover, [(12, "Clear"), (38, "Mostly clear"), (62, "Partly cloudy"), (88, "Mostly cloudy")], "Overcast", inclusive=True)


def pressure_trend(change: Column) -> Column:
    return F.when(change.isNull(), None).when(change >= 2, "Rising fast").when(change >= 0.5, "Rising").when(change <= -2, "Falling fast").when(change <= -0.5, "Falling").otherwise("Steady")


def pollen_band(grains: Column) -> Column:
    return ladder(grains, [(5, "Low"), (20, "Moderate"), (50, "High")], "Very high")


def is_precipitation(code: Column) -> Column:
    return F.coalesce(code.between(51, 67) | code.between(71, 77) | code.between(80, 86) | code.between(95, 99), F.lit(False))


def precipitation_noun(code: Column) -> Column:
    return F.when(code >= 95, "thunderstorms").when(code.between(71, 77) | code.isin(85, 86), "snow").when(code.between(80, 82), "showers").when(code.between(51, 57), "drizzle").otherwise("rain")


def precipitation_phrase(code: Column) -> Column:
    strength = F.when(code.isin(55, 65, 67, 75, 82, 86, 99), "heavy ").when(code.isin(51, 61, 71, 80, 85, 95), "light ").otherwise("")
    return F.concat(strength, precipitation_noun(code))


def sky_now(code: Column) -> Column:
    return F.when(code.isin(2, 3, 45, 48), "Cloudy").when(code <= 3, "Clear").otherwise("Calm")


def hours_phrase(h: Column) -> Column:
    plain = F.concat(h.cast("string"), F.lit(" hours"))
    return F.when(h <= 1, "about an hour").when(h <= 2, "a couple of hours").when(h <= 4, plain).when(h <= 7, "a few hours").when(h <= 12, "the rest of the morning").otherwise(plain)


def part_of_day(hour: Column) -> Column:
    return F.when(hour < 5, "overnight").when(hour < 12, "morning").when(hour < 17, "afternoon").when(hour < 21, "evening").otherwise("overnight")
