"""Landed payloads: weather with air quality, trending symbols, chart requests, snapshots that age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import constants as C

HOURLY = "struct<time:array<string>,temperature:array<double>,code:array<int>,precip_prob:array<double>>"
WEATHER = f"struct<hourly:{HOURLY}>"
AIR = "struct<hourly:struct<time:array<string>,aqi:array<double>>>"


def weather_hours(payloads: DataFrame) -> DataFrame:
    """place, pos, time, temperature, code, precip_prob of rows (place, payload): the parallel arrays by position; times are local."""
    hourly = F.from_json("payload", WEATHER)["hourly"]
    empty = {"time": "string", "temperature": "double", "code": "int", "precip_prob": "double"}
    zipped = F.arrays_zip(*[F.coalesce(hourly[c], F.array().cast(f"array<{kind}>")).alias(c) for c, kind in empty.items()])
    rows = payloads.select("place", F.posexplode(zipped).alias("pos", "h"))
    return rows.select("place", "pos", F.col("h.time").cast("timestamp_ntz").alias("time"), "h.temperature", "h.code", "h.precip_prob").where("time is not null")


def with_air_quality(hours: DataFrame, air_payloads: DataFrame) -> DataFrame:
    """hours with aqi; null where the air-quality call failed or lacks the hour."""
    hourly = F.from_json("payload", AIR)["hourly"]
    rows = air_payloads.select("place", F.explode(F.arrays_zip(hourly["time"].alias("time"), hourly["aqi"].alias("aqi"))).alias("h"))
    return hours.join(rows.select("place", F.col("h.time").cast("timestamp_ntz").alias("time"), "h.aqi"), ["place", "time"], "left")


def trending(payload: Column, most: int = 12) -> Column:
    """The first symbols of a trending payload."""
    quotes = F.get(F.from_json(payload, "struct<finance:struct<result:array<struct<quotes:array<struct<symbol:string>>>>>>")["finance"]["result"], F.lit(0))["quotes"]
    named = F.filter(quotes["symbol"], lambda s: F.coalesce(s, F.lit("")) != "")
    return F.coalesce(F.slice(named, 1, most), F.array().cast("array<string>"))


def chart_requests(spark: SparkSession) -> DataFrame:
    """view, range, interval: what each chart range asks the service for."""
    return spark.createDataFrame([(view, *asked) for view, asked in C.CHART_RANGES.items()], "view string, range string, interval string")


def trending_symbols(payloads: DataFrame, most: int = 12) -> DataFrame:
    """pos, symbol of payloads (payload)."""
    return payloads.select(F.posexplode(trending(F.col("payload"), most)).alias("pos", "symbol"))


def chart_requests_of(symbols: DataFrame) -> DataFrame:
    """symbol, view, range, interval: what the charts of each symbol ask the service for."""
    asked = F.array(*[F.struct(F.lit(view).alias("view"), F.lit(r).alias("range"), F.lit(i).alias("interval")) for view, (r, i) in C.CHART_RANGES.items()])
    return symbols.select("symbol", F.explode(asked).alias("a")).select("symbol", "a.view", "a.range", "a.interval")


def is_fresh(taken_at: Column, now: Column, seconds: int) -> Column:
    """Whether a snapshot taken then may still be served: ten minutes for weather, one for quotes."""
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(taken_at) < seconds, F.lit(False))


def snapshot(spark: SparkSession, path: str, now: str, seconds: int, make) -> DataFrame:
    """The newest snapshot under path if it is fresh; else make(), kept under a new one. One writer a path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    held = root.getFileSystem(conf)
    taken = sorted(s.getPath().getName()[6:] for s in held.listStatus(root) if s.getPath().getName().startswith("taken=")) if held.exists(root) else []
    stamp = lambda t: t.replace("_", " ").replace(".", ":")
    if taken and spark.range(1).select(is_fresh(F.lit(stamp(taken[-1])), F.lit(now), seconds)).first()[0]:
        return spark.read.parquet(f"{path}/taken={taken[-1]}")
    place = f"{path}/taken={now.replace(' ', '_').replace(':', '.')}"
    make().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)
