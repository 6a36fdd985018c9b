"""Feedback, versions and their roll-up; exact percentiles of any number of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import settled

RETRAIN_AFTER = 50
#: Bins of a pass of exact_percentiles, for each group and wanted rank.
BINS = 4096


def of_dimensions(feedback: DataFrame, dimensions: list[str]) -> DataFrame:
    return feedback.where(F.col("dimension").isin(*dimensions))


def since_last(feedback: DataFrame, versions: DataFrame) -> DataFrame:
    """pending: feedback newer than the last version, all of it if there is none."""
    last = versions.agg(F.max("trained_at")).scalar()
    return feedback.where(last.isNull() | (F.col("created_at") > last)).agg(F.count("*").alias("pending"))


def latest_version(versions: DataFrame) -> DataFrame:
    return versions.orderBy(F.col("version").desc()).limit(1)


def has_version(versions: DataFrame) -> DataFrame:
    """has_version: whether there is one."""
    return versions.limit(1).agg((F.count("*") > 0).alias("has_version"))


def overrides(feedback: DataFrame) -> DataFrame:
    """article_key, user_score: of the last feedback by id."""
    return feedback.groupBy("article_key").agg(F.max_by("user_score", "id").alias("user_score"))


def summary(feedback: DataFrame, versions: DataFrame) -> DataFrame:
    """total, pending, progress to the next retraining and the version in use, by model."""
    newest = versions.agg(F.max("version").alias("version"), F.count("*").alias("n_versions"))
    rows = newest.withColumn("total", feedback.agg(F.count("*")).scalar()).withColumn("pending", since_last(feedback, versions).scalar())
    return rows.withColumn("progress", F.least(F.lit(100.0), F.col("pending") / RETRAIN_AFTER * 100))


def should_retrain(pending: int, has_version: bool, articles: int, training: bool = False, after: int = RETRAIN_AFTER, bootstrap: int = 10) -> bool:
    """Whether to train now: not while training; on enough feedback, or for a first version on enough articles."""
    return not training and (pending >= after or not has_version and articles >= bootstrap)


def exact_percentiles(rows: DataFrame, groups: list[str], value: str, shares: list[float]) -> DataFrame:
    """The groups and p, array<double>: the value at each share, between two neighbours in proportion; null for a group without values.

    Each pass counts, for every group and wanted rank, the values of its interval in BINS equal bins, and goes on with the least and
    greatest value of the bin that holds the rank, until these are one value. Counting begins where the rows are, so a group of any size
    and any number of equal values costs a few thousand counters a pass, and no values are gathered. A pass narrows an interval
    BINS-fold at least. Nulls and values that are not finite are left out."""
    given = [F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]
    names = [f"_g{i}" for i in range(len(groups))]
    all_rows = rows.select(*given, F.col(value).cast("double").alias("_v"))
    held = all_rows.where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))
    at = lambda share, n: F.lit(float(share)) * (n - 1)
    n = F.col("_n")
    wanted = F.array(*[F.struct(F.lit(2 * i + up).alias("t"), (F.ceil(at(s, n)) if up else F.floor(at(s, n))).cast("long").alias("rank")) for i, s in enumerate(shares) for up in (0, 1)])
    seen = held.groupBy(*names).agg(F.count("*").alias("_n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).where("_n > 0")
    state = settled(seen.withColumn("_w", F.explode(wanted)).select(*names, "_n", "_w.t", "_w.rank", "lo", "hi"))
    same = F.lit(True)
    for g in names:
        same = same & F.col(f"s.{g}").eqNullSafe(F.col(f"v.{g}"))
    while not state.where("lo < hi").isEmpty():
        open_ = state.where("lo < hi").alias("s")
        half = F.col("hi") / 2 - F.col("lo") / 2  # the whole width may be too large for a double
        place = F.least(F.floor((F.col("_v") / 2 - F.col("lo") / 2) / half * BINS), F.lit(BINS - 1))
        met = open_.join(held.alias("v"), same & (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))).select(*[f"s.{g}" for g in names], "_n", "t", "rank", "_v", F.when(half > 0, place).otherwise((F.col("_v") > F.col("lo")).cast("long")).alias("bin"))
        bins = met.groupBy(*names, "_n", "t", "rank", "bin").agg(F.count("*").alias("k"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("k").over(Window.partitionBy(*names, "t").orderBy("bin"))
        chosen = bins.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("k")))
        state = settled(state.where("lo >= hi").unionByName(chosen.select(*names, "_n", "t", (F.col("rank") - F.col("upto") + F.col("k")).alias("rank"), "lo", "hi")))
    found = state.groupBy(*names).agg(F.first("_n").alias("_n"), F.transform(F.array_sort(F.collect_list(F.struct("t", "lo"))), lambda x: x["lo"]).alias("_x"))
    between = lambda i, s: F.get("_x", F.lit(2 * i)) + (F.get("_x", F.lit(2 * i + 1)) - F.get("_x", F.lit(2 * i))) * (at(s, n) - F.floor(at(s, n)))
    told = found.where("_n is not null").select(*names, F.array(*[between(i, s) for i, s in enumerate(shares)]).alias("p"))
    if not groups:
        return all_rows.sparkSession.range(1).select(F.lit(1).alias("_one")).join(told.withColumn("_one", F.lit(1)), "_one", "left").select("p")
    every = all_rows.select(*names).distinct()
    match = F.lit(True)
    for g in names:
        match = match & F.col(f"e.{g}").eqNullSafe(F.col(f"t.{g}"))
    return every.alias("e").join(told.alias("t"), match, "left").select(*[F.col(f"e.{g}").alias(c) for g, c in zip(names, groups, strict=True)], "p")
