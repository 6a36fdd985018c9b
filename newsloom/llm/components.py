"""Connected components of a link table, by alternating large and small stars.

Each round points every node's larger neighbours, then its smaller ones, at the least node it knows; the
rounds end when the links no longer change. Minima are taken with partial aggregation; the joins that hand
them back are on plain exchanges, so that a hub's links can be split over tasks. Each round is a written
table, which is deleted when the next one stands. Neither links nor labels come to the driver, only a count and
a checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import discard, written


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One step over links (a, b) with a > b, as a written table in place of links."""
    if large:
        seen = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        seen = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = written(seen.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), "least")
    joined = seen.where("v > u") if large else seen
    moved = joined.join(least, "u").select(F.col("v").alias("a"), F.col("low").alias("b"))
    if not large:
        moved = moved.unionByName(least.select(F.col("u").alias("a"), F.col("low").alias("b")))
    made = written(moved.where("a > b").distinct(), "stars")
    discard(least, links)
    return made


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
    return row["n"], row["sum"]


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node in links (a long, b long) that is not its own root."""
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        now = _stars(_stars(now, large=True), large=False)
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
