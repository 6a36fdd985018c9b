"""Hits of a whole lexicon in one pass: each word is looked up once, for all categories together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.sources.lexicon import as_dict

#: A lexicon of no more words than this is sent to all executors; a larger one is joined by word.
MOST_SENT = 200_000
#: One of no more words than this becomes part of the plan, and nothing is shuffled.
MOST_LISTED = 50_000


def masks(lexicon: DataFrame, categories: list[str]) -> DataFrame:
    """word, mask of a lexicon (category, word): bit i is set if the word is in category i."""
    number = F.element_at(F.create_map(*[x for i, c in enumerate(categories) for x in (F.lit(c), F.lit(i))]), F.col("category"))
    return lexicon.where(F.col("category").isin(*categories)).withColumn("_at", number).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, _at)")).alias("mask"))


def _those(tokens: str, words: list[str]) -> Column:
    """The words of an array column that are in a list, by a hash table."""
    quoted = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)
    return F.expr(f"filter(`{tokens}`, w -> w IN ({quoted}))") if words else F.array().cast("array<string>")


def listed(rows: DataFrame, tokens: str, lexicon: dict[str, list[str]]) -> tuple[DataFrame, dict[str, Column]]:
    """As `counted`, of words by category: one pass keeps the lexicon's words, and categories are counted among those alone."""
    held = rows.withColumn("_listed", _those(tokens, sorted({w for words in lexicon.values() for w in words})))
    hit = {c: f"_hits{i}" for i, c in enumerate(lexicon)}
    counts = {hit[c]: F.coalesce(F.size(_those("_listed", sorted(set(words)))), F.lit(0)).cast("long") for c, words in lexicon.items()}
    return held.withColumns(counts).drop("_listed"), {c: F.col(name) for c, name in hit.items()}


def counted(rows: DataFrame, key: str, tokens: str, lexicon: DataFrame, categories: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """rows with a column of hits for each category, and these columns by category, as the feature expressions take them.

    rows have one row a key and an array of words `tokens`. A lexicon of up to MOST_LISTED words is looked up where the tokens are; of a
    larger one, words are counted before anything is shuffled, and those that it lacks are dropped there."""
    known = masks(lexicon, categories)
    size = known.count()
    if size <= MOST_LISTED:
        found = as_dict(lexicon.where(F.col("category").isin(*categories)))
        return listed(rows, tokens, {c: found.get(c, []) for c in categories})
    known = F.broadcast(known) if size <= MOST_SENT else known
    found = rows.select(key, F.explode(tokens).alias("word")).join(known, "word")
    hit = {c: f"_hits{i}" for i, c in enumerate(categories)}
    counts = found.groupBy(key).agg(*[F.sum(F.shiftright("mask", i).bitwiseAND(F.lit(1))).alias(hit[c]) for i, c in enumerate(categories)])
    joined = rows.join(counts, key, "left").fillna(0, list(hit.values()))
    return joined, {c: F.col(name) for c, name in hit.items()}
