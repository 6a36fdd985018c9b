"""The emotion lexicon as a table: JSON of category to words, or tab-separated word, category, flag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """category, word: lower-cased and distinct."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return raw.select(F.explode("m").alias("category", "words")).select("category", F.explode("words").alias("word")).select("category", F.lower("word").alias("word")).distinct()


def read_tsv_lexicon(spark: SparkSession, path: str, categories: list[str]) -> DataFrame:
    """category, word of the lines word, category, flag whose flag is 1."""
    raw = spark.read.csv(path, sep="\t", schema="word string, category string, flag string", quote="")
    return raw.where((F.col("flag") == "1") & F.col("category").isin(*categories)).select("category", F.lower("word").alias("word")).distinct()


def as_dict(lexicon: DataFrame) -> dict[str, list[str]]:
    """The lexicon for feature expressions; a lexicon is a small table by nature (some thousand words)."""
    return {r["category"]: sorted(r["words"]) for r in lexicon.groupBy("category").agg(F.collect_set("word").alias("words")).collect()}


def write_tsv_lexicon(lexicon: DataFrame, path: str) -> str:
    """A lexicon (category, word) in the layout that read_tsv_lexicon reads."""
    lexicon.select("word", "category", F.lit(1).alias("flag")).write.csv(path, sep="\t", quote="", escape="")
    return path
