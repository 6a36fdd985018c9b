"""From raw documents to token ids: five stages, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
Rows without doc_id pass the stages that decide by doc_id; rows that share a doc_id go or stay together there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import bpe, decontam, langid, resemblance
from newsloom.llm.common import free_name, written
from newsloom.llm.line_dedup import LineIndex

#: The score that a document needs to stay: two languages in one text reach it, evidence spread over more does not.
LEAST_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known for certain enough; texts without letters go.

    Where no row is labelled there is nothing to learn from: all documents with letters stay."""
    return langid.keep_identified(docs, langid.fit(docs), LEAST_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that later documents repeat; n_chars follows the text."""
    kept = LineIndex(spark).insert(docs).apply(docs)
    n_chars = F.when(F.col(free_name(docs.columns, "_dropped")) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return kept.select(*[n_chars.alias(c) if c == "n_chars" else f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by doc_id, of each group of SimHash near duplicates with five-word Jaccard 0.8 or more."""
    later = resemblance.groups(docs).where("doc_id <> component_id").select("doc_id")
    return docs.join(later, "doc_id", "left_anti").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = decontam.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the ids decode to the text's bytes."""
    made = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_text=True)
    exact = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("exact"))


STAGES = [
    ("language", language),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("tokens", tokens),
]

#: Language models, similarity links and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
