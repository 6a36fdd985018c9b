"""Bias and sentiment models: features, balanced multinomial logistic regression, expected scores, quality, versions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.operators import logistic, stats, tfidf
from newsloom.operators.logistic import Logistic
from newsloom.session import settled

BIAS_VALUES, POLARITY_VALUES, INTENSITY_VALUES = [-5.0, -2.5, 0.0, 2.5, 5.0], [-1.0, 0.0, 1.0], [0.0, 0.5, 1.0]
UNTRAINED_CONFIDENCE = 0.3
MOST_TERMS = 5000


@dataclass
class Trained:
    """A model, the values of its classes and its quality; model is None where there is but one class."""

    model: Logistic | None
    values: list[float]
    accuracy: float | None = None
    mae: float | None = None


@dataclass
class TextSpace:
    """The terms that a text model knows: a table (term, df, at) of at most as many rows as it was fitted with, and its documents."""

    terms: DataFrame
    documents: int


def assemble(rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with `features`: a place for each of the columns."""
    at = F.lit(list(range(len(features)))).cast("array<int>")
    return rows.withColumn("features", F.struct(at.alias("at"), F.array(*[F.col(c).cast("double") for c in features]).alias("w")))


def fit_text(docs: DataFrame, text: str, most_terms: int = MOST_TERMS) -> TextSpace:
    """The most frequent words and pairs without stop words in two documents at least."""
    vocab = tfidf.frequent_terms(docs, text, tfidf.stop_words(), most_terms)
    placed = vocab.select("term", "df", (F.row_number().over(Window.orderBy("term")) - 1).alias("at"))  # one task, most_terms rows
    return TextSpace(settled(placed), docs.count())


def assemble_text(rows: DataFrame, features: list[str], docs: DataFrame, key: str, text: str, space: TextSpace) -> DataFrame:
    """rows with `features`: a place for each of the columns, and behind them one for each term that docs (key, text) holds,
    by sublinear weight; of unit length together."""
    behind = space.terms.withColumn("at", (F.col("at") + len(features)).cast("int"))
    held = tfidf.known_vectors(docs, key, text, tfidf.stop_words(), behind, space.documents, bigrams=True, sublinear=True).select(key, F.col("at").alias("_at"), F.col("w").alias("_w"))
    plain = F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features])
    both = [F.concat(first, F.coalesce(rest, F.array().cast(kind))) for first, rest, kind in ((F.lit(list(range(len(features)))).cast("array<int>"), "_at", "array<int>"), (plain, "_w", "array<double>"))]
    return rows.join(held, key, "left").withColumn("features", F.struct(both[0].alias("at"), both[1].alias("w"))).drop("_at", "_w")


def train(rows: DataFrame, values: list[float], folds: int = 3, fold_key: str = "id") -> Trained:
    """From rows (features, label, and a key that deals them into folds). One class: no model, no figures."""
    held = logistic.blocks(rows, "label", fold_key)
    classes = int((logistic.class_counts(held, len(values)) > 0).sum())
    if classes < 2:
        return Trained(None, values)
    made = logistic.fit(held, len(values), min(folds, classes))
    return Trained(made[0], values, *logistic.quality(held, made, values))


def expected(probability: Column, values: list[float]) -> Column:
    return F.aggregate(F.zip_with(probability, F.lit(values), lambda a, v: a * v), F.lit(0.0), lambda s, x: s + x)


def predict(trained: Trained, rows: DataFrame, fallback: Column) -> DataFrame:
    """rows with score (2 places) and confidence (3 places); without a model the fallback and a fixed confidence."""
    if trained.model is None:
        return rows.withColumn("score", F.round(fallback, 2)).withColumn("confidence", F.lit(UNTRAINED_CONFIDENCE))
    scored = rows.withColumn("_p", logistic.probabilities(trained.model, "features"))
    return scored.withColumn("score", F.round(expected(F.col("_p"), trained.values), 2)).withColumn("confidence", F.round(F.array_max("_p"), 3)).drop("_p")


ABOUT = "values array<double>, accuracy double, mae double, fitted boolean"
MODEL = "class int, intercept double, known boolean, coefficients array<double>"
SPACE = "term string, df long, at int, documents long"


def _place(path: str, version: int) -> str:
    return f"{path}/version={version:08d}"


def save(spark: SparkSession, trained: Trained, path: str, version: int, space: TextSpace | None = None) -> str:
    """Writes the model of a version and, beside it, its classes' values and quality and the terms that it knows; the latest
    version is the largest number, not the last name."""
    place = _place(path, version)
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{place}/{name}")
    if (model := trained.model) is not None:
        put([(i, float(model.intercepts[i]), bool(model.known[i]), model.coefficients[i].tolist()) for i in range(len(model.known))], MODEL, "model")
    if space is not None:
        space.terms.select("term", F.col("df").cast("long").alias("df"), F.col("at").cast("int").alias("at"), F.lit(space.documents).cast("long").alias("documents")).coalesce(1).write.mode("overwrite").parquet(f"{place}/terms")
    put([(trained.values, trained.accuracy, trained.mae, model is not None)], ABOUT, "about")
    return place


def load(spark: SparkSession, path: str, version: int) -> Trained:
    place = _place(path, version)
    about = spark.read.schema(ABOUT).parquet(f"{place}/about").first()
    if not about["fitted"]:
        return Trained(None, list(about["values"]), about["accuracy"], about["mae"])
    rows = spark.read.schema(MODEL).parquet(f"{place}/model").orderBy("class").collect()  # a row a class
    model = Logistic(np.array([r["coefficients"] for r in rows]), np.array([r["intercept"] for r in rows]), np.array([r["known"] for r in rows]))
    return Trained(model, list(about["values"]), about["accuracy"], about["mae"])


def load_text(spark: SparkSession, path: str, version: int) -> TextSpace:
    rows = spark.read.schema(SPACE).parquet(f"{_place(path, version)}/terms")
    return TextSpace(rows.drop("documents"), rows.agg(F.max("documents")).first()[0] or 0)


def intensity_thresholds(raw: DataFrame, column: str) -> tuple[float, float]:
    """33rd and 66th percentile of the non-zero values; fixed ones where fewer than max(20, a tenth) are non-zero."""
    some = raw.select(F.col(column).alias("v"))
    row = some.agg(F.count("v").alias("n"), F.count_if(F.col("v") > 0).alias("k")).first()
    return (0.005, 0.02) if row["k"] < max(20, row["n"] * 0.1) else tuple(stats.exact_percentiles(some.where("v > 0"), [], "v", [0.33, 0.66]).first()["p"])
