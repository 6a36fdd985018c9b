"""Retraining jobs: from the tables to the next ones, with a version more and all articles scored by it.

A job that is not due gives the tables back as they are. `bias` and `tone` are functions from tables to tables; `run_bias` and
`run_tone` read them from a keyed store and commit the scores and the version as one log entry, made from the entry that they
read: of two jobs at once one fails with keyed.Conflict and leaves no trace. The models of a version are saved under
`path` first, so that a version that is listed can be loaded."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators import models, stats, store
from newsloom.operators.keyed import KeyedStore, Table

BIAS, TONE = ["bias"], ["sentiment", "intensity"]
BIAS_VERSION = "version int, trained_at timestamp, feedback_count long, accuracy double, mae double, path string"
TONE_VERSION = "version int, trained_at timestamp, feedback_count long, polarity_accuracy double, intensity_accuracy double, path string"
BIAS_COLUMNS = {"bias_score": "double", "confidence": "double", "model_version": "int"}
TONE_COLUMNS = {"sentiment_score": "double", "intensity_score": "double", "sentiment_model_version": "int"}


@dataclass
class Retrained:
    """The next tables, and what changes in them: scores by id, and the version's row. version is None where no training was due."""

    articles: DataFrame
    versions: DataFrame
    version: int | None = None
    scored: DataFrame | None = None
    listed: DataFrame | None = None


def due(articles: DataFrame, feedback: DataFrame, versions: DataFrame, training: bool = False) -> bool:
    """Whether enough feedback came since the last version, or a first version has enough articles with a title."""
    counted = articles.where("title is not null").agg(F.count("*").alias("articles"))
    row = counted.select("articles", stats.since_last(feedback, versions).scalar().alias("pending"), stats.has_version(versions).scalar().alias("held")).first()
    return stats.should_retrain(row["pending"], row["held"], row["articles"], training)


def _next(versions: DataFrame) -> int:
    return (versions.agg(F.max("version").alias("v")).first()["v"] or 0) + 1


def _listed(feedback: DataFrame, schema: str, now: str, version: int, first: float | None, second: float | None, path: str | None) -> DataFrame:
    """The row of a version."""
    columns = [c.split()[0] for c in schema.split(", ")]
    figures = feedback.sparkSession.createDataFrame([(version, first, second, path)], f"version int, {columns[3]} double, {columns[4]} double, path string")
    return figures.withColumns({"trained_at": F.to_timestamp(F.lit(now)), "feedback_count": feedback.agg(F.count("*")).scalar()}).select(columns)


def _made(articles: DataFrame, versions: DataFrame, version: int, scored: DataFrame, listed: DataFrame, columns: dict[str, str]) -> Retrained:
    changed = store.update_by_key(store.with_columns(articles, columns), scored, "id", list(columns))
    return Retrained(changed, versions.unionByName(listed, allowMissingColumns=True), version, scored, listed)


def bias(articles: DataFrame, rows: DataFrame, feedback: DataFrame, versions: DataFrame, now: str, path: str | None = None, training: bool = False, space: models.TextSpace | None = None) -> Retrained:
    """rows: id, features, label and source_score of the articles to train on and to score; space: the terms behind features, to be saved."""
    own = stats.of_dimensions(feedback, BIAS)
    if not due(articles, own, versions, training):
        return Retrained(articles, versions)
    version, model = _next(versions), models.train(rows, models.BIAS_VALUES)
    place = models.save(rows.sparkSession, model, path, version, space) if path else None
    scored = models.predict(model, rows, F.col("source_score")).select("id", F.col("score").alias("bias_score"), "confidence", F.lit(version).alias("model_version"))
    return _made(articles, versions, version, scored, _listed(own, BIAS_VERSION, now, version, model.accuracy, model.mae, place), BIAS_COLUMNS)


def tone(articles: DataFrame, rows: DataFrame, feedback: DataFrame, versions: DataFrame, now: str, plain_heat, path: str | None = None, training: bool = False) -> Retrained:
    """Polarity and intensity. rows: id, features, p_class, i_class, polarity and raw; plain_heat: the intensity where there is no model."""
    own = stats.of_dimensions(feedback, TONE)
    if not due(articles, own, versions, training):
        return Retrained(articles, versions)
    version, spark = _next(versions), rows.sparkSession
    polarity = models.train(rows.withColumnRenamed("p_class", "label"), models.POLARITY_VALUES)
    heat = models.train(rows.withColumnRenamed("i_class", "label"), models.INTENSITY_VALUES)
    for model, name in ((polarity, "polarity"), (heat, "intensity")) if path else ():
        models.save(spark, model, f"{path}/{name}", version)
    first = models.predict(polarity, rows, F.col("polarity")).select("id", "features", "raw", F.col("score").alias("sentiment_score"))
    scored = models.predict(heat, first, plain_heat).select("id", "sentiment_score", F.col("score").alias("intensity_score"), F.lit(version).alias("sentiment_model_version"))
    return _made(articles, versions, version, scored, _listed(own, TONE_VERSION, now, version, polarity.accuracy, heat.accuracy, path), TONE_COLUMNS)


#: Tables of a store with retraining; a store's articles have its own columns and these.
VERSIONS = {"bias_versions": Table(BIAS_VERSION, ("version",)), "tone_versions": Table(TONE_VERSION, ("version",))}


def _attempt(path: str) -> str:
    """A folder of this job's own, so that one that fails in the end has not written over another's models."""
    return f"{path}/{uuid.uuid4().hex}"


def _run(held: KeyedStore, versions: str, job) -> int | None:
    """job(articles, versions) on the store's tables as one entry has them; its changes as the next entry."""
    since = held.state().version
    got = job(held.read("articles", since), held.read(versions, since))  # computed when they are written
    if got.version is not None:
        held.commit(inserts={versions: got.listed}, updates={"articles": got.scored}, since=since)
    return got.version


def run_bias(held: KeyedStore, rows: DataFrame, feedback: DataFrame, now: str, path: str, space: models.TextSpace | None = None) -> int | None:
    """`bias` over the tables articles and bias_versions of a store; the new version, if one was due."""
    return _run(held, "bias_versions", lambda articles, versions: bias(articles, rows, feedback, versions, now, _attempt(path), space=space))


def run_tone(held: KeyedStore, rows: DataFrame, feedback: DataFrame, now: str, plain_heat, path: str) -> int | None:
    return _run(held, "tone_versions", lambda articles, versions: tone(articles, rows, feedback, versions, now, plain_heat, _attempt(path)))
