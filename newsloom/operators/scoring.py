"""Articles as the bias model sees them, and scores by the version that a store lists last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import features as X
from newsloom.operators import models
from newsloom.operators.keyed import KeyedStore
from newsloom.operators.models import TextSpace


def bias_rows(articles: DataFrame, lexicon: list[str], space: TextSpace | None = None, columns: tuple[str, ...] = ()) -> tuple[DataFrame, TextSpace]:
    """id, source_score, `columns` and features of articles (id, title, body, source_score); terms are fitted to them if none are given."""
    read = X.feature_table(articles)
    vector = X.bias_vector(F.col("full_text"), F.col("tokens"), F.col("source_score"), lexicon)
    docs = read.select("id", "full_text")
    space = space or models.fit_text(docs, "full_text")
    made = read.select("id", "source_score", *columns, *[c.alias(n) for n, c in vector.items()])
    return models.assemble_text(made, list(vector), docs, "id", "full_text", space).select("id", "source_score", *columns, "features"), space


class Scorer:
    """Scores with the latest version in a store's bias_versions; asks for it each time, and loads it when it is new."""

    def __init__(self, held: KeyedStore, lexicon: list[str]):
        self.held, self.lexicon = held, lexicon
        self.version, self.model, self.space = 0, models.Trained(None, models.BIAS_VALUES), None

    def refresh(self) -> int:
        row = self.held.read("bias_versions").agg(F.max("version").alias("version"), F.max_by("path", "version").alias("path")).first()
        if (row["version"] or 0) != self.version:
            spark, path = self.held.spark, row["path"].rsplit("/version=", 1)[0]
            self.model, self.space = models.load(spark, path, row["version"]), models.load_text(spark, path, row["version"])
            self.version = row["version"]
        return self.version

    def score(self, articles: DataFrame) -> DataFrame:
        """articles (id, title, body, source_score) with bias_score, confidence and model_version. Before the first version: no scores."""
        if not self.refresh():
            return articles.withColumns({"bias_score": F.lit(None).cast("double"), "confidence": F.lit(None).cast("double"), "model_version": F.lit(None).cast("int")})
        rows, _ = bias_rows(articles, self.lexicon, self.space)
        scored = models.predict(self.model, rows, F.col("source_score")).select("id", F.col("score").alias("bias_score"), "confidence", F.lit(self.version).alias("model_version"))
        return articles.join(scored, "id", "left")
