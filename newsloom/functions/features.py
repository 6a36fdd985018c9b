"""Feature expressions over a title and a body: densities, ratios, bootstrap labels, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import constants as C
from newsloom.functions.text import words


def full_text(title: Column, body: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))


def _share(hits: Column, total: Column) -> Column:
    return hits / F.greatest(total, F.lit(1))


def hits(tokens: Column, lexicon: list[str] | Column) -> Column:
    """Words of a list among the tokens; a column is their number as counted before (see newsloom.operators.emotions)."""
    if isinstance(lexicon, Column):
        return lexicon
    return F.size(F.filter(tokens, lambda w: w.isin(*lexicon))) if len(lexicon) else F.lit(0)


def density(tokens: Column, lexicon: list[str] | Column) -> Column:
    return _share(hits(tokens, lexicon), F.size(tokens))


def sentence_marks(text: Column) -> Column:
    return F.greatest(F.regexp_count(text, F.lit("[.!?]")), F.lit(1))


def caps_ratio(text: Column, tokens: Column) -> Column:
    return _share(F.regexp_count(text, F.lit(r"(?U)\b[A-Z]{3,}\b")), F.size(tokens))


def bias_vector(text: Column, tokens: Column, source_score: Column, emotion_words: list[str] | Column = ()) -> dict[str, Column]:
    """Source prior, emotion share, hedging share, share of quoted characters, exclamations a sentence."""
    quoted = F.aggregate(F.regexp_extract_all(text, F.lit('"[^"]{10,}"'), F.lit(0)), F.lit(0), lambda n, q: n + F.char_length(q))
    return {
        "source_prior": source_score / 5.0,
        "emotional": density(tokens, emotion_words),
        "hedging": density(tokens, C.HEDGING_WORDS),
        "quoted": _share(quoted, F.char_length(text)),
        "exclaim": F.regexp_count(text, F.lit("!")) / sentence_marks(text),
    }


def sentiment_vector(text: Column, tokens: Column, lexicon: dict[str, list[str] | Column]) -> dict[str, Column]:
    """The 14 sentiment features, in order."""
    found = {c: density(tokens, lexicon.get(c, [])) for c in ("positive", "negative", *C.EMOTIONS)}
    return found | {
        "caps": caps_ratio(text, tokens),
        "exclaim": F.regexp_count(text, F.lit("!")) / sentence_marks(text),
        "question": F.regexp_count(text, F.lit(r"\?")) / sentence_marks(text),
        "loaded": density(tokens, lexicon.get("loaded_language", [])) * 100,
    }


def emotion_breakdown(tokens: Column, lexicon: dict[str, list[str] | Column]) -> dict[str, Column]:
    return {c: F.least(F.lit(1.0), density(tokens, lexicon.get(c, [])) * 100) for c in C.EMOTIONS}


def bootstrap_polarity(tokens: Column, lexicon: dict[str, list[str] | Column]) -> Column:
    p, n = hits(tokens, lexicon.get("positive", [])), hits(tokens, lexicon.get("negative", []))
    return (p - n) / (p + n + 1.0)


def bootstrap_intensity(text: Column, tokens: Column, lexicon: dict[str, list[str] | Column]) -> Column:
    d = {c: density(tokens, lexicon.get(c, [])) for c in ("anger", "fear", "disgust")}
    exclaim = F.regexp_count(text, F.lit("!")) / sentence_marks(text)
    return 0.30 * d["anger"] + 0.20 * d["fear"] + 0.20 * d["disgust"] + 0.15 * caps_ratio(text, tokens) + 0.15 * exclaim


def polarity_class(polarity: Column) -> Column:
    return F.when(polarity < -0.15, 0).when(polarity > 0.15, 2).otherwise(1)


def intensity_class(raw: Column, t33: Column | float, t66: Column | float) -> Column:
    return F.when(raw <= t33, 0).when(raw > t66, 2).otherwise(1)


def override_intensity_class(score: Column) -> Column:
    return F.when(score < 0.33, 0).when(score > 0.66, 2).otherwise(1)


def sentiment_classes(rows, t33: float, t66: float):
    """rows (polarity, raw, tone_vote, heat_vote) with p_class and i_class; a vote decides where there is one."""
    heat = F.when(F.col("heat_vote").isNotNull(), override_intensity_class(F.col("heat_vote"))).otherwise(intensity_class(F.col("raw"), t33, t66))
    return rows.withColumns({"p_class": polarity_class(F.coalesce("tone_vote", "polarity")), "i_class": heat})


def bias_class(score: Column) -> Column:
    return F.when(score < -4, 0).when(score < -2, 1).when(score < 2, 2).when(score < 4, 3).otherwise(4)


def fallback_intensity(raw: Column, t66: float = 1.0) -> Column:
    return F.round(F.least(F.lit(1.0), raw / max(t66 * 1.5, 1e-3)), 3)


def feature_table(articles, lexicon: dict[str, list[str]] = C.SMALL_LEXICON):
    """articles with text and tokens materialized as columns, so that expressions share them."""
    text = full_text(F.col("title"), F.col("body"))
    return articles.withColumn("full_text", text).withColumn("tokens", words(F.col("full_text")))
