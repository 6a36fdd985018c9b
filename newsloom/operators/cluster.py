"""Story clusters: similarity links, then a greedy, ordered, size-capped joining of groups.

Joining depends on the order of links, so it is a fold, not connected components; but links of different components
never meet, so each component is folded on its own. All this is over the newest `candidates` articles only, a bound of
the operator itself, not of a test."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.feed import newest
from newsloom.operators.tfidf import cosine_pairs, stop_words, terms, vocabulary, weights


def capped_groups(links: pd.DataFrame, most: int) -> pd.DataFrame:
    """rank, root (the least rank of its group) of all ranks in links (a, b): in order of (a, b), a link makes one group of
    its ends' groups unless that would have more than `most` members."""
    groups = {rank: {rank} for rank in pd.unique(links[["a", "b"]].to_numpy().ravel())}
    for a, b in sorted(zip(links["a"], links["b"], strict=True)):
        both = groups[a] | groups[b]
        if len(both) <= most:
            groups.update(dict.fromkeys(both, both))
    return pd.DataFrame({"rank": list(groups), "root": [min(g) for g in groups.values()]}, dtype="int64")


def component_of(links: DataFrame) -> DataFrame:
    """rank, component (its least rank) of the ranks in links (a, b); labels, at most a row a candidate, pass between the rounds."""
    ways = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).persist()
    try:
        labels = {r["a"]: r["low"] for r in ways.groupBy("a").agg(F.least("a", F.min("b")).alias("low")).collect()}  # candidates rows
        while True:
            labels = {k: labels[v] for k, v in labels.items()}
            held = links.sparkSession.createDataFrame(list(labels.items()), "b long, low long")
            after = {r["a"]: min(r["low"], labels[r["a"]]) for r in ways.join(F.broadcast(held), "b").groupBy("a").agg(F.min("low").alias("low")).collect()}
            if after == labels:
                break
            labels = after
    finally:
        ways.unpersist()
    return links.sparkSession.createDataFrame(list(labels.items()), "rank long, component long")


def cluster_text() -> Column:
    """Title twice and body, dots as blanks."""
    plain = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("."), F.lit(" "))
    return F.concat_ws(" ", plain("title"), plain("title"), plain("body"))


def story_clusters(articles: DataFrame, threshold: float = 0.32, most: int = 10, candidates: int = 500, max_terms: int = 3000) -> DataFrame:
    """group_id, article_ids of groups of two articles or more from two sources or more, members newest first."""
    recent = articles.where("title is not null").orderBy(*newest()).limit(candidates)
    ranked = recent.withColumn("rank", (F.row_number().over(Window.orderBy(*newest())) - 1).cast("long")).persist()  # candidates rows
    counts = terms(ranked.select("rank", cluster_text().alias("text")), "rank", "text", stop_words(), bigrams=True).persist()
    links = cosine_pairs(weights(counts, vocabulary(counts, 2, max_terms), "rank", ranked.count()), "rank", threshold).select("a", "b").persist()
    apart = links.join(F.broadcast(component_of(links).withColumnRenamed("rank", "a")), "a")
    roots = apart.groupBy("component").applyInPandas(lambda df: capped_groups(df, most), "rank long, root long")
    grouped = ranked.select("rank", "id", "source_id").join(roots, "rank").groupBy("root").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id")))["id"].alias("article_ids"), F.count("*").alias("n"), F.countDistinct("source_id").alias("outlets")
    )
    wanted = grouped.where("n >= 2 and outlets >= 2")
    return wanted.select(F.substring(F.sha2(F.array_join(F.sort_array("article_ids"), ":"), 256), 1, 12).alias("group_id"), "article_ids")
