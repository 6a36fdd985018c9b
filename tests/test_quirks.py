"""Small hand-made cases for the rules that decide results."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsloom.functions import features as X
from newsloom.functions import text as T
from newsloom.functions import weather as W
from newsloom.operators import cluster, feed, markets, models, signals, stats, store, stories
from newsloom.operators.summarize import pull_quote, summaries
from newsloom.operators import tfidf
from newsloom.plans import queries
from newsloom.sources import fixtures as S

SF = "/root/testdata/sf0.001"

NOW = "2024-01-31 12:00:00"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def articles(spark, rows):
    return spark.createDataFrame(rows, "id string, source_id string, title string, body string, published string, bias_score double").withColumn("published", F.to_timestamp("published"))


def test_lookback_floors_to_the_cutoffs_day(spark):
    rows = articles(spark, [("a", "s", "t", "b", "2024-01-30 01:00:00", 0.0), ("b", "s", "t", "b", "2024-01-29 23:59:59", 0.0)])
    policy = feed.Policy(lookback_hours=24)
    assert [r.id for r in feed.feed_filter(rows, policy, NOW).collect()] == ["a"]
    assert feed.feed_filter(rows, policy, NOW, mode="exact").count() == 0


def test_empty_source_list_filters_nothing(spark):
    rows = articles(spark, [("a", "s", "t", "b", None, None)])
    policy = feed.curation_policy(category="opinion", sources_of_category=())
    assert policy.per_source_cap == 5 and policy.lookback_hours == 24
    assert feed.feed_filter(rows, feed.Policy(source_ids=()), NOW, min_score=1.0).count() == 1  # null passes the range


def test_policy_kinds():
    assert feed.curation_policy(source_id="x").per_source_cap is None
    assert feed.curation_policy(include_all=True) == feed.Policy()
    assert len(feed.curation_policy().source_ids) == 10


def test_dedupe_keeps_place_of_first_and_content_of_best(spark):
    rows = articles(spark, [("a", "s", "Same: title!", "x", None, 0.0), ("b", "s", "other", "x", None, 0.0), ("c", "s", "same title", "longer", None, 0.0), ("d", "s", "", "", None, 0.0), ("e", "s", None, "", None, 0.0)])
    placed = rows.withColumn("pos", F.expr("ascii(id) - 97"))
    assert {(r.pos, r.id) for r in feed.dedupe(placed).collect()} == {(0, "c"), (1, "b"), (3, "d"), (4, "e")}


def test_score_bins_are_half_open(spark):
    got = [one(spark, X.bias_class(F.lit(s))) for s in (-4.5, -4.0, -2.0, 1.99, 2.0, 4.0)]
    assert got == [0, 1, 2, 2, 3, 4]


def test_blindspot_needs_four_outlets_and_a_share(spark):
    lean = spark.createDataFrame([("a", 4, 1, 0, 3), ("b", 4, 1, 1, 2), ("c", 3, 0, 0, 3), ("d", 4, 0, 4, 0)], "group_id string, outlets int, left_n int, center_n int, right_n int")
    got = {r.group_id: r.direction for r in stories.blindspot(lean).collect()}
    assert got == {"a": "left", "b": None, "c": None, "d": None}


def test_union_is_greedy_ordered_and_capped():
    links = pd.DataFrame({"a": [0, 1, 2, 3], "b": [1, 2, 3, 4]})
    got = cluster.capped_groups(links, 3)
    groups = got.groupby("root")["rank"].apply(lambda r: sorted(r)).tolist()
    assert sorted(groups) == [[0, 1, 2], [3, 4]]


def test_zero_previous_close_falls_through(spark):
    assert one(spark, F.coalesce(markets.truthy(F.lit(0.0)), markets.truthy(F.lit(3.0)))) == 3.0


def test_chart_zip_drops_missing_closes(spark):
    payload = '{"chart":{"result":[{"meta":{"symbol":"X","chartPreviousClose":0,"previousClose":4,"regularMarketPrice":5},"timestamp":[1,2,3],"indicators":{"quote":[{"open":[1],"close":[1.5,null,2.5]}]}}]}}'
    charts = markets.parse_chart(spark.createDataFrame([("X", payload), ("Y", '{"chart":{}}')], "symbol string, payload string"))
    assert [(r.t, r.o, r.c) for r in markets.chart_series(charts).collect()] == [(1, 1.0, 1.5), (3, None, 2.5)]
    quote = markets.compact_quote(charts).first()
    assert (quote.previous_close, quote.change, quote.spark) == (4.0, 1.0, [1.5, 2.5])


def test_binary_market_order_and_prices(spark):
    rows = spark.createDataFrame([('["Yes","No"]', '["0.3","0.7"]'), ('["No","Yes"]', '["0.3","0.7"]'), ("[", None), (None, None)], "o string, p string")
    got = rows.select(signals.is_binary(F.col("o")).alias("b"), signals.yes_price(F.col("o"), F.col("p")).alias("y")).collect()
    assert [(r.b, r.y) for r in got] == [(True, 0.3), (False, 0.7), (False, None), (False, None)]


def test_keywords_match_inside_words(spark):
    assert one(spark, signals.category(F.lit("best award"))) == "geopolitics"
    assert one(spark, signals.category(F.lit("oscar for war film"))) is None


def test_last_feedback_by_id_wins(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (3, "a", 3.0), (2, "a", 2.0)], "id long, article_key string, user_score double")
    assert stats.overrides(rows).first().user_score == 3.0


def test_retrain_rules():
    assert stats.should_retrain(50, True, 0) and not stats.should_retrain(49, True, 100)
    assert stats.should_retrain(0, False, 10) and not stats.should_retrain(0, False, 9) and not stats.should_retrain(99, True, 99, training=True)


def test_upserts(spark):
    old = spark.createDataFrame([("a", "old"), ("b", "old")], "id string, title string")
    new = spark.createDataFrame([("b", "new"), ("c", "new"), ("c", "newer")], "id string, title string")
    assert {tuple(r) for r in store.insert_absent(old, new, "id").collect()} == {("a", "old"), ("b", "old"), ("c", "new")}
    assert store.retain_members(old, "id", spark.createDataFrame([], "id string"), "id").count() == 2


def test_versioned_table(spark, tmp_path):
    table = store.VersionedTable(spark, f"file://{tmp_path}/t", "id string, title string")
    assert table.read().count() == 0
    rows = spark.createDataFrame([("a", "x")], table.schema)
    table.change(lambda now: store.insert_absent(now, rows, "id"))
    table.change(lambda now: store.insert_absent(now, rows.withColumn("title", F.lit("y")), "id"))
    assert [tuple(r) for r in table.read().collect()] == [("a", "x")]


def test_single_class_trains_no_model(spark):
    rows = models.assemble(spark.createDataFrame([("a", 1.0, 2), ("b", 2.0, 2)], "id string, x double, label int"), ["x"])
    got = models.train(rows, models.BIAS_VALUES)
    assert got.model is None and models.predict(got, rows, F.lit(1.234)).select("score", "confidence").first() == (1.23, 0.3)


def test_model_probabilities_and_expectation(spark):
    data = [(str(i), float(i % 2) * 4 + i / 100, 4 if i % 2 else 0) for i in range(40)]
    rows = models.assemble(spark.createDataFrame(data, "id string, x double, label int"), ["x"])
    got = models.train(rows, models.BIAS_VALUES)
    assert got.accuracy > 0.9 and got.mae < 0.5
    scores = {r.id: r.score for r in models.predict(got, rows, F.lit(0.0)).collect()}
    assert scores["0"] < 0 < scores["1"] and all(-5 <= s <= 5 for s in scores.values())


def test_subindex_edges(spark):
    got = [one(spark, W.subindex(F.lit("pm2_5"), F.lit(v))) for v in (0.0, 12.0, 35.4, 600.0)]
    assert got == [0.0, 50.0, 100.0, 500.0]
    assert one(spark, W.subindex(F.lit("pm2_5"), F.lit(None).cast("double"))) is None


def test_html_strip_and_low_signal(spark):
    rows = spark.createDataFrame([("<p>A &amp; <b>b</b></p>\n c",), (None,)], "h string")
    assert [r.t for r in rows.select(T.strip_html("h").alias("t")).collect()] == ["A & b c", ""]
    assert one(spark, T.low_signal(F.lit("The NFL season"))) and one(spark, T.low_signal(F.lit(None).cast("string")))


BREAK = re.compile(r"(?<=[.!?])\s+(?=[A-Z\"'])")


def brute_summary(title, body, budget):
    """The rule word by word: rank by centrality, take until full, put in order, cut."""
    count = lambda t: len(re.findall(r"\b\w+\b", t))
    cut = lambda t: t if len(t.split()) <= budget else " ".join(t.split()[:budget]).rstrip(",;:") + "…"
    title, body = " ".join((title or "").split()), " ".join((body or "").split())
    if not body:
        return cut(title)
    if count(body) <= budget:
        return body
    parts = [p for p in BREAK.split(body) if count(p) >= 4]
    stop = set(tfidf.stop_words())
    bags = [Counter(w for w in re.findall(r"\b\w\w+\b", p.lower()) if w not in stop) for p in [*parts, title]]
    df = Counter(w for bag in bags[:-1] for w in bag)
    if len(parts) < 3 or count(body) < 40 or not df:
        return cut(body)
    raw = [{w: n * (math.log((1 + len(parts)) / (1 + df[w])) + 1) for w, n in bag.items() if w in df} for bag in bags]
    unit = [{w: x / math.sqrt(sum(y * y for y in r.values())) for w, x in r.items()} for r in raw]
    dot = lambda x, y: sum(v * y.get(w, 0) for w, v in x.items())
    scores = [round(sum(dot(x, y) for j, y in enumerate(unit[:-1]) if j != i) + 0.5 * dot(x, unit[-1]), 9) for i, x in enumerate(unit[:-1])]
    taken, words = [], 0
    for i in sorted(range(len(parts)), key=lambda i: (-scores[i], i)):
        if words >= budget or words >= max(int(0.75 * budget), 30) and words + count(parts[i]) > 1.4 * budget:
            break
        taken.append(i)
        words += count(parts[i])
    out = " ".join(parts[i] for i in sorted(taken))
    return cut(out) if count(out) > budget else out


@pytest.mark.parametrize("budget", [20, 39, 60, 100])
def test_summaries_match_brute_force(spark, budget):
    rows = [(r.doc_id, r.title, r.body) for r in S.articles(spark, SF).select("doc_id", "title", "body").collect()]
    rows += [(90_001, "Only a title", None), (90_002, None, "Short body."), (90_003, "t", "the and of to. " * 30), (90_004, "T", "The and of it is. " * 30), (90_005, None, None)]
    rows += [(90_010, "Trade and tariff", " ".join(f"Sentence number {i} speaks of trade, ports and tariff rule {i % 7} today." for i in range(40)))]
    made = summaries(spark.createDataFrame(rows, "doc_id long, title string, body string"), "doc_id", "title", "body", budget)
    got = {r.doc_id: r.summary for r in made.collect()}
    assert len(got) == len(rows)
    wrong = [d for d, t, b in rows if got[d] != brute_summary(t, b, budget)]
    assert wrong == []


def brute_quote(title, body):
    paragraphs = [" ".join(p.split()) for p in (body or "").split("\n") if p.strip()]
    if len(paragraphs) < 6:
        return None
    head, opening = " ".join((title or "").split()).lower(), " ".join(paragraphs[:2]).lower()
    parts = [" ".join(s.split()) for s in BREAK.split(" ".join(paragraphs))]
    able = [s for s in parts if len(s) >= 30 and not (head and s.lower().startswith(head)) and s.lower()[:40] not in opening]
    return min(able, key=lambda s: abs(len(s) - 120), default=None)


def test_pull_quotes_match_brute_force(spark):
    body = "\n".join(f"Paragraph {i} holds one long sentence about the harbour and its ships number {i}." for i in range(6))
    rows = [(r.title, r.body) for r in S.articles(spark, SF).select("title", "body").collect()] + [("Title", body), ("Paragraph 3 holds", body), (None, body), ("Title", "one\ntwo"), ("t", None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, title string, body string")
    got = {r.i: r.q for r in frame.select("i", pull_quote(F.col("title"), F.col("body")).alias("q")).collect()}
    assert [got[i] for i in range(len(rows))] == [brute_quote(*r) for r in rows]


def test_raw_text_and_references_in_stripping(spark):
    pages = ["<p>a</p><script>var t='</p>&amp;';</script>&lt;b&gt;<!-- <p>no</p> -->x<br/>y", "a < b and 1<2", "<P CLASS='x>y'>q"]
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i long, h string")
    got = [r.t for r in frame.select("i", T.strip_html("h").alias("t")).orderBy("i").collect()]
    assert got[0] == "a var t='</p>&amp;'; <b> x y" and got[1] == "a < b and 1<2"


def test_votes_override_the_sentiment_classes(spark):
    rows = spark.createDataFrame([(0.9, 0.0, None, None), (0.9, 0.0, -0.9, 0.9), (0.0, 0.9, None, 0.5), (-0.9, 0.5, 0.0, 0.1)], "polarity double, raw double, tone_vote double, heat_vote double")
    got = [(r.p_class, r.i_class) for r in X.sentiment_classes(rows, 0.3, 0.6).collect()]
    assert got == [(2, 0), (0, 2), (1, 1), (1, 0)]


def test_models_come_back_with_their_classes(spark, tmp_path):
    rows = models.assemble(spark.createDataFrame([(str(i), i % 2, float(i % 2) + i / 100) for i in range(40)], "id string, label int, x double"), ["x"])
    one = models.train(rows.withColumn("label", F.lit(1)), models.POLARITY_VALUES)
    for version, made in enumerate((models.train(rows, models.POLARITY_VALUES), one)):
        models.save(spark, made, f"file://{tmp_path}/m", version)
        back = models.load(spark, f"file://{tmp_path}/m", version)
        assert (back.values, back.accuracy, back.mae, back.model is None) == (made.values, made.accuracy, made.mae, made.model is None)
        same = [models.predict(m, rows, F.lit(0.0)).select("id", "score").orderBy("id").collect() for m in (made, back)]
        assert same[0] == same[1]


def test_components_of_links_are_folded_apart(spark):
    links = spark.createDataFrame([(0, 4), (4, 7), (2, 7), (10, 11), (11, 12)], "a long, b long")
    assert {r["rank"]: r.component for r in cluster.component_of(links).collect()} == {0: 0, 4: 0, 7: 0, 2: 0, 10: 10, 11: 10, 12: 10}


def test_payloads(spark, tmp_path):
    from newsloom.sources import lexicon, payloads

    assert one(spark, payloads.trending(F.lit('{"finance":{"result":[{"quotes":[{"symbol":"A"},{},{"symbol":"B"}]}]}}'))) == ["A", "B"]
    assert one(spark, payloads.trending(F.lit("oops"))) == []
    first = payloads.snapshot(spark, f"file://{tmp_path}/s", "2024-01-31 12:00:00", 60, lambda: spark.range(3))
    again = payloads.snapshot(spark, f"file://{tmp_path}/s", "2024-01-31 12:00:59", 60, lambda: spark.range(5))
    later = payloads.snapshot(spark, f"file://{tmp_path}/s", "2024-01-31 12:01:00", 60, lambda: spark.range(5))
    assert (first.count(), again.count(), later.count()) == (3, 3, 5)
    (tmp_path / "l.json").write_text('{"joy": ["Glad", "glad", "eye-opening"], "fear": ["dread"]}')
    (tmp_path / "l.tsv").write_text("glad\tjoy\t1\nsad\tjoy\t0\nDread\tfear\t1\n")
    assert lexicon.as_dict(lexicon.read_json_lexicon(spark, f"file://{tmp_path}/l.json")) == {"joy": ["eye-opening", "glad"], "fear": ["dread"]}
    assert lexicon.as_dict(lexicon.read_tsv_lexicon(spark, f"file://{tmp_path}/l.tsv", ["joy", "fear"])) == {"joy": ["glad"], "fear": ["dread"]}


def test_whole_article_queries_match_brute_force(spark):
    docs = S.articles(spark, SF).where("title is not null").select("doc_id", "title", "body").collect()
    stop, word = set(tfidf.stop_words()), re.compile(r"\b\w\w+\b")

    def vectors(texts, most, sublinear):
        counts = {}
        for d, text in texts.items():
            words = [w for w in word.findall(text.lower()) if w not in stop]
            counts[d] = Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)])
        df, cf = Counter(t for c in counts.values() for t in c), sum(counts.values(), Counter())
        vocab = set(sorted((t for t in df if df[t] > 1), key=lambda t: (-cf[t], t))[:most])
        out = {}
        for d, c in counts.items():
            w = {t: (1 + math.log(n) if sublinear else n) * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in c.items() if t in vocab}
            size = math.sqrt(sum(x * x for x in w.values()))
            out[d] = {t: x / size for t, x in w.items()}
        return out

    held = vectors({r.doc_id: f"{r.title} {r.body or ''}" for r in docs}, 5000, True)
    got = {(r.doc_id, r.term): r.w for r in queries.QUERIES["q_d6_article_tfidf"](spark, SF).collect()}
    assert got == pytest.approx({(d, t): x for d, v in held.items() for t, x in v.items()}, abs=1e-4)
    plain = vectors({r.doc_id: f"{r.title} {r.title} {r.body or ''}".replace(".", " ") for r in docs}, 3000, False)
    cosine = {(a, b): sum(x * plain[b].get(t, 0.0) for t, x in plain[a].items()) for a in plain for b in plain if a < b}
    pairs = {(r.a, r.b): r.cosine for r in queries.QUERIES["q_j10_article_pairs"](spark, SF).collect()}
    assert pairs == pytest.approx({p: c for p, c in cosine.items() if c > 0.32}, abs=1e-4)


def test_story_groups_at_the_production_threshold(spark):
    got, production, narrow = (
        {(r.group_id, tuple(r.article_ids.split(","))) for r in frame.select("group_id", F.array_join("article_ids", ",").alias("article_ids")).collect()}
        for frame in (
            queries.QUERIES["q_d16_story_groups"](spark, SF).withColumn("article_ids", F.split("article_ids", ",")),
            cluster.story_clusters(S.articles(spark, SF), threshold=0.32),
            cluster.story_clusters(S.articles(spark, SF), threshold=0.6),
        )
    )
    print("story groups at 0.32 and 0.6:", len(production), len(narrow))
    assert got == production != narrow


def test_bias_model_takes_the_text(spark):
    rows, space = queries._bias_rows(spark, SF)
    terms = {r["term"] for r in queries.QUERIES["q_d6_article_tfidf"](spark, SF).select("term").distinct().collect()}
    assert {r["term"] for r in space.terms.collect()} == terms and len(terms) > 100
    places = [r["at"] for r in rows.select("features.at").collect()]
    assert all(at[:5] == [0, 1, 2, 3, 4] and at == sorted(set(at)) for at in places)
    assert {x for at in places for x in at} == set(range(5 + len(terms)))
