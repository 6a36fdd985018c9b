"""DuckDB statements for the queries that SQL can express, written independently of the DataFrame code."""

from __future__ import annotations

from newsloom.functions import constants as C
from newsloom.plans import views as V
from newsloom.plans.views import using

ORACLES: dict[str, str] = {}
TS = "'%Y-%m-%d %H:%M:%S'"
FINANCE = "('src0', 'src4', 'src8', 'src12', 'src16')"
NOW = "TIMESTAMP '2024-01-31 12:00:00'"


def oracle(name: str, *views: str, query: str) -> None:
    ORACLES[f"q_{name}"] = using(*views, query=query) if views else query


def quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def any_of(text: str, values: list[str]) -> str:
    return f"len(list_filter({quoted(values)}, lambda p: contains({text}, p))) > 0"


def norm(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def space(text: str) -> str:
    return f"trim(regexp_replace(coalesce({text}, ''), '\\s+', ' ', 'g'))"


WORDS = "'[\\p{L}\\p{N}_]+'"
PARTS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"

oracle("s8_active_sources", V.SOURCES, query="SELECT id, name, category, allsides_label, allsides_score FROM sources WHERE active")
oracle("s1_feed_xml", V.ARTICLES, query=f"""SELECT substr(sha256(source_id || ':' || url), 1, 16) AS id, source_id, 'Report ' || doc_id || ' & more' AS title, url, strftime(published, {TS}) AS published
    FROM (SELECT *, row_number() OVER (PARTITION BY source_id, doc_id // 96 ORDER BY doc_id) AS pos FROM articles WHERE source_id IS NOT NULL) WHERE pos <= 30""")
oracle("a21_sources_by_category", V.SOURCES, query="SELECT category, string_agg(name, '|' ORDER BY name) AS names FROM sources GROUP BY category")
oracle("f1_feed_filter", V.ARTICLES, query=f"""SELECT id, source_id, title, strftime(published, {TS}) AS published, bias_score FROM articles
    WHERE source_id IN {FINANCE} AND (bias_score IS NULL OR bias_score BETWEEN -2 AND 3) AND published >= TIMESTAMP '2024-01-29 00:00:00'""")
oracle("f2_null_range", V.ARTICLES, query="SELECT source_id, count(*) AS n, count(*) FILTER (bias_score IS NULL) AS n_null FROM articles WHERE bias_score IS NULL OR bias_score >= 0 GROUP BY 1")
oracle("f3_lookback_floor", V.ARTICLES, query="SELECT source_id, count(*) AS n FROM articles WHERE published >= TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1")
oracle("f3_lookback_exact", V.ARTICLES, query=f"SELECT source_id, count(*) AS n FROM articles WHERE published > {NOW} - INTERVAL 24 HOUR GROUP BY 1")
oracle("f6_low_signal", V.ARTICLES, query=f"""SELECT doc_id, coalesce(t, '') = '' OR {any_of("' ' || lower(t) || ' '", C.LOW_SIGNAL_TOKENS)} AS low_signal
    FROM (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN title || ' draft pick' WHEN doc_id % 19 = 0 THEN '' ELSE title END AS t FROM articles)""")
oracle("f7_paywall", V.ARTICLES, query=f"""SELECT doc_id, len(list_filter({quoted(C.PAYWALL_PHRASES)}, lambda p: contains(lower(t), p))) >= 2 AS paywall
    FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN coalesce(body, '') || ' Subscribe to read. Cancel anytime.' WHEN doc_id % 13 = 0 THEN 'cancel anytime' ELSE coalesce(body, '') END AS t FROM articles)""")
oracle("f10_short_bodies", V.ARTICLES, query=f"""SELECT id, source_id, strftime(published, {TS}) AS published FROM articles
    WHERE length(coalesce(body, '')) < 300 AND (doc_id % 3 <> 0 OR {NOW} - to_hours((doc_id % 48)::INT) < {NOW} - INTERVAL 24 HOUR)
    ORDER BY articles.published DESC NULLS LAST, id LIMIT 8""")
oracle("f11_unscored", V.ARTICLES, query="SELECT id, source_id FROM articles WHERE doc_id % 5 = 0 OR bias_score IS NULL OR sentiment_score IS NULL")
oracle("f12_feedback_dimension", V.FEEDBACK, query="SELECT dimension, feedback_type, count(*) AS n, round(avg(user_score), 6) AS avg_score FROM feedback WHERE dimension <> 'bias' GROUP BY 1, 2")
oracle("f14_market_news", V.ARTICLES, query=f"""SELECT id, title, strftime(published, {TS}) AS published FROM (
        SELECT * FROM articles WHERE {any_of("lower(title)", ["the", "und", "les"])} ORDER BY articles.published DESC NULLS LAST, id LIMIT 40) near
    WHERE list_has_any(regexp_extract_all(lower(title), {WORDS}), ['the', 'und', 'les']) ORDER BY near.published DESC NULLS LAST, id LIMIT 10""")
oracle("f17_digest_usable", V.ARTICLES, query=f"""SELECT doc_id, sha256(t) AS digest_sha256 FROM (
        SELECT doc_id, n, CASE WHEN length(s) >= length(h) THEN s ELSE b END AS t, h FROM (
            SELECT doc_id, {space("CASE WHEN doc_id % 4 = 0 THEN substr(body, 1, 150) END")} AS s, {space("body")} AS b, {space("title")} AS h, {norm("title")} AS n FROM articles))
    WHERE len(regexp_extract_all(t, {WORDS})) >= 15 AND NOT ({norm("t")} = n OR (starts_with({norm("t")}, n) AND length(t) - length(h) < 30))""")
oracle("f18_excerpt", V.ARTICLES, query=f"""SELECT doc_id, CASE WHEN t <> '' AND NOT starts_with({norm("t")}, {norm("title")}) THEN t END AS excerpt FROM (
        SELECT doc_id, title, CASE WHEN length(s) > 10 THEN s ELSE trim(substr(coalesce(body, ''), 1, 240)) END AS t
        FROM (SELECT *, trim(coalesce(CASE WHEN doc_id % 4 = 0 THEN substr(body, 100, 150) END, '')) AS s FROM articles))""")
oracle("j1_enrich", V.SOURCES, V.ARTICLES, query="""SELECT a.id, coalesce(s.name, a.source_id) AS source_name, coalesce(s.category, 'general') AS source_category,
        coalesce(s.allsides_label, 'center') AS source_label, coalesce(s.allsides_score, 0.0) AS source_score,
        coalesce(a.bias_score, s.allsides_score, 0.0) AS shown_score, coalesce(a.confidence, 0.3) AS shown_confidence
    FROM articles a LEFT JOIN sources s ON a.source_id = s.id AND s.active""")
oracle("f20_shown_scores", V.SOURCES, V.ARTICLES, query="""SELECT a.id, round(coalesce(a.bias_score, s.allsides_score, 0.0), 6) AS shown_score, round(coalesce(a.confidence, 0.3), 6) AS shown_confidence,
        round(coalesce(a.sentiment_score, 0.0), 6) AS shown_sentiment, round(coalesce(a.intensity_score, 0.0), 6) AS shown_intensity
    FROM articles a LEFT JOIN sources s ON a.source_id = s.id""")
oracle("s11_lookup", V.ARTICLES, query="SELECT id, source_id, title FROM articles WHERE doc_id = 7")
oracle("a5_has_version", V.FEEDBACK, V.VERSIONS, query="SELECT count(*) > 0 AS has_version FROM versions")
oracle("j2_source_stats", V.SOURCES, query="""SELECT s.id, s.name, f.article_count, f.error_count FROM sources s LEFT JOIN (
        SELECT source, count(*) AS article_count, count(*) FILTER (doc_id % 5 = 0) AS error_count FROM documents WHERE source <> 'src3' GROUP BY 1) f ON f.source = s.id""")
MEMBERS = "SELECT group_id, len(article_ids) AS group_size, unnest(article_ids) AS id, unnest(range(len(article_ids))) AS pos FROM story_groups"
oracle("j4_group_expand", V.ARTICLES, V.GROUPS, query=f"""SELECT group_id, pos, id, title FROM (
        SELECT m.*, a.title, count(*) OVER (PARTITION BY group_id) AS n FROM ({MEMBERS}) m JOIN articles a USING (id) WHERE a.body IS NOT NULL AND a.bias_score IS NOT NULL) WHERE n > 1""")
oracle("j5_containing_group", V.ARTICLES, V.GROUPS, query="""SELECT group_id, a.id, len(article_ids) AS group_size
    FROM story_groups JOIN (SELECT id FROM articles WHERE doc_id = 7) a ON list_contains(article_ids, a.id)""")
oracle("j6_coverage", V.SOURCES, V.ARTICLES, V.GROUPS, query=f"""SELECT group_id, string_agg(DISTINCT name, '|' ORDER BY name) AS sources
    FROM ({MEMBERS}) m JOIN articles a USING (id) JOIN sources s ON s.id = a.source_id AND s.active GROUP BY 1""")
KEYS = ["the", "of", "and", "que", "der", "les"]
oracle("j7_market_signal", V.ARTICLES, V.MARKETS, query=f"""SELECT a.id, s.rank AS signal_rank, s.yes_price, s.yes_change_24h FROM articles a LEFT JOIN (
        SELECT * FROM (SELECT a.id AS article, r.*, row_number() OVER (PARTITION BY a.id ORDER BY abs(r.yes_change_24h) DESC, r.rank) AS best
            FROM articles a JOIN (SELECT *, row_number() OVER (ORDER BY abs(yes_change_24h) DESC, id) AS rank FROM markets QUALIFY rank <= 80) r
            ON abs(r.yes_change_24h) > 0.03 AND len(list_filter({quoted(KEYS)}, lambda k: contains(lower(coalesce(a.title, '')), k) AND contains(lower(coalesce(r.question, '')), k))) > 0)
        WHERE best = 1) s ON s.article = a.id""")
oracle("j8_label_override", V.FEEDBACK, query="SELECT article_key, round(arg_max(user_score, id), 6) AS user_score FROM feedback WHERE dimension = 'bias' GROUP BY 1")
TERMS = "SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(coalesce(title, '')), '[\\p{L}\\p{N}_]+'), lambda w: length(w) > 1)) AS term FROM articles"
oracle("j10_cosine_pairs", V.ARTICLES, query=f"""SELECT a, b, round(cosine, 4) AS cosine FROM (
    WITH counts AS (SELECT doc_id, term, count(*) AS tf FROM ({TERMS}) GROUP BY 1, 2),
    vocab AS (SELECT term, count(*) AS df FROM counts GROUP BY 1 HAVING count(*) >= 2),
    raw AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(DISTINCT doc_id) FROM documents)) / (1 + df)::DOUBLE) + 1) AS w FROM counts JOIN vocab USING (term)),
    unit AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw)
    SELECT x.doc_id AS a, y.doc_id AS b, sum(x.w * y.w) AS cosine FROM unit x JOIN unit y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY 1, 2 HAVING sum(x.w * y.w) > 0.5)""")
oracle("j10_dense_pairs", query="""SELECT a, b, round(cosine, 4) AS cosine FROM (
    WITH coords AS (SELECT vec_id, unnest(embedding)::DOUBLE AS w, unnest(range(len(embedding))) AS k FROM embeddings),
    unit AS (SELECT vec_id, k, w / sqrt(sum(w * w) OVER (PARTITION BY vec_id)) AS w FROM coords)
    SELECT x.vec_id AS a, y.vec_id AS b, sum(x.w * y.w) AS cosine FROM unit x JOIN unit y ON x.k = y.k AND x.vec_id < y.vec_id GROUP BY 1, 2 HAVING sum(x.w * y.w) > 0.5)""")
oracle("j14_related", V.ARTICLES, V.GROUPS, query=f"""
    SELECT 'story' AS kind, id, source_id, title, strftime(published, {TS}) AS published FROM (SELECT * FROM articles WHERE id IN (
        SELECT unnest(article_ids) FROM (SELECT * FROM story_groups WHERE list_contains(article_ids, (SELECT id FROM articles WHERE doc_id = 7)) ORDER BY group_id LIMIT 1))
        AND doc_id <> 7 ORDER BY articles.published DESC NULLS LAST, id LIMIT 6)
    UNION ALL
    SELECT 'source', id, source_id, title, strftime(published, {TS}) FROM (SELECT * FROM articles
        WHERE source_id = (SELECT source_id FROM articles WHERE doc_id = 7) AND doc_id <> 7 ORDER BY articles.published DESC NULLS LAST, id LIMIT 6)""")
oracle("w1_feed_capped", V.SOURCES, V.ARTICLES, query=f"""SELECT row_number() OVER (ORDER BY p.published DESC, p.id) AS pos, p.id, p.source_id, s.name AS source_name, p.title, strftime(p.published, {TS}) AS published
    FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY published DESC NULLS LAST, id) AS rank FROM articles
        WHERE source_id IN {FINANCE} AND published >= TIMESTAMP '2024-01-30 00:00:00') WHERE rank <= 5 ORDER BY published DESC, id LIMIT 20) p JOIN sources s ON s.id = p.source_id""")
oracle("t2_page", V.ARTICLES, query=f"""SELECT row_number() OVER (ORDER BY p DESC NULLS LAST, id) AS pos, id, strftime(p, {TS}) AS published
    FROM (SELECT id, published AS p FROM articles ORDER BY p DESC NULLS LAST, id LIMIT 15 OFFSET 30)""")
oracle("w3_dedupe", V.ARTICLES, query=f"""SELECT first AS pos, id, source_id FROM (
        SELECT *, row_number() OVER (PARTITION BY source_id, k ORDER BY length(coalesce(body, '')) DESC, published DESC NULLS LAST, doc_id) AS best, min(doc_id) OVER (PARTITION BY source_id, k) AS first
        FROM (SELECT *, CASE WHEN {norm("title")} = '' THEN 'id:' || id ELSE 't:' || {norm("title")} END AS k FROM articles)) WHERE best = 1""")
SCORED = f"""SELECT r.*, m.group_id, coalesce(m.group_size, 1) AS group_size,
        round(coalesce(m.group_size, 1) * 3.0::DOUBLE + CASE WHEN h < 3 THEN 3.0 WHEN h < 12 THEN 2.0 WHEN h < 24 THEN 1.0 ELSE 0.3 END
            + CASE WHEN coalesce(m.group_size, 1) = 1 AND source_id IN ('src2', 'src6') THEN 2.0 ELSE 0.0 END + coalesce(intensity_score, 0) * 0.6::DOUBLE, 2) AS score
    FROM (SELECT *, epoch({NOW} - published) / 3600 AS h FROM articles WHERE published >= TIMESTAMP '2024-01-30 00:00:00' ORDER BY published DESC, id LIMIT 500) r
    LEFT JOIN ({MEMBERS}) m USING (id)"""
oracle("w2_top_stories", V.ARTICLES, V.GROUPS, query=f"""SELECT pos, id, group_id, group_size, score, title FROM (
    SELECT *, row_number() OVER (PARTITION BY source_id, k ORDER BY length(coalesce(body, '')) DESC, published DESC, place) AS best, min(place) OVER (PARTITION BY source_id, k) AS pos FROM (
        SELECT *, row_number() OVER (ORDER BY score DESC, published DESC, id) AS place, CASE WHEN {norm("title")} = '' THEN 'id:' || id ELSE 't:' || {norm("title")} END AS k FROM (
            SELECT * FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(group_id, id) ORDER BY score DESC, published DESC, id) AS one FROM ({SCORED})) WHERE one = 1
                ORDER BY score DESC, published DESC, id LIMIT 36)
            WHERE NOT (coalesce(title, '') = '' OR {any_of("' ' || lower(title) || ' '", C.LOW_SIGNAL_TOKENS)}) ORDER BY score DESC, published DESC, id LIMIT 12))) WHERE best = 1""")
LEAN = f"""lean AS (SELECT group_id, count(*) AS outlets, count(*) FILTER (allsides_label IN ('far_left', 'left', 'lean_left')) AS left_n,
        count(*) FILTER (allsides_label = 'center') AS center_n, count(*) FILTER (allsides_label IN ('lean_right', 'right', 'far_right')) AS right_n
    FROM (SELECT DISTINCT group_id, source_id FROM ({MEMBERS}) m JOIN articles a USING (id)) v JOIN sources s ON s.id = v.source_id GROUP BY 1
), spots AS (SELECT *, CASE WHEN outlets >= 4 AND left_n + right_n > 0 THEN CASE WHEN right_n / (left_n + right_n) >= 0.7 THEN 'left' WHEN left_n / (left_n + right_n) >= 0.7 THEN 'right' END END AS direction,
    CASE WHEN outlets >= 4 AND left_n + right_n > 0 THEN CASE WHEN right_n / (left_n + right_n) >= 0.7 THEN right_n / (left_n + right_n) WHEN left_n / (left_n + right_n) >= 0.7 THEN left_n / (left_n + right_n) ELSE 0 END ELSE 0 END AS skew FROM lean)"""
SPOTS = (V.SOURCES, V.ARTICLES, V.GROUPS, LEAN)
oracle("a8_outlet_lean", *SPOTS, query="SELECT group_id, outlets, left_n, center_n, right_n FROM lean")
oracle("d18_blindspot", *SPOTS, query="SELECT group_id, direction, round(skew::DOUBLE, 6) AS skew FROM spots")
oracle("t7_stories_by_skew", *SPOTS, query="SELECT group_id, outlets, round(skew::DOUBLE, 6) AS skew FROM spots WHERE direction = 'left'")
oracle("a20_chip_counts", *SPOTS, query="SELECT count(*) AS total, count(*) FILTER (direction = 'left') AS left_blind, count(*) FILTER (direction = 'right') AS right_blind FROM spots")
oracle("l6_lean_shares", *SPOTS, query="SELECT group_id, round(left_n / outlets, 6) AS left_share, round(center_n / outlets, 6) AS center_share, round(right_n / outlets, 6) AS right_share FROM lean")
oracle("w9_headline", V.ARTICLES, V.GROUPS, query=f"""SELECT group_id, id, title FROM (SELECT m.group_id, m.id, a.title, row_number() OVER (PARTITION BY group_id ORDER BY coalesce(bias_score, 0), pos) AS r, count(*) OVER (PARTITION BY group_id) AS n
    FROM ({MEMBERS}) m JOIN articles a USING (id)) WHERE r = n // 2 + 1""")
CATEGORY = "CASE WHEN " + any_of("lower(q)", C.SKIP_KEYWORDS) + " THEN NULL " + " ".join(f"WHEN {any_of('lower(q)', words)} THEN '{name}'" for name, words in C.CATEGORY_KEYWORDS.items()) + " ELSE 'finance' END"
oracle("d19_signal_normalize", V.RAW_MARKETS, query=f"""SELECT condition_id AS id, q AS question, category, round(yes_price, 4) AS yes_price, yes_change_24h, volume_24h, 'https://polymarket.com/event/' || slug AS url
    FROM (SELECT *, {CATEGORY} AS category FROM (SELECT *, trim(coalesce(question, '')) AS q FROM raw_markets)) WHERE yes_no AND NOT sports AND q <> '' AND category IS NOT NULL AND yes_price IS NOT NULL""")
oracle("d19_categorize", query=f"SELECT item_id, {CATEGORY} AS category FROM (SELECT item_id, text || ['', ' bitcoin', ' ceasefire', ' fed decision', ' senate vote', ' nfl draft'][item_id % 6 + 1] AS q FROM benchmark)")
oracle("f8_binary_market", V.RAW_MARKETS, query="SELECT condition_id AS id, coalesce(yes_no, FALSE) AS is_binary, sports AS is_sports FROM raw_markets")
oracle("f13_active_markets", V.MARKETS, query=f"SELECT id, strftime(end_date, {TS}) AS end_date FROM markets WHERE category = 'view' AND (end_date IS NULL OR end_date >= TIMESTAMP '2024-01-31 00:00:00')")
for _sort, _key in {"movers": "abs(coalesce(yes_change_24h, 0)) DESC", "volume": "coalesce(m.volume_24h, 0) DESC", "expiry": "m.end_date ASC NULLS FIRST"}.items():
    oracle(f"t3_signals_{_sort}", V.MARKETS, query=f"""SELECT id, category, yes_change_24h, round(volume_24h, 6) AS volume_24h, strftime(end_date, {TS}) AS end_date
        FROM (SELECT * FROM markets m WHERE end_date IS NULL OR end_date >= TIMESTAMP '2024-01-15 00:00:00' ORDER BY {_key}, id LIMIT 40)""")
oracle("a1_category_counts", V.MARKETS, query="SELECT category, count(*) AS n FROM markets WHERE category IS NOT NULL GROUP BY 1")
oracle("a2_meta", V.MARKETS, query=f"SELECT count(*) AS total, strftime(max(last_updated), {TS}) AS last_updated FROM markets")
oracle("a4_since_retrain", V.FEEDBACK, V.VERSIONS, query="SELECT count(*) AS pending FROM feedback WHERE created_at > (SELECT max(trained_at) FROM versions) OR NOT EXISTS (FROM versions)")
oracle("a6_latest_version", V.FEEDBACK, V.VERSIONS, query="SELECT version::BIGINT AS version, feedback_count::BIGINT AS feedback_count, accuracy FROM versions ORDER BY version DESC LIMIT 1")
oracle("a7_stats", V.FEEDBACK, V.VERSIONS, query="""SELECT total, pending, version::BIGINT AS version, n_versions, round(least(100.0::DOUBLE, pending / 50 * 100), 6) AS progress FROM (
    SELECT count(*) AS total, count(*) FILTER (created_at > coalesce((SELECT max(trained_at) FROM versions), TIMESTAMP '1900-01-01')) AS pending, (SELECT max(version) FROM versions) AS version, (SELECT count(*) FROM versions) AS n_versions FROM feedback)""")
oracle("a11_sentiment_summary", V.ARTICLES, query="""SELECT *, CASE WHEN avg_sentiment > 0.15 THEN 'Positive' WHEN avg_sentiment < -0.15 THEN 'Negative' ELSE 'Neutral' END AS label FROM (
    SELECT count(sentiment_score) AS n, count(*) FILTER (sentiment_score >= 0.3) AS pos, count(*) FILTER (sentiment_score <= -0.3) AS neg, count(*) FILTER (bias_score <= -0.5) AS left_n,
        count(*) FILTER (bias_score >= 0.5) AS right_n, count(*) FILTER (bias_score > -0.5 AND bias_score < 0.5) AS center_n, round(avg(sentiment_score), 6) AS avg_sentiment, round(avg(bias_score), 6) AS avg_bias FROM articles)""")

TEXTS = f"""texts AS (SELECT doc_id, source_id, bias_score, coalesce(title, '') || ' ' || coalesce(body, '') AS t FROM articles
), tokens AS (SELECT *, regexp_extract_all(lower(t), {WORDS}) AS w, greatest(len(regexp_extract_all(t, '[.!?]')), 1)::DOUBLE AS marks, len(regexp_extract_all(t, '!'))::DOUBLE AS bangs,
    len(regexp_extract_all(t, '\\?'))::DOUBLE AS asks, len(list_filter(regexp_extract_all(t, {WORDS}), lambda x: regexp_full_match(x, '[A-Z]{{3,}}')))::DOUBLE AS caps FROM texts
), sized AS (SELECT *, greatest(len(w), 1)::DOUBLE AS n FROM tokens)"""


def share(words: list[str]) -> str:
    return f"len(list_filter(w, lambda x: list_contains({quoted(words)}, x))) / n"


#: The derived lexicon: its words with their digests, the words of each category, and each article's hits.
CATEGORIES = ["positive", "negative", *C.EMOTIONS, "loaded_language"]
HITS = """used AS (SELECT w, count(*) AS k FROM (SELECT unnest(w) AS w FROM tokens) GROUP BY 1 ORDER BY k DESC, w LIMIT 50000
), digests AS (SELECT w, sha256(w) AS s FROM used
), members AS (SELECT DISTINCT w, category FROM (
    SELECT w, """ + quoted(CATEGORIES) + """[strpos('0123456789abcdef', substr(s, 2, 1))] AS category FROM digests WHERE s < '3'
    UNION ALL SELECT w, CASE WHEN substr(s, 3, 1) < '4' THEN 'positive' WHEN substr(s, 3, 1) < '8' THEN 'negative' END FROM digests WHERE s < '3') WHERE category IS NOT NULL
), hits AS (SELECT doc_id, """ + ", ".join(f"count(*) FILTER (category = '{c}') AS h_{c}" for c in CATEGORIES) + """ FROM (SELECT doc_id, unnest(w) AS w FROM tokens) JOIN members USING (w) GROUP BY 1
), scored AS (SELECT sized.*, """ + ", ".join(f"coalesce(h_{c}, 0)::DOUBLE AS {c}" for c in CATEGORIES) + """ FROM sized LEFT JOIN hits USING (doc_id))"""
FEATURES = (V.ARTICLES, TEXTS, HITS)
INTENSITY = "0.30::DOUBLE * anger / n + 0.20::DOUBLE * fear / n + 0.20::DOUBLE * disgust / n + 0.15::DOUBLE * caps / n + 0.15::DOUBLE * bangs / marks"
POLARITY = "(positive - negative) / (positive + negative + 1.0::DOUBLE)"
oracle("s9_lexicon", *FEATURES, query="SELECT category, count(*) AS n, min(w) AS first, max(w) AS last FROM members GROUP BY 1")
oracle("a10_lexicon_density", *FEATURES, query="SELECT doc_id, " + ", ".join(f"round({c} / n, 6) AS {c}" for c in CATEGORIES) + " FROM scored")
oracle("d5_linguistic", V.SOURCES, *FEATURES, query=f"""SELECT doc_id, round(allsides_score / 5, 6) AS source_prior, round(negative / n, 6) AS emotional, round({share(C.HEDGING_WORDS)}, 6) AS hedging,
    round(coalesce(list_sum(list_transform(regexp_extract_all(t, '"[^"]{{10,}}"'), lambda q: length(q))), 0) / greatest(length(t), 1), 6) AS quoted, round(bangs / marks, 6) AS exclaim FROM scored JOIN sources ON sources.id = source_id""")
oracle("d7_sentiment_vec", *FEATURES, query="SELECT doc_id, " + ", ".join(f"round({c} / n, 6) AS {c}" for c in CATEGORIES[:-1])
       + ", round(caps / n, 6) AS caps, round(bangs / marks, 6) AS exclaim, round(asks / marks, 6) AS question, round(loaded_language / n * 100, 6) AS loaded FROM scored")
oracle("d8_emotions", *FEATURES, query="SELECT doc_id, " + ", ".join(f"round(least(1.0::DOUBLE, {c} / n * 100), 6) AS {c}" for c in C.EMOTIONS) + " FROM scored")
oracle("d9_bootstrap", *FEATURES, query=f"SELECT doc_id, round({POLARITY}, 6) AS polarity, round({INTENSITY}, 6) AS intensity FROM scored")
oracle("d10_classes", *FEATURES, query=f"""SELECT doc_id, (CASE WHEN p < -0.15 THEN 0 WHEN p > 0.15 THEN 2 ELSE 1 END)::BIGINT AS polarity_class, (CASE WHEN i <= 0.02 THEN 0 WHEN i > 0.03 THEN 2 ELSE 1 END)::BIGINT AS intensity_class,
    (CASE WHEN bias_score < -4 THEN 0 WHEN bias_score < -2 THEN 1 WHEN bias_score < 2 THEN 2 WHEN bias_score < 4 THEN 3 ELSE 4 END)::BIGINT AS bias_class FROM (SELECT doc_id, bias_score, {POLARITY} AS p, round({INTENSITY}, 6) AS i FROM scored)""")
oracle("d11_fallback", *FEATURES, query=f"SELECT doc_id, round(least(1.0::DOUBLE, i / 0.03::DOUBLE), 3) AS intensity FROM (SELECT doc_id, round({INTENSITY}, 6) AS i FROM scored)")
oracle("a22_percentiles", query="SELECT event_type, round(quantile_cont(value, 0.33) FILTER (value > 0), 4) AS p33, round(quantile_cont(value, 0.66) FILTER (value > 0), 4) AS p66 FROM events GROUP BY 1")
oracle("d2_norm_title", V.ARTICLES, query=f"SELECT doc_id, {norm('title')} AS title_key FROM articles")
oracle("d3_ids", V.ARTICLES, query="SELECT doc_id, substr(sha256(source_id || ':' || url), 1, 16) AS article_id FROM articles")
oracle("d4_words", V.ARTICLES, query=f"SELECT doc_id, greatest(1, len(regexp_extract_all(lower(coalesce(body, '')), {WORDS})))::BIGINT AS n_words FROM articles")
oracle("d6_tfidf", V.ARTICLES, query="""SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 4) AS w FROM (
    WITH words AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(title, '')), '[\\p{L}\\p{N}_]+'), lambda x: length(x) > 1) AS ws FROM articles),
    grams AS (SELECT doc_id, unnest(ws) AS term FROM words UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM words),
    counts AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY 1, 2), vocab AS (SELECT term, count(*) AS df FROM counts GROUP BY 1 HAVING count(*) >= 2)
    SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1) AS w FROM counts JOIN vocab USING (term))""")
MARKED = "regexp_replace(" + space("body") + """, '([.!?])\\s+([A-Z"''])', '\\1' || chr(1) || '\\2', 'g')"""
oracle("d22_sentences", V.ARTICLES, query=f"""SELECT doc_id, len(list_filter(string_split({MARKED}, chr(1)), lambda s: len(regexp_extract_all(s, {WORDS})) >= 4))::BIGINT AS n_sentences FROM articles""")
oracle("d23_truncate", V.ARTICLES, query=f"""SELECT doc_id, CASE WHEN len(p) <= 12 THEN b ELSE regexp_replace(array_to_string(p[1:12], ' '), '[,;:]+$', '') || '…' END AS short
    FROM (SELECT doc_id, b, {PARTS.format("b")} AS p FROM (SELECT doc_id, {space("body")} AS b FROM articles))""")
oracle("d25_reading_time", V.ARTICLES, query=f"""SELECT doc_id, greatest(1, floor(len({PARTS.format("coalesce(body, '')")}) / 230 + 0.5))::BIGINT AS minutes,
    len(list_filter(regexp_split_to_array(coalesce(body, ''), '\\n+'), lambda p: trim(p) <> ''))::BIGINT AS n_paragraphs FROM articles""")

oracle("s12_insert_if_absent", V.ARTICLES, query="SELECT id, CASE WHEN sentiment_score IS NOT NULL THEN title ELSE 'new ' || title END AS title FROM articles")
oracle("s13_upsert_latest", V.FEEDBACK, query="""SELECT first_id AS id, article_key, feedback_type, dimension, round(user_score, 6) AS user_score FROM (
    SELECT *, row_number() OVER (PARTITION BY article_key, feedback_type, dimension ORDER BY batch DESC, created_at DESC, id DESC) AS r,
        coalesce(min(id) FILTER (batch = 0) OVER (PARTITION BY article_key, feedback_type, dimension), min(id) OVER (PARTITION BY article_key, feedback_type, dimension)) AS first_id
    FROM (SELECT *, CASE WHEN turn < 2 THEN 0 ELSE 1 END AS batch FROM feedback)) WHERE r = 1""")
oracle("s14_upsert_accumulate", query="SELECT source AS source_id, count(*) AS article_count, sum(doc_id % 3)::BIGINT AS error_count, max(doc_id) AS last_fetched FROM documents GROUP BY 1")
oracle("s15_partial_update", V.ARTICLES, query="SELECT id, CASE WHEN intensity_score = 0 THEN 1.5 ELSE bias_score END AS bias_score, CASE WHEN sentiment_score IS NULL THEN 'old' END AS summary FROM articles")
oracle("s16_full_replace", V.GROUPS, query="SELECT group_id, array_to_string(article_ids, ',') AS article_ids FROM story_groups")
oracle("s17_append_version", V.FEEDBACK, V.VERSIONS, query="SELECT version::BIGINT AS version, feedback_count::BIGINT AS feedback_count FROM versions UNION ALL SELECT (SELECT coalesce(max(version), 0) + 1 FROM versions), count(*) FROM feedback")
oracle("s18_orphan_cleanup", V.SOURCES, V.ARTICLES, query="SELECT a.id, a.source_id FROM articles a JOIN sources s ON s.id = a.source_id AND s.active")
oracle("s19_prune", V.MARKETS, query="SELECT id, category FROM markets WHERE last_updated >= TIMESTAMP '2024-01-29 00:00:00'")
oracle("s20_schema_evolution", V.FEEDBACK, query="SELECT id, feedback_type, 'bias' AS dimension, NULL::VARCHAR AS note FROM feedback")

PERF = """perf AS (SELECT symbol, count(*) AS n, arg_min(c, t) AS first_c, arg_max(c, t) AS last_c, max(coalesce(h, c)) AS high, min(coalesce(l, c)) AS low FROM ohlc WHERE c IS NOT NULL GROUP BY 1)"""
oracle("a12_range_perf", V.OHLC, PERF, query="""SELECT symbol, n, round(first_c, 6) AS first_c, round(last_c, 6) AS last_c, round(high, 6) AS high, round(low, 6) AS low, round(last_c - first_c, 6) AS change,
    round((last_c - first_c) / nullif(first_c, 0) * 100, 6) AS pct FROM perf""")
oracle("a13_quote_change", V.OHLC, query="""SELECT symbol, t::VARCHAR AS t, round(p, 6) AS previous_close, round(c - p, 6) AS change, round((c - p) / p * 100, 6) AS change_pct
    FROM (SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY t) AS p FROM ohlc WHERE c IS NOT NULL)""")
LAST = "last40 AS (SELECT symbol, t, c, 41 - back - greatest(0, 40 - n) AS pos FROM (SELECT symbol, t, c, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS back, count(*) OVER (PARTITION BY symbol) AS n FROM ohlc WHERE c IS NOT NULL) WHERE back <= 40)"
oracle("a14_last40", V.OHLC, LAST, query="SELECT symbol, pos::BIGINT AS pos, t::VARCHAR AS t, round(c, 6) AS c FROM last40")
oracle("m6_sparkline", V.OHLC, LAST, query="""SELECT symbol, pos::BIGINT AS pos, round((c - min(c) OVER w) / coalesce(nullif(max(c) OVER w - min(c) OVER w, 0), 1), 6) AS y FROM last40 WINDOW w AS (PARTITION BY symbol)""")
oracle("m4_baseline", V.OHLC, PERF, query="""SELECT symbol, CASE WHEN last_c > first_c THEN 'up' WHEN last_c < first_c THEN 'down' ELSE 'flat' END AS direction, round(first_c, 6) AS baseline,
    round(lo - m, 6) AS low_edge, round((lo + hi) / 2, 6) AS mid, round(hi + m, 6) AS high_edge FROM (SELECT *, coalesce(nullif(hi - lo, 0), 1) * 0.06::DOUBLE AS m FROM (SELECT *, least(low, first_c) AS lo, greatest(high, first_c) AS hi FROM perf))""")
oracle("j12_ohlc_zip", V.OHLC, query="""SELECT symbol, t::VARCHAR AS t, round(c, 6) AS c, CASE WHEN i <= 80 THEN v::DOUBLE END AS v
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM ohlc) WHERE c IS NOT NULL""")
oracle("m1_compact_quote", V.OHLC, query="""SELECT symbol, 'Name ' || symbol AS name, round(p, 6) AS price, round(q, 6) AS previous_close, round(p - q, 6) AS change, round((p - q) / q * 100, 6) AS change_pct, least(40, n)::BIGINT AS n_spark
    FROM (SELECT symbol, max(h) AS p, min(l) AS q, count(c) AS n FROM ohlc GROUP BY 1)""")
oracle("m3_buckets", V.QUOTES, query="SELECT bucket, count(*) AS n, count(price) AS n_quotes FROM (SELECT * FROM (VALUES " + ", ".join(f"('{b}', '{x}')" for b, listed in C.BUCKETS.items() for x in listed)
       + ") t(bucket, symbol) UNION ALL SELECT 'trending', symbol FROM trends) LEFT JOIN quotes USING (symbol) GROUP BY 1")
oracle("s6_trending", V.QUOTES, query="SELECT pos, symbol, round(price, 6) AS price, trades FROM trends JOIN quotes USING (symbol)")
oracle("m5_formats", query="""SELECT event_id, CASE WHEN v >= 1e9 THEN printf('%.2fB', v / 1e9) WHEN v >= 1e6 THEN printf('%.2fM', v / 1e6) WHEN v >= 1e3 THEN printf('%.1fK', v / 1e3) ELSE printf('%.0f', v) END AS volume,
    CASE WHEN p >= 0 THEN '+' ELSE '' END || printf('%.2f', p) || '%' AS pct FROM (SELECT event_id, (n * n)::DOUBLE AS v, (n % 2000 - 1000) / 7.0::DOUBLE AS p FROM (SELECT event_id, event_id * 7919 % 100000 AS n FROM events))""")
oracle("m7_time_ago", V.ARTICLES, query=f"""SELECT doc_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60)::BIGINT || 'm ago' WHEN s < 86400 THEN (s // 3600)::BIGINT || 'h ago' WHEN s IS NOT NULL THEN (s // 86400)::BIGINT || 'd ago' END AS ago
    FROM (SELECT doc_id, epoch({NOW})::BIGINT - epoch(published)::BIGINT AS s FROM articles)""")
oracle("l1_bias_label", V.ARTICLES, query="""SELECT doc_id, CASE WHEN b <= -3.5 THEN 'Far left' WHEN b <= -1 THEN 'Left' WHEN b <= 1 THEN 'Center' WHEN b <= 3.5 THEN 'Right' WHEN b IS NOT NULL THEN 'Far right' END AS bias_label,
    round(CASE WHEN b IS NULL THEN 100.0 ELSE greatest(0.0, least(100.0, (b + 5) / 10 * 100)) END, 6) AS gauge FROM (SELECT doc_id, bias_score AS b FROM articles)""")
oracle("l2_tone", V.ARTICLES, query="""SELECT doc_id, CASE WHEN s IS NULL OR i IS NULL THEN NULL WHEN i >= 0.66 THEN 'Charged' WHEN i >= 0.4 THEN 'Heated' WHEN s >= 0.3 THEN 'Positive' WHEN s <= -0.3 THEN 'Negative' ELSE 'Neutral' END AS tone,
    CASE WHEN s >= 0.3 THEN 'green' WHEN s <= -0.3 THEN 'red' ELSE 'gray' END AS polarity_color, CASE WHEN i >= 0.66 THEN 'red' WHEN i >= 0.33 THEN 'amber' ELSE 'green' END AS intensity_color
    FROM (SELECT doc_id, sentiment_score AS s, intensity_score * 0.5 AS i FROM articles)""")
oracle("d26_feedback_submit", V.FEEDBACK, query="SELECT id, round(CASE WHEN feedback_type = 'thumbs_up' THEN 0.5 ELSE user_score END, 6) AS score FROM feedback")

WMO = "CASE code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in C.WMO_LABELS.items()) + " ELSE 'Unknown' END"
PHRASE = """CASE WHEN {0} IN (55, 65, 67, 75, 82, 86, 99) THEN 'heavy ' WHEN {0} IN (51, 61, 71, 80, 85, 95) THEN 'light ' ELSE '' END
    || CASE WHEN {0} >= 95 THEN 'thunderstorms' WHEN {0} BETWEEN 71 AND 77 OR {0} IN (85, 86) THEN 'snow' WHEN {0} BETWEEN 80 AND 82 THEN 'showers' WHEN {0} BETWEEN 51 AND 57 THEN 'drizzle' ELSE 'rain' END"""
WET = "({0} BETWEEN 51 AND 67 OR {0} BETWEEN 71 AND 77 OR {0} BETWEEN 80 AND 86 OR {0} BETWEEN 95 AND 99)"
oracle("e1_wmo", V.WEATHER, query=f"""SELECT strftime(time, {TS}) AS time, {WMO} AS label, CASE WHEN code >= 95 THEN 'thunder' WHEN code BETWEEN 71 AND 77 OR code IN (85, 86) THEN 'snow' WHEN code BETWEEN 51 AND 67 OR code BETWEEN 80 AND 82 THEN 'rain'
    WHEN code IN (45, 48) THEN 'fog' ELSE CASE WHEN code IN (1, 2, 3) THEN 'cloudy-' ELSE 'clear-' END || CASE WHEN is_day THEN 'day' ELSE 'night' END END AS kind,
    ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][floor(wind_direction / 45 + 0.5)::INT % 8 + 1] AS wind, {WET.format("code")} AS wet, {PHRASE.format("code")} AS phrase FROM weather""")
oracle("e4_moon", query="""SELECT day::VARCHAR AS day, round(p, 6) AS phase, floor(50 * (1 - cos(2 * pi() * p)) + 0.5)::BIGINT AS illumination,
    CASE WHEN p < 0.03 OR p > 0.97 THEN 'New Moon' WHEN p < 0.22 THEN 'Waxing Crescent' WHEN p < 0.28 THEN 'First Quarter' WHEN p < 0.47 THEN 'Waxing Gibbous' WHEN p < 0.53 THEN 'Full Moon'
        WHEN p < 0.72 THEN 'Waning Gibbous' WHEN p < 0.78 THEN 'Last Quarter' ELSE 'Waning Crescent' END AS name
    FROM (SELECT day, CASE WHEN a < 0 THEN a + 30 ELSE a END / 29.53::DOUBLE AS p FROM (SELECT day, floor(r * 11 % 30 + month(day) + day(day) + CASE WHEN month(day) < 3 THEN 2 ELSE 0 END - CASE WHEN year(day) < 2000 THEN 4.0::DOUBLE ELSE 8.3::DOUBLE END + 0.5) % 30 AS a
        FROM (SELECT day, CASE WHEN year(day) % 100 % 19 > 9 THEN year(day) % 100 % 19 - 19 ELSE year(day) % 100 % 19 END AS r FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders))))""")


def steps(value: str, edges: list[tuple[float, str]], above: str, test: str = "<") -> str:
    return "CASE " + " ".join(f"WHEN {value} {test} {e} THEN '{label}'" for e, label in edges) + f" ELSE '{above}' END"


oracle("e5_bands", V.WEATHER, query=f"""SELECT strftime(time, {TS}) AS time, {steps("s % 400", [(50, "Good"), (100, "Moderate"), (150, "Unhealthy for sensitive"), (200, "Unhealthy"), (300, "Very unhealthy")], "Hazardous", "<=")} AS aqi,
    {steps("dew_point", [(55, "Dry"), (60, "Comfortable"), (65, "Sticky"), (70, "Muggy"), (75, "Oppressive")], "Miserable")} AS dew, {steps("uv", [(3, "Low"), (6, "Moderate"), (8, "High"), (11, "Very high")], "Extreme")} AS uv_band,
    {steps("cover", [(12, "Clear"), (38, "Mostly clear"), (62, "Partly cloudy"), (88, "Mostly cloudy")], "Overcast", "<=")} AS cloud, round(visibility / 1609.34, 6) AS miles,
    {steps("visibility / 1609.34", [(0.25, "Dense fog"), (1, "Poor"), (3, "Moderate"), (6, "Good")], "Excellent")} AS seen, {steps("cover", [(5, "Low"), (20, "Moderate"), (50, "High")], "Very high")} AS pollen FROM weather""")
BREAKS = "breaks(pollutant, low, high, low_aqi, high_aqi) AS (VALUES " + ", ".join(
    f"('{p}', {lo}::DOUBLE, {hi}::DOUBLE, {la}::DOUBLE, {ha}::DOUBLE)" for p, e in C.POLLUTANT_EDGES.items() for lo, hi, la, ha in zip([0, *e], e, [0, *C.AQI_EDGES], C.AQI_EDGES, strict=False)) + ")"
READINGS = """readings AS (SELECT r.*, coalesce((SELECT min_by(low_aqi + (r.value - low) / (high - low) * (high_aqi - low_aqi), high) FROM breaks b WHERE b.pollutant = r.pollutant AND r.value <= b.high), 500.0) AS subindex FROM pollutants r WHERE value IS NOT NULL)"""
oracle("e6_subindex", V.POLLUTANTS, BREAKS, READINGS, query=f"""SELECT reading_id, pollutant, round(subindex, 6) AS subindex, round(least(2.0, subindex / 100), 7) AS fraction,
    {steps("subindex", [(50, "Good"), (100, "Moderate"), (150, "USG"), (200, "Unhealthy"), (300, "Very unhealthy")], "Hazardous", "<=")} AS band FROM readings""")
oracle("a19_aqi_driver", V.POLLUTANTS, BREAKS, READINGS, query=f"""SELECT strftime(hour, {TS}) AS hour, pollutant AS driver, round(subindex, 4) AS subindex FROM (
    SELECT date_trunc('hour', ts) AS hour, pollutant, max(subindex) AS subindex FROM readings GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY hour ORDER BY subindex DESC, list_position({quoted(list(C.POLLUTANT_EDGES))}, pollutant)) = 1""")
oracle("a18_pollen_top", query="SELECT event_type AS species, round(max(value), 4) AS peak FROM events GROUP BY 1 HAVING max(value) > 1 ORDER BY max(value) DESC, 1 LIMIT 4")
oracle("w5_pressure_trend", V.WEATHER, query=f"""SELECT strftime(time, {TS}) AS time, change, CASE WHEN change >= 2 THEN 'Rising fast' WHEN change >= 0.5 THEN 'Rising' WHEN change <= -2 THEN 'Falling fast' WHEN change <= -0.5 THEN 'Falling' WHEN change IS NOT NULL THEN 'Steady' END AS trend
    FROM (SELECT time, pressure - lag(pressure, 3) OVER (PARTITION BY time::DATE ORDER BY time) AS change FROM weather)""")
RUNS = """runs AS (SELECT day, min(time) AS started, max(time) AS ended, count(*) AS n, epoch(max(time))::BIGINT - epoch(min(time))::BIGINT AS seconds FROM (
    SELECT day, time, i - row_number() OVER (PARTITION BY day ORDER BY i) AS island FROM (SELECT time::DATE AS day, time, is_day, row_number() OVER (PARTITION BY time::DATE ORDER BY time) AS i FROM weather) WHERE is_day) GROUP BY day, island)"""
oracle("w6_day_runs", V.WEATHER, RUNS, query=f"""SELECT day::VARCHAR AS day, strftime(started, {TS}) AS started, strftime(ended, {TS}) AS ended, n, seconds, lead(seconds) OVER (PARTITION BY date_trunc('month', day) ORDER BY runs.day, runs.started) - seconds AS trend,
    round(greatest(0.0, least(1.0, (epoch(runs.day::TIMESTAMP) + 43200 - epoch(runs.started)) / nullif(seconds, 0))), 6) AS sun_fraction FROM runs""")
AHEAD = "ahead AS (SELECT *, row_number() OVER (ORDER BY time) - 1 AS pos FROM weather WHERE time >= TIMESTAMP '2024-01-20 10:30:00' ORDER BY time LIMIT {0})"
oracle("w7_next24", V.WEATHER, AHEAD.format(24), query=f"SELECT pos, strftime(time, {TS}) AS time, round(temperature, 4) AS temperature FROM ahead")
SPOKEN = "CASE WHEN {0} <= 1 THEN 'about an hour' WHEN {0} <= 2 THEN 'a couple of hours' WHEN {0} <= 4 THEN {0} || ' hours' WHEN {0} <= 7 THEN 'a few hours' WHEN {0} <= 12 THEN 'the rest of the morning' ELSE {0} || ' hours' END"
oracle("w8_nowcast", V.WEATHER, AHEAD.format(12), query=f"""SELECT code::BIGINT AS code, rain AS rain_now, chg AS change_at, CASE WHEN rain THEN upper(substr(fall, 1, 1)) || substr(fall, 2) ||
        CASE WHEN chg IS NULL THEN ' through the next ' || {SPOKEN.format("(n - 1)")} || '.' WHEN chg = 1 THEN ', easing in about an hour.' ELSE ' for about ' || {SPOKEN.format("chg")} || ', then easing.' END
    ELSE sky || CASE WHEN chg IS NULL THEN ' for the next ' || {SPOKEN.format("(n - 1)")} || '.' WHEN chg <= 1 THEN ' now, ' || come || ' starting within the hour.' WHEN chg <= 3 THEN ' for the next ' || {SPOKEN.format("chg")} || ', then ' || come || '.'
        ELSE ' for a few hours, then ' || come || ' by ' || CASE WHEN next_hour < 5 THEN 'overnight' WHEN next_hour < 12 THEN 'morning' WHEN next_hour < 17 THEN 'afternoon' WHEN next_hour < 21 THEN 'evening' ELSE 'overnight' END || '.' END END AS sentence
    FROM (SELECT *, CASE WHEN rain THEN stop_at ELSE start_at END AS chg, {PHRASE.format("code")} AS fall, {PHRASE.format("next_code")} AS come, CASE WHEN code IN (2, 3, 45, 48) THEN 'Cloudy' WHEN code <= 3 THEN 'Clear' ELSE 'Calm' END AS sky
        FROM (SELECT *, {WET.format("code")} OR prob >= 50 AS rain FROM (
            SELECT max(code) FILTER (pos = 0) AS code, max(precip_prob) FILTER (pos = 0) AS prob, count(*) AS n, min(pos) FILTER (pos > 0 AND NOT {WET.format("code")} AND precip_prob < 30 AND precip < 0.005) AS stop_at,
                min(pos) FILTER (pos > 0 AND wet) AS start_at, arg_min(code, pos) FILTER (pos > 0 AND wet) AS next_code, arg_min(hour(time), pos) FILTER (pos > 0 AND wet) AS next_hour
            FROM (SELECT *, {WET.format("code")} OR (precip_prob >= 50 AND precip >= 0.005) AS wet FROM ahead))))""")
DAYS = """days AS (SELECT time::DATE AS day, max(temperature) AS hottest, min(temperature) AS coldest, count(*) FILTER (is_day AND cover <= 25) AS sun_hours, max(precip_prob) AS wet, max(gust) AS gust, max(uv) AS uv FROM weather GROUP BY 1)"""
oracle("a15_week_extremes", V.WEATHER, DAYS, query="SELECT day::VARCHAR AS day, round(hottest, 4) AS hottest, round(coldest, 4) AS coldest, round(hottest - coldest, 4) AS spread, sun_hours FROM days")
oracle("e15_day_tags", V.WEATHER, DAYS, query="""SELECT day::VARCHAR AS day, CASE WHEN i = 1 THEN NULL WHEN hottest = hot THEN 'warmest' WHEN coldest = cold THEN 'coldest' WHEN wet >= 70 THEN 'wet' END AS tag,
    round((coldest - cold) / coalesce(nullif(hot - cold, 0), 1), 3) AS bar_left, round((hottest - coldest) / coalesce(nullif(hot - cold, 0), 1), 3) AS bar_width
    FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('week', day) ORDER BY day) AS i, max(hottest) OVER (PARTITION BY date_trunc('week', day)) AS hot, min(coldest) OVER (PARTITION BY date_trunc('week', day)) AS cold FROM days)""")
oracle("a16_peaks", V.WEATHER, query=f"""SELECT day::VARCHAR AS day, strftime(d, {TS}) AS dew_peak, CASE WHEN u > 0 THEN strftime(uv_time, {TS}) END AS uv_peak, strftime(v, {TS}) AS visibility_low FROM (
    SELECT time::DATE AS day, arg_max(time, (dew_point, -epoch(time))) AS d, max(uv) AS u, arg_max(time, (uv, -epoch(time))) AS uv_time, arg_min(time, (visibility, epoch(time))) AS v FROM weather GROUP BY 1)""")
oracle("e16_day_strips", V.WEATHER, DAYS, query=f"""SELECT day::VARCHAR AS day, strftime(days.day, '%a') AS weekday, gust, uv, {steps("uv", [(3, "Low"), (6, "Moderate"), (8, "High"), (11, "Very high")], "Extreme")} AS uv_band, sun_hours, (ceil(gust / 5) * 5)::BIGINT AS gust_axis FROM days""")
oracle("e18_chart_extents", V.WEATHER, query="""SELECT day, CASE WHEN n > 1 THEN dl END AS dew_low, CASE WHEN n > 1 THEN greatest(10.0, dh - dl) END AS dew_range,
    CASE WHEN n > 1 THEN round(pl, 6) END AS pressure_low, CASE WHEN n > 1 THEN round(ph - pl, 6) END AS pressure_range FROM (
    SELECT day, n, greatest(20.0, floor((d0 - 4) / 5) * 5)::DOUBLE AS dl, least(85.0, ceil((d1 + 4) / 5) * 5)::DOUBLE AS dh, least(p0 - pad, 1012.25) AS pl, greatest(p1 + pad, 1014.25) AS ph FROM (
        SELECT time::DATE::VARCHAR AS day, count(*) AS n, min(dew_point) AS d0, max(dew_point) AS d1, min(pressure) AS p0, max(pressure) AS p1,
            greatest(1.0, (max(pressure) - min(pressure)) / 4)::DOUBLE AS pad FROM weather GROUP BY 1))""")
oracle("s4_market_source", V.RAW_MARKETS, query="""SELECT condition_id, condition_id::BIGINT % 40 AS poll, round(volume_24h, 6) AS volume FROM (
    SELECT *, row_number() OVER (PARTITION BY condition_id::BIGINT % 40 ORDER BY volume_24h DESC NULLS LAST, condition_id) AS rank FROM raw_markets) WHERE rank <= 200""")
oracle("s5_weather_payload", V.WEATHER, query=f"""SELECT time::DATE::VARCHAR AS place, row_number() OVER (PARTITION BY time::DATE ORDER BY weather.time) - 1 AS pos, strftime(weather.time, {TS}) AS time,
    round(temperature, 4) AS temperature, code::BIGINT AS code, CASE WHEN day(weather.time) % 5 <> 0 THEN (s % 300)::DOUBLE END AS aqi FROM weather""")
oracle("s7_chart_requests", V.QUOTES, query="SELECT symbol, t.* FROM quotes, (VALUES " + ", ".join(f"('{v}', '{r}', '{i}')" for v, (r, i) in C.CHART_RANGES.items()) + ") t(view, range, interval)")
oracle("d20_symbol_keywords", V.QUOTES, query="SELECT symbol, CASE symbol " + " ".join(f"WHEN '{s}' THEN '{'|'.join(k)}'" for s, k in C.SYMBOL_KEYWORDS.items())
       + " ELSE ltrim(split_part(symbol, '=', 1), '^') END AS keywords FROM quotes")
oracle("f19_nested", V.SOURCES, V.ARTICLES, query="""SELECT a.id, coalesce(s.name, a.source_id) AS source_name, coalesce(s.allsides_label, 'center') AS label,
    CASE WHEN doc_id % 7 <> 0 THEN round((doc_id % 10)::DOUBLE / 10, 6) END AS anger FROM articles a LEFT JOIN sources s ON s.id = a.source_id AND s.active""")
oracle("a3_counts", V.ARTICLES, query="SELECT source_id, count(*) AS total, count(published) AS dated, count(*) FILTER (title <> '') AS titled FROM articles GROUP BY 1")
oracle("a9_group_sizes", V.ARTICLES, V.GROUPS, query=f"SELECT group_id, count(*) AS n, count(DISTINCT source_id) AS outlets FROM ({MEMBERS}) m JOIN articles a USING (id) GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT source_id) >= 2")
oracle("j3_article_groups", V.ARTICLES, V.GROUPS, query=f"SELECT a.id, m.group_id, m.group_size FROM articles a LEFT JOIN ({MEMBERS}) m ON m.id = a.id")
oracle("w4_one_vote", V.ARTICLES, V.GROUPS, query=f"SELECT group_id, source_id, arg_min(m.id, pos) AS id FROM ({MEMBERS}) m JOIN articles a ON a.id = m.id GROUP BY 1, 2")
oracle("t9_home_slots", query="SELECT unnest(list_filter([CASE WHEN pos <= 6 THEN 'carousel' END, CASE WHEN pos = 1 THEN 'hero' END, CASE WHEN pos BETWEEN 2 AND 5 THEN 'secondary' END, CASE WHEN pos >= 6 THEN 'trending' END], lambda x: x IS NOT NULL)) AS slot, pos, id FROM ("
       + ORACLES["q_w2_top_stories"] + ")")
oracle("t10_version_history", V.FEEDBACK, V.VERSIONS, query=f"SELECT version::BIGINT AS version, strftime(trained_at, {TS}) AS trained_at, accuracy FROM versions")
oracle("e17_day_labels", V.WEATHER, query="SELECT day::VARCHAR AS day, CASE date_diff('day', DATE '2024-01-20', day) WHEN 0 THEN 'Today' WHEN 1 THEN 'Tomorrow' ELSE strftime(day, '%a') END AS label FROM (SELECT DISTINCT time::DATE AS day FROM weather)")

oracle("s14_source_counters", V.ARTICLES, query=f"""SELECT source_id, count(*) AS fetch_count, coalesce(sum(n) FILTER (block % 7 <> 3), 0)::BIGINT AS article_count, count(*) FILTER (block % 7 = 3) AS error_count,
    strftime(max(TIMESTAMP '2024-01-31 00:00:00' + to_seconds(block)), {TS}) AS last_fetched, count(*) FILTER (block % 7 = 3) AS quarantined
    FROM (SELECT source_id, doc_id // 96 AS block, least(count(*), 30) AS n FROM articles WHERE source_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
oracle("s12_keyed_store", V.ARTICLES, query="""SELECT id, source_id, CASE WHEN doc_id % 3 = 2 THEN 'new ' || title ELSE title END AS title, CASE WHEN doc_id % 5 = 0 THEN 4.5 ELSE bias_score END AS bias_score FROM articles""")
