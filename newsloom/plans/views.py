"""The derived tables again, as DuckDB common table expressions for the oracles."""

from newsloom.functions.constants import BUCKETS

SOURCES = """sources AS (
    SELECT source AS id, 'Outlet ' || n AS name, n % 10 <> 9 AS active,
        ['finance', 'geopolitics', 'science', 'news'][n % 4 + 1] AS category,
        ['far_left', 'left', 'lean_left', 'center', 'lean_right', 'right', 'far_right'][n % 7 + 1] AS allsides_label,
        (n % 7 - 3)::DOUBLE AS allsides_score
    FROM (SELECT DISTINCT source, substr(source, 4)::INT AS n FROM documents WHERE source IS NOT NULL)
)"""
ARTICLES = """articles AS (
    SELECT d.doc_id, substr(sha256(source || ':' || d.doc_id), 1, 16) AS id, source AS source_id,
        substr(split_part(text, chr(10), 1), 1, 80) AS title,
        CASE WHEN d.doc_id % 53 <> 0 THEN text END AS body, 'https://news.example/a/' || d.doc_id AS url,
        CASE WHEN d.doc_id % 29 <> 0 THEN TIMESTAMP '2024-01-31 00:00:00' - to_hours((d.doc_id * 37 % 96)::INT) END AS published,
        CASE WHEN d.doc_id % 7 <> 0 THEN (d.doc_id % 101)::DOUBLE / 10 - 5 END AS bias_score,
        CASE WHEN d.doc_id % 7 <> 0 THEN (d.doc_id % 10)::DOUBLE / 10 END AS confidence,
        quality * 2.0::DOUBLE - 1 AS sentiment_score, toxic::DOUBLE AS intensity_score
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""
FEEDBACK = """feedback AS (
    SELECT conv_id * 1000 + turn AS id, turn, conv_id AS article_key, (length(text) % 101)::DOUBLE / 10 - 5 AS user_score,
        CASE role WHEN 'user' THEN 'thumbs_up' WHEN 'assistant' THEN 'slider' ELSE 'thumbs_down' END AS feedback_type,
        ['bias', 'sentiment', 'intensity'][conv_id % 3 + 1] AS dimension,
        TIMESTAMP '2024-01-31 00:00:00' - to_hours(((conv_id * 11 + turn) % 500)::INT) AS created_at
    FROM conversations
)"""
VERSIONS = """versions AS (
    SELECT row_number() OVER (ORDER BY day)::INT AS version, day + INTERVAL 6 HOUR AS trained_at, n::INT AS feedback_count, (n % 7) / 10.0::DOUBLE + 0.3::DOUBLE AS accuracy
    FROM (SELECT created_at::DATE AS day, count(*) AS n FROM feedback WHERE dimension = 'bias' AND created_at < TIMESTAMP '2024-01-20' GROUP BY 1)
)"""
QUOTES = """quotes AS (
    SELECT symbols[event_id % len(symbols) + 1] AS symbol, arg_max(value, event_id) AS price, count(*) AS trades
    FROM events, (SELECT """ + str(sorted({s for listed in BUCKETS.values() for s in listed})) + """ AS symbols) WHERE event_id % len(symbols) % 5 <> 3 GROUP BY 1
), trends AS (SELECT row_number() OVER (ORDER BY price DESC, symbol DESC)::INT - 1 AS pos, symbol FROM quotes QUALIFY pos < 12)"""
GROUPS = """story_groups AS (
    SELECT (doc_id // 96) || '-' || substr(sha256(doc_id::VARCHAR), 1, 1) AS group_id,
        list(substr(sha256(source || ':' || doc_id), 1, 16) ORDER BY doc_id) AS article_ids
    FROM documents GROUP BY 1 HAVING count(*) > 1
)"""
MARKETS = """markets AS (
    SELECT event_id AS id, b.text AS question, event_type AS category, k::DOUBLE / 100 AS yes_price, (k - 50)::DOUBLE / 100 AS yes_change_24h,
        value AS volume_24h, CASE WHEN event_id % 11 <> 0 THEN date_trunc('second', ts) + to_hours(k) END AS end_date, ts AS last_updated
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) LEFT JOIN benchmark b ON b.item_id = event_id % 40
)"""
RAW_MARKETS = MARKETS + """, raw_markets AS (
    SELECT id::VARCHAR AS condition_id, question, CASE WHEN id % 17 = 0 THEN NULL WHEN id % 13 = 0 THEN FALSE ELSE TRUE END AS yes_no,
        yes_price, id % 19 = 0 OR id % 23 = 0 AS sports, 'm-' || id AS slug, yes_change_24h, volume_24h FROM markets
)"""
OHLC = """ohlc AS (
    SELECT c_mktsegment AS symbol, o_orderdate::DATE AS t, arg_min(o_totalprice, o_orderkey) AS o, max(o_totalprice) AS h, min(o_totalprice) AS l,
        CASE WHEN day(any_value(o_orderdate)) <> 13 THEN arg_max(o_totalprice, o_orderkey) END AS c, count(*) AS v
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
)"""
WEATHER = """hours AS (
    SELECT date_trunc('hour', ts) AS time, round(avg(value), 4) AS temperature, round(avg(k), 4) AS precip_prob, sum(k)::BIGINT AS s
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) GROUP BY 1
), weather AS (
    SELECT *, [0, 1, 2, 3, 45, 48, 51, 53, 55, 56, 57, 61, 63, 65, 66, 67, 71, 73, 75, 77, 80, 81, 82, 85, 86, 95, 96, 99][s % 28 + 1] AS code,
        hour(time) BETWEEN 6 AND 18 AS is_day, (s % 101)::DOUBLE AS cover, (s * 37 % 16000)::DOUBLE AS visibility, (s % 120)::DOUBLE / 10 AS uv,
        (1000 + s % 40)::DOUBLE AS pressure, (40 + s % 45)::DOUBLE AS dew_point, (s * 7 % 360)::DOUBLE AS wind_direction,
        (s % 7)::DOUBLE / 500 AS precip, (s % 60)::DOUBLE AS gust
    FROM hours
)"""
POLLUTANTS = """pollutants AS (
    SELECT event_id AS reading_id, ts, CASE event_type WHEN 'view' THEN 'pm2_5' WHEN 'click' THEN 'pm10' WHEN 'error' THEN 'o3'
        WHEN 'signup' THEN 'no2' WHEN 'purchase' THEN 'so2' END AS pollutant, value FROM events
    UNION ALL
    SELECT event_id, ts, 'co', value * 100 FROM events WHERE event_type = 'view' AND event_id % 2 = 0
)"""


def using(*views: str, query: str) -> str:
    """A statement over some of the views."""
    return f"WITH {', '.join(views)} {query}"
