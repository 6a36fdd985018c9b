"""DuckDB SQL for the training-data queries that SQL can express."""

from newsloom.llm.url_filter import TWO_LABEL_SUFFIXES

LINE_DEDUP = """
WITH lines AS (
    SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
    SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), repeated AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
    SELECT k.*, r.key IS NULL OR k.doc_id = r.keeper AS stays FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_LEVEL = """
    SELECT CASE WHEN g < 2 OR mean <= 0 OR mean >= 1 OR room <= 0 OR between_groups <= 0 THEN 1000.0
        ELSE least(1000.0, greatest(1.0, round(room / between_groups - 1, 6))) END
    FROM (
        SELECT count(*) AS g, any_value(t.mean) AS mean,
            sum(n * power(bad / n - t.mean, 2)) / (any_value(t.mean) * (1 - any_value(t.mean))) - (count(*) - 1) AS between_groups,
            sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room
        FROM {level}, total t WHERE n > 0
    )
"""

_SUFFIXES = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)

URL_FILTER = f"""
WITH parts AS (
    SELECT page_id,
        translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), known AS (
    SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
    WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id
), hosts AS (
    SELECT host, CASE WHEN ip THEN name WHEN two IN ({_SUFFIXES}) THEN array_to_string(list_slice(labels_, -3, -1), '.') ELSE two END AS domain,
        CASE WHEN ip THEN name WHEN two IN ({_SUFFIXES}) THEN two ELSE labels_[-1] END AS suffix, n, bad
    FROM (
        SELECT host, any_value(name) AS name, string_split(any_value(name), '.') AS labels_, array_to_string(list_slice(string_split(any_value(name), '.'), -2, -1), '.') AS two,
            regexp_matches(any_value(name), '^(\\[.*|[0-9]+([.][0-9]+){{3}})$') AS ip,
            count(k.bad)::DOUBLE AS n, coalesce(sum(k.bad), 0)::DOUBLE AS bad
        FROM (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM parts) LEFT JOIN known k ON k.doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:[./]|$)', 1) AS BIGINT)
        GROUP BY host
    )
), domains AS (
    SELECT domain, max(suffix) AS suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain
), suffixes AS (
    SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix
), total AS (
    SELECT CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n) ELSE 0 END AS mean FROM suffixes
), by_suffix AS (
    SELECT suffix, (bad + k * mean) / (n + k) AS prior FROM suffixes, total, (SELECT ({_LEVEL.format(level="suffixes")}) AS k)
), by_domain AS (
    SELECT domain, (bad + k * prior) / (n + k) AS prior FROM domains JOIN by_suffix USING (suffix), (SELECT ({_LEVEL.format(level="domains")}) AS k)
), reputation AS (
    SELECT host, n + k AS weight, (bad + k * prior) / (n + k) AS mean
    FROM hosts JOIN by_domain USING (domain), (SELECT ({_LEVEL.format(level="hosts")}) AS k)
), posterior AS (
    SELECT host, a, b, 0.5 > (a + 1) / (a + b + 2) AS swapped, CASE WHEN swapped THEN b ELSE a END AS p, CASE WHEN swapped THEN a ELSE b END AS q
    FROM (SELECT host, mean * weight AS a, (1 - mean) * weight AS b FROM reputation)
), areas AS (
    SELECT *, exp((p + q) * ln(0.5) - lgamma(p) - lgamma(q) + lgamma(p + q)) / (p * list_reduce(
        list_prepend(1.0::DOUBLE, list_transform(range(500, 0, -1), lambda m: m::DOUBLE)),
        lambda f, m: 1 - (p + m - 1) * (p + q + m - 1) * 0.5 / ((p + 2 * m - 2) * (p + 2 * m - 1))
            / (1 + m * (q - m) * 0.5 / ((p + 2 * m - 1) * (p + 2 * m)) / f))) AS area
    FROM posterior WHERE a > 0 AND b > 0
), verdicts AS (
    SELECT host, CASE WHEN a <= 0 THEN 1 WHEN b <= 0 THEN 0 WHEN o.swapped THEN 1 - area ELSE area END < 0.05 AS blocked
    FROM posterior o LEFT JOIN (SELECT host, area FROM areas) USING (host)
), judged AS (
    SELECT page_id, host, path, blocked,
        CASE
            WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
            WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
            WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
            WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
            WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/'
        END AS rule
    FROM parts JOIN verdicts USING (host)
)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
        WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

HARD_NEGATIVES = """
WITH sound AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM sound a JOIN sound b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank,
    other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) <= 5
"""
