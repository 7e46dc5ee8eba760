"""DuckDB SQL of the queries that SQL can express, over the same tables."""

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"coalesce(regexp_extract_all({}, '[^\x20\x09-\x0D]+'), [])"

SUBSTRINGS = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS.format("text")} AS w FROM documents),
position_ AS (SELECT rid, unnest(range(1, len(w) - 33)) AS i FROM d),
win AS (SELECT rid, i, sha256(array_to_string(w[i:i + 34], ' ')) AS k FROM position_ JOIN d USING (rid)),
again AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS i FROM win SEMI JOIN again USING (k)),
word AS (SELECT rid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""

DECONTAMINATE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
pattern AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS p FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM pattern),
position_ AS (SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, size),
hit AS (SELECT rid, i, position_.n, item_id FROM position_ JOIN d USING (rid) JOIN pattern ON pattern.n = position_.n AND p = array_to_string(w[i:i + position_.n - 1], ' ')),
words AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS i FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item_id FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
VENDOR = r"((?:gh[opsur]_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|SG\.|npm_|hf_)[A-Za-z0-9_.-]+)"
SECRETS = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
kinds AS (SELECT * FROM (VALUES (0, 'assign', 8), (1, 'access', 16), (2, 'hex', 32), (3, 'vendor', 24)) AS k(kind, name, least_)),
found AS (
  SELECT rid, 0 AS kind, string_split_regex(text, '{ASSIGN}') AS gaps, regexp_extract_all(text, '{ASSIGN}') AS whole, regexp_extract_all(text, '{ASSIGN}', 2) AS value FROM d
  UNION ALL SELECT rid, 1, string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT rid, 2, string_split_regex(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+') FROM d
  UNION ALL SELECT rid, 3, string_split_regex(text, '{VENDOR}'), regexp_extract_all(text, '{VENDOR}'), regexp_extract_all(text, '{VENDOR}') FROM d),
each AS (SELECT rid, kind, unnest(range(1, len(whole) + 1)) AS i, unnest(gaps[1:len(whole)]) AS gap, unnest(whole) AS whole, unnest(value) AS value FROM found WHERE len(whole) > 0),
placed AS (SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY rid, kind ORDER BY i) AS stop FROM each),
fits AS (SELECT rid, kind, value, (stop - length(whole))::BIGINT AS start, stop::BIGINT AS stop FROM placed JOIN kinds USING (kind) WHERE length(value) >= least_),
owners AS (SELECT value, count(*) AS owners, sum(n) AS repositories FROM (SELECT value, source, count(*) AS n FROM (SELECT DISTINCT value, source, doc_id FROM fits JOIN d USING (rid)) GROUP BY value, source) GROUP BY value),
judged AS (
  SELECT rid, kind, name, start, stop, name || ':' || start || ':' || stop AS t,
    CASE WHEN owners >= 3 OR (owners > 1 AND repositories >= 20) THEN 'example' WHEN length(value) >= 16 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 8 THEN 'live' ELSE 'weak' END AS verdict
  FROM fits JOIN owners USING (value) JOIN kinds USING (kind)),
row_ AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(t, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(t, ',' ORDER BY start, kind) AS spans,
    count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example
  FROM judged WHERE kind < 3 OR verdict <> 'example' GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM d LEFT JOIN row_ USING (rid)
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT rid, vec_id, list_transform(e, lambda x: x / list_max(list_transform(e, lambda y: abs(y)))) AS e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b FROM good a JOIN good b ON a.rid <> b.rid AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(rid, to_) AS (SELECT rid, rid FROM good UNION SELECT r.rid, l.b FROM reach r JOIN link l ON l.a = r.to_),
component AS (SELECT r.rid, min(g.vec_id) AS component_id FROM reach r JOIN good g ON g.rid = r.to_ GROUP BY r.rid),
linked AS (SELECT a AS rid, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(vec_id = coalesce(component_id, vec_id), false) AS kept FROM v LEFT JOIN component USING (rid) LEFT JOIN linked USING (rid)
"""

ORACLE_SQL = {"op3_substrings": SUBSTRINGS, "op5_secrets": SECRETS, "op6_embeddings": EMBEDDINGS, "op8_decontaminate": DECONTAMINATE}
