"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"coalesce(regexp_extract_all({_LOWER}, " + r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, w[i : i + least(13, len(w)) - 1] AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT r, i, x.n, item_id
  FROM (SELECT r, s.n, i, w[i : i + s.n - 1] AS g
        FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) AS p, sizes AS s
        WHERE i + s.n - 1 <= len(w)) AS x JOIN win ON win.n = x.n AND win.g = x.g
),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM occ) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN its USING (r)
"""

_ESCAPED = r"replace(replace(replace({0}, '\', '\\'), '###', '\h'), '</turn>', '\e')"
_ROLE_ESCAPED = r"replace(replace(" + _ESCAPED + r", ':', '\c'), chr(10), '\n')"

CHAT = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || {_ROLE_ESCAPED.format("role")} || ': ' || {_ESCAPED.format("text")} || ' </turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

_CANONICAL = r"""CASE WHEN regexp_extract(rest, '^[^/?]*') <> '' THEN
  regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '')
  || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
  || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END"""

REVISITS = rf"""
WITH p AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS digest, page_id * 10 AS rts, page_id * 10 + 5 + (page_id * 7919 % 30011) * 10 AS nts FROM pages
),
t AS (SELECT *, '"' || substr(digest, 1, 16) || '"' AS tag, 'day ' || (page_id % 28) AS modified FROM p),
u AS (
  SELECT 'response' AS kind, *, url AS own FROM t
  UNION ALL SELECT 'revisit', *, regexp_replace(url, '[?#].*', '') || '?utm_source=again#top' FROM t
),
v AS (SELECT *, regexp_replace(regexp_extract(own, '^[A-Za-z][A-Za-z0-9+.-]*://(.*)$', 1), '#.*', '') AS rest FROM u),
w AS (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS q
  FROM v
),
c AS (SELECT *, {_CANONICAL} AS canonical_url FROM w),
r AS (
  SELECT canonical_url, rts, max_by(struct_pack(page_id := page_id, digest := digest, tag := tag, modified := modified), 'r' || page_id) AS r
  FROM c WHERE kind = 'response' GROUP BY canonical_url, rts
),
n AS (
  SELECT *, CASE WHEN page_id % 5 = 4 THEN '"stale"' WHEN page_id % 5 = 3 THEN 'W/' || tag WHEN page_id % 5 < 2 THEN tag END AS etag,
    CASE WHEN page_id % 3 > 0 THEN modified END AS last_modified
  FROM c WHERE kind = 'revisit'
),
j AS (
  SELECT n.*, r.rts AS refers_ts, r.r AS r, CASE WHEN r.r.page_id % 7 <> 3 THEN r.r.tag END AS rtag
  FROM n ASOF LEFT JOIN r ON n.canonical_url = r.canonical_url AND n.nts > r.rts
),
s AS (
  SELECT *, CASE WHEN refers_ts IS NULL THEN 'no_response'
    WHEN etag IS NOT NULL AND rtag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = rtag THEN 'resolved' ELSE 'mismatch' END
    WHEN etag IS NULL AND last_modified IS NOT NULL THEN CASE WHEN last_modified = r.modified THEN 'resolved' ELSE 'mismatch' END
    ELSE 'unchecked' END AS status
  FROM j
)
SELECT 'n' || page_id AS record_id, page_id, canonical_url, nts AS ts, status, 'r' || r.page_id AS refers_to, refers_ts, r.digest AS refers_digest,
  CASE WHEN status IN ('resolved', 'unchecked') THEN CAST(nts AS VARCHAR) END AS date,
  CASE WHEN status IN ('resolved', 'unchecked') THEN 'max-age=600' END AS cache_control,
  CASE WHEN status IN ('resolved', 'unchecked') THEN '32' END AS content_length,
  CASE WHEN status IN ('resolved', 'unchecked') THEN 'text/html' END AS content_type
FROM s
"""
