"""SQL of a second engine for the queries of this folder that SQL can express."""

from __future__ import annotations

A_Z, A_Z_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = r"[\x20\x09-\x0D]"

TOPK = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
pairs AS (SELECT q.vec_id AS query_id, i.vec_id, len(list_filter(list_zip(q.b, i.b), lambda p: p[1] <> p[2])) AS distance
  FROM v q JOIN v i ON q.vec_id % 20 = 0 AND q.vec_id <> i.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""

MIX = r"""
WITH docs AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CASE WHEN text IS NULL THEN 1.0 ELSE 1.0 / (1 + 10 * (
      (length(text) - length(translate(text, '#$%&*|!<>{}=~^_\', '')))
      / greatest(length(text), 1)::DOUBLE)) END AS weight,
    (('0x' || md5(coalesce(doc_id::VARCHAR, 'null') || ':7')[1:12])::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
keyed AS (SELECT *, -ln(u) / weight AS k FROM docs),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3.0, 1.0, 2.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::DOUBLE AS w
  FROM keyed GROUP BY source),
capped AS (SELECT *, source_size * 2.0::DOUBLE AS c, source_size * 2.0::DOUBLE / w AS ratio,
    sum(source_size) OVER () * 1.5::DOUBLE AS total FROM sources),
leveled AS (SELECT *,
    (total - coalesce(sum(c) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM capped),
edges AS (SELECT *, lag(ratio, 1, 0) OVER (ORDER BY ratio, source NULLS LAST) AS lower FROM leveled),
levels AS (SELECT max(lv) AS lv FROM edges WHERE lv <= ratio AND lv >= lower),
targets AS (SELECT source, source_size, least(c, w * coalesce((SELECT lv FROM levels), ratio)) AS target FROM capped),
epochs AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS e FROM targets),
placed AS (
  SELECT doc_id, source, size,
    coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed)
SELECT p.doc_id, p.size::BIGINT AS size, t.source_size, t.target,
  (p.size * (t.e + CASE WHEN p.before + p.size / 2.0 <= t.target - t.e * t.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed p JOIN epochs t ON p.source IS NOT DISTINCT FROM t.source
"""

LINES = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT r, doc_id, string_split(text, chr(10)) AS parts FROM docs),
lines AS (SELECT r, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM cut),
keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^{BLANK}+', ''), '{BLANK}+$', ''),
  '{A_Z}', '{A_Z_LOWER}') AS k FROM lines),
repeated AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT a.*, b.k IS NOT NULL AND a.doc_id <> b.keeper AS gone FROM keyed a LEFT JOIN repeated b USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, length(regexp_replace(replace(role, '\', '\\'), '<(\||/?s>|/?SYS>)|\[/?INST\]', '\0+', 'g')) AS rl,
    length(regexp_replace(replace(text, '\', '\\'), '<(\||/?s>|/?SYS>)|\[/?INST\]', '\0+', 'g')) AS tl
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(8 + 8 + 7 + rl + tl)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

DECONTAMINATE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{A_Z}', '{A_Z_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id,
    regexp_extract_all(translate(text, '{A_Z}', '{A_Z_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
patterns AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM patterns),
windows AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS p
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)),
hits AS (SELECT r, n, i, item_id FROM windows JOIN patterns USING (n, p)),
words AS (SELECT r, count(DISTINCT pos) AS n_hit
  FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT r, n, i FROM hits)) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""


def _strength(level: str) -> str:
    """Prior strength of a level as in ``url_filter``."""
    return f"""
  {level}_sums AS (SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, sum(n::DOUBLE * n) AS nn,
    sum(bad::DOUBLE * bad / n) AS within FROM {level}s WHERE n > 0),
  {level}_parts AS (SELECT *, greatest(within - bad * bad / n, 0) / (k - 1) AS b,
    greatest(bad - within, 0) / (n - k) AS i, (n - nn / n) / (k - 1) AS z FROM {level}_sums),
  {level}_fit AS (SELECT CASE WHEN k < 2 OR n <= k OR n IS NULL THEN 1.0 ELSE (1 - s) / s END AS m FROM (
    SELECT k, n, round(least(greatest((b - i) / greatest(b + (z - 1) * i, 1e-12), 0.001), 0.5), 4) AS s
    FROM {level}_parts))"""


URLS = rf"""
WITH urls AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{A_Z}', '{A_Z_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM urls),
outcomes AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix,
  count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM parts LEFT JOIN outcomes USING (page_id) GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixs AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
{_strength("host")},{_strength("domain")},{_strength("suffix")},
prior AS (SELECT (coalesce(sum(bad), 0) + 1)::DOUBLE / (coalesce(sum(n), 0) + 2) AS p FROM suffixs),
s AS (SELECT suffix, (m * p + bad) / (m + n) AS suffix_mean FROM suffixs, suffix_fit, prior),
d AS (SELECT domain, suffix, (m * suffix_mean + bad) / (m + n) AS domain_mean FROM domains JOIN s USING (suffix), domain_fit),
h AS (SELECT host, n, m + n AS total, (m * domain_mean + bad) / (m + n) AS mean
  FROM hosts JOIN d USING (domain, suffix), host_fit),
bounds AS (SELECT host, n, mean, mean - 1.64 * sqrt(mean * (1 - mean) / (total + 1)) AS bound FROM h),
judged AS (SELECT p.page_id, p.host, p.path, n, mean, bound,
  CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts p JOIN bounds USING (host))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
  n AS host_labels, round(mean, 6) AS bad_mean, round(bound, 6) AS bad_bound
FROM judged
"""

ORACLE = {
    "op1_hamming_topk": TOPK,
    "op2_mix_sources": MIX,
    "op4_line_dedup": LINES,
    "op8_chat_format": CHAT,
    "op9_decontaminate": DECONTAMINATE,
    "op10_url_filter": URLS,
}
