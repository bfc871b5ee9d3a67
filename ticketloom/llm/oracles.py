"""DuckDB SQL for the queries that SQL can express."""

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP7 = rf"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), {LOWER}), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
k AS (
  SELECT *, regexp_replace(host, '^(www|blog|m)\.', '') || regexp_replace(path, '/+$', '') AS key
  FROM p),
listed AS (SELECT DISTINCT key FROM k WHERE regexp_matches(host, '(^|\.)(cheap-pills|spam-farm)\.')),
r AS (
  SELECT k.*, listed.key IS NOT NULL AS listed, CASE
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM k LEFT JOIN listed USING (key))
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

OP8 = rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {LOWER}),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents),
i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {LOWER}),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, list_slice(words, s, s + 9) AS words
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS s FROM i WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT len(words) AS size FROM windows),
spots AS (
  SELECT doc_id, s, size, list_slice(words, s, s + size - 1) AS words
  FROM (SELECT d.*, size, unnest(range(1, len(words) - size + 2)) AS s FROM d, sizes
        WHERE len(words) >= size)),
hits AS (SELECT doc_id, s, size, item_id FROM spots JOIN windows USING (words)),
places AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + size)) AS place FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
    lambda w: w <> '') AS words
  FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(words[s:s + 49], ' ') AS w
  FROM (SELECT *, unnest(range(1, len(words) - 48)) AS s FROM d)),
owners AS (
  SELECT w, min(doc_id) AS least FROM windows GROUP BY w HAVING max(doc_id) > min(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS place
  FROM windows JOIN owners USING (w) WHERE doc_id > least),
spread AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM d),
kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY place) AS kept
  FROM spread ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP9 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (
  SELECT doc_id, s, doc_id * 4294967296 + s AS place, md5_number(substr(h, 2 * s + 1, 200)) AS b
  FROM (SELECT *, unnest(range(0, len(h) // 2 - 99)) AS s FROM d)),
later AS (
  SELECT doc_id, s FROM (
    SELECT *, least FROM strings JOIN (
      SELECT b, min(place) AS least FROM strings GROUP BY b HAVING count(*) > 1) USING (b))
  WHERE least <> place),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 100)) AS place FROM later),
runs AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < place - 1)
    AS n_spans
  FROM (SELECT *, lag(place) OVER (PARTITION BY doc_id ORDER BY place) AS before FROM gone)
  GROUP BY doc_id),
spread AS (
  SELECT doc_id, place, substr(h, 2 * place + 1, 2) AS pair
  FROM (SELECT *, unnest(range(0, len(h) // 2)) AS place FROM d)),
kept AS (
  SELECT doc_id, string_agg(pair, '' ORDER BY place) AS h
  FROM spread ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP11 = rf"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, {LOWER}),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
q AS (
  SELECT item_id, term, count(*) AS qtf FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, {LOWER}),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
postings AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY doc_id),
total AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM lengths),
m AS (SELECT doc_id, 25 + (75 * n * nn) // l AS m FROM lengths, total),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM postings, total GROUP BY term, nn),
scores AS (
  SELECT item_id, doc_id,
    CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN postings USING (term) JOIN m USING (doc_id)
  GROUP BY item_id, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
