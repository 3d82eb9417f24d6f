"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {
    "op10_benchmark_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 9))) AS i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op3_revisit_resolution": r"""
WITH p AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS dg, '"' || md5(coalesce(html, '')) || '"' AS tag, regexp_replace(trim(url), '#.*$', '') AS bare FROM pages
), parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?]*)', 1)), '^(www|m)\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(bare, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid|sessionid)(=|$)'))) AS kept
  FROM p
), named AS (
  SELECT page_id, dg, tag, host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url FROM parts
), resp AS (SELECT page_id * 2 AS id, canonical_url, page_id * 10 AS ts, dg, tag, page_id FROM named),
rev AS (
  SELECT page_id * 2 + 1 AS id, canonical_url, page_id * 10 + 5 + ((page_id * 37) % 5000) * 10 AS ts,
    CASE WHEN page_id % 7 < 5 THEN 'W/' || tag WHEN page_id % 7 = 5 THEN '"stale"' END AS validator
  FROM named
), found AS (
  SELECT rev.id, rev.canonical_url, rev.ts, validator, resp.id AS oid, resp.ts AS ots, resp.dg, resp.tag, resp.page_id,
    row_number() OVER (PARTITION BY rev.id ORDER BY resp.ts DESC, resp.id DESC) AS k
  FROM rev LEFT JOIN resp ON rev.canonical_url = resp.canonical_url AND resp.ts < rev.ts
), judged AS (
  SELECT *, CASE WHEN canonical_url IS NULL THEN 'no_url' WHEN oid IS NULL THEN 'no_original' WHEN validator IS NULL OR regexp_replace(validator, '^W/', '') = tag THEN 'resolved' ELSE 'validator_mismatch' END AS status
  FROM found WHERE k = 1
)
SELECT id AS record_id, canonical_url, ts, status, CASE WHEN status = 'resolved' THEN oid END AS original_id, CASE WHEN status = 'resolved' THEN ots END AS original_ts,
  CASE WHEN status = 'resolved' THEN dg END AS digest,
  CASE WHEN status = 'resolved' THEN 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || coalesce(validator, tag) || chr(10) || 'last-modified: day ' || (page_id // 100)
  ELSE 'content-type: none' || chr(10) || 'date: ' || ts || chr(10) || coalesce('etag: ' || validator || chr(10), '') || 'set-cookie: no' END AS headers
FROM judged
""",
    "op1_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM w, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 4))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN c ON c.a = w.doc_id
""",
    "op4_lm_scores": r"""
WITH w AS (SELECT doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' end') AS w FROM documents),
h AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)), lambda acc, b: list_reduce(list_concat([xor(acc, b)], range(8)), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 5 = 1 AS held_out, w FROM w),
t AS (SELECT doc_id, held_out, w[i] AS tok, CASE WHEN i = 1 THEN ' begin' ELSE w[i - 1] END AS one, CASE WHEN i <= 2 THEN ' begin' ELSE w[i - 2] END AS two FROM h, LATERAL (SELECT unnest(generate_series(1, len(w))) AS i)),
u AS (SELECT tok, count(*) AS c1 FROM t WHERE NOT held_out GROUP BY 1),
g AS (SELECT one, tok, count(*) AS c2 FROM t WHERE NOT held_out GROUP BY ALL),
q AS (SELECT two, one, tok, count(*) AS c3 FROM t WHERE NOT held_out GROUP BY ALL),
gh AS (SELECT one, sum(c2) AS h2 FROM g GROUP BY ALL),
qh AS (SELECT two, one, sum(c3) AS h3 FROM q GROUP BY ALL),
k AS (SELECT sum(c1) AS n, count(*) AS v FROM u),
p AS (SELECT doc_id, held_out, coalesce(c1, 0) > 0 AS known, (coalesce(c1, 0) + 0.5::DOUBLE) / (k.n + 0.5::DOUBLE * (k.v + 1)) AS p1, coalesce(c2, 0) AS c2, coalesce(h2, 0) AS h2, coalesce(c3, 0) AS c3, coalesce(h3, 0) AS h3, k.n
  FROM t LEFT JOIN u USING (tok) LEFT JOIN g USING (one, tok) LEFT JOIN gh USING (one) LEFT JOIN q USING (two, one, tok) LEFT JOIN qh USING (two, one), k)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, CAST(count_if(known) AS BIGINT) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10(p1)), 6) AS base_score,
  round(sum(log10((c3 + 200 * ((c2 + 200 * p1) / (h2 + 200))) / (h3 + 200))), 6) AS score FROM p GROUP BY 1
""",
    "op9_chat_prefix_tree": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, role || chr(1) || text AS b FROM c),
e AS (SELECT *, list_sum(list_transform(['\', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>', '<|endoftext|>', '<|im_start|>', '<|im_end|>'], lambda x: (length(b) - length(replace(b, x, ''))) // length(x))) AS marks FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + 17 + marks) AS BIGINT) AS formatted_chars FROM e GROUP BY 1
""",
}
