"""DuckDB twins of the queries in this subpackage, where SQL can express them.

Language, quality (compression), sharding (turn taking), pieces, extraction and whitening (eigenvectors) have none; the tests hold them against brute force,
a library's own answer, or held-out labels.
"""

from __future__ import annotations

_HEX = "('0x' || substr(md5({0}), {1}, {2}))::BIGINT"


def _hex(text: str, at: int, n: int) -> str:
    return _HEX.format(text, at, n)


OP3 = rf"""
WITH captures AS (
  SELECT page_id, url, 1704067200 + {_hex('page_id::VARCHAR', 1, 7)} % (365 * 86400) AS fetched_at,
    lower(regexp_extract(url, '^[a-zA-Z][^:/?#]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1)) AS host,
    regexp_replace(regexp_extract(url, '^[a-zA-Z][^:/?#]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path
  FROM pages),
keys AS (
  SELECT page_id, url, fetched_at, unnest(list_distinct(list_append(
    list_transform(generate_series(1, len(string_split(host, '.'))), lambda i: array_to_string(string_split(host, '.')[i:], '.')), host || path))) AS rule
  FROM captures WHERE host <> ''),
rules AS (SELECT DISTINCT rule FROM keys WHERE contains(rule, '.')),
drawn AS (
  SELECT rule, contains(rule, '/') AS page, 1704067200 + {_hex('rule', 1, 7)} % (300 * 86400) AS since,
    {_hex('rule', 20, 2)} AS kind FROM rules),
dated AS (SELECT *, since + 86400 + {_hex('rule', 8, 6)} % (60 * 86400) AS removed FROM drawn),
listed AS (
  SELECT *, removed + 86400 + {_hex('rule', 14, 6)} % (60 * 86400) AS again, CASE WHEN page AND kind % 8 = 0 THEN 'allow' ELSE 'block' END AS verdict
  FROM dated WHERE CASE WHEN page THEN kind % 4 = 0 ELSE kind % 8 <> 0 END),
held AS (
  SELECT rule, verdict, since AS lo, CASE WHEN kind % 3 <> 0 THEN removed END AS hi FROM listed
  UNION ALL SELECT rule, verdict, again, NULL FROM listed WHERE kind % 3 = 2),
hits AS (
  SELECT k.page_id, k.url, h.rule, h.verdict FROM keys k JOIN held h ON k.rule = h.rule AND h.lo <= k.fetched_at AND (h.hi IS NULL OR k.fetched_at < h.hi)),
best AS (
  SELECT *, count(*) OVER (PARTITION BY page_id, url) AS n_active,
    row_number() OVER (PARTITION BY page_id, url ORDER BY length(rule) DESC, verdict, rule) AS place FROM hits)
SELECT c.page_id, c.url, c.host, c.fetched_at, coalesce(b.n_active, 0) AS n_active, b.rule, b.verdict, coalesce(b.verdict <> 'block', true) AS kept
FROM captures c LEFT JOIN best b ON b.page_id = c.page_id AND b.url = c.url AND b.place = 1
"""

OP7 = r"""
WITH n AS (SELECT doc_id, coalesce(length(text), 0) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
k AS (
  SELECT doc_id, first_value(doc_id) OVER (PARTITION BY bare ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
    sha256(bare) AS text_sha256 FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""

OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM reach GROUP BY 1),
same AS (SELECT doc_id, list_sort(list(g)) AS gs FROM s GROUP BY 1),
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY gs) AS class_id FROM same)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.low, d.doc_id) AS component_id, coalesce(cls.class_id, d.doc_id) AS class_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id LEFT JOIN cls ON cls.doc_id = d.doc_id
"""

OP9 = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('42:' || coalesce(doc_id::VARCHAR, 'null')) AS draw FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM sized GROUP BY source),
wts AS (SELECT *, CASE (turn - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS stop FROM src),
lvl AS (
  SELECT *, ((SELECT sum(source_size::DOUBLE) FROM src) - coalesce(sum(stop) OVER (ORDER BY stop / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY stop / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM wts),
tgt AS (SELECT *, least(stop, (SELECT max(level) FROM lvl) * weight) AS target FROM lvl),
seats AS (
  SELECT turn, row_number() OVER (ORDER BY target / (s - 0.5::DOUBLE) DESC, turn) AS place
  FROM tgt, unnest(generate_series(1, (target / 16)::BIGINT + 2)) AS u(s) WHERE target > 0),
won AS (SELECT turn, count(*) AS blocks FROM seats WHERE place <= (SELECT sum(source_size) // 16 FROM src) GROUP BY 1),
plan AS (
  SELECT t.*, coalesce(blocks, 0) AS blocks, 1 + source_size // 1048576 + docs // 4096 AS shards FROM tgt t LEFT JOIN won USING (turn)),
placed AS (
  SELECT d.*, p.source_size, p.target, p.turn, p.blocks, {_HEX.format("'42:' || coalesce(doc_id::VARCHAR, 'null')", 1, 8)} % shards AS shard
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
sh AS (SELECT turn, shard, any_value(blocks) AS blocks, sum(size)::BIGINT AS words FROM placed GROUP BY 1, 2),
shseats AS (
  SELECT turn, shard, blocks, row_number() OVER (PARTITION BY turn ORDER BY words / (s - 0.5::DOUBLE) DESC, shard) AS place
  FROM sh, unnest(generate_series(1, blocks)) AS u(s) WHERE words > 0),
shwon AS (SELECT turn, shard, count(*) AS q FROM shseats WHERE place <= blocks GROUP BY 1, 2),
ring AS (
  SELECT turn, shard, words, least(coalesce(q, 0), 3 * words // 16) * 16 AS quota,
    {_HEX.format("'42:' || turn || ':' || shard", 1, 12)} % words AS start
  FROM sh LEFT JOIN shwon USING (turn, shard) WHERE words > 0),
laid AS (
  SELECT *, sum(size) OVER (PARTITION BY turn, shard ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS hi FROM placed)
SELECT l.doc_id, l.size, l.source_size, l.target, coalesce(
  l.size * (quota // words) + greatest(least(hi, start + quota % words) - greatest(hi - l.size, start), 0)
  + greatest(least(hi, start + quota % words - words) - (hi - l.size), 0), 0)::BIGINT AS taken
FROM laid l LEFT JOIN ring r USING (turn, shard)
"""

OP10 = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n
  FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, {_hex('line', 1, 12)} % 2147483647 AS now FROM l),
p AS (SELECT *, lag(now, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM h),
e AS (SELECT *, ((before * 1000003 + now) % 2147483647 % 3 = 0 OR i = n)::INT AS last FROM p),
g AS (SELECT *, coalesce(sum(last) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e),
c AS (SELECT doc_id, chunk, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS body FROM g GROUP BY 1, 2),
r AS (
  SELECT *, lines > 1 AND regexp_matches(body, '\S') AND row_number() OVER (PARTITION BY body ORDER BY doc_id, chunk) > 1 AS gone FROM c)
SELECT d.doc_id, coalesce(count(*) FILTER (gone), 0)::INT AS chunks_removed, coalesce(sum(lines) FILTER (gone), 0)::INT AS lines_removed,
  CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (NOT gone), '') END AS text
FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id
"""

OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(doc_id::VARCHAR, 'null')) AS s FROM documents),
h AS (
  SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(s, i, 8))::BIGINT) AS h FROM d),
c AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

OP13 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN
      list_transform(generate_series(1, len(ws) - 3), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM reach GROUP BY 1),
same AS (SELECT doc_id, list_sort(list(g)) AS gs FROM s GROUP BY 1),
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY gs) AS class_id FROM same)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.low, d.doc_id) AS component_id, coalesce(c.low, d.doc_id) = d.doc_id AS kept,
  coalesce(cls.class_id, d.doc_id) AS class_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id LEFT JOIN cls ON cls.doc_id = d.doc_id
"""

ORACLE: dict[str, str] = {
    "op3_url_filter": OP3, "op7_exact_dedup": OP7, "op8_jaccard_join": OP8, "op9_sainte_lague_mix": OP9, "op10_line_chunks": OP10, "op11_fill_in_middle": OP11,
    "op13_superminhash": OP13,
}
