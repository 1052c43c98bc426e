"""DuckDB SQL for the operators that SQL can express, by brute force over whole tables."""

#: Words of each document, in order.
_WORDS = r"SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents"

OP1_SQL = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM t WHERE n >= 100)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM late)) GROUP BY doc_id, g),
kept AS (SELECT doc_id, string_agg(part, '' ORDER BY a) AS h FROM (SELECT r.doc_id, r.a, substr(t.h, 2 * coalesce(lag(r.b) OVER (PARTITION BY r.doc_id ORDER BY r.a), 0) + 1, 2 * (r.a - coalesce(lag(r.b) OVER (PARTITION BY r.doc_id ORDER BY r.a), 0))) AS part FROM runs r JOIN t ON t.doc_id = r.doc_id
  UNION ALL SELECT t.doc_id, t.n + 1, substr(t.h, 2 * coalesce(m.b, 0) + 1) FROM t LEFT JOIN (SELECT doc_id, max(b) AS b FROM runs GROUP BY doc_id) m ON m.doc_id = t.doc_id) GROUP BY doc_id)
SELECT t.doc_id, t.n AS n_bytes, CAST(coalesce(s.removed, 0) AS BIGINT) AS n_removed, coalesce(s.spans, 0) AS n_spans, sha256(unhex(k.h)) AS kept_sha256 FROM t JOIN kept k ON k.doc_id = t.doc_id LEFT JOIN (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id) s ON s.doc_id = t.doc_id"""

OP8_SQL = f"""WITH w AS ({_WORDS}),
p AS (SELECT doc_id, i, md5_number(array_to_string(list_slice(ws, i, i + 49), ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
late AS (SELECT p.doc_id, p.i FROM p JOIN (SELECT k, min(doc_id) AS d FROM p GROUP BY k) f ON f.k = p.k WHERE f.d < p.doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS g FROM late GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(len(g), 0) AS n_removed, sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda x: NOT list_contains(coalesce(g, []), x)), lambda x: ws[x]), ' '), '')) AS kept_sha256 FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id"""

OP9_SQL = f"""WITH RECURSIVE w AS ({_WORDS}),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [''] END) AS e FROM w),
x AS (SELECT doc_id, len(e) AS n, unnest(e) AS e FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.e = b.e AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a"""

#: log P(X = i) for a binomial X of n trials at the risk that ``quality_rules`` controls.
_LOG = "lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.005e0) + (n - i) * ln(0.995e0)"
_TAIL = f"list_sum(list_transform(range(0, CAST({{k}} AS BIGINT) + 1), lambda i: exp({_LOG})))"

OP4_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '~') AS st, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
r AS (SELECT doc_id, len(list_distinct(flatten(list([i, i + 1, i + 2])))) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3))) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
c AS (SELECT d.doc_id, d.st, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(ls) AS n_lines FROM d JOIN l ON l.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id),
v AS (SELECT doc_id, st, 's' AS rule, n_symbols / greatest(n_words, 1) AS value FROM c UNION ALL SELECT doc_id, st, 'l', n_dup_lines / greatest(n_lines, 1) FROM c UNION ALL SELECT doc_id, st, 'r', n_repeat_words / greatest(n_words, 1) FROM c),
clean AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
h AS (SELECT st, rule, value FROM v JOIN clean ON clean.doc_id = v.doc_id),
cut AS (SELECT CAST(0.02 * i AS DOUBLE) AS c FROM range(2, 51) x(i)),
o AS (SELECT st, rule, c, count(*) AS n, sum(CASE WHEN value > c THEN 1 ELSE 0 END) AS k FROM h, cut GROUP BY st, rule, c UNION ALL SELECT '', rule, c, count(*), sum(CASE WHEN value > c THEN 1 ELSE 0 END) FROM h, cut GROUP BY rule, c),
p AS (SELECT o.*, level, CASE WHEN k >= n * 0.005e0 THEN true ELSE {_TAIL.format(k="k")} > level END AS bad FROM o, (SELECT 0.05e0 / ((count(DISTINCT st) + 1) * 3) AS level FROM h)),
b AS (SELECT st, rule, max(n) AS n, max(level) AS level, min(CASE WHEN c > worst THEN c END) AS best FROM (SELECT p.*, coalesce(max(CASE WHEN bad THEN c END) OVER (PARTITION BY st, rule), -1) AS worst FROM p) GROUP BY st, rule),
q AS (SELECT rule, best AS pooled FROM b WHERE st = ''),
s AS (SELECT b.st, b.rule, CASE WHEN power(0.995e0, n) > level AND pooled IS NOT NULL THEN (SELECT min(o.c) FROM o WHERE o.st = b.st AND o.rule = b.rule AND o.c >= pooled AND o.k < o.n * 0.005e0) ELSE best END AS cutoff FROM b JOIN q ON q.rule = b.rule WHERE b.st <> ''),
f AS (SELECT v.doc_id, max(CASE WHEN value > CASE WHEN s.st IS NULL THEN pooled ELSE cutoff END THEN 1 ELSE 0 END) AS hit FROM v LEFT JOIN q ON q.rule = v.rule LEFT JOIN s ON s.st = v.st AND s.rule = v.rule GROUP BY v.doc_id)
SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND hit = 0 AS kept FROM c JOIN f ON f.doc_id = c.doc_id"""
