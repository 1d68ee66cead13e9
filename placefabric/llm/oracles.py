"""SQL twins of the corpus queries that SQL can express, for DuckDB on small tables."""

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_sort(list_distinct([concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) for i in range(1, len(ws) - 1)])) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
k AS (SELECT doc_id, len(sh) AS n, md5(array_to_string(sh, chr(10))) AS h FROM s),
c AS (SELECT h, n, min(doc_id) AS head, count(*) AS copies FROM k WHERE n > 0 GROUP BY h, n),
e AS (SELECT c.head AS doc_id, c.n, unnest(s.sh) AS g FROM c JOIN s ON s.doc_id = c.head),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(doc_id, reached) AS (SELECT head, head FROM c UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT k.doc_id, k.n AS n_shingles, coalesce(m.component_id, k.doc_id) AS component_id, coalesce(c.copies, 1) AS copies
FROM k LEFT JOIN c ON c.h = k.h AND c.n = k.n LEFT JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = c.head"""

OP6 = f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT h, min(doc_id) AS first_doc FROM s GROUP BY h),
g AS (SELECT DISTINCT doc_id, i + j AS place FROM (SELECT s.doc_id, s.i FROM s JOIN f USING (h) WHERE s.doc_id > first_doc), range(0, 50) t(j)),
k AS (SELECT w.doc_id, i, ws[i] AS word FROM w, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i)),
t AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM k ANTI JOIN g ON g.doc_id = k.doc_id AND g.place = k.i GROUP BY k.doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(t.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN t USING (doc_id)"""

OP5 = """WITH t AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT r, k, substr(x, 1024 * k + 1, 1824) AS y FROM (SELECT r, x, unnest(range(0, (len(x) // 2 - 400) // 512 + 1)) AS k FROM t WHERE len(x) >= 800)),
w AS (SELECT r, 512 * k + j AS i, md5_number(substr(y, 2 * j + 1, 800)) AS h FROM (SELECT *, unnest(range(0, least(512, len(y) // 2 - 399))) AS j FROM b)),
g AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
s AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM w SEMI JOIN g USING (h)),
k AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS span FROM s),
p AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM k GROUP BY r, span),
q AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM p),
m AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept FROM q JOIN t USING (r) GROUP BY r)
SELECT doc_id, len(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM t LEFT JOIN m USING (r)"""

_MARKS = ("<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>")
_ESCAPED = r"replace({0}, '\', '\\')"
for _mark in _MARKS:
    _ESCAPED = f"replace({_ESCAPED}, '{_mark}', '<\\{_mark[1:]}')"

OP13 = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST({len(_MARKS[0])} + sum({sum(map(len, _MARKS[1:]))} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

_CRC32 = "xor(list_reduce([4294967295] || list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: ascii(x)), lambda c, b: list_reduce([xor(c, b)] || range(8), lambda k, i: xor(k >> 1, 3988292384 * (k & 1)))), 4294967295)"

OP12 = f"""WITH o AS (SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
q AS (SELECT o.c, coalesce(b.l[1:h], []) || o.l[h + 1:] AS l FROM (SELECT *, {_CRC32.format("c")} % 6 AS h FROM o) o LEFT JOIN o b ON b.c = o.c - o.c % 100),
p AS (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM q),
n AS (SELECT c, d, min(c) OVER (PARTITION BY l[1:d], d) AS rep, d = len(l) AS ends, length(l[d].text) AS chars FROM p),
g AS (SELECT rep, d, count(*) AS n_convs, any_value(chars) AS chars, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ids FROM n GROUP BY rep, d),
u AS (SELECT g.*, n.rep AS above FROM g LEFT JOIN n ON n.c = g.rep AND n.d = g.d - 1),
k AS (SELECT above, d - 1 AS d, count(*) AS n_children FROM u WHERE d > 0 GROUP BY above, d),
w AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN k ON k.above = u.rep AND k.d = u.d),
s AS (SELECT n.rep, n.d, sum((w.n_convs - 1) * coalesce(w.chars, 0)) AS saved, count(*) FILTER (w.n_children = 0) AS leaves FROM w JOIN n ON n.c = w.rep AND n.d <= w.d GROUP BY n.rep, n.d)
SELECT w.rep AS conv_id, w.d AS depth, w.above AS parent_conv_id, n_convs, n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ids) AS ends_sha256 FROM w JOIN s ON s.rep = w.rep AND s.d = w.d"""
