"""DuckDB SQL for the operators that it can express, over whole tables."""

from __future__ import annotations

from recollect.llm.chat_format import DEFAULT as _CHAT

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, size, list_slice(w, p, p + size - 1) AS win FROM
  (SELECT item_id, w, least(len(w), 13) AS size, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT r, size, p, list_slice(w, p, p + size - 1) AS win FROM
  (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
m AS (SELECT dw.r, dw.p, dw.size, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.size = iw.size),
h AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + size)) AS q FROM (SELECT DISTINCT r, p, size FROM m)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN t ON d.r = t.r"""

OP2 = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
  ELSE list_transform(range(1, len(w) - 3), lambda k: list_slice(w, k, k + 4)) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id"""

OP3 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5"""

OP5 = """WITH b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5_number(substr(h, 2 * p - 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(1, n - 98)) AS p FROM b)),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
u AS (SELECT doc_id, unnest(regexp_extract_all(h, '..')) AS byte, unnest(range(1, n + 1)) AS q FROM b),
c AS (SELECT u.doc_id AS doc_id, q, byte, max(CASE WHEN f.p IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY u.doc_id ORDER BY q ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS x
  FROM u LEFT JOIN f ON u.doc_id = f.doc_id AND u.q = f.p),
e AS (SELECT *, coalesce(lag(x) OVER (PARTITION BY doc_id ORDER BY q), 0) AS before FROM c),
k AS (SELECT doc_id, sum(x) AS gone, sum(CASE WHEN x = 1 AND before = 0 THEN 1 ELSE 0 END) AS runs, string_agg(CASE WHEN x = 0 THEN byte END, '' ORDER BY q) AS kept FROM e GROUP BY doc_id)
SELECT b.doc_id, b.n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM b LEFT JOIN k ON b.doc_id = k.doc_id"""

OP10 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
p AS (SELECT doc_id, p, list_slice(w, p, p + 12) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first FROM p) WHERE first < doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM f),
k AS (SELECT u.doc_id, count(g.q) AS gone, string_agg(CASE WHEN g.q IS NULL THEN word END, ' ' ORDER BY u.q) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d) u LEFT JOIN g ON u.doc_id = g.doc_id AND u.q = g.q GROUP BY u.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(k.gone, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""


# CRC-32 of the id's digits, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
# A run is an island of equal five-word windows on one lag, under the least lag that gives the same stretch.
OP13 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w, {_CRC} AS h FROM documents),
a AS (SELECT r, doc_id, w, len(w) AS n, coalesce(h % 10 = 0, false) AND len(w) > 0 AS planted, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM d),
t AS (SELECT r, doc_id, n, CASE WHEN planted THEN list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE w END AS w FROM a),
g AS (SELECT r, n, i, md5(array_to_string(list_slice(w, i + 1, i + 5), ' ')) AS k FROM (SELECT r, n, w, unnest(range(0, n - 4)) AS i FROM t)),
p AS (SELECT x.r, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.r = y.r AND x.k = y.k AND y.i > x.i WHERE 4 * (y.i - x.i) <= x.n),
s AS (SELECT r, q, min(i) AS start, count(*) + 4 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS part FROM p)
  GROUP BY r, q, part HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
u AS (SELECT r, start, length, min(q) AS period FROM s GROUP BY r, start, length),
b AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
  first(start ORDER BY length DESC, start, period) AS start, max(length) AS length, first(period ORDER BY length DESC, start, period) AS period FROM u GROUP BY r),
c AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM u),
k AS (SELECT o.r, string_agg(CASE WHEN c.i IS NULL THEN word END, ' ' ORDER BY o.i) AS kept
  FROM (SELECT r, unnest(w) AS word, unnest(range(0, n)) AS i FROM t) o LEFT JOIN c ON o.r = c.r AND o.i = c.i GROUP BY o.r)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN b ON t.r = b.r LEFT JOIN k ON t.r = k.r"""

_SAID = "</s>[INST] ok [/INST]"


def _escaped_length(x: str) -> str:
    """Code points of an escaped text: one more for each escape character and each control string."""
    extra = [f"(length({x}) - length(replace({x}, '{m}', ''))) // {len(m)}" for m in (_CHAT.escape, *_CHAT.controls)]
    return f"(length({x}) + {' + '.join(extra)})"


OP12 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{_SAID}'), (-1, 1, 'assistant', '{_SAID}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(_CHAT.turn + _CHAT.says + _CHAT.end)} + {_escaped_length('role')} + {_escaped_length('text')}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

OP11 = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM
  (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, k AS size, a FROM f WHERE k > 1),
h AS (SELECT lang, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase, max(a) AS longer FROM
  (SELECT lang, w, n, a, unnest(range(1, size - n + 2)) AS i FROM c, (SELECT unnest(range(2, 5)) AS n) WHERE n < size) GROUP BY ALL),
k AS (SELECT c.* FROM c LEFT JOIN h ON c.lang = h.lang AND c.phrase = h.phrase WHERE longer IS NULL OR 100 * longer < 100 * a),
s AS (SELECT lang, phrase, a, cut, array_to_string(list_slice(w, 1, cut), ' ') AS x, array_to_string(list_slice(w, cut + 1, size), ' ') AS y FROM
  (SELECT *, unnest(range(1, size)) AS cut FROM k)),
v AS (SELECT s.lang, s.phrase, s.a, cut, x.a AS l, y.a AS r, t.n, (1000::HUGEINT * s.a * t.n) // (x.a::HUGEINT * y.a) AS score FROM s
  JOIN f x ON x.lang = s.lang AND x.phrase = s.x JOIN f y ON y.lang = s.lang AND y.phrase = s.y JOIN t ON t.lang = s.lang),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM b QUALIFY rank <= 2000"""
