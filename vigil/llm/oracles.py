"""DuckDB twins of the queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op1_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES["op3_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS words FROM d GROUP BY source
), p AS (
  SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight, sum(words) OVER () AS total FROM s
), l AS (
  SELECT *, 3 * words / weight AS brim,
    sum(3 * words) OVER (ORDER BY 3 * words / weight) AS cum_cap,
    sum(weight) OVER () - sum(weight) OVER (ORDER BY 3 * words / weight) AS open_weight FROM p
), f AS (
  SELECT *, cum_cap + brim * open_weight <= total AS is_full FROM l
), g AS (
  SELECT *, (total - sum(CASE WHEN is_full THEN 3 * words ELSE 0 END) OVER ())::DOUBLE
    / (sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ())::DOUBLE AS rate FROM f
), t AS (
  SELECT source, words, CASE WHEN is_full THEN (3 * words)::DOUBLE ELSE weight * coalesce(rate, 0.0) END AS target FROM g
), m AS (
  SELECT d.doc_id, d.size, t.words, t.target, coalesce(t.target / nullif(t.words, 0)::DOUBLE, 0.0) AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0 AS chance
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, words AS source_size, target,
  (size * (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM m
"""

_MATCHES = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"(AKIA[A-Z0-9]{12,})",
    "hex": r"([0-9a-f]{32,})",
    "owned": r"([A-Za-z0-9+/_.=-]{20,})",
}


def _matches(kind: str, number: int) -> str:
    whole = f"((?s:.*?))(?:{_MATCHES[kind]})"
    return f"""
SELECT doc_id, source, lang, {number} AS k, value,
  (sum(length(hit)) OVER w - length(hit) + length(gap))::BIGINT AS s, (sum(length(hit)) OVER w)::BIGINT AS e
FROM (SELECT doc_id, source, lang, unnest(regexp_extract_all(text, '{whole}', 0)) AS hit,
  unnest(regexp_extract_all(text, '{whole}', 1)) AS gap, unnest(regexp_extract_all(text, '{whole}', 2)) AS value,
  generate_subscripts(regexp_extract_all(text, '{whole}', 0), 1) AS i FROM documents)
WINDOW w AS (PARTITION BY doc_id ORDER BY i)"""


ORACLES["op4_secret_scan"] = f"""
WITH a AS ({_matches("assign", 0)}), b AS ({_matches("access", 1)}), c AS ({_matches("hex", 2)}), o AS ({_matches("owned", 3)}),
base AS (SELECT * FROM a WHERE length(value) >= 8 UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c),
found AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM o WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
    AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = o.doc_id AND base.s < o.e AND o.s < base.e)
), owners AS (
  SELECT value, n >= 3 OR n > 1 AND m >= 6 AS about FROM (
    SELECT value, count(DISTINCT source) + max((source IS NULL)::INT) AS n, count(DISTINCT concat_ws('/', source, lang)) AS m
    FROM found GROUP BY value)
), kept AS (
  SELECT f.*, about, ['assign', 'access', 'hex', 'owned'][k + 1] || ':' || s || ':' || e AS span
  FROM found f JOIN owners USING (value) WHERE k < 3 OR NOT about
)
SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
  count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (k = 3) AS n_owned, count(*) FILTER (k < 3 AND about) AS n_copied,
  sha256(coalesce(string_agg(span, ',' ORDER BY s, k, e) FILTER (k < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY s, k, e), '') AS spans
FROM documents d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id
"""

ORACLES["op10_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, role = 'assistant' AS replied,
    length(role || text) + len(regexp_extract_all(role || ' ' || text, '\\|\[INST\]|\[/INST\]|\[:\]|<s>|</s>'))
    + CASE WHEN role = 'assistant' THEN 10 ELSE 16 END AS chars FROM c
), p AS (
  SELECT *, sum(chars) OVER w AS upto, sum(chars) OVER (PARTITION BY conv_id) AS total,
    max(CASE WHEN replied THEN turn END) OVER (PARTITION BY conv_id) AS last_reply FROM e
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (replied), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (replied), '')) AS loss_sha256,
  (coalesce(sum(upto) FILTER (replied), 0)
    + coalesce(sum(chars) FILTER (last_reply IS NULL OR turn > last_reply), 0))::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""

ORACLES["op5_ngram_jaccard"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+3], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)
), r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT r.x AS doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.y) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.x GROUP BY r.x
"""

ORACLES["op9_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), f AS (SELECT t, min(doc_id) AS first_id FROM g GROUP BY t HAVING count(*) > 1),
m AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN f USING (t) WHERE first_id < doc_id
), k AS (
  SELECT w.doc_id, count(*) AS n, count(m.i) AS gone,
    string_agg(word, ' ' ORDER BY w.i) FILTER (m.i IS NULL) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d) w LEFT JOIN m USING (doc_id, i) GROUP BY w.doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

#: One row with the list of the 256 remainders of crc32, and the crc32 of a list of byte values.
_CRC_TABLE = """SELECT list(list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)"""


def _crc32(values: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, {values}),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""


ORACLES["op11_periodic_runs"] = rf"""
WITH z AS ({_CRC_TABLE}), w AS (
  SELECT doc_id, {_crc32("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)")} AS h,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents, z
), m AS (
  SELECT doc_id, w, len(w) AS n, h, (h // 10) % nullif(len(w), 0) AS a FROM w
), x AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - a) // (3 + (h // 10) % 8) END AS p FROM m
), e AS (
  SELECT doc_id, n, i, w[1 + CASE WHEN p IS NOT NULL AND i >= a THEN a + (i - a) % p ELSE i END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM x)
), s AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM (
    SELECT l.doc_id, r.i - l.i AS q, l.i FROM e l JOIN e r ON l.doc_id = r.doc_id AND l.word = r.word AND r.i > l.i AND 4 * (r.i - l.i) <= l.n)
), c AS (
  SELECT doc_id, min(i) AS start, count(*) + q AS length, q AS period FROM s GROUP BY doc_id, q, island
  HAVING count(*) + q >= greatest(6, 4 * q)
), r AS (
  SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.doc_id = c.doc_id AND o.period < c.period
    AND o.start <= c.start AND o.start + o.length >= c.start + c.length)
), f AS (
  SELECT doc_id, count(*) AS n_runs,
    sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256,
    first({{'start': start, 'length': length, 'period': period}} ORDER BY length::DOUBLE / period DESC, start, period) AS b
  FROM r GROUP BY doc_id
), g AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS content FROM e ANTI JOIN g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, b.length AS length, b.period AS period,
  1000 * b.length // b.period AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(content, '')) AS collapsed_sha256
FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN k USING (doc_id)
"""

ORACLES["op13_spelling_variants"] = rf"""
WITH RECURSIVE z AS ({_CRC_TABLE}), o AS (
  SELECT doc_id, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS word FROM documents)
), b AS (SELECT doc_id, word, count(*) AS m, hex(encode(doc_id || ':' || word)) AS x FROM o GROUP BY doc_id, word),
h AS (
  SELECT word, m, {_crc32("list_transform(range(0, len(x), 2), lambda i: ('0x' || substr(x, i + 1, 2))::BIGINT)")} AS h FROM b, z
), v AS (
  SELECT word, sum(m)::BIGINT AS n FROM (
    SELECT m, CASE WHEN h % 97 = 0 THEN substr(word, 1, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word FROM h
  ) GROUP BY word HAVING length(word) >= 5 AND sum(m) >= 3
), c AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
d AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM c),
g AS (SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS cut FROM c),
l AS (SELECT d.word AS longer, d.n AS longer_n, v.word AS shorter, v.n AS shorter_n FROM d JOIN v ON d.cut = v.word),
p AS (
  SELECT longer AS word, longer_n AS n, shorter AS near, shorter_n AS near_n FROM l
  UNION ALL SELECT shorter, shorter_n, longer, longer_n FROM l
  UNION ALL SELECT x.word, x.n, y.word, y.n FROM g x JOIN g y ON x.cut = y.cut AND x.i = y.i AND x.word <> y.word
), f AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) FILTER (near_n >= 2 * n) AS form,
    max(near_n) FILTER (near_n >= 2 * n) AS form_n FROM p GROUP BY word
), r AS (
  SELECT word, word AS root, 0 AS step FROM v UNION ALL SELECT r.word, f.form, step + 1 FROM r JOIN f ON f.word = r.root AND f.form IS NOT NULL
), t AS (SELECT word, first(root ORDER BY step DESC) AS root FROM r GROUP BY word)
SELECT v.word, f.form, t.root, v.n, coalesce(f.n_near, 0) AS n_near, f.form_n FROM v LEFT JOIN f USING (word) JOIN t USING (word)
"""
