"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op7_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
five AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g FROM five),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n >= 2),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM dup, (VALUES (0), (1), (2), (3), (4)) v(k) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dl AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words,
    length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(regexp_extract_all(t, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]')) AS n_unspaced
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN dl ON dl.doc_id = w.doc_id),
b AS (SELECT *,
    CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 2 * n_symbols > word_chars THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 8 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN n_words > 0 AND word_chars > 100 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 32 ELSE 0 END + CASE WHEN 3 * n_dup_lines > n_lines THEN 64 ELSE 0 END
    + CASE WHEN n_words > 0 AND 2 * n_unspaced <= word_chars AND (word_chars < 3 * n_words OR word_chars > 10 * n_words)
      THEN 128 ELSE 0 END AS fail_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept,
  CAST(n_lines AS BIGINT) AS n_lines, CAST(fail_bits AS BIGINT) AS fail_bits
FROM b
"""

SQL["op3_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
  count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

SQL["op1_chat_formatting"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos,
    (strlen(text) + 3) // 4 + 4 AS tok,
    24 + length(role) + length(regexp_replace(text,
      '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])', '\1\\\2\3', 'g')) AS f FROM c),
p AS (SELECT *, CAST(sum(tok) OVER (PARTITION BY conv_id ORDER BY pos) AS BIGINT) AS e FROM t),
s AS (SELECT conv_id, tok AS st, f AS sf FROM p WHERE pos = 0 AND role = 'system'),
x AS (SELECT p.*, e - tok AS b, greatest(768 - coalesce(st, 0), 128) AS room FROM p LEFT JOIN s ON s.conv_id = p.conv_id),
y AS (SELECT *, (b // room) * 2 + CASE WHEN e > (b // room + 1) * room THEN 1 ELSE 0 END AS win FROM x),
w AS (SELECT conv_id, win, min(pos) AS fp, min(b) AS wb FROM y GROUP BY conv_id, win),
h AS (SELECT w.conv_id, sum(f) AS n FROM w JOIN y ON y.conv_id = w.conv_id AND w.wb >= y.e AND w.wb <= y.b + 256
  WHERE NOT (y.pos = 0 AND y.role = 'system') GROUP BY w.conv_id),
z AS (SELECT w.conv_id, sum(sf) AS n FROM w JOIN s ON s.conv_id = w.conv_id WHERE fp > 0 GROUP BY w.conv_id),
k AS (SELECT conv_id, count(*) AS n_windows FROM w GROUP BY conv_id),
g AS (SELECT conv_id, count(*) AS n_turns, sum(f) AS f,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS target FROM y GROUP BY conv_id)
SELECT g.conv_id, n_turns, turns_sha256, length(target) AS loss_chars, sha256(target) AS loss_sha256,
  CAST(g.f + coalesce(h.n, 0) + coalesce(z.n, 0) AS BIGINT) AS formatted_chars, n_windows
FROM g JOIN k ON k.conv_id = g.conv_id LEFT JOIN h ON h.conv_id = g.conv_id LEFT JOIN z ON z.conv_id = g.conv_id
"""


def _either_case(words: str) -> str:
    """The pattern with both cases of each letter (outside of escapes)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def _secret_kind(name: str, kind: int, pattern: str, keep: str) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""
{name}_m AS (SELECT doc_id, regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS g FROM d
  WHERE regexp_matches(t, {p})),
{name}_i AS (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM {name}_m),
{name} AS (SELECT doc_id, {kind} AS kind, m[i] AS v, length(array_to_string(g[1:i], ''))
    + CASE WHEN i > 1 THEN length(array_to_string(m[1:i-1], '')) ELSE 0 END AS b FROM {name}_i WHERE {keep.format(p=p)})"""


_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
_SECRET_KINDS = ",".join((
    _secret_kind("assign", 0, "(" + _either_case("password|passwd|secret|token|api_?key") + ")" + _VALUE + r"([A-Za-z0-9+/_.=-]+)",
                 "length(regexp_extract(m[i], {p}, 2)) >= 6"),
    _secret_kind("access", 1, "AKIA[A-Z0-9]+", "length(m[i]) >= 20"),
    _secret_kind("hex", 2, "[0-9a-f]+", "length(m[i]) >= 24"),
    _secret_kind("account", 3, "(?:" + _either_case("user_?name|user_?id|login|client_?id|access_?key_?id|account_?id") + ")"
                 + _VALUE + r"[A-Za-z0-9_.@+-]{3,}", "true"),
    _secret_kind("random", 4, "[A-Za-z0-9+/_-]{20,}={0,2}", "regexp_matches(m[i], '[a-z]') "
                 "AND regexp_matches(m[i], '[A-Z]') AND regexp_matches(m[i], '[0-9]')"),
    _secret_kind("endpoint", 5, "(?:https?|s3|ftp|amqps?|redis|mongodb|mysql|postgres|postgresql)://[A-Za-z0-9_.:@/?&=%+-]+", "true"),
))
SQL["op2_secret_scan"] = "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)," + _SECRET_KINDS + r""",
a AS (SELECT doc_id, kind, b, b + length(v) AS e FROM (SELECT * FROM assign UNION ALL SELECT * FROM access
  UNION ALL SELECT * FROM hex UNION ALL SELECT * FROM account UNION ALL SELECT * FROM random UNION ALL SELECT * FROM endpoint)),
n AS (SELECT a.doc_id, a.kind, a.b, a.e, bool_or(o.kind IN (1, 3)) AS acc, bool_or(o.kind IN (0, 2, 4)) AS sec
  FROM a JOIN a o ON o.doc_id = a.doc_id AND abs(o.b - a.b) <= 400 GROUP BY ALL),
r AS (SELECT doc_id, kind, b, e FROM n WHERE kind < 3 OR (kind = 3 AND sec) OR (kind = 4 AND acc) OR (kind = 5 AND acc AND sec)),
s AS (SELECT doc_id, kind, b, (['assign', 'access', 'hex', 'linked_account', 'linked_random', 'linked_endpoint'])[kind + 1]
  || ':' || b || ':' || e AS x FROM r),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
    count(*) FILTER (kind = 2) AS n_hex, string_agg(x, ',' ORDER BY b, kind) FILTER (kind < 3) AS base,
    string_agg(x, ',' ORDER BY b, kind) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""

SQL["op4_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l0 AS (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) - 1 AS line FROM d),
l1 AS (SELECT doc_id, x, line, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM l0),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS pos,
    sum(w) OVER (PARTITION BY doc_id ORDER BY line) AS cw FROM l1 WHERE w > 0),
run AS (SELECT a.doc_id, a.pos, min(b.pos) AS last FROM l a JOIN l b
  ON b.doc_id = a.doc_id AND b.pos >= a.pos AND b.pos < a.pos + 50 AND b.cw - a.cw + a.w >= 50 GROUP BY a.doc_id, a.pos
  UNION SELECT a.doc_id, max(b.pos), a.pos FROM l a JOIN l b
  ON b.doc_id = a.doc_id AND b.pos <= a.pos AND b.pos > a.pos - 50 AND a.cw - b.cw + b.w >= 50 GROUP BY a.doc_id, a.pos
  UNION SELECT a.doc_id, b.pos, b.pos + 1 FROM l a JOIN l b ON b.doc_id = a.doc_id AND b.pos IN (a.pos - 1, a.pos)
  JOIN l c ON c.doc_id = b.doc_id AND c.pos = b.pos + 1 WHERE a.w >= 50),
txt AS (SELECT r.doc_id, r.pos, r.last, string_agg(l.x, chr(10) ORDER BY l.pos) AS g
  FROM run r JOIN l ON l.doc_id = r.doc_id AND l.pos BETWEEN r.pos AND r.last GROUP BY r.doc_id, r.pos, r.last),
f AS (SELECT *, first_value(doc_id) OVER q AS fd, first_value(pos) OVER q AS fp FROM txt
  WINDOW q AS (PARTITION BY g ORDER BY doc_id, pos)),
gone AS (SELECT DISTINCT l0.doc_id, l0.line FROM f
  JOIN l a ON a.doc_id = f.doc_id AND a.pos = f.pos JOIN l b ON b.doc_id = f.doc_id AND b.pos = f.last
  JOIN l0 ON l0.doc_id = f.doc_id AND l0.line BETWEEN a.line AND b.line
  WHERE f.fd <> f.doc_id OR f.fp + (f.last - f.pos + 1) <= f.pos),
isl AS (SELECT doc_id, min(line) AS a, max(line) AS b FROM (SELECT doc_id, line,
  line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM gone) GROUP BY doc_id, k),
runs AS (SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS deleted, sum(b - a + 1) AS n FROM isl GROUP BY doc_id),
stay AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY line) AS clean FROM l0 ANTI JOIN gone USING (doc_id, line) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(a) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_deleted,
  coalesce(deleted, '') AS deleted, sha256(coalesce(clean, '')) AS clean_sha256
FROM d LEFT JOIN runs ON runs.doc_id = d.doc_id LEFT JOIN stay ON stay.doc_id = d.doc_id
"""

SQL["op10_near_dedup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 4)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id,
  coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id
"""

SQL["op11_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(s, 0) AS s FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS s FROM c GROUP BY ALL) USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
    CAST(1 + (1000000000 * (coalesce(n, 0) + 2)) // (g.s + 2 * g.v) AS BIGINT) AS p
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT lang, sum(s) AS s, max(v) AS v FROM g GROUP BY lang),
q AS (SELECT c.lang, c.term, CAST(1 + (1000000000 * (sum(n) + 2)) // (max(l.s) + 2 * max(l.v)) AS BIGINT) AS q
  FROM c JOIN l ON l.lang = c.lang GROUP BY ALL),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 10
"""
