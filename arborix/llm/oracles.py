"""DuckDB SQL for the queries that SQL can express: the definitions, written once more without the operators' methods.

Fingerprints (op1), the hashed slots (op3), tokenizers (op4) and the network
(op7) have none; their tests hold them against brute force or the library.
"""

from __future__ import annotations

from .lines import SIXTEENTHS
from .mixing import ROUNDS
from .quality import FUNCTION_WORDS, RULES
from .substring import WINDOW

SPACE = "[\\x20\\x09-\\x0D]+"
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda x: x <> '')"


def crc32(text: str) -> str:
    """CRC-32 of a short ASCII text, bit by bit."""
    step = "list_reduce(list_prepend(xor(acc, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda h, z: CASE WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda acc, x: {step}), 4294967295)"


MIXING = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, len({WORDS}) AS n_tokens,
    CASE WHEN contains(coalesce(text, ''), '```') THEN 'code' WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(coalesce(text, ''), 'http') THEN 'web' WHEN contains(coalesce(text, ''), '?') THEN 'question' WHEN regexp_matches(coalesce(text, ''), '[0-9]') THEN 'figures' ELSE 'prose' END AS topic,
    CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':17'), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM documents),
  cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL),
  total AS (SELECT sum(tokens) AS total FROM cells),
  shares AS (SELECT 0 AS dim, source AS v, pow(sum(tokens) / any_value(total), 0.7) AS s FROM cells, total GROUP BY source UNION ALL SELECT 1, lang, pow(sum(tokens) / any_value(total), 0.7) FROM cells, total GROUP BY lang UNION ALL SELECT 2, topic, pow(sum(tokens) / any_value(total), 0.7) FROM cells, total GROUP BY topic),
  want AS MATERIALIZED (SELECT dim, v, s / sum(s) OVER (PARTITION BY dim) AS want FROM shares),
  rake AS (SELECT 0 AS it, source, lang, topic, tokens, CAST(1.0 AS DOUBLE) AS w FROM cells UNION ALL
    SELECT it + 1, source, lang, topic, tokens, w * want * total / sum(tokens * w) OVER (PARTITION BY v) FROM rake JOIN want ON dim = it % 3 AND v = CASE it % 3 WHEN 0 THEN source WHEN 1 THEN lang ELSE topic END, total WHERE it < {3 * ROUNDS}),
  r AS (SELECT *, sum(tokens) OVER o AS full_tokens, lead(w) OVER o AS below, sum(tokens * w) OVER () - sum(tokens * w) OVER o AS rest FROM rake WHERE it = {3 * ROUNDS} WINDOW o AS (ORDER BY w DESC, source, lang, topic)),
  c AS (SELECT 0.75 * total / (SELECT sum(tokens * w) FROM r) AS c, (SELECT max(w) FROM r) AS peak, 0.0 AS above FROM total UNION ALL SELECT (0.75 * total - full_tokens) / rest, below, w FROM r, total WHERE below IS NOT NULL),
  k AS (SELECT min(c) AS c FROM c WHERE c * peak <= 1 + 1e-12 AND (above = 0 OR c * above >= 1 - 1e-12)),
  p AS (SELECT source, lang, topic, least(1.0, w * c) AS p FROM r, k)
  SELECT doc_id, source, lang, topic, n_tokens, u < p AS kept FROM d JOIN p USING (source, lang, topic)"""

LINES = f"""WITH l AS (SELECT doc_id, text, md5(coalesce(text, '')) AS key, i, ls[i] AS line FROM (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
  m AS MATERIALIZED (SELECT *, trim(line, {BLANKS}) <> '' AS ok, sum(CASE WHEN trim(line, {BLANKS}) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM l),
  w AS MATERIALIZED (SELECT doc_id, key, CAST(k AS INTEGER) AS k, line, md5(line) AS h, count(*) OVER (PARTITION BY doc_id) AS n FROM m WHERE ok),
  e AS (SELECT doc_id, key, k, n, k = n - 1 OR substr(md5(coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY k), '') || h), 1, 1) < '{"0123456789abcdefg"[SIXTEENTHS]}' AS mark FROM w),
  b AS (SELECT doc_id, key, k AS last, coalesce(lag(k) OVER o + 1, 0) AS first, CAST(row_number() OVER o AS INTEGER) - 1 AS c FROM e WHERE mark WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
  x AS (SELECT *, lead(last) OVER o AS last1, lead(last, 2) OVER o AS last2, lead(last, 3) OVER o AS last3, lag(first) OVER o AS first1, lag(first, 2) OVER o AS first2 FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY c)),
  y AS (SELECT doc_id, key, c, first, CASE WHEN last > first THEN last ELSE last1 END AS last, CASE WHEN last > first THEN last1 ELSE last2 END AS next1, CASE WHEN last > first THEN last2 ELSE last3 END AS next2, first1, first2 FROM x),
  a AS (SELECT doc_id, list(line ORDER BY k) AS ls FROM w GROUP BY doc_id),
  u AS MATERIALIZED (SELECT y.doc_id, key, c, first, last, array_to_string(ls[first + 1:last + 1], chr(10)) AS body,
      CASE WHEN c = 0 THEN [] ELSE list_reverse(ls[CASE WHEN first1 = first - 1 THEN coalesce(first2, first1) ELSE first1 END + 1:first]) END AS before,
      CASE WHEN next1 IS NULL THEN [] ELSE ls[last + 2:CASE WHEN next1 = last + 1 THEN coalesce(next2, next1) ELSE next1 END + 1] END AS after FROM y JOIN a USING (doc_id) WHERE last IS NOT NULL),
  f AS (SELECT *, first_value(before) OVER o AS before0, first_value(after) OVER o AS after0, row_number() OVER o AS k FROM u WINDOW o AS (PARTITION BY body ORDER BY doc_id, key, c)),
  g AS (SELECT doc_id, first, last, len(list_filter(range(1, least(len(before), len(before0)) + 1), lambda i: before[1:i] = before0[1:i])) AS back, len(list_filter(range(1, least(len(after), len(after0)) + 1), lambda i: after[1:i] = after0[1:i])) AS onward FROM f WHERE k > 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(first - back, last + onward + 1)) AS k FROM g)
  SELECT m.doc_id, CASE WHEN any_value(m.text) IS NULL THEN 0 ELSE count(*) END AS n_lines, count(gone.k) AS n_removed, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone.k IS NULL), '')) AS kept_md5 FROM m LEFT JOIN gone ON gone.doc_id = m.doc_id AND gone.k = m.k GROUP BY m.doc_id"""

_discounts = lambda n: ", ".join(
    f"CASE WHEN {n}1 = 0 OR {n}2 = 0 THEN 0.5 ELSE least({top}, greatest(0.05, {value})) END AS {n}d{k}"
    for k, (top, value) in enumerate(((0.95, f"1 - 2 * {n}y * {n}2 / {n}1"), (1.9, f"2 - 3 * {n}y * {n}3 / {n}2"), (2.85, f"CASE WHEN {n}3 > 0 THEN 3 - 4 * {n}y * {n}4 / {n}3 ELSE 0 END")), 1)
)
_counts = lambda n, c: ", ".join(f"CAST(count(*) FILTER (WHERE {c} = {k}) AS DOUBLE) AS {n}{k}" for k in (1, 2, 3, 4))
_taken = lambda n, c: f"(CASE WHEN {c} >= 3 THEN {n}d3 WHEN {c} = 2 THEN {n}d2 WHEN {c} = 1 THEN {n}d1 ELSE 0 END)"

MODEL = f"""WITH d AS (SELECT doc_id, {crc32('CAST(doc_id AS VARCHAR)')} % 7 = 2 AS held_out, list_append(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}'), lambda x: x <> ''), chr(10)) AS ws FROM documents),
  t AS MATERIALIZED (SELECT doc_id, held_out, i, ws[i] AS w, CASE WHEN i = 1 THEN '' ELSE ws[i - 1] END AS a FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM d)),
  uni AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
  bi AS MATERIALIZED (SELECT a, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY a, w),
  before AS (SELECT w, count(*) AS b FROM bi GROUP BY w),
  size AS (SELECT sum(c) AS n, count(*) AS v FROM uni), pairs AS (SELECT count(*) AS pairs FROM bi),
  h AS (SELECT *, h1 / (h1 + 2 * h2) AS hy FROM (SELECT {_counts('h', 'c')} FROM bi)), l AS (SELECT *, l1 / (l1 + 2 * l2) AS ly FROM (SELECT {_counts('l', 'b')} FROM before)),
  hd AS (SELECT {_discounts('h')} FROM h), ld AS (SELECT {_discounts('l')} FROM l),
  spread AS (SELECT sum({_taken('l', 'b')}) / any_value(pairs) AS spread FROM before, ld, pairs),
  after AS (SELECT a, sum(c) AS total, sum({_taken('h', 'c')}) / sum(c) AS gamma FROM bi, hd GROUP BY a),
  p AS (SELECT t.doc_id, t.held_out, uni.c AS c, log10((coalesce(uni.c, 0) + 1) / (n + v + 1)) AS base,
      log10(coalesce((bi.c - {_taken('h', 'bi.c')}) / total, 0) + coalesce(gamma, 1) * ((coalesce(b, 0) - {_taken('l', 'coalesce(b, 0)')}) / pairs + spread / (v + 1))) AS own
    FROM t LEFT JOIN uni ON uni.w = t.w LEFT JOIN before ON before.w = t.w LEFT JOIN bi ON bi.a = t.a AND bi.w = t.w LEFT JOIN after ON after.a = t.a, size, pairs, hd, ld, spread)
  SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, (SELECT CAST(n AS BIGINT) FROM size) AS train_tokens, round(sum(base), 6) AS base_score, round(sum(own), 6) AS score FROM p GROUP BY doc_id"""


def _quality() -> str:
    """Measures by windows and lists, votes, and expectation-maximisation as a recursion over the counts of vote patterns."""
    say = lambda bad, good: f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"
    votes = (
        say("n_words < 50 OR n_words > 1000000", "n_words >= 100"),
        say("n_symbols * 10 > n", "n_symbols * 100 <= n"),
        say("letters * 100 < word_chars * 85", "letters * 100 >= word_chars * 95"),
        say("capitals * 10 > letters * 3", "capitals * 100 <= letters * 15"),
        say("n_repeat_words * 10 > n * 3", "n_repeat_words * 10 <= n"),
        say("variety * variety < 4 * n", "variety * variety >= 25 * n"),
        say("n_dup_lines * 10 > n_lines * 4", "n_dup_lines * 10 <= n_lines"),
        say("functions * 200 < n", "functions * 20 >= n"),
        say("word_chars >= 8 * n OR word_chars * 2 <= 5 * n", "word_chars >= 3 * n AND word_chars < 7 * n"),
    )
    k = len(RULES)
    odds = "ln(good / (1 - good)) + " + " + ".join(f"CASE WHEN v[{i}] < 0 THEN ln(a[{i}] / (1 - b[{i}])) WHEN v[{i}] > 0 THEN ln((1 - a[{i}]) / b[{i}]) ELSE 0 END" for i in range(1, k + 1))
    mass = lambda p, test: f"coalesce(sum({p} * n) FILTER (WHERE {test}), 0)"
    share = lambda p, i, sign, start, low, high: f"least({high}, greatest({low}, ({mass(p, f'v[{i}] {sign} 0')} + 20 * {start}) / ({mass(p, f'v[{i}] <> 0')} + 20)))"
    a = ", ".join(share("p", i, "<", 0.02, 1e-4, 0.5) for i in range(1, k + 1))
    b = ", ".join(share("(1 - p)", i, ">", 0.6, 1e-3, 0.98) for i in range(1, k + 1))
    functions = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(FUNCTION_WORDS)))
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {BLANKS}) <> '') AS ls FROM documents),
  g AS (SELECT doc_id, i, ws[i:i + 2] AS g FROM (SELECT *, unnest(range(1, len(ws) - 1)) AS i FROM d)),
  r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
  c AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM r) GROUP BY doc_id),
  m AS (SELECT d.doc_id, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, greatest(len(ws), 1) AS n,
      len(regexp_replace(t, '\\P{{L}}+', '', 'g')) AS letters, len(regexp_replace(t, '\\P{{Lu}}+', '', 'g')) AS capitals, len(list_distinct(ws)) AS variety, len(ls) AS n_lines, len(list_filter(ws, lambda x: x IN ({functions}))) AS functions FROM d LEFT JOIN c USING (doc_id)),
  q AS MATERIALIZED (SELECT *, [{', '.join(votes)}] AS v FROM m),
  pats AS MATERIALIZED (SELECT v, CAST(count(*) AS DOUBLE) AS n FROM q GROUP BY v),
  em AS (SELECT 0 AS it, 0.85::DOUBLE AS good, list_transform(range({k}), lambda i: 0.02::DOUBLE) AS a, list_transform(range({k}), lambda i: 0.6::DOUBLE) AS b UNION ALL
    SELECT it + 1, (sum(p * n) + 20 * 0.85) / (sum(n) + 20), [{a}], [{b}] FROM (SELECT it, v, n, 1 / (1 + exp(-({odds}))) AS p FROM em, pats WHERE it < 60) GROUP BY it),
  z AS (SELECT q.*, 1 / (1 + exp(-({odds}))) AS p FROM q, (SELECT * FROM em WHERE it = 60))
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND p >= 0.5 AS kept, round(p, 6) AS p_good FROM z"""


REPEATS = f"""WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
  g AS MATERIALIZED (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d)),
  r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
  w AS (SELECT doc_id, i, ws[i] AS w FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM d)),
  c AS (SELECT w.doc_id, w.i, w.w, max(r.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.i = w.i),
  k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
  SELECT d.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, CASE WHEN list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) THEN list_transform(embedding, lambda x: coalesce(CAST(x AS DOUBLE), 0)) ELSE [0.0]::DOUBLE[] END AS e FROM embeddings),
  u AS MATERIALIZED (SELECT vec_id, e, n FROM (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v) WHERE n > 0),
  links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a, u b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / a.n / b.n >= 0.95),
  reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
  c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
  SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id"""

SUFFIXES = """WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS i, hex(encode(coalesce(text, ''))) AS x FROM documents),
  c AS MATERIALIZED (SELECT r, i, o, substr(x, 2 * o + 1, 354) AS y FROM (SELECT r, i, x, unnest(range(0, length(x) // 2 - 49, 128)) AS o FROM d)),
  s AS MATERIALIZED (SELECT r, i, o + p AS p, substr(y, 2 * p + 1, 100) AS s FROM (SELECT r, i, o, y, unnest(range(0, least(128, length(y) // 2 - 49))) AS p FROM c)),
  low AS MATERIALIZED (SELECT s, min(i) AS low FROM s GROUP BY s HAVING min(i) < max(i)),
  b AS (SELECT r, p, coalesce(p > lag(p) OVER (PARTITION BY r ORDER BY p) + 50, true) AS new FROM s JOIN low USING (s) WHERE low < i),
  g AS (SELECT r, p, sum(CAST(new AS INTEGER)) OVER (PARTITION BY r ORDER BY p) AS k FROM b),
  runs AS (SELECT r, min(p) AS a, max(p) + 50 AS e FROM g GROUP BY r, k),
  parts AS (SELECT r, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS f FROM runs),
  cut AS (SELECT r, CAST(sum(e - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(e) AS z, string_agg(substr(x, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) AS kept FROM parts JOIN d USING (r) GROUP BY r)
  SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(CASE WHEN cut.r IS NULL THEN x ELSE kept || substr(x, 2 * z + 1) END)) AS kept_sha256
  FROM d LEFT JOIN cut USING (r)"""

_STEPS = "list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda h, z: CASE WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END)"


def _importance(least: int = 20, percent: int = 5) -> str:
    """CRCs of distinct features by a table of 256 steps, gains of the buckets, and the draw."""
    return f"""WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda v: {_STEPS}) AS tab),
  texts AS (SELECT 0 AS kind, doc_id AS i, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
  d AS MATERIALIZED (SELECT kind, row_number() OVER () AS r, i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM texts),
  t AS (SELECT kind, r, ws[k] AS a, ws[k + 1] AS b, ws[k + 2] AS c FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM d)),
  f AS MATERIALIZED (SELECT kind, r, unnest(list_filter([a, a || ' ' || b, a || ' ' || b || ' ' || c], lambda x: x IS NOT NULL)) AS f FROM t),
  u AS (SELECT DISTINCT f, hex(encode(f)) AS x FROM f),
  crc AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda k: 16 * (strpos('0123456789ABCDEF', x[k]) - 1) + strpos('0123456789ABCDEF', x[k + 1]) - 1)),
    lambda h, z: xor(h >> 8, tab[(xor(h, z) & 255) + 1])), 4294967295) % 10000 AS bucket FROM u, tab),
  g AS MATERIALIZED (SELECT kind, r, bucket FROM f JOIN crc USING (f)),
  n AS (SELECT bucket, CAST(count(*) FILTER (WHERE kind = 0) AS DOUBLE) AS s, CAST(count(*) FILTER (WHERE kind = 1) AS DOUBLE) AS t FROM g GROUP BY bucket),
  z AS (SELECT CAST(count(*) FILTER (WHERE kind = 0) AS DOUBLE) AS zs, CAST(count(*) FILTER (WHERE kind = 1) AS DOUBLE) AS zt FROM g),
  gain AS MATERIALIZED (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (zs + 10000) / ((s + 1) * (zt + 10000)))) AS BIGINT) AS gain FROM n, z),
  w AS (SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM g JOIN gain USING (bucket) WHERE kind = 0 GROUP BY r),
  q AS MATERIALIZED (SELECT i AS doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(i AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM d LEFT JOIN w USING (r) WHERE kind = 0),
  o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {least} ORDER BY score DESC, doc_id NULLS LAST, n_features) AS k, {percent} * count(*) OVER (PARTITION BY n_words >= {least}) // 100 AS m FROM q)
  SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {least} AND k <= m THEN k END AS rank FROM o"""


AUDIT = f"""WITH s AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
  m AS (SELECT part, doc_id, CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * len(t) THEN 'C' ELSE '' END
      || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN coalesce(doc_id, 9223372036854775807) > min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM s),
  l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
  c AS MATERIALIZED (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, fails),
  f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
  o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
  p AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS before FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
  x AS (SELECT part, filter_order, step, f, CAST(sum(n) FILTER (WHERE translate(before || f, fails, '') = before || f) AS BIGINT) AS kept, CAST(sum(n) FILTER (WHERE now AND translate(before, fails, '') = before) AS BIGINT) AS removed,
      CAST(sum(n) FILTER (WHERE now AND translate(before, fails, '') <> before) AS BIGINT) AS redundant, CAST(sum(n) FILTER (WHERE fails = f) AS BIGINT) AS unique_fails,
      CAST(sum(good) FILTER (WHERE now AND translate(before, fails, '') = before) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (WHERE now AND translate(before, fails, '') = before) AS BIGINT) AS toxic_lost
    FROM (SELECT *, contains(fails, f) AS now FROM c, p) GROUP BY part, filter_order, step, f)
  SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
    coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley FROM x"""

ORACLES: dict[str, str] = {"op2_mixing": MIXING, "op5_line_dedup": LINES, "op6_lm": MODEL, "op8_quality": _quality(), "op9_substring": REPEATS, "op10_embedding": VECTORS, "op11_suffix_array": SUFFIXES, "op12_importance": _importance(), "op13_audit": AUDIT}
