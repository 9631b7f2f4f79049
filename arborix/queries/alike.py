"""Likeness of questions and header paths: how many pairs are compared, and SQL of all queries that rest on likeness.

The SQL finds matching blocks by recursion: the longest common substring, then
the same to its left and to its right.  It compares every pair, without bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import likeness, questions
from .base import grid, questions_of_tables, sales_cells
from .hits import _ASKED, _CHUNK
from .retrieval import _TERMS, _bm25_sql

N = 4


def path_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all pairs of a question and a cell's whole path, those that a ranking of four compares, by both likenesses."""
    asked = questions_of_tables(spark, sf_dir).select("query_id", "table_id", questions.terms("question").alias("terms"))
    paths = sales_cells(spark, sf_dir).select("table_id", F.concat("row_path", "col_path").alias("path")).distinct()
    parts = [likeness.pruning(asked, paths, N, by).select(F.lit(by).alias("kind"), "query_id", "n_pairs", "n_scored") for by in likeness.BY]
    return parts[0].unionByName(parts[1])


def ranked_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four cells' paths most like each question, by both likenesses."""
    q = questions_of_tables(spark, sf_dir)
    paths = sales_cells(spark, sf_dir).select("table_id", F.concat("row_path", "col_path").alias("path")).distinct()
    parts = [questions.path_ranking(q, paths, N, by).select(F.lit(by).alias("kind"), "query_id", F.array_join("path", " > ").alias("path"), "rank", F.round("score", 6).alias("score")) for by in likeness.BY]
    return parts[0].unionByName(parts[1])


def _block(a: str, b: str) -> str:
    """[length, -start] of the longest substring of a that b holds, the leftmost of those."""
    longest = f"list_max(list_filter(range(0, length({a}) - i + 2), lambda k: k = 0 OR contains({b}, substr({a}, i, k))))"
    return f"list_max(list_transform(range(1, length({a}) + 1), lambda i: [{longest}, -i]))"


#: seg: matching blocks of the distinct texts of pairs (a, b); alike (a, b, ratio).
_ALIKE = f"""texts AS (SELECT DISTINCT a, b FROM pairs), seg(a0, b0, a, b, t) AS (SELECT a, b, a, b, {_block('a', 'b')} FROM texts
   UNION ALL SELECT a0, b0, x.a, x.b, {_block('x.a', 'x.b')} FROM (SELECT a0, b0, unnest([{{'a': substr(a, 1, -t[2] - 1), 'b': substr(b, 1, j - 1)}}, {{'a': substr(a, -t[2] + t[1]), 'b': substr(b, j + t[1])}}]) AS x
     FROM (SELECT *, strpos(b, substr(a, -t[2], t[1])) AS j FROM seg WHERE t[1] > 0)) WHERE x.a <> '' AND x.b <> ''),
 alike AS (SELECT a0 AS a, b0 AS b, 2::DOUBLE * sum(t[1])::DOUBLE / (length(a0) + length(b0)) AS ratio FROM seg GROUP BY a0, b0)"""
_SCORE = "0.7::DOUBLE * ns / greatest(nf, 1) + 0.3::DOUBLE * {}"
_STORE = f"list_sort(list_distinct(regexp_extract_all(lower(array_to_string({_TERMS}, ' ')), '[a-z0-9]+')))"
_LISTED = f"list_sort(list_distinct({_TERMS}))"
_NAMED = "list_sort(list_distinct(regexp_extract_all(lower(array_to_string(path, ' > ')), '[\\p{L}\\p{N}]+')))"
_SAID = "regexp_extract_all(lower(array_to_string(path, ' ')), '[a-z0-9]+')"


def _pairs(paths: str) -> str:
    """CTEs up to pairs (kind, axis, query_id, table_id, path, a, b, ns, nf, longest) of the CTE paths (axis, table_id, path)."""
    return f"""{_ASKED}, {paths},
 q AS (SELECT 'store' AS kind, query_id, table_id, {_STORE} AS aw FROM asked UNION ALL SELECT 'decomposer', query_id, table_id, {_LISTED} FROM asked),
 p AS (SELECT 'store' AS kind, axis, table_id, path, {_SAID} AS said FROM paths UNION ALL SELECT 'decomposer', axis, table_id, path, {_NAMED} FROM paths),
 met AS (SELECT kind, axis, query_id, table_id, path, array_to_string(aw, ' ') AS a, array_to_string(said, ' ') AS b, list_filter(aw, lambda w: list_contains(said, w)) AS shared, CASE kind WHEN 'store' THEN len(aw) ELSE len(said) END AS nf FROM q JOIN p USING (kind, table_id) WHERE len(aw) > 0 AND len(said) > 0),
 pairs AS (SELECT *, len(shared) AS ns, list_max(list_transform(shared, lambda w: length(w))) AS longest FROM met WHERE {{keep}})"""


def _sql(paths: str, keep: str, rest: str) -> str:
    return grid("+ " + _pairs(paths).replace("{keep}", keep) + ", " + rest).replace("WITH ", "WITH RECURSIVE ", 1)


_RANKED = f"""{_ALIKE}, ranked AS (SELECT *, row_number() OVER (PARTITION BY kind, axis, query_id ORDER BY score DESC, key) AS rank
   FROM (SELECT kind, axis, query_id, table_id, path, array_to_string(path, ' > ') AS key, {_SCORE.format('ratio')} AS score FROM pairs JOIN alike USING (a, b)) WHERE score > 0)"""
_AXES = "paths AS (SELECT DISTINCT 'col' AS axis, table_id, col_path AS path FROM cells UNION ALL SELECT DISTINCT 'row', table_id, row_path FROM cells)"
_WHOLE = "paths AS (SELECT DISTINCT 'cell' AS axis, table_id, list_concat(row_path, col_path) AS path FROM cells)"
_NODES = "paths AS (SELECT DISTINCT 'row' AS axis, table_id, row_path[1:k] AS path FROM cells, (SELECT unnest([1, 2]) AS k) WHERE k <= len(row_path))"
_WORDS_ONLY = "kind = 'store' AND len(shared) > 0"
#: The first two paths of each axis of each question, or an empty one where an axis has none.
_OPERANDS = """few AS (SELECT axis, query_id, path, score FROM ranked WHERE rank <= 2 UNION ALL SELECT x.axis, a.query_id, []::VARCHAR[], 0 FROM asked a, (SELECT unnest(['row', 'col']) AS axis) x WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.axis = x.axis AND r.query_id = a.query_id)),
 ops AS (SELECT r.query_id, list_concat(r.path, c.path) AS path, max(greatest(r.score, c.score)) AS s FROM few r JOIN few c ON r.query_id = c.query_id AND r.axis = 'row' AND c.axis = 'col' WHERE len(r.path) + len(c.path) > 0 GROUP BY ALL)"""
_WORDS_OF = "list_filter(string_split_regex(lower(array_to_string({}, ' ')), '[^a-z0-9]+'), lambda w: w <> '')"
_COVERED = "len(list_filter(want, lambda w: NOT list_contains(toks, w))) = 0"
_LETTER_SUM = " + ".join([f"least(length(a) - length(replace(a, '{x}', '')), length(b) - length(replace(b, '{x}', '')))" for x in likeness.LETTERS] + [f"least(length(translate(a, '{likeness.LETTERS}', '')), length(translate(b, '{likeness.LETTERS}', '')))"])

SQL = {
    "resolved_paths": _sql(_AXES, _WORDS_ONLY, f"""{_RANKED}, said AS (SELECT query_id, string_agg(key, '|' ORDER BY rank) FILTER (WHERE axis = 'col' AND rank <= 3) AS cols, string_agg(key, '|' ORDER BY rank) FILTER (WHERE axis = 'row' AND rank <= 4) AS rows_ FROM ranked GROUP BY query_id)
      SELECT query_id, coalesce(cols, '') AS col_paths, coalesce(rows_, '') AS row_paths FROM asked LEFT JOIN said USING (query_id)"""),
    "decomposed_operands": _sql(_AXES, _WORDS_ONLY, f"{_RANKED}, {_OPERANDS} SELECT query_id, array_to_string(path, ' > ') AS path FROM ops"),
    "operand_confidence": _sql(_AXES, _WORDS_ONLY, f"{_RANKED}, {_OPERANDS} SELECT query_id, round(coalesce(avg(s), 0.0), 6) AS confidence FROM asked LEFT JOIN ops USING (query_id) GROUP BY query_id"),
    "resolver_modes": _sql(_NODES, _WORDS_ONLY, f"""{_RANKED}, w AS (SELECT query_id, least(count(*), 3) AS n FROM ranked GROUP BY query_id), every AS (SELECT query_id, count(*) AS n FROM asked JOIN paths USING (table_id) GROUP BY query_id),
      other AS (SELECT every.* FROM every ANTI JOIN w USING (query_id)),
      modes AS (SELECT 'lexical' AS mode, * FROM w UNION ALL SELECT 'embed', query_id, least(n, 3) FROM every UNION ALL SELECT 'cross', query_id, least(n, 2) FROM every UNION ALL SELECT 'mixed', query_id, least(n, 3) FROM every
        UNION ALL SELECT 'cascade', * FROM w UNION ALL SELECT 'cascade', query_id, least(n, 2) FROM other UNION ALL SELECT 'cross_cascade', * FROM w UNION ALL SELECT 'cross_cascade', query_id, least(n, 2) FROM other)
      SELECT mode, query_id, n, n AS last FROM modes"""),
    "decomposition_accuracy": _sql(_WHOLE, "kind = 'decomposer'", f"""{_RANKED} SELECT query_id, coalesce(max(CASE WHEN path = ['ASIA', '1995', 'A'] THEN 1.0::DOUBLE END), 0.0::DOUBLE) AS accuracy FROM asked LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) USING (query_id) GROUP BY query_id"""),
    "operand_retrieval": _sql(_AXES, _WORDS_ONLY, f"""{_RANKED}, {_OPERANDS}, {_CHUNK}, asked1 AS (SELECT 'plain' AS mode, query_id AS owner, table_id, question FROM asked UNION SELECT 'operand', query_id, table_id, array_to_string(ops.path, ' ') FROM ops JOIN asked USING (query_id)),
      probes AS (SELECT *, mode || '|' || owner || '|' || question AS query_id FROM asked1), {_bm25_sql('chunks', 'chunk_id', 'probes', part='table_id')},
      best AS (SELECT mode, owner, chunk_id, max(score) AS score FROM scores JOIN probes USING (query_id) GROUP BY ALL), top AS (SELECT *, row_number() OVER (PARTITION BY mode, owner ORDER BY round(score, 6) DESC, chunk_id) AS place FROM best),
      gold AS (SELECT query_id, mode, chunk_id, k FROM asked JOIN cells USING (table_id) JOIN chunks USING (table_id, r), (SELECT unnest(['plain', 'operand']) AS mode), (SELECT unnest([1, 3, 5]) AS k) WHERE r = c AND r < 4),
      per AS (SELECT gold.mode, k, query_id, avg(CASE WHEN place <= k THEN 1 ELSE 0 END) AS recall FROM gold LEFT JOIN top ON top.owner = gold.query_id AND top.mode = gold.mode AND top.chunk_id = gold.chunk_id GROUP BY gold.mode, k, query_id)
      SELECT mode, k, count(*) AS n, round(avg(recall), 6) AS recall FROM per GROUP BY mode, k"""),
    "fallback_contexts": _sql(_AXES, _WORDS_ONLY, f"""{_RANKED}, {_OPERANDS}, {_CHUNK}, {_bm25_sql('chunks', 'chunk_id', 'asked', part='table_id')},
      hits AS (SELECT query_id, table_id, r, chunk_id, text, place, {_WORDS_OF.format('h.row_path')} AS toks FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS place FROM scores) JOIN chunks USING (chunk_id) JOIN (SELECT DISTINCT table_id, r, row_path FROM cells) h USING (table_id, r) WHERE place <= 5),
      done AS (SELECT query_id, s, EXISTS (SELECT 1 FROM hits WHERE hits.query_id = ops.query_id AND {_COVERED}) AS ok FROM (SELECT query_id, s, {_WORDS_OF.format('path')} AS want FROM ops) ops),
      reports AS (SELECT query_id, avg(CAST(ok AS INTEGER)) < 0.7 OR avg(s) < 0.3 AS fallback FROM done GROUP BY query_id),
      chosen AS (SELECT query_id, place, text FROM hits JOIN reports USING (query_id) WHERE NOT fallback UNION ALL SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY c.r), c.text FROM (SELECT DISTINCT query_id, table_id FROM hits) JOIN reports USING (query_id) JOIN chunks c USING (table_id) WHERE fallback),
      spent AS (SELECT query_id, place, greatest(1, length(text) // 4) AS tokens FROM chosen), used AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY place) AS used FROM spent)
      SELECT query_id, count(*) AS n_chunks, CAST(sum(tokens) AS BIGINT) AS tokens FROM used WHERE used <= 4096 OR place = 1 GROUP BY query_id"""),
    "ranked_cells": _sql(_WHOLE, "kind = 'decomposer' OR len(shared) > 0", f"{_RANKED} SELECT kind, query_id, key AS path, rank, round(score, 6) AS score FROM ranked WHERE rank <= {N}"),
    "path_candidates": _sql(_WHOLE, "true", f"""bound AS (SELECT kind, query_id, ns, {_SCORE.format(f"CASE WHEN ns > 0 AND length(b) < {likeness.LONG} THEN 2::DOUBLE * longest / (length(a) + length(b)) ELSE 0 END")} AS low, {_SCORE.format(f"(2::DOUBLE * ({_LETTER_SUM}) / (length(a) + length(b)))")} AS high FROM pairs),
      floors AS (SELECT kind, query_id, low AS floor FROM (SELECT *, row_number() OVER (PARTITION BY kind, query_id ORDER BY low DESC) AS k FROM bound WHERE ns > 0) WHERE k = {N})
      SELECT kind, query_id, count(*) AS n_pairs, count(*) FILTER (WHERE (ns > 0 OR (kind = 'decomposer' AND high > 0)) AND high >= coalesce(floor, 0) - {likeness.SLACK}) AS n_scored FROM bound LEFT JOIN floors USING (kind, query_id) GROUP BY kind, query_id"""),
}
QUERIES = {f.__name__: f for f in (path_candidates, ranked_cells)}
