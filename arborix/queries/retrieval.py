"""Queries of questions, scores, scopes and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import linking, questions, scope, scoring, texts
from .base import QUESTIONS, grid, literal, literal_sql, phrased, phrased_sql, questions_of_tables, sales_cells, table


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def question_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = phrased(spark, sf_dir, QUESTIONS, "question")
    t = q.withColumn("kind", questions.query_type("question"))
    return t.select("id", "kind", questions.needs_symbolic("kind").alias("symbolic"), F.array_join(questions.stages("kind"), ",").alias("stages"), questions.answer_strategy("kind").alias("strategy"), questions.route("question").alias("route"), questions.is_ratio("question").alias("ratio"), questions.is_comparison("question").alias("comparison"))


def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = phrased(spark, sf_dir, QUESTIONS, "question")
    return q.select("id", F.array_join(questions.terms("question"), " ").alias("terms"), questions.expansion("question").alias("expansion"), questions.with_totals("question", True).alias("rewritten"))


def compared_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrased(spark, sf_dir, QUESTIONS, "question").select("id", F.array_join(questions.compared_spans("question"), "|").alias("spans"))


def message_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of question types, routes and spans over every turn of the conversations."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("question"))
    kind = questions.query_type("question")
    return t.select("conv_id", "turn", kind.alias("kind"), questions.needs_symbolic(kind).alias("symbolic"), F.array_join(questions.stages(kind), ",").alias("stages"), questions.answer_strategy(kind).alias("strategy"), questions.route("question").alias("route"), questions.is_ratio("question").alias("ratio"), questions.is_comparison("question").alias("comparison"))


def passage_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header terms, their expansion and compared spans of every benchmark passage."""
    t = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    return t.select("item_id", F.array_join(questions.terms("question"), " ").alias("terms"), questions.expansion("question").alias("expansion"), questions.with_totals("question", True).alias("rewritten"), F.array_join(questions.compared_spans("question"), "|").alias("spans"))


def difficulty_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of parts: their type's words as aggregation labels, their name as a formula."""
    p = table(spark, sf_dir, "part")
    kinds = F.array(F.lit("sum"), F.lit("argmax"), F.lit("opposite"), F.lit("none"), F.lit("pair-argmax"))
    formula = F.concat(F.lit("=A1"), F.when(F.col("p_size") % 3 == 0, "+B1").otherwise(""), F.when(F.col("p_size") % 4 == 0, "/C1").otherwise(""))
    t = p.select("p_partkey", F.array(F.get(kinds, (F.col("p_partkey") % 5).cast("int"))).alias("a"), F.array(formula).alias("f"))
    return t.select("p_partkey", questions.difficulty("a", "f").alias("class"), questions.formula_route("f").alias("route"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.compact_rows(sales_cells(spark, sf_dir)).select("chunk_id", "table_id", "text", "rows", "cols")


def _asked(spark: SparkSession) -> DataFrame:
    return literal(spark, QUESTIONS, "question").select(F.col("id").alias("query_id"), "question")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage against all documents."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scoring.bm25_topk(q, d, 10, key="doc_id").select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


def bm25_within_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions_of_tables(spark, sf_dir)
    s = scoring.bm25(q, _chunks(spark, sf_dir), within=["table_id"])
    return scoring.top_k(s, 3, ["query_id"], "chunk_id").select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all vectors."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    return scoring.dense_topk(q, v, 5, key="vec_id").select("query_id", "vec_id", "rank", F.round("score", 4).alias("score"))


def hashed_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.hashed_topk(_asked(spark), _chunks(spark, sf_dir), 5).select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q, c = _asked(spark), _chunks(spark, sf_dir)
    return scoring.hashed_cosine(q, c), scoring.bm25(q, c).select("query_id", "chunk_id", "score")


def hybrid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = _two(spark, sf_dir)
    h = scoring.hybrid_minmax(d, b, alpha=0.5, n_all=F.lit(_chunks(spark, sf_dir).count()))
    return scoring.top_k(h, 5, ["query_id"], "chunk_id").select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


def rrf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = _two(spark, sf_dir)
    out = [scoring.top_k(scoring.rrf([d, b], base=k), 5, ["query_id"], "chunk_id").select(F.lit(k).alias("base"), "query_id", "chunk_id", "rank", F.round("score", 6).alias("score")) for k in (0, 1)]
    return _union(out)


def table_maxpool(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir)
    s = scoring.bm25(_asked(spark), c).join(c.select("chunk_id", "table_id"), "chunk_id")
    return scoring.ranked(scoring.max_pooled(s), ["query_id"], "table_id").select("query_id", "table_id", "rank", F.round("score", 4).alias("score"))


def table_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir)
    s = scoring.bm25(_asked(spark), c).join(c.select("chunk_id", "table_id"), "chunk_id")
    return scoring.cascade(scoring.max_pooled(s), s, 2, 5).select("query_id", "chunk_id", "rank")


def best_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir)
    s = scoring.bm25(_asked(spark), c).join(c.select("chunk_id", "table_id"), "chunk_id")
    return scoring.best_per_table(s, 8, 2).select("query_id", "table_id", "chunk_id", "rank")


def lexical_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sales_cells(spark, sf_dir).groupBy("table_id", "r").agg(F.first(tx.path_text("row_path")).alias("header"))
    h = questions_of_tables(spark, sf_dir).join(lines, "table_id").select("query_id", "question", F.col("r").alias("i"), "header")
    return scoring.lexical_headers(h, 2).select("query_id", "i", "rank", "overlap")


def label_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.collisions(sales_cells(spark, sf_dir))


def total_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sales_cells(spark, sf_dir)
    return _union([scope.totals(c, d).select(F.lit(d).alias("detector"), "table_id", "r") for d in ("keyword", "structural", "hybrid")])


def row_relatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scope.rows_of(sales_cells(spark, sf_dir))
    return _union([f(rows).select(F.lit(n).alias("kind"), "table_id", "r", "member") for n, f in (("children", scope.children), ("siblings", scope.siblings))])


#: Header queries that scopes are enumerated for (row path, column path).
SCOPES = [(["ASIA"], ["1995"]), (["asia > nation_12"], ["1995 > A"]), (["total"], []), (["nowhere"], ["1996"]), (["EAST"], ["R"]), (["MIDDLE EAST"], ["never"])]


def _scopes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    seg = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("table_id")).distinct()
    none = F.array().cast("array<string>")
    arr = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else none
    every = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), arr(a).alias("rp"), arr(b).alias("cp")) for i, (a, b) in enumerate(SCOPES)])).alias("x")
    q = seg.select("table_id", every).select(F.concat("table_id", F.lit("/"), F.col("x.i").cast("string")).alias("query_id"), "table_id", "x.rp", "x.cp")
    return q, q.select("query_id", "table_id", F.col("rp").alias("path")), q.select("query_id", "table_id", F.col("cp").alias("path"))


def scope_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of enumerated scopes: plain, with totals, with siblings, and with the last column alone."""
    q, rp, cp = _scopes(spark, sf_dir)
    c = sales_cells(spark, sf_dir)
    arms = {"plain": {}, "totals": {"add_totals": True}, "siblings": {"expand": True}, "last": {"col_fallback": "last"}}
    return _union([scope.enumerated(q, rp, cp, c, **k).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("r").cast("long").alias("sum_r"), F.sum("c").cast("long").alias("sum_c"), F.max(F.col("row_fallback").cast("int")).alias("row_fallback"), F.max(F.col("col_fallback").cast("int")).alias("col_fallback")).select(F.lit(a).alias("arm"), "*") for a, k in arms.items()])


def _seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_cells(spark, sf_dir).filter((F.col("r") == F.col("c")) & (F.col("r") > 2)).select(F.concat(F.lit("q"), "table_id").alias("query_id"), "table_id", "r", "c")


def axis_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.axis_complete(_seed(spark, sf_dir), sales_cells(spark, sf_dir)).groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.col("r") * 1000 + F.col("c")).cast("long").alias("mark"))


def injected_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = _seed(spark, sf_dir), sales_cells(spark, sf_dir)
    return _union([scope.injected(s, c, m).groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.col("r") * 1000 + F.col("c")).cast("long").alias("mark")).select(F.lit(m).alias("columns"), "*") for m in ("all", "touched")])


def last_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.last_numeric_column(sales_cells(spark, sf_dir)).select("table_id", F.col("at").alias("last"))


def row_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold rows are every third row; the scope is the rows of ASIA."""
    rows = scope.rows_of(sales_cells(spark, sf_dir))
    q = F.concat("table_id", F.lit("/"), (F.col("r") % 3).cast("string"))
    gold = rows.select(q.alias("query_id"), "table_id", "r")
    have = rows.filter(F.get("row_path", 0) == "ASIA").select(q.alias("query_id"), "table_id", "r")
    return scope.row_failures(gold, have, sales_cells(spark, sf_dir))


def subtables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of tables that questions point to (their size)."""
    return scope.subtable(questions_of_tables(spark, sf_dir), sales_cells(spark, sf_dir)).groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("r").alias("n_rows"), F.count_distinct("c").alias("n_cols"))


def value_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the first column looked up anywhere in the same table, best by header."""
    c = sales_cells(spark, sf_dir)
    op = c.filter("c = 0").select("table_id", F.col("table_id").alias("query_id"), F.col("r").alias("operand"), F.col("num").alias("value"), F.array(F.lower(tx.leaf("row_path"))).alias("row_headers"), F.array(F.lit("a")).alias("col_headers"))
    best = linking.best_candidate(linking.value_candidates(op, c))
    return best.select("table_id", "operand", "r", "c")


def offset_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shift of annotations planted two rows and one column off, pooled by table and by query."""
    c = sales_cells(spark, sf_dir)
    coords = c.filter((F.col("r") + F.col("c")) % 5 == 0).select(F.concat("table_id", F.lit("/"), (F.col("r") % 2).cast("string")).alias("query_id"), "table_id", (F.col("r") + 2).alias("i"), (F.col("c") + 1).alias("j"), F.col("num").alias("value"))
    return linking.pooled_offset(coords, c)


def evidence_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences about two cells of each table, resolved to their places."""
    c = sales_cells(spark, sf_dir)
    said = c.filter("(r = 1 and c = 0) or (r = 2 and c = 1)").select("table_id", "r", F.concat(F.lit("the "), tx.leaf("row_path"), F.lit(" of "), F.array_join("col_path", " "), F.lit(" is "), "raw", F.lit(" ;")).alias("s"))
    texts_ = said.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "s"))), lambda x: x["s"]), " ").alias("evidence")).select(F.col("table_id").alias("query_id"), "table_id", "evidence")
    rows = c.groupBy("table_id", "r").agg(F.first(tx.leaf("row_path")).alias("label")).select("table_id", F.col("r").alias("at"), "label")
    cols = c.groupBy("table_id", "c").agg(F.first(F.array_join("col_path", " ")).alias("label")).select("table_id", F.col("c").alias("at"), "label")
    return linking.evidence_operands(texts_, rows, cols)


def covered_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of diagonal cells by the first three row chunks of each question."""
    q = questions_of_tables(spark, sf_dir)
    ch = _chunks(spark, sf_dir)
    hits = scoring.top_k(scoring.bm25(q, ch, within=["table_id"]), 3, ["query_id"], "chunk_id").select("query_id", "chunk_id", "rank").join(ch, "chunk_id")
    gold = q.select("query_id", "table_id").join(sales_cells(spark, sf_dir).filter("r = c").select("table_id", "r", "c"), "table_id")
    return linking.operand_recall(gold, hits).select("query_id", F.round("recall", 6).alias("recall"))


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sales_cells(spark, sf_dir)
    return linking.attribution(c.select("table_id", F.col("table_id").alias("query_id"), F.concat_ws("_", "r", "c").alias("operand"), F.col("num").alias("value")), c)


def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header paths that questions refer to, by similarity."""
    r = questions.resolved(questions_of_tables(spark, sf_dir), sales_cells(spark, sf_dir))
    say = lambda c: F.array_join(F.transform(c, lambda p: F.array_join(p, " > ")), "|")
    return r.select("query_id", say("col_paths").alias("col_paths"), say("row_paths").alias("row_paths"))


def decomposed_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = questions.resolved(questions_of_tables(spark, sf_dir), sales_cells(spark, sf_dir))
    return questions.decomposed(r).select("query_id", F.array_join("path", " > ").alias("path"))


_Q = literal_sql(QUESTIONS, "question")
_PQ = phrased_sql(QUESTIONS, "question")
_HAS = lambda p, x="q": f"regexp_matches({x}, '(?i){p}')"
_s = lambda p: p.replace("'", "''")
_KIND = f"""CASE WHEN len(q) - len(translate(q, '+-*/', '')) >= 2 OR len(list_distinct(regexp_extract_all(lower(q), '{questions.TRIGGER}', 1))) >= 2 OR {_HAS(questions.MULTI)} THEN 'multi_op_formula'
  WHEN {_HAS(questions.ENTITY)} AND ({_HAS(questions.ARG)} OR {_HAS(questions.PAIR)}) THEN 'single_arg'
  WHEN {_HAS(questions.ARITHMETIC)} OR regexp_matches(regexp_replace(lower(q), '\\btotal\\s+(row|column|col|cell|of\\s+the)', '', 'g'), '\\btotal\\b') THEN 'arithmetic_agg'
  WHEN {_HAS(questions.PAIR)} OR {_HAS(questions.ARG)} THEN 'single_arg'
  WHEN {_HAS(questions.COMPARE)} OR {_HAS(questions.COUNT)} THEN 'comparison_or_count'
  WHEN {_HAS(questions.DEFINITION)} AND NOT {_HAS(questions.TABLE_WORD)} THEN 'reasoning_only' ELSE 'simple_lookup' END"""
_KINDS = f"kinds AS (SELECT id, question, trim(question) AS q, {_KIND} AS kind FROM (SELECT id, question, trim(question) AS q FROM {_PQ}))"
_any = lambda ps: " OR ".join(f"regexp_matches(lower(trim(question)), '{_s(p)}')" for p in ps)
_STOPS = ", ".join(f"'{w}'" for w in [*questions.CUES, *questions.STOP])
_TERMS = rf"""list_filter(list_transform(regexp_extract_all(question, '[A-Za-z][A-Za-z0-9_&$%/\-]+|\d{{4}}'), lambda t: lower(t)), lambda t: regexp_full_match(t, '1[89]\d{{2}}|20\d{{2}}') OR (len(t) >= 3 AND NOT list_contains([{_STOPS}], t)))"""
# list_distinct keeps no order: keep first places
_ONCE = lambda x: f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"
_RATIO = _HAS(r"\b(percent|percentage|share|proportion|fraction|ratio|times|per\b|out of)\b", "question")

_CHUNK = """+ chunks AS (SELECT table_id || '#r' || r AS chunk_id, table_id, r, title || ' | ' || string_agg(array_to_string(list_concat(row_path, col_path), ' > ') || ': ' || raw, ' | ' ORDER BY c) AS text FROM cells GROUP BY table_id, title, r)"""


def _bm25_sql(chunks: str, key: str, asked: str, prefix: str = "", part: str = "") -> str:
    """CTEs that end in scores(query_id, key, score); part names a column that parts the corpus."""
    p, on = (f"{part}, ", f" AND a.{part} = b.{part}") if part else ("", "")
    by = f"PARTITION BY {part}" if part else ""
    group = f"GROUP BY {part}" if part else ""
    join = f"USING ({part})" if part else "ON true"
    return f"""{prefix}tf AS (SELECT {p}{key}, term, count(*) AS tf FROM (SELECT {p}{key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {chunks}) GROUP BY ALL),
 dl AS (SELECT {p}{key}, sum(tf) AS dl FROM tf GROUP BY ALL),
 st AS (SELECT {p}n, length / n AS avgdl FROM (SELECT {p}count(*) AS n FROM {chunks} {group}) JOIN (SELECT {p}sum(tf) AS length FROM tf {group}) {join}),
 raw_idf AS (SELECT {p}term, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT {p}term, count(*) AS df FROM tf GROUP BY ALL) JOIN st {join}),
 idf AS (SELECT {p}term, avgdl, CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER ({by}) ELSE idf END AS idf FROM raw_idf),
 qt AS (SELECT {p}query_id, term, count(*) AS qn FROM (SELECT {p}query_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS term FROM {asked}) GROUP BY ALL),
 scores AS (SELECT query_id, {key}, sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN idf USING ({p}term) JOIN tf USING ({p}term) JOIN dl USING ({p}{key}) GROUP BY ALL)"""


_ASKED = f"asked AS (SELECT id AS query_id, question FROM {_Q})"
_ASKED_T = f"seg AS (SELECT DISTINCT c_mktsegment AS table_id FROM customer), asked AS (SELECT table_id || '/' || id AS query_id, table_id, question FROM seg, {_Q})"
_RANKED = lambda key, src="scores": f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, {key}) AS rank FROM {src})"


def _hash_sql(src: str, key: str, text: str, out: str) -> str:
    return rf""" {out}_t AS (SELECT {key}, CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) % 512 AS b FROM (SELECT {key}, md5(lower(unnest(regexp_extract_all({text}, '[A-Za-z0-9][A-Za-z0-9_&$%/.\-]*')))) AS h FROM {src})),
 {out} AS (SELECT {key}, b, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM (SELECT {key}, b, ln(1 + count(*)) AS w FROM {out}_t GROUP BY ALL))"""


_BOTH = f"{_CHUNK}, {_ASKED}, {_bm25_sql('chunks', 'chunk_id', 'asked')},{_hash_sql('asked', 'query_id', 'question', 'hq')},{_hash_sql('chunks', 'chunk_id', 'text', 'hc')}, dense AS (SELECT query_id, chunk_id, sum(hq.w * hc.w) AS score FROM hq JOIN hc USING (b) GROUP BY ALL)"
_POOL = f"{_CHUNK}, {_ASKED}, {_bm25_sql('chunks', 'chunk_id', 'asked')}, s AS (SELECT scores.*, table_id FROM scores JOIN chunks USING (chunk_id)), pool AS (SELECT query_id, table_id, max(score) AS score FROM s GROUP BY ALL)"

_ROWS = "rows_ AS (SELECT DISTINCT table_id, r, row_path, len(row_path) AS depth, row_path[1:len(row_path)-1] AS parent FROM cells)"
_STRUCT = """num AS (SELECT c.table_id, c.r, c.c, c.num, depth, parent, x.row_path FROM cells c JOIN rows_ x USING (table_id, r)),
 grp AS (SELECT n.table_id, n.parent, n.depth, n.c, sum(num) AS s, any_value(z.n) AS n FROM num n JOIN (SELECT table_id, parent, depth, count(*) AS n FROM rows_ GROUP BY ALL) z USING (table_id, parent, depth) GROUP BY n.table_id, n.parent, n.depth, n.c HAVING count(num) = any_value(z.n)),
 chk AS (SELECT 'sib' AS k, a.table_id, a.r, a.num, g.s - a.num AS s FROM num a JOIN grp g USING (table_id, parent, depth, c) WHERE g.n - 1 >= 2
   UNION ALL SELECT 'chi', a.table_id, a.r, a.num, g.s FROM num a JOIN grp g ON g.table_id = a.table_id AND g.parent = a.row_path AND g.depth = a.depth + 1 AND g.c = a.c WHERE g.n >= 2),
 structural AS (SELECT DISTINCT table_id, r FROM (SELECT k, table_id, r, count(*) AS n, count(*) FILTER (WHERE abs(num - s) <= greatest(abs(num), abs(s), 1.0) * 0.02) AS m FROM chk GROUP BY k, table_id, r) WHERE n >= 2 AND 2 * m >= n),
 keyword AS (SELECT table_id, r FROM rows_ WHERE regexp_matches(row_path[-1], '(?i)\\b(total|overall)\\b|^all\\b')),
 hybrid AS (SELECT * FROM keyword UNION SELECT * FROM structural)"""
_SEED = "seed AS (SELECT 'q' || table_id AS query_id, table_id, r, c FROM cells WHERE r = c AND r > 2)"


def _scope_sql() -> str:
    arr = lambda xs: "[" + ", ".join(f"'{x.lower()}'" for x in xs) + "]::VARCHAR[]"
    vals = ", ".join(f"({i}, {arr(a)}, {arr(b)})" for i, (a, b) in enumerate(SCOPES))
    match = lambda line, q: f"len({line}) > 0 AND len({q}) > 0 AND list_bool_and(list_transform(string_split_regex(array_to_string({q}, ' > '), '\\s*>\\s*'), lambda t: regexp_matches(lower(array_to_string({line}, ' :: ')), '(^|[^A-Za-z0-9])' || t || '([^A-Za-z0-9]|$)')))"
    return f"""+ {_ROWS}, {_STRUCT}, q AS (SELECT DISTINCT table_id || '/' || col0 AS query_id, table_id, col1 AS rp, col2 AS cp FROM cells, (VALUES {vals})),
 mr AS (SELECT DISTINCT query_id, q.table_id, x.r, x.row_path FROM q JOIN rows_ x USING (table_id) WHERE {match('x.row_path', 'rp')}),
 mc AS (SELECT DISTINCT query_id, c.c FROM q JOIN cells c USING (table_id) WHERE {match('c.col_path', 'cp')}),
 arms AS (SELECT unnest(['plain', 'totals', 'siblings', 'last']) AS arm),
 rr AS (SELECT arm, query_id, r FROM mr, arms UNION SELECT 'totals', m.query_id, k.r FROM mr m JOIN keyword k USING (table_id)
   UNION SELECT 'siblings', m.query_id, x.r FROM mr m JOIN rows_ y ON y.table_id = m.table_id AND y.r = m.r AND y.depth >= 2 JOIN rows_ x ON x.table_id = m.table_id AND x.depth >= 2 AND x.parent = y.parent),
 f AS (SELECT arm, query_id, table_id, NOT EXISTS (SELECT 1 FROM mr WHERE mr.query_id = q.query_id) AS rf, NOT EXISTS (SELECT 1 FROM mc WHERE mc.query_id = q.query_id) AS cf FROM q, arms),
 t AS (SELECT f.*, c.r, c.c, max(c.c) OVER (PARTITION BY arm, query_id) AS last FROM f JOIN cells c USING (table_id) WHERE (rf OR EXISTS (SELECT 1 FROM rr WHERE rr.arm = f.arm AND rr.query_id = f.query_id AND rr.r = c.r)) AND (cf OR EXISTS (SELECT 1 FROM mc WHERE mc.query_id = f.query_id AND mc.c = c.c)))
 SELECT arm, query_id, count(*) AS n, CAST(sum(r) AS BIGINT) AS sum_r, CAST(sum(c) AS BIGINT) AS sum_c, CAST(max(CAST(rf AS INTEGER)) AS INTEGER) AS row_fallback, CAST(max(CAST(cf AS INTEGER)) AS INTEGER) AS col_fallback FROM t WHERE arm <> 'last' OR NOT cf OR c = last GROUP BY arm, query_id"""


_TYPES = f"""kind, kind IN ('multi_op_formula', 'arithmetic_agg') AS symbolic,
      CASE WHEN kind = 'reasoning_only' THEN 'llm_answer' WHEN kind IN ('multi_op_formula', 'arithmetic_agg') THEN 'retrieve,symbolic,llm_answer' ELSE 'retrieve,llm_answer' END AS stages,
      CASE WHEN kind IN ('single_arg', 'simple_lookup', 'reasoning_only') THEN 'naive' WHEN kind IN ('arithmetic_agg', 'comparison_or_count') THEN 'sc' ELSE 'grounded' END AS strategy,
      CASE WHEN {_any(questions.ROUTE_COMPARE)} OR {_any(questions.ROUTE_ARITHMETIC)} THEN 'gamma' WHEN {_any(questions.ROUTE_LIST)} THEN 'beta' ELSE 'gamma' END AS route,
      {_RATIO} AS ratio, {_HAS(r'\b(times|ratio|relationship|for every|per\b|compared)\b', 'question')} OR {_HAS(r'\b(vs\.?|versus|between)\b', 'question')} AS comparison"""


def _span_case() -> str:
    clean = lambda k, p: rf"trim(regexp_replace(trim(regexp_extract(question, '{p}', {k}), ' ,.?'), '(?i)^(what|how|the|is|was|are|were|did|do|of)\b\s*', ''))"
    out = "question"
    for p in reversed(questions.SPLITS):
        a, b = clean(1, p), clean(2, p)
        out = f"CASE WHEN regexp_matches(question, '{p}') AND {a} <> '' AND {b} <> '' AND lower({a}) <> lower({b}) THEN {a} || '|' || {b} ELSE {out} END"
    return out


_NUMBERS = r"list_transform(regexp_extract_all(question, '-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+\.?\d*'), lambda x: round(CAST(replace(x, ',', '') AS DOUBLE), 3))"


def _line_count(axis: str, cap: int) -> str:
    return f"CASE WHEN coalesce({axis}.n, 0) = 0 THEN least(s.{axis}_last + 1, {cap}) WHEN {axis}.n = 1 THEN least({axis}.only + 1, s.{axis}_last) - greatest({axis}.only - 1, 0) + 1 ELSE least({axis}.n, {cap}) END"


SQL = {
    "subtables": grid(f"""+ {_ASKED_T}, q AS (SELECT query_id, table_id, {_TERMS} AS kw, {_NUMBERS} AS nums FROM asked), s AS (SELECT table_id, max(r) AS rr_last, max(c) AS cc_last FROM cells GROUP BY table_id),
      rr AS (SELECT query_id, count(DISTINCT r) AS n, min(r) AS only FROM q JOIN cells USING (table_id) WHERE len(list_filter(kw, lambda k: contains(lower(array_to_string(row_path, ' ')), k))) > 0 OR list_contains(nums, round(num, 3)) GROUP BY query_id),
      cc AS (SELECT query_id, count(DISTINCT c) AS n, min(c) AS only FROM q JOIN cells USING (table_id) WHERE len(list_filter(kw, lambda k: contains(lower(array_to_string(col_path, ' ')), k))) > 0 GROUP BY query_id)
      SELECT query_id, n_rows * n_cols AS n, n_rows, n_cols FROM (SELECT q.query_id, {_line_count('rr', 12)} AS n_rows, {_line_count('cc', 10)} AS n_cols FROM q JOIN s USING (table_id) LEFT JOIN rr ON rr.query_id = q.query_id LEFT JOIN cc ON cc.query_id = q.query_id)"""),
    "question_types": f"WITH {_KINDS} SELECT id, {_TYPES} FROM kinds",
    "message_types": f"""WITH kinds AS (SELECT conv_id, turn, question, {_KIND} AS kind FROM (SELECT conv_id, turn, text AS question, trim(text) AS q FROM conversations))
      SELECT conv_id, turn, {_TYPES} FROM kinds""",
    "passage_terms": f"""WITH kinds AS (SELECT item_id, question, {_KIND} AS kind FROM (SELECT item_id, text AS question, trim(text) AS q FROM benchmark)), t AS (SELECT item_id, question, kind, {_ONCE(_TERMS)} AS ts FROM kinds),
      h AS (SELECT *, CASE WHEN kind IN ('arithmetic_agg', 'multi_op_formula') THEN ['total', 'percent'] WHEN kind = 'comparison_or_count' THEN ['total'] ELSE []::VARCHAR[] END AS hs FROM t)
      SELECT item_id, array_to_string(ts, ' ') AS terms, array_to_string(list_concat(ts, list_filter(hs, lambda x: NOT list_contains(ts, x))), ' ') AS expansion, CASE WHEN {_RATIO} THEN question || ' total overall' ELSE question END AS rewritten, {_span_case()} AS spans FROM h""",
    "question_terms": f"""WITH {_KINDS}, t AS (SELECT id, question, kind, {_ONCE(_TERMS)} AS ts FROM kinds),
      h AS (SELECT *, CASE WHEN kind IN ('arithmetic_agg', 'multi_op_formula') THEN ['total', 'percent'] WHEN kind = 'comparison_or_count' THEN ['total'] ELSE []::VARCHAR[] END AS hs FROM t)
      SELECT id, array_to_string(ts, ' ') AS terms, array_to_string(list_concat(ts, list_filter(hs, lambda x: NOT list_contains(ts, x))), ' ') AS expansion, CASE WHEN {_RATIO} THEN question || ' total overall' ELSE question END AS rewritten FROM h""",
    "compared_spans": f"SELECT id, {_span_case()} AS spans FROM {_PQ}",
    "difficulty_classes": """SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_size % 4 = 0 THEN 'multi_op_formula' WHEN p_partkey % 5 = 0 THEN 'arithmetic_agg' WHEN p_partkey % 5 = 4 THEN 'pair_or_topk_arg' WHEN p_partkey % 5 = 1 THEN 'single_arg' WHEN p_partkey % 5 = 2 THEN 'comparison_or_count'
      WHEN p_size % 3 = 0 OR p_size % 4 = 0 THEN 'single_op_formula' ELSE 'simple_lookup' END AS class, CASE WHEN p_size % 3 = 0 OR p_size % 4 = 0 THEN 'gamma' ELSE 'beta' END AS route FROM part""",
    "bm25_topk": f"WITH asked AS (SELECT item_id AS query_id, text AS question FROM benchmark), {_bm25_sql('documents', 'doc_id', 'asked')} SELECT query_id, doc_id, rank, round(score, 4) AS score FROM {_RANKED('doc_id')} WHERE rank <= 10",
    "bm25_within_table": grid(f"{_CHUNK}, {_ASKED_T}, {_bm25_sql('chunks', 'chunk_id', 'asked', part='table_id')} SELECT query_id, chunk_id, rank, round(score, 4) AS score FROM {_RANKED('chunk_id')} WHERE rank <= 3"),
    "dense_topk": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v),
      scores AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e) / a.n / b.n AS score FROM u a, u b WHERE a.vec_id % 20 = 0) SELECT query_id, vec_id, rank, round(score, 4) AS score FROM {_RANKED('vec_id')} WHERE rank <= 5""",
    "hashed_dense": grid(f"{_BOTH} SELECT query_id, chunk_id, rank, round(score, 4) AS score FROM {_RANKED('chunk_id', 'dense')} WHERE rank <= 5"),
    "hybrid_scores": grid(f"""{_BOTH}, na AS (SELECT count(*) AS n FROM chunks),
      mm AS (SELECT k, query_id, chunk_id, score, min(score) OVER w AS lo, max(score) OVER w AS hi, count(*) OVER w AS cnt FROM (SELECT 'd' AS k, * FROM dense UNION ALL SELECT 'b', * FROM scores) WINDOW w AS (PARTITION BY k, query_id)),
      sc AS (SELECT k, query_id, chunk_id, CASE WHEN cnt < n THEN least(lo, 0.0) ELSE lo END AS lo, CASE WHEN cnt < n THEN greatest(hi, 0.0) ELSE hi END AS hi, score FROM mm, na),
      h AS (SELECT query_id, chunk_id, sum(0.5 * CASE WHEN hi - lo < 1e-12 THEN 0 ELSE (score - lo) / (hi - lo) END) AS score FROM sc GROUP BY ALL)
      SELECT query_id, chunk_id, rank, round(score, 4) AS score FROM {_RANKED('chunk_id', 'h')} WHERE rank <= 5"""),
    "rrf_scores": grid(f"""{_BOTH}, rk AS (SELECT query_id, chunk_id, rank FROM {_RANKED('chunk_id', 'dense')} UNION ALL SELECT query_id, chunk_id, rank FROM {_RANKED('chunk_id', 'scores')}),
      f AS (SELECT base, query_id, chunk_id, sum(1.0 / (60 + rank - 1 + base)) AS score FROM rk, (SELECT unnest([0, 1]) AS base) GROUP BY ALL)
      SELECT CAST(base AS INTEGER) AS base, query_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY base, query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM f) WHERE rank <= 5"""),
    "table_maxpool": grid(f"{_POOL} SELECT query_id, table_id, rank, round(score, 4) AS score FROM {_RANKED('table_id', 'pool')}"),
    "table_cascade": grid(f"{_POOL}, keep AS (SELECT query_id, table_id FROM {_RANKED('table_id', 'pool')} WHERE rank <= 2), inside AS (SELECT s.* FROM s JOIN keep USING (query_id, table_id)) SELECT query_id, chunk_id, rank FROM {_RANKED('chunk_id', 'inside')} WHERE rank <= 5"),
    "best_tables": grid(f"{_POOL}, near AS (SELECT * FROM {_RANKED('chunk_id', 's')} WHERE rank <= 8), b AS (SELECT query_id, table_id, arg_min(chunk_id, rank) AS chunk_id, max(score) AS score FROM near GROUP BY ALL) SELECT query_id, table_id, chunk_id, rank FROM {_RANKED('table_id', 'b')} WHERE rank <= 2"),
    "lexical_headers": grid(f"""+ {_ASKED_T}, h AS (SELECT DISTINCT table_id, r, array_to_string(row_path, ' > ') AS header FROM cells),
      p AS (SELECT query_id, r AS i, len(list_intersect(regexp_extract_all(lower(question), '[a-z0-9]+'), regexp_extract_all(lower(header), '[a-z0-9]+'))) AS overlap, len(list_distinct(regexp_extract_all(lower(header), '[a-z0-9]+'))) AS n FROM asked JOIN h USING (table_id))
      SELECT query_id, i, rank, CAST(overlap AS INTEGER) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, n, i DESC) AS rank FROM p) WHERE rank <= 2"""),
    "label_collisions": grid("SELECT lower(row_path[-1]) AS label, count(DISTINCT table_id) AS tables, count(DISTINCT table_id) >= 5 AS colliding FROM cells GROUP BY 1"),
    "total_rows": grid(f"+ {_ROWS}, {_STRUCT} SELECT 'keyword' AS detector, * FROM keyword UNION ALL SELECT 'structural', * FROM structural UNION ALL SELECT 'hybrid', * FROM hybrid"),
    "row_relatives": grid(f"+ {_ROWS} SELECT 'children' AS kind, a.table_id, a.r, b.r AS member FROM rows_ a JOIN rows_ b ON a.table_id = b.table_id AND b.parent = a.row_path AND b.depth = a.depth + 1 UNION ALL SELECT 'siblings', a.table_id, a.r, b.r FROM rows_ a JOIN rows_ b ON a.table_id = b.table_id AND a.parent = b.parent AND a.depth = b.depth AND a.r <> b.r"),
    "scope_cells": grid(_scope_sql()),
    "axis_complete": grid(f"+ {_SEED}, u AS (SELECT s.query_id, c.r, c.c FROM seed s JOIN cells c ON c.table_id = s.table_id AND c.r = s.r UNION SELECT s.query_id, c.r, c.c FROM seed s JOIN cells c ON c.table_id = s.table_id AND c.c = s.c) SELECT query_id, count(*) AS n, CAST(sum(r * 1000 + c) AS BIGINT) AS mark FROM u GROUP BY query_id"),
    "injected_cells": grid(f"""+ {_SEED}, {_ROWS}, {_STRUCT}, more AS (SELECT s.query_id, c.r, c.c FROM (SELECT DISTINCT query_id, table_id FROM seed) s JOIN hybrid h USING (table_id) JOIN cells c ON c.table_id = s.table_id AND c.r = h.r),
      u AS (SELECT 'all' AS columns, query_id, r, c FROM seed UNION SELECT 'all', * FROM more UNION SELECT 'touched', query_id, r, c FROM seed UNION SELECT 'touched', m.* FROM more m WHERE (m.query_id, m.c) IN (SELECT (query_id, c) FROM seed))
      SELECT columns, query_id, count(*) AS n, CAST(sum(r * 1000 + c) AS BIGINT) AS mark FROM u GROUP BY columns, query_id"""),
    "last_columns": grid("SELECT table_id, max(c) AS last FROM cells GROUP BY table_id"),
    "row_failures": grid(f"""+ {_ROWS}, gold AS (SELECT *, table_id || '/' || (r % 3) AS query_id, row_path[1] = 'ASIA' AS hit, row_path[-1] = 'total' AS tot FROM rows_),
      p AS (SELECT query_id, table_id, count(*) AS n, count(*) FILTER (WHERE NOT hit) AS missed, count(*) FILTER (WHERE NOT hit AND tot) AS mt FROM gold GROUP BY ALL)
      SELECT query_id, CASE WHEN mt > 0 THEN 'total_pairing' ELSE 'cross_parent' END AS bucket, missed, missed = mt AS recover_by_totals FROM p WHERE missed > 0"""),
    "value_join": grid("""+ o AS (SELECT table_id, r AS operand, num, lower(row_path[-1]) AS rh FROM cells WHERE c = 0),
      k AS (SELECT o.table_id, o.operand, c.r, c.c, row_number() OVER (PARTITION BY o.table_id, o.operand ORDER BY CAST(contains(o.rh, lower(c.row_path[-1])) OR contains(lower(c.row_path[-1]), o.rh) AS INTEGER) + CAST(contains('a', lower(c.col_path[-1])) OR contains(lower(c.col_path[-1]), 'a') AS INTEGER) DESC, c.r, c.c) AS k
        FROM o JOIN cells c ON c.table_id = o.table_id AND round(c.num, 4) = round(o.num, 4)) SELECT table_id, operand, r, c FROM k WHERE k = 1"""),
    "offset_search": grid("SELECT DISTINCT table_id || '/' || (r % 2) AS query_id, 2 AS h, 1 AS w FROM cells WHERE (r + c) % 5 = 0"),
    "evidence_cells": grid("SELECT table_id AS query_id, table_id, r, c, num AS value, 'number' AS value_type FROM cells WHERE (r = 1 AND c = 0) OR (r = 2 AND c = 1)"),
    "covered_cells": grid(f"""{_CHUNK}, {_ASKED_T}, {_bm25_sql('chunks', 'chunk_id', 'asked', part='table_id')}, top AS (SELECT query_id, r FROM {_RANKED('chunk_id')} JOIN chunks USING (chunk_id) WHERE rank <= 3)
      SELECT a.query_id, round(avg(CASE WHEN t.r IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall FROM asked a JOIN cells c ON c.table_id = a.table_id AND c.r = c.c LEFT JOIN top t ON t.query_id = a.query_id AND t.r = c.r GROUP BY a.query_id"""),
    "attribution": grid("""+ n AS (SELECT a.table_id, a.r, a.c, count(*) AS k FROM cells a JOIN cells b ON a.table_id = b.table_id AND round(a.num, 4) = round(b.num, 4) GROUP BY ALL) SELECT count(*) AS n, count(*) FILTER (WHERE k > 1) AS ambiguous, count(*) FILTER (WHERE k > 1) / count(*) AS share FROM n"""),
}
QUERIES = {f.__name__: f for f in (question_types, question_terms, compared_spans, message_types, passage_terms, difficulty_classes, bm25_topk, bm25_within_table, dense_topk, hashed_dense, hybrid_scores, rrf_scores, table_maxpool, table_cascade, best_tables, lexical_headers, label_collisions, total_rows, row_relatives, scope_cells, axis_complete, injected_cells, last_columns, row_failures, subtables, value_join, offset_search, evidence_cells, covered_cells, attribution, resolved_paths, decomposed_operands)}
