"""Queries of hit lists, path recall, completeness, traces, alignments and resolvers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.udfs import answer_text_udf
from ..operators import coverage, evaluation, linking, metrics, questions, ranking, resolvers, scoring, significance, structure, texts
from ..sources import sinks
from .base import HORNER, POLY, QUESTIONS, RANKS, dealt, grid, literal, literal_sql, questions_of_tables, rank_records, sales_cells, table
from .retrieval import _hash_sql


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as the hits of a query: (query_id, cell, score, part, flag)."""
    line = dealt(spark, sf_dir, "lineitem", "l_orderkey").groupBy("l_orderkey", "l_linenumber")
    return line.agg(F.max("l_quantity").cast("double").alias("score"), F.min("l_partkey").alias("part"), F.min("l_returnflag").alias("flag")).select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("cell"), "score", "part", "flag")


LINES = "lines AS (SELECT l_orderkey AS query_id, l_linenumber AS cell, CAST(max(l_quantity) AS DOUBLE) AS score, min(l_partkey) AS part, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL)"


def rank_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable and optimistic ranks of each order's lines, from 1 and from 0, and the ranks of gold lines within a limit."""
    h = _lines(spark, sf_dir).select("query_id", "cell", "score")
    stable = scoring.ranked(h, ["query_id"], "cell")
    kinds = {"stable": stable, "from_1": ranking.competition_rank(h, ["query_id"]), "from_0": ranking.competition_rank(h, ["query_id"], base=0), "gold": ranking.gold_ranks(stable, h.filter("cell % 2 = 1").select("query_id", "cell"), limit=2)}
    return _union([d.select(F.lit(k).alias("kind"), "query_id", "cell", F.col("rank").cast("long").alias("rank")) for k, d in kinds.items()])


def merged_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of two sub-queries, returned lines and the others: at their best score, and in the order first seen."""
    h = _lines(spark, sf_dir).withColumn("chunk_id", F.col("part") % 5).withColumn("op", (F.col("flag") != "R").cast("int"))
    best = scoring.merged_best([h.filter(f"op = {k}").select("query_id", "chunk_id", "score") for k in (0, 1)])
    first = scoring.merged_first(h.select("query_id", "chunk_id", "op", F.col("cell").alias("rank")))
    return best.select(F.lit("best").alias("kind"), "query_id", "chunk_id", "score").unionByName(first.select(F.lit("first").alias("kind"), "query_id", "chunk_id", F.col("position").cast("double").alias("score")))


def path_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of all row paths by the tokens of leaves and of whole paths, at some k."""
    c = sales_cells(spark, sf_dir).filter("c = 0")
    gold = c.select(F.col("table_id").alias("query_id"), F.col("r").alias("g"), F.col("row_path").alias("path"))
    leaves = c.select(F.col("table_id").alias("query_id"), (F.col("r") + 1).alias("rank"), F.array(tx.leaf("row_path")).alias("path"))
    whole = c.select(F.col("table_id").alias("query_id"), (F.col("r") + 1).alias("rank"), F.array(F.upper(F.array_join("row_path", "::"))).alias("path"))
    return _union([linking.path_recall(gold, h, k).select(F.lit(n).alias("kind"), F.lit(k).alias("k"), "query_id", F.round("recall", 6).alias("recall")) for n, h in (("leaf", leaves), ("path", whole)) for k in (5, 20)])


def completeness_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the large lines hold all lines of an order: by priority, and the mean over priorities."""
    h = _lines(spark, sf_dir)
    q = metrics.completeness(h.select("query_id", "cell"), h.filter("score > 15").select("query_id", "cell"), ("query_id", "cell"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("key"))
    g = metrics.by_group(q.join(o, "query_id"), "key")
    places = lambda d: d.select("level", "key", "n", F.round("osc", 6).alias("osc"), F.round("recall", 6).alias("recall"))
    none = lambda t: F.lit(None).cast(t)
    mean = metrics.macro(g, "osc").select(F.lit("macro").alias("level"), none("string").alias("key"), none("long").alias("n"), F.col("macro").alias("osc"), none("double").alias("recall"))
    return places(g.withColumn("level", F.lit("group"))).unionByName(places(mean))


def omitted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagonal cells that the first rows miss, of the tables found early."""
    q = questions_of_tables(spark, sf_dir)
    c = sales_cells(spark, sf_dir)
    gold = q.select("query_id", "table_id").join(c.filter("r = c").select("table_id", "r", "c"), "table_id")
    rows = texts.compact_rows(c).filter("r < 7").select("table_id", "rows", "cols")
    hits = q.select("query_id", "table_id").join(rows, "table_id")
    rank = q.select("query_id", (F.length("query_id") % 4 + 1).alias("rank"))
    t = metrics.omission(gold, hits, rank, 2)
    return t.select("n_queries", F.round("miss_rate", 6).alias("miss_rate"), F.round("any_miss", 6).alias("any_miss"))


def reranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest lines of an order by their part's number, the rest behind them."""
    h = scoring.ranked(_lines(spark, sf_dir), ["query_id"], "cell")
    return scoring.reranked(h, F.col("part").cast("double"), pool=3).select("query_id", "cell", "rank", "new_rank")


def composed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of cells from those of their row and column paths."""
    c = sales_cells(spark, sf_dir)
    rows = c.groupBy("table_id", "r").agg(F.first(F.length(tx.path_text("row_path"))).cast("double").alias("score")).withColumnRenamed("table_id", "query_id")
    cols = c.select("table_id", "c").distinct().select(F.col("table_id").alias("query_id"), "c", (F.col("c") / 2).alias("score"))
    return scoring.composed(rows, cols).select("query_id", "r", "c", "score")


#: Header pairs that are looked up in every table; rows 1, 6, 11 and so on are without numbers.
LOOKUPS = [("total", "1995 > A"), ("nowhere", "1995 > A"), ("total", "1890"), ("AFRICA > nation_0", "1996 > R"), ("AFRICA > nation_5", "1996 > R")]


def traced_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by header pairs with what went wrong, and whether an answer from them needs repair."""
    c = sales_cells(spark, sf_dir).withColumn("num", F.when(F.col("r") % 5 != 1, F.col("num")))
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("row_header"), F.lit(b).alias("col_header")) for a, b in LOOKUPS])).alias("x")
    asked = c.select("table_id").distinct().select(F.col("table_id").alias("query_id"), "table_id", pairs).select("query_id", "table_id", "x.row_header", "x.col_header")
    t = evaluation.traced_lookup(asked, c).withColumn("error", F.lit(None).cast("string")).withColumn("flags", F.array("flag"))
    return t.select("query_id", "row_header", "col_header", "value", "flag", evaluation.needs_repair("value", "error", F.col("flags")).alias("repair"))


def aligned_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row labels found again among noise, tables whose values agree, near numbers, and segments a title covers."""
    c = sales_cells(spark, sf_dir)
    labels = c.filter("c = 0").groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", tx.leaf("row_path").alias("s")))), lambda x: x["s"]).alias("gold"))
    noisy = labels.withColumn("found", F.flatten(F.transform("gold", lambda s: F.array(F.lit("noise"), F.concat(F.lit(" "), F.upper(s))))))
    places = structure.greedy_alignment(noisy).select("table_id", F.aggregate("at", F.lit(0).cast("long"), lambda a, x: a + x).alias("places"))
    written = F.when(F.col("r") % 7 == 3, F.concat("raw", F.lit(".0"))).when((F.col("r") % 12 == 5) & (F.col("table_id") < "C"), "wrong").otherwise(F.col("raw"))
    agree = structure.accepted_alignment(c.select("table_id", F.col("raw").alias("gold_value"), written.alias("grid_value")), 0.95)
    near = c.groupBy("table_id").agg(F.count_if(tx.values_match(F.col("num"), F.col("num") * (1 + F.col("c") / 10000))).alias("near"), F.round(F.avg(structure.segment_coverage("row_path", F.concat("title", F.lit(" in nation 3, ASIA")))), 6).alias("covered"))
    return places.join(agree, "table_id", "left").join(near, "table_id").select("table_id", "places", F.round("agreement", 6).alias("agreement"), "near", "covered")


def extended_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row as the hit of each question, and the whole table or its rows where the question falls back."""
    c = sales_cells(spark, sf_dir)
    rows = texts.compact_rows(c).select("table_id", "r", "chunk_id", "text")
    q = questions_of_tables(spark, sf_dir).select("query_id", "table_id")
    hits = q.join(rows.filter("r = 2"), "table_id").withColumn("position", F.lit(1))
    reports = q.select("query_id", (F.length("query_id") % 2 == 0).alias("fallback"))
    sizes = c.groupBy("table_id").agg((F.max("r") + F.when(F.col("table_id") < "C", 100).otherwise(0)).alias("n_rows"))
    out = coverage.extended(hits, reports, texts.whole_tables(c), rows, sizes)
    return out.select("query_id", "chunk_id", "position", F.length("text").alias("n_chars"))


def validated_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed paths that exist, then the first paths of the table, four in all."""
    c = sales_cells(spark, sf_dir)
    known = c.filter("c = 0").select("table_id", "r", F.col("row_path").alias("path"))
    proposals = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, p)).alias("path")) for k, p in enumerate((["nowhere"], ["total"], ["ASIA"], ["total"]))])
    q = known.select("table_id").distinct().select(F.concat(F.lit("q-"), "table_id").alias("query_id"), "table_id")
    proposed = q.select("query_id", "table_id", F.explode(proposals).alias("x")).select("query_id", "table_id", "x.k", "x.path")
    fallback = q.join(known.filter("r < 5"), "table_id").select("query_id", "table_id", F.col("r").alias("k"), "path")
    return questions.validated(proposed, known.select("table_id", "path"), fallback, 4).select("query_id", "k", F.array_join("path", " > ").alias("path"))


def linked_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of linked headers: parts with brand and type above and, for half of them, a name on the left."""
    p = table(spark, sf_dir, "part")
    left = F.when(F.col("p_size") % 2 == 0, F.array("p_name")).otherwise(F.array().cast("array<string>"))
    return questions.linked_operands(p.select(F.col("p_partkey").alias("query_id"), F.array("p_brand", "p_type").alias("tops"), left.alias("lefts"))).select("query_id", F.array_join("path", " > ").alias("path"))


def attached_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the customer whom they name, if there is one."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("table_id"))
    return linking.attach(o, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("table_id"), F.col("c_mktsegment").alias("title")))


def covering_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many row chunks cover each diagonal cell, and a call made once for equal labels."""
    c = sales_cells(spark, sf_dir)
    chunks = texts.compact_rows(c).select("table_id", "rows", "cols")
    cover = c.filter("r = c").select("table_id", "r", "c", "row_path").join(chunks, "table_id").groupBy("table_id", "r", "c", tx.leaf("row_path").alias("label")).agg(F.count_if(linking.covers("rows", "cols", F.col("r"), F.col("c"))).alias("n"))
    return sinks.once_per_key(cover, ["label"], lambda d: d.withColumn("coded", F.md5(F.col("label").cast("binary")))).select("table_id", "r", "c", "n", "coded")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as headings of the nations below them."""
    t = lambda n: table(spark, sf_dir, n)
    blank = F.array(F.lit(""), F.lit(None).cast("string"))
    r = t("region").select(F.col("r_regionkey").alias("a"), F.lit(-1).alias("b"), F.col("r_name").alias("label"), blank.alias("rest"))
    n = t("nation").select(F.col("n_regionkey").alias("a"), F.col("n_nationkey").alias("b"), F.col("n_name").alias("label"), F.array(F.col("n_nationkey").cast("string"), F.lit("")).alias("rest"))
    rows = r.unionByName(n).select(F.lit("geo").alias("table_id"), (F.col("a") * 1000 + F.col("b") + 1).alias("r"), "label", "rest")
    return structure.sectioned_rows(rows).select("r", F.array_join("row_path", " > ").alias("path"))


def run_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the order of a run that takes what changes first, and the best three of a stored ranking."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 2 == 0).alias("base"), (F.col("p_size") % 3 == 0).alias("treat"))
    placed = ranking.flips_first(p, "base", "treat", "p_partkey").select(F.lit("flips").alias("kind"), F.col("p_partkey").alias("id"), F.col("place").cast("long").alias("place"))
    stored = scoring.ranked(_lines(spark, sf_dir), ["query_id"], "cell").select("query_id", "cell", "rank")
    best = ranking.prefix(stored, 3).select(F.lit("prefix").alias("kind"), (F.col("query_id") * 10 + F.col("cell")).alias("id"), F.col("rank").cast("long").alias("place"))
    return placed.unionByName(best)


def wrong_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagonal cells under headers that a rebuilding by leaves alone gets wrong."""
    c = sales_cells(spark, sf_dir)
    lines = lambda at, path: c.groupBy("table_id", at).agg(F.first(path).alias("path"))
    rows, cols = lines("r", "row_path"), lines("c", "col_path")
    bad_rows = structure.bad_lines(rows.filter("r % 9 <> 0").withColumn("path", F.array(F.upper(tx.leaf("path")))), rows, "r")
    bad_cols = structure.bad_lines(cols.withColumn("path", F.when(F.col("c") % 2 == 0, F.col("path")).otherwise(F.reverse("path"))), cols, "c")
    ops = c.filter("r = c").select(F.concat(F.lit("q"), "table_id").alias("query_id"), "table_id", "r", "c")
    return structure.affected_operands(ops, bad_rows, bad_cols).select("query_id", "r", "c", "bad_row", "bad_col")


def text_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References, coordinates, code, JSON and reasoned answers read from replies about every part; answers by the official normaliser."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_size").cast("string")
    ref = tx.grid_reference(F.concat(F.char(F.col("p_size") % 26 + 65), F.lit("b"), n), 2)
    at = tx.coordinate(F.concat(F.lit("("), n, F.lit(", "), F.col("p_partkey").cast("string"), F.lit(")")))
    return p.select(
        "p_partkey",
        ref["r"].alias("ref_r"), ref["c"].alias("ref_c"), at["r"].alias("at_r"), at["c"].alias("at_c"),
        tx.code_block(F.concat(F.lit("Sure:\n```python\n# size\nx = "), n, F.lit("\n\nprint(x)\n```\nDone"))).alias("code"),
        tx.outer_json(F.concat(F.lit("so {\"a\": "), F.when(F.col("p_size") % 2 == 0, n).otherwise(F.lit("oops")), F.lit("} ."))).alias("json"),
        tx.reasoned_answer(F.concat(F.lit("ANSWER: 1\nno\nAnswer: "), "p_brand", F.lit(".."))).alias("reasoned"),
        tx.normal_value(F.concat(F.lit(" 1,"), F.lpad(n, 3, "0"), F.lit(".0"))).alias("value"),
        answer_text_udf(F.concat(F.lit("“Größe  "), "p_type", F.lit("” [2]†"))).alias("answer"),
    )


def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the size of every part, right in several ways and wrong in others, by every scorer."""
    p = table(spark, sf_dir, "part")
    n, k = F.col("p_size"), F.col("p_partkey") % 6
    say = F.when(k == 0, F.concat(F.lit("It is "), n.cast("string"))).when(k == 1, F.concat((n * 100).cast("string"), F.lit("%"))).when(k == 2, "no idea").when(k == 3, (n * 37 + 7000000).cast("string")).when(k == 4, F.concat(F.lit("-"), n.cast("string"))).otherwise(F.concat(n.cast("string"), F.lit(".0")))
    a = p.select("p_partkey", say.alias("pred"), F.array(n.cast("string")).alias("gold"))
    g = F.get("gold", 0)
    return a.select("p_partkey", metrics.numeric_match("pred", "gold").alias("numeric"), metrics.exact_match("pred", "gold").alias("exact"), metrics.official_match_text(F.col("pred"), g).alias("official"), metrics.percent_match(F.col("pred"), g).alias("percent"), metrics.answer_bucket("pred", "gold").alias("bucket"), metrics.failure_mode("pred", "gold").alias("failure"))


def tolerance_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of predictions that are off by up to six percent, by brand, for each tolerance."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("bucket"), (F.col("p_size") * 1000 * (100 + F.col("p_partkey") % 7) / 100).cast("long").cast("string").alias("pred"), F.array((F.col("p_size") * 1000).cast("string")).alias("gold"))
    return metrics.rescored(p, (0.0, 0.015, 0.035)).select("bucket", F.col("tolerance").cast("double").alias("tolerance"), "n", F.round("accuracy", 6).alias("accuracy"))


def metric_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired tests of the two arms, for each metric the one that suits it, by scope size."""
    q = metrics.per_query(rank_records(spark, sf_dir), ks=(20,), by=("arm", "query_id")).withColumn("scope", metrics.scope_bin("m"))
    arm = lambda a: q.filter(F.col("arm") == a).select("query_id", "scope", F.col("set_recall_20").alias("osc"), F.col("rr").alias("rr"))
    t = significance.paired_metrics(arm("base"), arm("treat"), {"osc": "binary", "rr": "continuous"}, ("scope",))
    return t.select("scope", "metric", "n", F.round("delta", 6).alias("delta"), "gain", "loss", F.round("p", 4).alias("p"))


def signed_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact signed ranks of the two arms over the lines of each order."""
    r = rank_records(spark, sf_dir)
    a, b = (r.filter(F.col("arm") == x).select("query_id", "cell", F.col("rank").alias(x)) for x in ("base", "treat"))
    t = significance.exact_signed_rank(a.join(b, ["query_id", "cell"]).filter("base is not null and treat is not null"), "base", "treat", ["query_id"])
    return t.select("query_id", "n", "w", F.round("p", 6).alias("p"))


def _asked_paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return questions_of_tables(spark, sf_dir), resolvers.node_paths(sales_cells(spark, sf_dir), "row")


def resolver_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row paths nearest to each question by the hashing encoder, which is allowed as the fallback."""
    q, p = _asked_paths(spark, sf_dir)
    return resolvers.resolved(q, p, "embed", 3, encoder=scoring.chosen_encoder(allow_fallback=True)).select("query_id", F.array_join("path", " > ").alias("path"), "rank")


def _shared(question, path):
    """A pair scorer for tests: shared words, fewer words of the path first."""
    a, b = F.array_distinct(tx.alnum_tokens(question)), F.array_distinct(tx.alnum_tokens(path))
    return F.size(F.array_intersect(a, b)) * 100 - F.size(b)


def resolver_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column paths under the years 1995 and 1996 by a scorer of question and path together."""
    c = sales_cells(spark, sf_dir)
    allowed = c.filter(F.get("col_path", 0).isin("1995", "1996")).select("table_id", "c").distinct()
    p = resolvers.allowed_paths(resolvers.node_paths(c, "col"), c, allowed)
    return resolvers.resolved(questions_of_tables(spark, sf_dir), p, "cross", scorer=_shared).select("query_id", F.array_join("path", " > ").alias("path"), "rank")


def resolver_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many paths each mode finds for each question."""
    q, p = _asked_paths(spark, sf_dir)
    e = scoring.chosen_encoder(allow_fallback=True)
    arms = {m: resolvers.resolved(q, p, m, 3, e, _shared) for m in resolvers.MODES} | {"mixed": resolvers.mixed(q, p, e, 3)}
    return _union([d.groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").cast("long").alias("last")).select(F.lit(m).alias("mode"), "*") for m, d in arms.items()])


def encoded_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest row chunks of each question by a pluggable encoder, whose name is kept."""
    q = literal(spark, QUESTIONS, "question").select(F.col("id").alias("query_id"), "question")
    c = texts.compact_rows(sales_cells(spark, sf_dir)).select("chunk_id", "text")
    return scoring.encoded_topk(q, c, 4, scoring.chosen_encoder(allow_fallback=True)).select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"), "encoder")


def operand_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the paths of decomposed operands match the terms of each question."""
    q = questions_of_tables(spark, sf_dir)
    ops = questions.decomposed(questions.resolved(q, sales_cells(spark, sf_dir)))
    return questions.confidence(q, ops).select("query_id", F.round("confidence", 6).alias("confidence"))


_RANKED = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, cell)"
_WORDS = lambda x: f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda t: t <> '')"
_SEGMENTS = "seg AS (SELECT DISTINCT c_mktsegment AS table_id FROM customer)"
_Q = literal_sql(QUESTIONS, "question")
_ASKED = f"asked AS (SELECT DISTINCT table_id || '/' || id AS query_id, table_id, question FROM cells, {_Q})"
_CHUNK = "chunks AS (SELECT table_id || '#r' || r AS chunk_id, table_id, r, title || ' | ' || string_agg(array_to_string(list_concat(row_path, col_path), ' > ') || ': ' || raw, ' | ' ORDER BY c) AS text FROM cells GROUP BY table_id, title, r)"


_POLY, _HORNER = POLY, HORNER

SQL = {
    "rank_kinds": f"""WITH {LINES}, s AS (SELECT query_id, cell, {_RANKED} AS rank, rank() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC) AS o FROM lines)
      SELECT 'stable' AS kind, query_id, cell, rank FROM s UNION ALL SELECT 'from_1', query_id, cell, o FROM s UNION ALL SELECT 'from_0', query_id, cell, o - 1 FROM s UNION ALL SELECT 'gold', query_id, cell, CASE WHEN rank <= 2 THEN rank END FROM s WHERE cell % 2 = 1""",
    "merged_hits": f"""WITH {LINES}, h AS (SELECT *, part % 5 AS chunk_id, CASE WHEN flag = 'R' THEN 0 ELSE 1 END AS op FROM lines),
      f AS (SELECT query_id, chunk_id, min(op * 1000 + cell) AS place FROM h GROUP BY ALL)
      SELECT 'best' AS kind, query_id, chunk_id, max(score) AS score FROM h GROUP BY ALL UNION ALL SELECT 'first', query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place, chunk_id) AS DOUBLE) FROM f""",
    "path_recall": grid(f"""+ p AS (SELECT table_id AS query_id, r, row_path, {_WORDS("array_to_string(row_path, ' ')")} AS ws FROM cells WHERE c = 0),
      h AS (SELECT 'leaf' AS kind, query_id, r + 1 AS rank, {_WORDS('row_path[-1]')} AS hs FROM p UNION ALL SELECT 'path', query_id, r + 1, ws FROM p),
      ks AS (SELECT unnest([5, 20]) AS k), kinds AS (SELECT unnest(['leaf', 'path']) AS kind)
      SELECT kind, CAST(k AS INTEGER) AS k, query_id, round(avg(CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.kind = kinds.kind AND h.query_id = p.query_id AND h.rank <= k AND list_has_all(h.hs, p.ws)) THEN 1.0 ELSE 0.0 END), 6) AS recall FROM p, ks, kinds GROUP BY ALL"""),
    "completeness_groups": f"""WITH {LINES}, q AS (SELECT query_id, min(CASE WHEN score > 15 THEN 1 ELSE 0 END) AS osc, avg(CASE WHEN score > 15 THEN 1.0 ELSE 0.0 END) AS recall FROM lines GROUP BY query_id),
      g AS (SELECT o_orderpriority AS key, count(*) AS n, avg(osc) AS osc, avg(recall) AS recall FROM q JOIN orders ON o_orderkey = query_id GROUP BY 1)
      SELECT 'group' AS level, key, n, round(osc, 6) AS osc, round(recall, 6) AS recall FROM g UNION ALL SELECT 'macro', NULL, NULL, round(avg(osc), 6), NULL FROM g""",
    "omitted_cells": grid(f"""+ {_ASKED}, q AS (SELECT query_id, table_id FROM asked WHERE length(query_id) % 4 + 1 <= 2),
      m AS (SELECT query_id, avg(CASE WHEN r < 7 THEN 0.0 ELSE 1.0 END) AS miss FROM q JOIN cells USING (table_id) WHERE r = c GROUP BY query_id)
      SELECT count(*) AS n_queries, round(avg(miss), 6) AS miss_rate, round(avg(CASE WHEN miss > 0 THEN 1.0 ELSE 0.0 END), 6) AS any_miss FROM m"""),
    "reranked_hits": f"""WITH {LINES}, s AS (SELECT *, {_RANKED} AS rank FROM lines)
      SELECT query_id, cell, rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 3 THEN part END DESC NULLS LAST, rank) AS new_rank FROM s""",
    "composed_scores": grid("SELECT table_id AS query_id, r, c, length(array_to_string(row_path, ' > ')) + c / 2 AS score FROM cells"),
    "traced_lookups": grid("""+ n AS (SELECT table_id, r, row_path, col_path, CASE WHEN r % 5 <> 1 THEN num END AS num FROM cells), t AS (SELECT DISTINCT table_id FROM cells),
      l AS (SELECT * FROM (VALUES ('total', '1995 > A', ['total'], ['1995', 'A']), ('nowhere', '1995 > A', ['nowhere'], ['1995', 'A']), ('total', '1890', ['total'], ['1890', '']), ('AFRICA > nation_0', '1996 > R', ['AFRICA', 'NATION_0'], ['1996', 'R']), ('AFRICA > nation_5', '1996 > R', ['AFRICA', 'NATION_5'], ['1996', 'R'])) v(row_header, col_header, rp, cp)),
      f AS (SELECT t.table_id, row_header, col_header, n.r, n.num FROM t CROSS JOIN l LEFT JOIN n ON n.table_id = t.table_id AND n.row_path = l.rp AND n.col_path = l.cp)
      SELECT table_id AS query_id, row_header, col_header, num AS value, CASE WHEN r IS NULL THEN 'NO_MATCH' WHEN num IS NULL THEN 'EMPTY' END AS flag, num IS NULL AS repair FROM f"""),
    "aligned_values": grid(f"""+ a AS (SELECT table_id, avg(CASE WHEN r % 12 = 5 AND table_id < 'C' AND r % 7 <> 3 THEN 0.0 ELSE 1.0 END) AS agreement,
        count(*) FILTER (WHERE num = num * (1 + c / 10000) OR abs(num - num * (1 + c / 10000)) <= 1e-3 * greatest(abs(num), abs(num * (1 + c / 10000)))) AS near,
        round(avg(len(list_filter(row_path, lambda s: list_has_all({_WORDS("title || ' in nation 3, ASIA'")}, {_WORDS('s')}))) / len(row_path)), 6) AS covered FROM cells GROUP BY table_id),
      p AS (SELECT table_id, CAST(sum(2 * r + 1) AS BIGINT) AS places FROM (SELECT DISTINCT table_id, r FROM cells) GROUP BY table_id)
      SELECT table_id, places, CASE WHEN agreement >= 0.95 THEN round(agreement, 6) END AS agreement, near, covered FROM a JOIN p USING (table_id)"""),
    "extended_hits": grid(f"""+ {_CHUNK}, {_ASKED}, f AS (SELECT table_id || '#full' AS chunk_id, table_id, any_value(t) AS title, any_value(t) || chr(10) || string_agg(text, chr(10) ORDER BY r) AS text FROM (SELECT c.*, (SELECT any_value(title) FROM cells x WHERE x.table_id = c.table_id) AS t FROM chunks c) GROUP BY table_id)
      SELECT query_id, chunk_id, 1 AS position, length(text) AS n_chars FROM asked JOIN chunks USING (table_id) WHERE r = 2
      UNION ALL SELECT query_id, chunk_id, 1073741824, length(text) FROM asked JOIN f USING (table_id) WHERE length(query_id) % 2 = 0 AND table_id >= 'C'
      UNION ALL SELECT query_id, chunk_id, 1073741824, length(text) FROM asked JOIN chunks USING (table_id) WHERE length(query_id) % 2 = 0 AND table_id < 'C' AND r <> 2"""),
    "validated_paths": grid("""+ k AS (SELECT DISTINCT table_id, r, row_path FROM cells),
      b AS (SELECT table_id, 0 AS source, 1 AS k, ['total'] AS p FROM k WHERE row_path = ['total'] UNION ALL SELECT table_id, 0, 2, ['ASIA'] FROM k WHERE row_path = ['ASIA'] UNION ALL SELECT table_id, 1, r, row_path FROM k WHERE r < 5),
      f AS (SELECT table_id, p, min(source * 1000 + k) AS place FROM b GROUP BY ALL)
      SELECT 'q-' || table_id AS query_id, CAST(k AS INTEGER) AS k, array_to_string(p, ' > ') AS path FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY place, p) AS k FROM f) WHERE k <= 4"""),
    "linked_operands": "SELECT DISTINCT p_partkey AS query_id, CASE WHEN p_size % 2 = 0 THEN p_name || ' > ' ELSE '' END || t AS path FROM (SELECT *, unnest([p_brand, p_type]) AS t FROM part)",
    "attached_tables": "SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS table_id, CASE WHEN o_orderkey % 5 <> 0 THEN c_mktsegment END AS title FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "covering_chunks": grid("SELECT table_id, r, c, 1 AS n, md5(row_path[-1]) AS coded FROM cells WHERE r = c"),
    "sections": "SELECT r_regionkey * 1000 AS r, r_name AS path FROM region UNION ALL SELECT n_regionkey * 1000 + n_nationkey + 1, r_name || ' > ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "run_order": f"""WITH {LINES}, p AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END - CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS gain FROM part)
      SELECT 'flips' AS kind, p_partkey AS id, row_number() OVER (ORDER BY gain DESC, p_partkey) AS place FROM p UNION ALL SELECT 'prefix', query_id * 10 + cell, rank FROM (SELECT *, {_RANKED} AS rank FROM lines) WHERE rank <= 3""",
    "wrong_headers": grid("SELECT 'q' || table_id AS query_id, r, c, r % 9 = 0 OR len(row_path) > 1 AS bad_row, c % 2 = 1 AS bad_col FROM cells WHERE r = c"),
    "text_readings": """SELECT p_partkey, CASE WHEN p_size >= 3 THEN p_size - 3 END AS ref_r, CASE WHEN p_size >= 3 THEN (p_size % 26 + 1) * 26 + 1 END AS ref_c, p_size AS at_r, p_partkey AS at_c, 'x = ' || p_size AS code,
      CASE WHEN p_size % 2 = 0 THEN '{"a": ' || p_size || '}' END AS json, p_brand AS reasoned, '1' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS value, 'große ' || lower(p_type) AS answer FROM part""",
    "answer_checks": """WITH k AS (SELECT p_partkey, p_size AS n, p_partkey % 6 AS k FROM part)
      SELECT p_partkey, k NOT IN (2, 3) AS numeric, false AS exact, k = 5 AS official, k = 5 AS percent, CASE WHEN k = 2 THEN 'non_number' WHEN k = 3 THEN 'silent_wrong' ELSE 'correct' END AS bucket,
        CASE WHEN k = 2 THEN 'abstain' WHEN k = 3 THEN 'wrong_cell' ELSE 'correct' END AS failure FROM k""",
    "tolerance_rates": """WITH p AS (SELECT p_brand AS bucket, p_partkey % 7 AS k, p_size FROM part)
      SELECT bucket, CAST(t AS DOUBLE) AS tolerance, count(*) AS n, round(avg(CASE WHEN k = 0 OR k < t * 100 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p, (SELECT unnest([0.0, 0.015, 0.035]) AS t) GROUP BY bucket, t""",
    "metric_tests": f"""{RANKS}, q AS (SELECT arm, query_id, count(*) AS m, coalesce(1.0 / min(rank), 0) AS rr, min(CASE WHEN rank <= 20 THEN 1 ELSE 0 END) AS osc FROM ranks GROUP BY ALL),
      b AS (SELECT CASE WHEN a.m <= 1 THEN '1' WHEN a.m = 2 THEN '2' WHEN a.m <= 4 THEN '3-4' WHEN a.m <= 8 THEN '5-8' ELSE '9+' END AS scope, CAST(t.osc - a.osc AS DOUBLE) AS dosc, round(t.rr - a.rr, 12) AS drr FROM q a JOIN q t ON a.query_id = t.query_id AND a.arm = 'base' AND t.arm = 'treat'),
      l AS (SELECT scope, 'osc' AS metric, dosc AS d FROM b UNION ALL SELECT scope, 'rr', drr FROM b),
      s AS (SELECT scope, metric, count(*) AS n, avg(d) AS delta, count(*) FILTER (WHERE d > 0) AS gain, count(*) FILTER (WHERE d < 0) AS loss FROM l GROUP BY ALL),
      r AS (SELECT scope, metric, d, avg(k) OVER (PARTITION BY scope, metric, abs(d)) AS mid, count(*) OVER (PARTITION BY scope, metric, abs(d)) AS t FROM (SELECT *, row_number() OVER (PARTITION BY scope, metric ORDER BY abs(d)) AS k FROM l WHERE d <> 0)),
      w AS (SELECT scope, metric, CAST(count(*) AS DOUBLE) AS m, least(sum(mid) FILTER (WHERE d > 0), sum(mid) FILTER (WHERE d < 0)) AS w, sum(t * t - 1.0) AS ties FROM r GROUP BY ALL),
      z AS (SELECT scope, metric, (w - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48) AS z FROM w),
      bin AS (SELECT scope, gain + loss AS n, least(1.0, 2 * (SELECT sum(exp(lgamma(gain + loss + 1) - lgamma(i + 1) - lgamma(gain + loss - i + 1) - (gain + loss) * ln(2.0))) FROM (SELECT unnest(range(0, least(gain, loss) + 1)) AS i))) AS p, (abs(gain - loss) - 1) / sqrt(gain + loss) AS z FROM s WHERE metric = 'osc'),
      e AS (SELECT scope, 'rr' AS metric, abs(z) / sqrt(2.0) AS x, NULL AS p FROM z WHERE metric = 'rr' UNION ALL SELECT scope, 'osc', greatest(z, 0) / sqrt(2.0), p FROM bin),
      v AS (SELECT scope, metric, coalesce(p, least(1.0, t * exp(-x * x + {_HORNER}))) AS p FROM (SELECT *, {_POLY} AS t FROM e))
      SELECT scope, metric, n, round(delta, 6) AS delta, gain, loss, round(p, 4) AS p FROM s LEFT JOIN v USING (scope, metric)""",
    "signed_ranks": f"""{RANKS}, d AS (SELECT a.query_id, a.rank - b.rank AS d FROM ranks a JOIN ranks b ON a.query_id = b.query_id AND a.cell = b.cell AND a.arm = 'base' AND b.arm = 'treat' WHERE a.rank IS NOT NULL AND b.rank IS NOT NULL AND a.rank <> b.rank),
      r AS (SELECT query_id, d, avg(k) OVER (PARTITION BY query_id, abs(d)) AS mid, row_number() OVER (PARTITION BY query_id) AS i FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY abs(d)) AS k FROM d)),
      g AS (SELECT query_id, count(*) AS n, least(coalesce(sum(mid) FILTER (WHERE d > 0), 0), coalesce(sum(mid) FILTER (WHERE d < 0), 0)) AS w FROM r GROUP BY query_id),
      s AS (SELECT g.query_id, signs, sum(CASE WHEN (signs >> (r.i - 1)) & 1 = 1 THEN mid ELSE 0 END) AS t FROM (SELECT *, unnest(range(0, 1 << CAST(n AS INTEGER))) AS signs FROM g) g JOIN r USING (query_id) GROUP BY ALL),
      p AS (SELECT s.query_id, count(*) FILTER (WHERE t <= w + 1e-9) / count(*) AS tail FROM s JOIN g USING (query_id) GROUP BY s.query_id)
      SELECT query_id, n, CAST(w AS DOUBLE) AS w, round(least(1.0, 2 * tail), 6) AS p FROM g JOIN p USING (query_id)""",
    "resolver_embed": grid(f"""+ {_ASKED}, p AS (SELECT DISTINCT table_id, array_to_string(row_path[1:k], ' > ') AS path FROM cells, (SELECT unnest([1, 2]) AS k) WHERE k <= len(row_path)),
      dq AS (SELECT DISTINCT question FROM asked), dp AS (SELECT DISTINCT path FROM p),{_hash_sql('dq', 'question', 'question', 'hq')},{_hash_sql('dp', 'path', 'path', 'hp')},
      near AS (SELECT question, path, sum(hq.w * hp.w) AS s FROM hq JOIN hp USING (b) GROUP BY ALL),
      a AS (SELECT query_id, path, coalesce(s, 0) AS s FROM asked JOIN p USING (table_id) LEFT JOIN near USING (question, path))
      SELECT query_id, path, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, path) AS rank FROM a) WHERE rank <= 3"""),
    "resolver_cross": grid(f"""+ {_ASKED}, p AS (SELECT DISTINCT table_id, array_to_string(col_path[1:k], ' > ') AS path FROM cells, (SELECT unnest([1, 2]) AS k) WHERE col_path[1] IN ('1995', '1996')),
      a AS (SELECT query_id, path, len(list_intersect(regexp_extract_all(lower(question), '[a-z0-9]+'), regexp_extract_all(lower(path), '[a-z0-9]+'))) * 100 - len(list_distinct(regexp_extract_all(lower(path), '[a-z0-9]+'))) AS s FROM asked JOIN p USING (table_id))
      SELECT query_id, path, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, path) AS rank FROM a) WHERE rank <= 2"""),
    "encoded_passages": grid(f"""+ {_CHUNK}, asked AS (SELECT id AS query_id, question FROM {_Q}),{_hash_sql('asked', 'query_id', 'question', 'hq')},{_hash_sql('chunks', 'chunk_id', 'text', 'hc')},
      near AS (SELECT query_id, chunk_id, sum(hq.w * hc.w) AS s FROM hq JOIN hc USING (b) GROUP BY ALL), a AS (SELECT query_id, chunk_id, coalesce(s, 0.0) AS score FROM asked CROSS JOIN chunks LEFT JOIN near USING (query_id, chunk_id))
      SELECT query_id, chunk_id, rank, round(score, 4) AS score, 'hashing-512' AS encoder FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM a) WHERE rank <= 4"""),
}
QUERIES = {f.__name__: f for f in (rank_kinds, merged_hits, path_recall, completeness_groups, omitted_cells, reranked_hits, composed_scores, traced_lookups, aligned_values, extended_hits, validated_paths, linked_operands, attached_tables, covering_chunks, sections, run_order, wrong_headers, text_readings, answer_checks, tolerance_rates, metric_tests, signed_ranks, resolver_embed, resolver_cross, resolver_modes, encoded_passages, operand_confidence)}
