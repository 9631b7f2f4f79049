"""Queries of ranks, metrics, statistics, budgets, plans and pipelines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.udfs import html_to_grid
from ..operators import coverage, evaluation, metrics, questions, ranking, scoring, significance, structure, texts
from ..plans import pipelines
from .base import QUESTIONS, RANKS, dealt, grid, literal, literal_sql, lower_sql, phrased, questions_of_tables, rank_records, sales_cells, table, upper_sql
from .retrieval import _KINDS, _bm25_sql, _hash_sql


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = metrics.per_query(rank_records(spark, sf_dir), by=("arm", "query_id"))
    return metrics.summary(q, by=("arm",))


def query_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = metrics.per_query(rank_records(spark, sf_dir), ks=(10,), by=("arm", "query_id"))
    return q.select("arm", "query_id", "m", F.round("rr", 6).alias("rr"), "set_recall_10", F.round("coverage_10", 6).alias("coverage_10"), "hit_10", F.round("ndcg_10", 6).alias("ndcg_10"))


def osc_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness overall and by scope size, status and priority, in one pass."""
    q = metrics.per_query(rank_records(spark, sf_dir).filter("arm = 'base'"), ks=(50,))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderstatus").alias("depth"), F.col("o_orderpriority").alias("aggregation"))
    r = q.join(o, "query_id").select(metrics.scope_bin("m").alias("scope"), "depth", "aggregation", F.col("set_recall_50").alias("osc"), F.col("coverage_50").alias("recall"))
    return metrics.stratified(r).select("dimension", "value", "n", F.round("osc", 4).alias("osc"), F.round("recall", 4).alias("recall"))


def gain_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rank_records(spark, sf_dir)
    return metrics.gain_decomposition(r.filter("arm = 'base'"), r.filter("arm = 'treat'"), 30)


def collision_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.strata_medians(rank_records(spark, sf_dir)).select("colliding", "n", "median_rank", F.round("reached", 6).alias("reached"))


def table_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rank_records(spark, sf_dir).filter("cell = 1")
    return metrics.table_ranks(r, by=("arm",))


def recall_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = metrics.per_query(rank_records(spark, sf_dir).filter("arm = 'base'"), ks=(50,))
    return metrics.predicted_decay(q.select("m", F.col("set_recall_50").alias("osc"), F.col("coverage_50").alias("recall"))).select("m", "n", F.round("osc", 6).alias("osc"), F.round("predicted", 6).alias("predicted"))


#: Predictions, gold answers and their bucket.
ANSWERS = [
    ("12", ["12"]), ("0.12", ["12"]), ("-12.1", ["12"]), ("15", ["12"]), ("200", ["12"]), ("", ["12"]), ("no idea", ["12"]), ("Quebec", ["quebec"]), ("it is Quebec.", ["quebec"]), ("Ontario", ["quebec"]),
    ("1,234.5", ["1234.5"]), ("3 and 4", ["3", "4"]), ("3", ["3", "4"]), ("0", ["0"]), ("7", ["0"]), ("1200%", ["12"]), (None, ["12"]), ("QUEBEC", ["quebec", "ontario"]),
]


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part one of the predictions, with the part's size put in, and its gold answers, in every third part with the size as well."""
    put = lambda x: F.replace(x, F.lit("5"), F.col("p_size").cast("string"))
    given = spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(ANSWERS)], "k int, pred string, gold array<string>")
    part = table(spark, sf_dir, "part").withColumn("k", F.pmod("p_partkey", F.lit(len(ANSWERS))).cast("int")).join(F.broadcast(given), "k")
    return part.select(F.col("p_partkey").alias("id"), put(F.col("pred")).alias("pred"), F.when(F.col("p_partkey") % 3 == 0, F.transform("gold", put)).otherwise(F.col("gold")).alias("gold"))


def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir)
    g = F.get("gold", 0)
    return a.select("id", metrics.numeric_match("pred", "gold").alias("numeric"), metrics.exact_match("pred", "gold").alias("exact"), metrics.official_match_text(F.col("pred"), g).alias("official"), metrics.percent_match(F.col("pred"), g).alias("percent"), metrics.answer_bucket("pred", "gold").alias("bucket"), metrics.failure_mode("pred", "gold").alias("failure"))


def answer_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rescored(_answers(spark, sf_dir).withColumn("bucket", F.when(F.col("id") % 2 == 0, "even").otherwise("odd")))


def router_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("gold"), F.col("o_orderpriority").alias("pred"))
    return metrics.confusion(p)


def class_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "part").select(F.col("p_brand").alias("class"), (F.col("p_size") > 25).alias("large"), (F.col("p_retailprice") > 1000).alias("dear"))
    return metrics.class_counters(r, "class", ["large", "dear"])


def condition_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    r = e.select(F.col("event_type").alias("condition"), (k % 3 == 0).alias("correct"), (k % 5 == 0).alias("no_match"), (k % 7 == 0).alias("empty"), (k % 11 == 0).alias("failed"))
    t = metrics.condition_summary(r, "condition")
    return t.select("condition", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "no_match", "empty", "clean", "accuracy_clean")])


def sentence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of leaf headers against those of full paths, with some missing."""
    c = sales_cells(spark, sf_dir)
    a, b = texts.verbalized(c, "short"), texts.verbalized(c, "short")
    return metrics.sentence_scores(a.filter("r % 7 <> 0"), b.filter("c % 5 <> 0"))


def exact_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binomial p values of each supplier's returned lines against others of large quantity, of each ship mode's and of all lines."""
    line = table(spark, sf_dir, "lineitem").filter("l_quantity > 25")
    of = F.explode(F.array(F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")), F.concat(F.lit("flag and month "), F.month("l_shipdate").cast("string")), F.lit("all"))).alias("of")
    t = line.select(of, (F.col("l_returnflag") == "R").alias("hit"), (F.col("l_returnflag") == "A").alias("miss")).groupBy("of").agg(F.count_if("hit").alias("b"), F.count_if("miss").alias("c"))
    w = significance.wilson((F.col("b") / F.greatest(F.col("b") + F.col("c"), F.lit(1))), F.col("b") + F.col("c"))
    log = lambda p: F.round(F.log(F.when(p > 1e-290, p)), 6) + 0.0
    return t.select("of", "b", "c", log(significance.mcnemar("b", "c")).alias("log_mcnemar"), log(significance.sign_test("b", "c")).alias("log_sign"), F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"))


def paired_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = metrics.per_query(rank_records(spark, sf_dir), ks=(20,), by=("arm", "query_id"))
    arm = lambda a: q.filter(F.col("arm") == a).select("query_id", "m", F.col("set_recall_20").alias("osc"))
    t = significance.flips(arm("base").withColumn("scope", metrics.scope_bin("m")), arm("treat"), by=("scope",))
    return t.select("scope", "n", "a_covered", "b_covered", "gain", "loss")


def rank_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U of colliding against other ranks, and signed ranks of the two arms, with two-sided and one-sided p values."""
    r = rank_records(spark, sf_dir)
    ps = [F.round(p, 6).alias(p) for p in ("p", "p_greater", "p_less")]
    u = significance.mann_whitney(r.filter("arm = 'base'")).select(F.lit("u").alias("test"), (F.col("n1") + F.col("n2")).alias("n"), F.col("u").alias("statistic"), *ps)
    a, b = (r.filter(F.col("arm") == x).select("query_id", "cell", F.col("rank").alias(x)) for x in ("base", "treat"))
    w = significance.wilcoxon(a.join(b, ["query_id", "cell"]).filter("base is not null and treat is not null"), "base", "treat").select(F.lit("w").alias("test"), "n", F.col("w").alias("statistic"), *ps)
    return u.unionByName(w)


def exact_rank_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of returned against other lines of each part, by their permutation distribution."""
    line = table(spark, sf_dir, "lineitem").filter("l_partkey % 7 = l_linenumber").select("l_partkey", F.round("l_quantity").cast("int").alias("q"), (F.col("l_returnflag") == "R").alias("hit"))
    t = significance.exact_rank_sum(line, "q", "hit", ["l_partkey"])
    return t.select("l_partkey", "n1", "n2", "u", *[F.round(p, 6).alias(p) for p in ("p", "p_greater", "p_less")], "exact")


def bootstrap_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the difference of the two arms over all orders."""
    q = metrics.per_query(rank_records(spark, sf_dir), ks=(20,), by=("arm", "query_id")).withColumnRenamed("set_recall_20", "osc")
    return significance.paired_bootstrap(q.filter("arm = 'base'"), q.filter("arm = 'treat'"))


def packed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation that fit 60 tokens."""
    c = table(spark, sf_dir, "conversations")
    return ranking.packed(c, 60, ["conv_id"], "turn").select("conv_id", "turn", "tokens", F.col("used").cast("long").alias("used"))


def joined_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return ranking.context(c, ["conv_id"], "turn", 50).select("conv_id", F.length("context").alias("n_chars"), "truncated")


def token_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean discount at the largest line number that each budget pays for, by return flag."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("arm"), F.col("l_linenumber").cast("long").alias("k"))
    p = line.agg((F.count("*") % 97 + F.col("k") * 100).alias("tokens"), F.round(F.avg("l_discount"), 6).alias("osc"))
    b = spark.createDataFrame([(x,) for x in (150, 300, 450, 1000)], "budget long")
    return ranking.budget_points(p, b, "osc", ["arm"])


def ladder_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rung (ten ranks each) at which all cells of an order are found."""
    r = rank_records(spark, sf_dir).filter("arm = 'base'")
    found = r.filter("rank is not null").select("query_id", "cell", F.ceil(F.col("rank") / 10).cast("int").alias("rung"))
    return ranking.first_complete_rung(found, r.select("query_id", "cell")).groupBy("rung").agg(F.count("*").alias("n"))


def cheapest_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    c = line.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"), F.max("l_quantity").alias("q"))
    return ranking.cheapest_complete(c.select(F.col("l_orderkey").alias("query_id"), F.col("l_returnflag").alias("config"), F.col("n").alias("n_cells"), (F.col("q") > 30).alias("complete")))


def rung_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rank_records(spark, sf_dir).filter("arm = 'base'")
    per = r.groupBy("query_id").agg(F.count("*").alias("m"), F.max(F.coalesce("rank", F.lit(99))).alias("worst"))
    ladder = per.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("rung"), "m", "worst").select("query_id", "rung", (F.col("rung") * 10).alias("n_cells"), (F.col("worst") <= F.col("rung") * 10).alias("complete"))
    chosen = per.select("query_id", F.when(F.col("m") <= 2, 2).otherwise(4).alias("rung"))
    return ranking.policy(ladder, chosen).select(F.round("mean_cells", 6).alias("mean_cells"), "median_cells", F.round("osc", 6).alias("osc"), "n")


def throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", (F.col("event_id") % 100).alias("tokens"))
    return ranking.throttled(e, 90, by=["event_type"], seconds=3600).select("event_id", "window_tokens", "allowed")


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.stratified(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", 5, "p_partkey").select("p_partkey", "p_brand", "place")


def quota_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("stratum")).agg(F.count("*").alias("n"))
    return ranking.quotas(s, 103)


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"))
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("query_id"))
    return ranking.pending(o, done)


def fallback_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    r = p.select(F.col("p_partkey").alias("query_id"), (F.col("p_size") % 5).cast("long").alias("n_operands"), (F.col("p_size") / 50).alias("coverage"), ((F.col("p_partkey") % 10) / 10).alias("confidence"))
    return coverage.decided(r).select("query_id", "reason", "fallback")


def fallback_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_quantity") / 50).alias("score"))
    return coverage.assessed(line).select("query_id", "n_operands", F.round("coverage", 6).alias("coverage"), "reason", "fallback")


PLANS = [("x1 - x2", [("x1", "asia", "1995 > A"), ("x2", "europe", "1995 > A")]), ("(x1 - x2) / x2 * 100", [("x1", "total", "1996 > R"), ("x2", "total", "1995 > R")]), ("max(x1, x2, abs(-3))", [("x1", "nation_12", "1996 > N"), ("x2", "nation_17", "1996 > A")]), ("x1 / 0", [("x1", "asia", "1995 > A")]), ("x1 + y", [("x1", "asia", "1995 > A")]), ("__import__('os')", [("x1", "asia", "1995 > A")]), ("x1", [("x1", "nowhere at all", "1995 > A")])]


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("table_id")).distinct()
    cell = lambda v, a, b: F.struct(F.lit(v).alias("var"), F.lit(a).alias("row_header"), F.lit(b).alias("col_header"))
    every = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(e).alias("expression"), F.array(*[cell(*c) for c in cs]).alias("cells")) for i, (e, cs) in enumerate(PLANS)])
    return seg.select("table_id", F.explode(every).alias("x")).select(F.concat("table_id", F.lit("/"), F.col("x.i").cast("string")).alias("query_id"), "table_id", "x.expression", "x.cells")


def plan_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arithmetic plans over resolved cells of every table."""
    p = _plans(spark, sf_dir)
    asked = p.select("query_id", "table_id", F.explode("cells").alias("x")).select("query_id", "table_id", "x.var", "x.row_header", "x.col_header")
    got = evaluation.resolve(asked, sales_cells(spark, sf_dir))
    return evaluation.evaluate(p.select("query_id", "expression"), got).select("query_id", F.round("value", 6).alias("value"), "error")


def consistency_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of each order's line quantities, the first line as the floor."""
    line = dealt(spark, sf_dir, "lineitem", "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("f"))
    s = line.select(F.col("l_orderkey").alias("query_id"), (F.col("l_linenumber") - 1).alias("k"), F.col("q").cast("long").cast("string").alias("pred"), (F.col("f") == "R").alias("clean"))
    return _union([evaluation.vote(s, plain=p).select(F.lit(p).alias("plain"), "query_id", "answer") for p in (False, True)])


HTML = [
    '<table><tr><th rowspan="2">club</th><th colspan="2">league</th></tr><tr><td>apps</td><td>goals</td></tr><tr><td>a</td><td>1</td><td>2</td></tr></table>',
    '<table><tr><td colspan="2"Title</td><td>x</td></tr><tr><td rowspan=2>r</td><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>',
    "<p>no table</p>", "", None,
]


def html_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of the parts' HTML tables, as given and with spans filled, with guessed header boundaries and paths."""
    out = []
    for fill in (False, True):
        t = phrased(spark, sf_dir, HTML, "html").select("id", html_to_grid(F.col("html"), fill).alias("g"))
        t = t.withColumn("nr", structure.guessed_header_rows("g.grid")).withColumn("nc", structure.guessed_header_cols("g.grid", F.col("nr")))
        say = lambda p: F.array_join(F.transform(p, lambda x: F.array_join(x, ">")), "|")
        m = structure.merged_paths("g.grid", "g.merges", F.col("nr"), F.col("nc"))
        out.append(t.select(F.lit(fill).alias("fill"), "id", F.size("g.grid").alias("n_rows"), F.size("g.merges").alias("n_merges"), "nr", "nc", say(structure.col_paths("g.grid", F.col("nr"), F.col("nc"))).alias("cols"), say(structure.row_paths("g.grid", F.col("nr"), F.col("nc"))).alias("rows"), say(m["cols"]).alias("merged_cols")))
    return _union(out)


def page_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table parser over all web pages."""
    p = table(spark, sf_dir, "pages").select("page_id", html_to_grid(F.col("html")).alias("g"))
    return p.select("page_id", F.size("g.grid").alias("n_rows"), F.size("g.merges").alias("n_merges"))


def _operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions_of_tables(spark, sf_dir).select("query_id", "table_id")
    return q.join(sales_cells(spark, sf_dir).filter("r = c and r < 4").select("table_id", "r", "c"), "table_id")


def collision_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank records of all schemes and retrievers over the corpus of cells, summed up."""
    r = pipelines.collision_study(questions_of_tables(spark, sf_dir), sales_cells(spark, sf_dir), _operands(spark, sf_dir))
    q = metrics.per_query(r, by=("scheme", "retriever", "query_id"))
    return metrics.summary(q, by=("scheme", "retriever"))


def operand_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pipelines.operand_retrieval(questions_of_tables(spark, sf_dir), sales_cells(spark, sf_dir), _operands(spark, sf_dir))
    return r.groupBy("mode", "k").agg(F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("recall"))


def agent_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plans(spark, sf_dir)
    i = F.element_at(F.split("query_id", "/"), -1).cast("int")
    q = p.select("query_id", "table_id", F.get(F.array(*[F.lit(x) for x in QUESTIONS]), i).alias("question"), F.array(F.lit("12")).alias("answer"))
    return pipelines.agent_evaluation(q, sales_cells(spark, sf_dir), p.select("query_id", "expression", "cells"), pipelines.mock_reader).select("query_id", "kind", "source", "pred", "numeric_match", "exact_match", "error")


def fallback_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions_of_tables(spark, sf_dir)
    c = sales_cells(spark, sf_dir)
    rows = texts.compact_rows(c)
    hits = scoring.top_k(scoring.bm25(q, rows, within=["table_id"]), 5, ["query_id"], "chunk_id").join(rows.select("chunk_id", "r", "text"), "chunk_id").join(c.groupBy("table_id", "r").agg(F.first("row_path").alias("header_path")), ["table_id", "r"])
    return pipelines.fallback_contexts(q, c, hits.select("query_id", "table_id", "chunk_id", F.col("rank").alias("position"), "text", "header_path")).groupBy("query_id").agg(F.count("*").alias("n_chunks"), F.sum("tokens").alias("tokens"))


def decomposition_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of two header paths among as many paths ranked for each question."""
    q = questions_of_tables(spark, sf_dir)
    c = sales_cells(spark, sf_dir)
    best = questions.path_ranking(q, c.select("table_id", F.concat("row_path", "col_path").alias("path")).distinct(), 4, by="decomposer")
    gold = q.select("query_id", F.array(F.lit("ASIA"), F.lit("1995"), F.lit("A")).alias("path"))
    return questions.match_accuracy(best.select("query_id", "path", "rank"), gold)


def _per(ks: tuple[int, ...]) -> str:
    """CTE pq(arm, query_id, m, rr, s, c, h and d of each k) over the rank records."""
    hit = lambda k: f"CAST(coalesce(rank <= {k}, false) AS INTEGER)"
    first = ", ".join(f"min({hit(k)}) AS s{k}, avg({hit(k)}) AS c{k}, max({hit(k)}) AS h{k}, sum(CASE WHEN rank <= {k} THEN ln(2.0) / ln(rank + 1) ELSE 0 END) AS g{k}" for k in ks)
    ideal = ", ".join(f"g{k} / list_sum(list_transform(range(1, CAST(least(m, {k}) AS BIGINT) + 1), lambda i: ln(2.0) / ln(i + 1))) AS d{k}" for k in ks)
    return f"pq0 AS (SELECT arm, query_id, count(*) AS m, coalesce(1.0 / min(rank), 0.0) AS rr, {first} FROM ranks GROUP BY arm, query_id), pq AS (SELECT *, {ideal} FROM pq0)"


def _summary(ks: tuple[int, ...] = (10, 20, 50)) -> str:
    return "count(*) AS n_queries, round(avg(rr), 4) AS mrr, " + ", ".join(f"round(avg(s{k}), 4) AS set_recall_{k}, round(avg(c{k}), 4) AS coverage_{k}, count(*) FILTER (WHERE s{k} = 0 AND c{k} > 0) AS n_partial_{k}, round(avg(h{k}), 4) AS hit_{k}, round(avg(d{k}), 4) AS ndcg_{k}" for k in ks)


_PLAN_CELLS = """v AS (SELECT table_id, max(CASE WHEN row_path = ['ASIA'] AND col_path = ['1995', 'A'] THEN num END) AS a0, max(CASE WHEN row_path = ['EUROPE'] AND col_path = ['1995', 'A'] THEN num END) AS e0, max(CASE WHEN row_path = ['total'] AND col_path = ['1996', 'R'] THEN num END) AS t6, max(CASE WHEN row_path = ['total'] AND col_path = ['1995', 'R'] THEN num END) AS t5,
        max(CASE WHEN row_path[2] = 'NATION_12' AND col_path = ['1996', 'N'] THEN num END) AS ch, max(CASE WHEN row_path[2] = 'NATION_17' AND col_path = ['1996', 'A'] THEN num END) AS jp, arg_max(num, (len(row_path[2]) + len(row_path[1])) * 1000 - r) FILTER (WHERE row_path[1] = 'ASIA' AND col_path = ['1995', 'A']) AS asia, arg_max(num, (len(row_path[2]) + len(row_path[1])) * 1000 - r) FILTER (WHERE row_path[1] = 'EUROPE' AND col_path = ['1995', 'A']) AS eur FROM cells GROUP BY table_id)"""
_PLAN_VALUES = """SELECT table_id || '/0' AS query_id, round(asia - eur, 6) AS value, NULL::VARCHAR AS error FROM v UNION ALL SELECT table_id || '/1', round((t6 - t5) / t5 * 100, 6), NULL FROM v UNION ALL SELECT table_id || '/2', round(greatest(ch, jp, 3), 6), NULL FROM v
      UNION ALL SELECT table_id || '/3', NULL, 'eval_error:division' FROM v UNION ALL SELECT table_id || '/4', NULL, 'eval_error:undefined' FROM v UNION ALL SELECT table_id || '/5', NULL, 'eval_error:grammar' FROM v UNION ALL SELECT table_id || '/6', NULL, 'unresolved_cell:x1' FROM v"""
_OPS = "CASE split_part(query_id, '/', 2) " + " ".join(f"WHEN '{i}' THEN {sum(e.count(x) for x in '+-*/')}" for i, (e, _) in enumerate(PLANS)) + " END"
_CELLS = "CASE split_part(query_id, '/', 2) " + " ".join(f"WHEN '{i}' THEN {len(c)}" for i, (_, c) in enumerate(PLANS)) + " END"

#: Cells as texts of three schemes, ranked for every question by words, by buckets and by both.
_STUDY = f"""+ asked0 AS (SELECT DISTINCT table_id || '/' || id AS query_id, table_id, question FROM cells, {literal_sql(QUESTIONS, 'question')}),
  base AS (SELECT *, table_id || '#' || r || '_' || c AS chunk_id FROM cells),
  chunks AS (SELECT 'flat' AS scheme, chunk_id, row_path[-1] || ' ' || col_path[-1] || ' ' || raw AS text FROM base
    UNION ALL SELECT 'S2', chunk_id, array_to_string(list_concat(row_path, col_path), ' > ') || ': ' || raw FROM base
    UNION ALL SELECT 'S3', chunk_id, 'For ' || array_to_string(row_path, ' > ') || ', ' || array_to_string(col_path, ' > ') || ' is ' || raw || '.' FROM base),
  asked AS (SELECT scheme, scheme || '|' || query_id AS query_id, question FROM asked0, (SELECT unnest(['flat', 'S2', 'S3']) AS scheme)),
  named AS (SELECT scheme || '~' || chunk_id AS name, text FROM chunks), {_bm25_sql('chunks', 'chunk_id', 'asked', part='scheme')},{_hash_sql('asked', 'query_id', 'question', 'hq')},{_hash_sql('named', 'name', 'text', 'hc')},
  dense AS (SELECT query_id, split_part(name, '~', 2) AS chunk_id, sum(hq.w * hc.w) AS score FROM hq JOIN hc ON hq.b = hc.b AND split_part(query_id, '|', 1) = split_part(name, '~', 1) GROUP BY query_id, name),
  mm AS (SELECT query_id, chunk_id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM (SELECT 'd' AS k, * FROM dense UNION ALL SELECT 'b', * FROM scores) WINDOW w AS (PARTITION BY k, query_id)),
  every AS (SELECT 'bm25' AS retriever, * FROM scores UNION ALL SELECT 'dense', * FROM dense UNION ALL SELECT 'hybrid', query_id, chunk_id, sum(0.5 * s) FROM mm GROUP BY query_id, chunk_id),
  top AS (SELECT * FROM (SELECT retriever, query_id, chunk_id, row_number() OVER (PARTITION BY retriever, query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM every) WHERE rank <= 100),
  ranks AS (SELECT x.retriever AS arm, a.query_id, b.chunk_id AS cell, t.rank FROM asked a JOIN asked0 q ON a.query_id = a.scheme || '|' || q.query_id JOIN base b ON b.table_id = q.table_id AND b.r = b.c AND b.r < 4 CROSS JOIN (SELECT unnest(['bm25', 'dense', 'hybrid']) AS retriever) x LEFT JOIN top t ON t.retriever = x.retriever AND t.query_id = a.query_id AND t.chunk_id = b.chunk_id)"""

SQL = {
    "consistency_votes": """WITH l AS (SELECT l_orderkey AS query_id, l_linenumber - 1 AS k, CAST(min(l_quantity) AS BIGINT) AS x, min(l_returnflag) = 'R' AS clean FROM lineitem GROUP BY l_orderkey, l_linenumber),
      f AS (SELECT query_id, min(k) FILTER (WHERE x = 50) < min(k) FILTER (WHERE x = 49) AS near, max(x) FILTER (WHERE k = 0) AS floor FROM l GROUP BY query_id),
      m AS (SELECT l.*, floor, CASE WHEN x = 49 AND near THEN 50 ELSE x END AS rep FROM l JOIN f USING (query_id)),
      p AS (SELECT unnest([false, true]) AS plain),
      g AS (SELECT plain, query_id, rep, any_value(floor) AS floor, min(k) AS first, sum(CASE WHEN plain THEN 1.0 WHEN k = 0 THEN 1.6 WHEN clean THEN 1.0 ELSE 0.6 END)::DOUBLE AS w, max(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS own FROM m, p GROUP BY plain, query_id, rep),
      b AS (SELECT plain, query_id, any_value(floor) AS floor, arg_max(rep, round(w, 6) * 1000 - first) AS rep, max(w) AS w, max(CASE WHEN own = 1 THEN w END) AS own FROM g GROUP BY plain, query_id)
      SELECT plain, query_id, CAST(CASE WHEN NOT plain AND own IS NOT NULL AND w <= own + 1e-9 THEN floor ELSE rep END AS VARCHAR) AS answer FROM b""",
    "collision_study": grid(f"{_STUDY}, {_per((10, 20, 50))} SELECT split_part(query_id, '|', 1) AS scheme, arm AS retriever, {_summary()} FROM pq GROUP BY ALL"),
    "rank_metrics": f"{RANKS}, {_per((10, 20, 50))} SELECT arm, {_summary()} FROM pq GROUP BY arm",
    "query_metrics": f"{RANKS}, {_per((10,))} SELECT arm, query_id, m, round(rr, 6) AS rr, s10 AS set_recall_10, round(c10, 6) AS coverage_10, h10 AS hit_10, round(d10, 6) AS ndcg_10 FROM pq",
    "osc_strata": f"""{RANKS}, {_per((50,))}, r AS (SELECT CASE WHEN m <= 1 THEN '1' WHEN m = 2 THEN '2' WHEN m <= 4 THEN '3-4' WHEN m <= 8 THEN '5-8' ELSE '9+' END AS scope, o_orderstatus AS depth, o_orderpriority AS aggregation, s50 AS osc, c50 AS recall FROM pq JOIN orders ON query_id = o_orderkey WHERE arm = 'base')
      SELECT d AS dimension, v AS value, count(*) AS n, round(avg(osc), 4) AS osc, round(avg(recall), 4) AS recall FROM (SELECT 'overall' AS d, 'all' AS v, osc, recall FROM r UNION ALL SELECT 'scope', scope, osc, recall FROM r UNION ALL SELECT 'depth', depth, osc, recall FROM r UNION ALL SELECT 'aggregation', aggregation, osc, recall FROM r) GROUP BY d, v""",
    "gain_decomposition": f"""{RANKS}, q AS (SELECT query_id, count(*) AS m, min(CAST(coalesce(b <= 30, false) AS INTEGER)) AS cb, min(CAST(coalesce(t <= 30, false) AS INTEGER)) AS ct, min(CAST(b IS NOT NULL AS INTEGER)) AS pool, count(*) FILTER (WHERE b IS NULL) AS absent, count(*) FILTER (WHERE b > 30) AS low
        FROM (SELECT query_id, cell, max(CASE WHEN arm = 'base' THEN rank END) AS b, max(CASE WHEN arm = 'treat' THEN rank END) AS t FROM ranks GROUP BY query_id, cell) GROUP BY query_id)
      SELECT count(*) AS n_queries, CAST(sum(cb) AS BIGINT) AS base_covered, CAST(sum(ct) AS BIGINT) AS treat_covered, count(*) FILTER (WHERE ct = 1 AND cb = 0) AS gain, count(*) FILTER (WHERE ct = 0 AND cb = 1) AS loss, count(*) FILTER (WHERE ct = 1 AND cb = 0 AND pool = 0) AS gain_pool_limited, count(*) FILTER (WHERE ct = 1 AND cb = 0 AND pool = 1) AS gain_rank_limited,
        CAST(coalesce(sum(absent) FILTER (WHERE ct = 1 AND cb = 0), 0) AS BIGINT) AS cells_missing, CAST(coalesce(sum(low) FILTER (WHERE ct = 1 AND cb = 0), 0) AS BIGINT) AS cells_ranked_out, round(count(*) FILTER (WHERE pool = 1 AND m <= 30) / count(*), 4) AS oracle_base FROM q""",
    "collision_strata": f"{RANKS} SELECT colliding, count(*) AS n, median(rank) AS median_rank, round(avg(CAST(coalesce(rank <= 50, false) AS INTEGER)), 6) AS reached FROM ranks GROUP BY colliding",
    "table_recall": f"{RANKS} SELECT arm, count(*) AS n, round(avg(coalesce(1.0 / rank, 0)), 4) AS mrr, round(avg(CAST(coalesce(rank <= 1, false) AS INTEGER)), 4) AS recall_1, round(avg(CAST(coalesce(rank <= 5, false) AS INTEGER)), 4) AS recall_5, round(avg(CAST(coalesce(rank <= 10, false) AS INTEGER)), 4) AS recall_10, round(avg(CASE WHEN rank <= 10 THEN ln(2.0) / ln(rank + 1) ELSE 0 END), 4) AS ndcg_10 FROM ranks WHERE cell = 1 GROUP BY arm",
    "recall_decay": f"{RANKS}, {_per((50,))}, b AS (SELECT * FROM pq WHERE arm = 'base') SELECT m, count(*) AS n, round(avg(s50), 6) AS osc, round(pow((SELECT sum(c50 * m) / sum(m) FROM b), m), 6) AS predicted FROM b GROUP BY m",
    "router_confusion": "SELECT o_orderstatus AS gold, o_orderpriority AS pred, count(*) AS n FROM orders GROUP BY ALL",
    "class_counters": "SELECT p_brand AS class, count(*) AS n, count(*) FILTER (WHERE p_size > 25) AS large, count(*) FILTER (WHERE p_retailprice > 1000) AS dear FROM part GROUP BY ROLLUP (p_brand)",
    "condition_rates": """WITH r AS (SELECT event_type AS condition, CAST(event_id % 3 = 0 AS INTEGER) AS a, CAST(event_id % 5 = 0 AS INTEGER) AS b, CAST(event_id % 7 = 0 AS INTEGER) AS e FROM events WHERE event_id % 11 <> 0)
      SELECT condition, count(*) AS n, round(avg(a), 6) AS accuracy, round(avg(b), 6) AS no_match, round(avg(e), 6) AS empty, round(avg(CASE WHEN b = 0 AND e = 0 THEN 1 ELSE 0 END), 6) AS clean, round(avg(a) FILTER (WHERE b = 0 AND e = 0), 6) AS accuracy_clean FROM r GROUP BY condition""",
    "sentence_scores": grid("""+ t AS (SELECT count(*) FILTER (WHERE r % 7 <> 0) AS produced, count(*) FILTER (WHERE c % 5 <> 0) AS gold, count(*) FILTER (WHERE r % 7 <> 0 AND c % 5 <> 0) AS correct, count(*) FILTER (WHERE r % 7 = 0 AND c % 5 <> 0) AS dropped, count(*) FILTER (WHERE r % 7 <> 0 AND c % 5 = 0) AS spurious FROM cells)
      SELECT *, correct / produced AS precision, correct / gold AS recall, 2 * correct / (produced + gold) AS f1 FROM t"""),
    "exact_tests": f"""WITH l AS (SELECT l_returnflag AS flag, unnest(['supplier ' || l_suppkey, 'flag and month ' || month(l_shipdate), 'all']) AS of FROM lineitem WHERE l_quantity > 25),
      t AS (SELECT of, count(*) FILTER (WHERE flag = 'R') AS b, count(*) FILTER (WHERE flag = 'A') AS c, count(*) FILTER (WHERE flag IN ('R', 'A')) AS n FROM l GROUP BY of),
      p AS (SELECT *, {lower_sql('n', 'least(b, c)')} AS low, CASE WHEN b > c THEN {lower_sql('n', 'c')} ELSE 1 - {lower_sql('n', 'b - 1')} END AS up, b / greatest(n, 1) AS s FROM t),
      q AS (SELECT *, CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * low) END AS two, CASE WHEN n > 0 THEN least(1.0, up) END AS one FROM p)
      SELECT of, b, c, round(ln(CASE WHEN two > 1e-290 THEN two END), 6) + 0.0 AS log_mcnemar, round(ln(CASE WHEN one > 1e-290 THEN one END), 6) + 0.0 AS log_sign,
        round(CASE WHEN n > 0 THEN greatest(0.0, (s + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(s * (1 - s) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)) END, 6) AS low,
        round(CASE WHEN n > 0 THEN least(1.0, (s + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(s * (1 - s) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)) END, 6) AS high FROM q""",
    "paired_flips": f"{RANKS}, {_per((20,))}, j AS (SELECT CASE WHEN a.m <= 1 THEN '1' WHEN a.m = 2 THEN '2' WHEN a.m <= 4 THEN '3-4' WHEN a.m <= 8 THEN '5-8' ELSE '9+' END AS scope, a.s20 AS x, b.s20 AS y FROM pq a JOIN pq b ON a.query_id = b.query_id AND a.arm = 'base' AND b.arm = 'treat') SELECT scope, count(*) AS n, CAST(sum(x) AS BIGINT) AS a_covered, CAST(sum(y) AS BIGINT) AS b_covered, count(*) FILTER (WHERE y = 1 AND x = 0) AS gain, count(*) FILTER (WHERE x = 1 AND y = 0) AS loss FROM j GROUP BY scope",
    "rank_tests": f"""{RANKS}, v AS (SELECT rank, colliding FROM ranks WHERE arm = 'base' AND rank IS NOT NULL), mr AS (SELECT colliding, CAST(count(*) OVER (PARTITION BY rank) AS DOUBLE) AS k, rank() OVER (ORDER BY rank) + (count(*) OVER (PARTITION BY rank) - 1) / 2.0 AS r FROM v),
      d AS (SELECT CAST(a.rank - b.rank AS DOUBLE) AS d FROM ranks a JOIN ranks b ON a.query_id = b.query_id AND a.cell = b.cell AND a.arm = 'base' AND b.arm = 'treat' WHERE a.rank <> b.rank), dr AS (SELECT d, CAST(count(*) OVER (PARTITION BY abs(d)) AS DOUBLE) AS k, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d),
      u AS (SELECT 'u' AS test, count(*) AS n, CAST(count(*) FILTER (WHERE colliding) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE NOT colliding) AS DOUBLE) AS n2, sum(r) FILTER (WHERE colliding) - count(*) FILTER (WHERE colliding) * (count(*) FILTER (WHERE colliding) + 1) / 2.0 AS u, sum(k * k - 1) AS t FROM mr),
      uz AS (SELECT test, n, u AS statistic, u - n1 * n2 / 2 AS far, sqrt(n1 * n2 / 12 * ((n + 1) - t / (CAST(n AS DOUBLE) * (n - 1)))) AS sd FROM u),
      w AS (SELECT 'w' AS test, count(*) AS n, CAST(count(*) AS DOUBLE) AS m, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS plus, coalesce(sum(r) FILTER (WHERE d < 0), 0) AS minus, sum(k * k - 1) AS t FROM dr),
      wz AS (SELECT test, n, least(plus, minus) AS statistic, (least(plus, minus) - m * (m + 1) / 4) / sd AS z, (plus - m * (m + 1) / 4) / sd AS zp, (minus - m * (m + 1) / 4) / sd AS zm FROM (SELECT *, sqrt(m * (m + 1) * (2 * m + 1) / 24 - t / 48) AS sd FROM w))
      SELECT test, n, statistic, round(least(1.0, 2 * {upper_sql('greatest((abs(far) - 0.5) / sd, 0)')}), 6) AS p, round({upper_sql('((far - 0.5) / sd)')}, 6) AS p_greater, round({upper_sql('((-far - 0.5) / sd)')}, 6) AS p_less FROM uz
      UNION ALL SELECT test, n, statistic, round(least(1.0, 2 * {upper_sql('abs(z)')}), 6), round({upper_sql('zp')}, 6), round({upper_sql('zm')}, 6) FROM wz""",
    "exact_rank_sums": f"""WITH v AS (SELECT l_partkey, CAST(round(l_quantity) AS INTEGER) AS q, l_returnflag = 'R' AS hit FROM lineitem WHERE l_partkey % 7 = l_linenumber),
      r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey) - 1 AS i, 2 * rank() OVER (PARTITION BY l_partkey ORDER BY q) + count(*) OVER (PARTITION BY l_partkey, q) - 1 AS r2, count(*) OVER (PARTITION BY l_partkey, q) AS k FROM v),
      g AS (SELECT l_partkey, CAST(count(*) FILTER (WHERE hit) AS INTEGER) AS n1, CAST(count(*) FILTER (WHERE NOT hit) AS INTEGER) AS n2, coalesce(sum(r2) FILTER (WHERE hit), 0) AS s2, list(r2 ORDER BY i) AS rs FROM r GROUP BY l_partkey),
      c AS (SELECT l_partkey, list_sum(list_transform(range(1, len(rs) + 1), lambda i: CASE WHEN (pick >> (i - 1)) & 1 = 1 THEN rs[i] ELSE 0 END)) AS s, s2 FROM (SELECT *, unnest(range(0, 1 << len(rs))) AS pick FROM g WHERE n1 > 0 AND n2 > 0) WHERE bit_count(pick) = n1),
      p AS (SELECT l_partkey, count(*) FILTER (WHERE s >= s2) / count(*) AS up, count(*) FILTER (WHERE s <= s2) / count(*) AS low FROM c GROUP BY l_partkey)
      SELECT l_partkey, n1, n2, s2 / 2.0 - n1 * (n1 + 1) / 2.0 AS u, round(CASE WHEN up IS NOT NULL THEN least(1.0, 2 * least(up, low)) END, 6) AS p, round(up, 6) AS p_greater, round(low, 6) AS p_less, true AS exact FROM g LEFT JOIN p USING (l_partkey)""",
    "packed_context": "SELECT conv_id, turn, tokens, CAST(used AS BIGINT) AS used FROM (SELECT conv_id, turn, tokens, sum(tokens) OVER w AS used, row_number() OVER w AS k FROM (SELECT conv_id, turn, CAST(greatest(1, len(text) // 4) AS INTEGER) AS tokens FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) WHERE used <= 60 OR k = 1",
    "joined_context": """WITH t AS (SELECT conv_id, len(text) AS n, sum(len(text)) OVER w + row_number() OVER w - 1 AS used, row_number() OVER w AS k FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
      f AS (SELECT *, used <= 200 OR k = 1 AS ok FROM t) SELECT conv_id, CAST(sum(n) FILTER (WHERE ok) + count(*) FILTER (WHERE ok) - 1 AS INTEGER) AS n_chars, count(*) FILTER (WHERE ok) < count(*) AS truncated FROM f GROUP BY conv_id""",
    "token_budgets": "WITH p AS (SELECT l_returnflag AS arm, CAST(l_linenumber AS BIGINT) AS k, count(*) % 97 + l_linenumber * 100 AS tokens, round(avg(l_discount), 6) AS osc FROM lineitem GROUP BY l_returnflag, l_linenumber), b AS (SELECT unnest([150, 300, 450, 1000])::BIGINT AS budget) SELECT arm, budget, arg_max(osc, k) AS osc, max(k) AS k FROM p JOIN b ON tokens <= budget GROUP BY arm, budget",
    "ladder_rungs": f"{RANKS}, q AS (SELECT query_id, CASE WHEN count(*) = count(rank) THEN max(CAST(ceil(rank / 10) AS INTEGER)) END AS rung FROM ranks WHERE arm = 'base' GROUP BY query_id) SELECT rung, count(*) AS n FROM q GROUP BY rung",
    "cheapest_config": "WITH c AS (SELECT l_orderkey AS query_id, l_returnflag AS config, count(*) AS n_cells, max(l_quantity) > 30 AS complete FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_cells, config) AS k FROM c WHERE complete) SELECT a.query_id, r.config, r.n_cells FROM (SELECT DISTINCT query_id FROM c) a LEFT JOIN r ON r.query_id = a.query_id AND k = 1",
    "rung_policy": f"{RANKS}, p AS (SELECT query_id, count(*) AS m, max(coalesce(rank, 99)) AS worst FROM ranks WHERE arm = 'base' GROUP BY query_id), c AS (SELECT worst, CASE WHEN m <= 2 THEN 2 ELSE 4 END AS rung FROM p) SELECT round(avg(rung * 10), 6) AS mean_cells, median(rung * 10) AS median_cells, round(avg(CAST(worst <= rung * 10 AS INTEGER)), 6) AS osc, count(*) AS n FROM c",
    "throttle": "SELECT event_id, CAST(w AS BIGINT) AS window_tokens, w <= 90 AS allowed FROM (SELECT event_id, sum(event_id % 100) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS w FROM events)",
    "stratified_sample": "SELECT p_partkey, p_brand, place FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5(p_partkey || ':0')) AS place FROM part) WHERE place <= 5",
    "quota_allocation": "WITH s AS (SELECT o_orderpriority AS stratum, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT *, 103 * n / sum(n) OVER () AS x FROM s), f AS (SELECT *, floor(x) AS fl, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, stratum) AS k FROM e) SELECT stratum, n, CAST(fl + CASE WHEN k <= 103 - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f",
    "resume_pending": "SELECT o_orderkey AS query_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey = o_orderkey)",
    "fallback_decisions": "WITH r AS (SELECT p_partkey AS query_id, p_size % 5 AS n, p_size / 50 AS c, (p_partkey % 10) / 10 AS f FROM part), s AS (SELECT query_id, CASE WHEN n = 0 THEN 'no_operands' WHEN c < 0.7 AND f < 0.3 THEN 'low_both' WHEN c < 0.7 THEN 'low_coverage' WHEN f < 0.3 THEN 'low_confidence' ELSE 'ok' END AS reason FROM r) SELECT query_id, reason, reason <> 'ok' AS fallback FROM s",
    "fallback_by_score": "WITH a AS (SELECT l_orderkey AS query_id, count(*) AS n, avg(CAST(l_quantity / 50 >= 0.3 AS INTEGER)) AS c FROM lineitem GROUP BY 1) SELECT query_id, n AS n_operands, round(c, 6) AS coverage, CASE WHEN c < 0.7 THEN 'coverage<0.7' ELSE 'ok' END AS reason, c < 0.7 AS fallback FROM a",
    "plan_values": grid(f"+ {_PLAN_CELLS} {_PLAN_VALUES}"),
    "agent_answers": grid(f"""+ {_PLAN_CELLS}, pv AS ({_PLAN_VALUES}), {_KINDS}, first AS (SELECT table_id, raw FROM cells WHERE r = 0 AND c = 0),
      t AS (SELECT pv.query_id, kind, value, error, raw, {_OPS} AS ops, {_CELLS} AS n_cells FROM pv JOIN kinds ON kinds.id = CAST(split_part(query_id, '/', 2) AS INTEGER) JOIN first ON first.table_id = split_part(query_id, '/', 1)),
      a AS (SELECT *, error IS NULL AND (ops >= 2 OR (kind = 'arithmetic_agg' AND ops >= 1 AND n_cells >= 2)) AS symbolic FROM t),
      b AS (SELECT *, CASE WHEN NOT symbolic THEN raw WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE regexp_replace(regexp_replace(printf('%.4f', value), '0+$', ''), '\\.$', '') END AS pred FROM a),
      c AS (SELECT *, CAST(pred AS DOUBLE) AS x FROM b)
      SELECT query_id, kind, CASE WHEN symbolic THEN 'symbolic' ELSE 'reader' END AS source, pred, len(list_filter([x, 100 * x, x / 100, abs(x)], lambda p: abs(p - 12) / 12 < 0.02 OR abs(p - 1200) / 1200 < 0.02 OR abs(p - 0.12) / 0.12 < 0.02)) > 0 AS numeric_match, pred = '12' AS exact_match, error FROM c"""),
    "page_grids": "SELECT page_id, 0 AS n_rows, 0 AS n_merges FROM pages WHERE NOT contains(html, '<table')",
}
QUERIES = {f.__name__: f for f in (rank_metrics, query_metrics, osc_strata, gain_decomposition, collision_strata, table_recall, recall_decay, answer_scores, answer_rescore, router_confusion, class_counters, condition_rates, sentence_scores, exact_tests, paired_flips, rank_tests, exact_rank_sums, bootstrap_delta, packed_context, joined_context, token_budgets, ladder_rungs, cheapest_config, rung_policy, throttle, stratified_sample, quota_allocation, resume_pending, fallback_decisions, fallback_by_score, plan_values, consistency_votes, html_grids, page_grids, collision_study, operand_retrieval, agent_answers, fallback_contexts, decomposition_accuracy)}
