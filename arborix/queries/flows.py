"""Queries of whole studies: reranking, injection, selector policies, cost of reconstruction, comparison of two arms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import metrics, scoring, structure
from ..plans import pipelines
from .base import RANKS, grid, lower_sql, rank_records, sales_cells, table
from .evaluation import _per
from .hits import _HORNER, _POLY, LINES, _lines


def rerank_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines among the two largest of an order, and among the two with the highest part numbers of the three largest."""
    h = _lines(spark, sf_dir)
    hits = scoring.ranked(h, ["query_id"], "cell")
    t = pipelines.rerank_contrast(hits, h.filter("flag = 'R'").select("query_id", "cell"), F.col("part").cast("double"), 2, 3)
    return t.select("n", "a_covered", "b_covered", "gain", "loss")


def injected_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions for a diagonal cell and, for half of the tables, a total; the reader takes the last value."""
    c = sales_cells(spark, sf_dir)
    name = F.concat(F.lit("q"), "table_id")
    seed = c.filter("r = 3 and c = 3").select(name.alias("query_id"), "table_id", "r", "c")
    last = c.filter("c = 0 and row_path[0] = 'total'")
    want = last.filter("table_id < 'F'").select(name.alias("query_id"), "table_id", "r", "c")
    q = c.filter("row_path[0] = 'total'").groupBy("table_id").agg(F.max_by("raw", "c").alias("raw")).select(name.alias("query_id"), F.array("raw").alias("answer"))
    return pipelines.injected_answers(q, c, seed, seed.unionByName(want), lambda v: F.element_at(v, -1), "keyword")


def selector_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks in rungs of ten: each rung for all, the cheapest complete one, and one by the number of gold cells."""
    r = rank_records(spark, sf_dir).filter("arm = 'base'")
    per = r.groupBy("query_id").agg(F.count("*").alias("m"), F.max(F.coalesce("rank", F.lit(99))).alias("worst"))
    ladder = per.select("query_id", "worst", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("rung")).select("query_id", "rung", (F.col("rung") * 10).alias("n_cells"), (F.col("worst") <= F.col("rung") * 10).alias("complete"))
    t = pipelines.selector_policies(ladder, per, F.when(F.col("m") <= 2, 3).otherwise(6))
    return t.select("policy", F.round("mean_cells", 6).alias("mean_cells"), "median_cells", F.round("osc", 6).alias("osc"), "n")


def reconstruction_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of three schemes for each table, beside row paths rebuilt from grids of one level only."""
    c = sales_cells(spark, sf_dir)
    lines = c.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("r", "row_path"))), lambda x: x["row_path"]).alias("paths"))
    back = lines.select("table_id", F.posexplode(structure.carried(structure.flattened_headers(F.col("paths"), F.lit(1)))).alias("r", "path"))
    return pipelines.reconstruction_cost(c, back)


def ir_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and paired tests of five metrics of the two arms."""
    t = pipelines.ir_comparison(rank_records(spark, sf_dir))
    return t.select("metric", F.round("base", 6).alias("base"), F.round("treat", 6).alias("treat"), "n", "gain", "loss", F.round("p", 4).alias("p"))


def completeness_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the rows of ASIA hold one of two neighbouring rows or both, by depth of the table's headers, which half of the tables have cut."""
    c = sales_cells(spark, sf_dir).withColumn("row_path", F.when(F.col("table_id") < "F", F.slice("row_path", 1, 1)).otherwise(F.col("row_path")))
    gold = c.filter("c = 0 and r % 4 in (1, 2)").select(F.concat("table_id", F.lit("/"), F.floor(F.col("r") / 4).cast("string")).alias("query_id"), "table_id", "r", "c")
    asked = gold.select("query_id", "table_id").distinct()
    have = asked.join(c.filter("row_path[0] = 'ASIA'").select("table_id", "r", "c"), "table_id")
    depth = c.groupBy("table_id").agg(F.max(F.size("row_path")).alias("d"))
    q = metrics.completeness(gold, have).join(asked, "query_id").join(depth, "table_id")
    return metrics.by_group(q.withColumn("depth", metrics.depth_bin("d")), "depth").select("depth", "n", F.round("osc", 6).alias("osc"), F.round("recall", 6).alias("recall"))


def parsed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric readings of whole numbers, prices and percentages made of every part, in forms that vary with its size."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    price = F.format_number("p_retailprice", 2)
    neg = F.concat(F.when(size % 2 == 0, "($").otherwise("("), price, F.lit(")"))
    share = F.concat(F.lit(" "), size.cast("string"), F.lit(" %"))
    both = F.concat(neg, F.when(size % 5 > 0, share).otherwise(""))
    mark = F.when(size % 3 == 0, "-").otherwise(F.col("p_brand"))
    return p.select("p_partkey", tx.number_prefix(price).alias("prefix"), tx.number_accounting(neg).alias("accounting"), tx.number_search(share).alias("search"), tx.last_number(F.concat(share, F.lit(" of "), price)).alias("last"), F.size(tx.numbers(both)).alias("n_numbers"), tx.looks_numeric(neg).alias("numeric"), tx.data_like(mark).alias("data"))


_METRICS = {"set_recall_20": "s20", "hit_20": "h20", "coverage_20": "c20", "ndcg_20": "d20", "rr": "rr"}
_LONG = " UNION ALL ".join(f"SELECT query_id, '{m}' AS metric, max(CASE WHEN arm = 'base' THEN {c} END) AS b, max(CASE WHEN arm = 'treat' THEN {c} END) AS t FROM pq GROUP BY query_id" for m, c in _METRICS.items())

SQL = {
    "rerank_contrast": f"""WITH {LINES}, s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, cell) AS rank FROM lines),
      n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 3 THEN part END DESC NULLS LAST, rank) AS new_rank FROM s),
      q AS (SELECT query_id, min(CASE WHEN rank <= 2 THEN 1 ELSE 0 END) AS x, min(CASE WHEN new_rank <= 2 THEN 1 ELSE 0 END) AS y FROM n WHERE flag = 'R' GROUP BY query_id)
      SELECT count(*) AS n, CAST(sum(x) AS BIGINT) AS a_covered, CAST(sum(y) AS BIGINT) AS b_covered, count(*) FILTER (WHERE y > x) AS gain, count(*) FILTER (WHERE x > y) AS loss FROM q""",
    "injected_answers": grid("""+ k AS (SELECT table_id, max(r) AS total, count(*) FILTER (WHERE row_path = ['total']) AS n, arg_max(num, c) FILTER (WHERE row_path = ['total']) AS want, max(num) FILTER (WHERE r = 3 AND c = 3) AS seed FROM cells GROUP BY table_id),
      f AS (SELECT 'q' || table_id AS query_id, table_id >= 'F' AS base_osc, n AS injected, abs(want - seed) <= 0.02 * want AS base_ok FROM k)
      SELECT query_id, row_number() OVER (ORDER BY base_osc, query_id) AS place, base_osc, true AS treat_osc, CAST(injected AS INTEGER) AS injected, base_ok, true AS treat_ok FROM f"""),
    "selector_policies": f"""{RANKS}, p AS (SELECT query_id, count(*) AS m, max(coalesce(rank, 99)) AS worst FROM ranks WHERE arm = 'base' GROUP BY query_id),
      a AS (SELECT 'rung_' || g AS policy, g AS at_, worst FROM p, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS g) UNION ALL SELECT 'oracle', CASE WHEN worst <= 60 THEN ceil(worst / 10.0) ELSE 6 END, worst FROM p UNION ALL SELECT 'chosen', CASE WHEN m <= 2 THEN 3 ELSE 6 END, worst FROM p)
      SELECT policy, round(avg(at_ * 10), 6) AS mean_cells, CAST(median(at_ * 10) AS DOUBLE) AS median_cells, round(avg(CASE WHEN worst <= at_ * 10 THEN 1.0 ELSE 0.0 END), 6) AS osc, count(*) AS n FROM a GROUP BY policy""",
    "reconstruction_cost": grid("""+ t AS (SELECT 'flat' AS scheme, table_id, row_path[-1] || ' ' || col_path[-1] || ' ' || raw AS text FROM cells UNION ALL SELECT 'S2', table_id, array_to_string(list_concat(row_path, col_path), ' > ') || ': ' || raw FROM cells
        UNION ALL SELECT 'S3', table_id, 'For ' || array_to_string(row_path, ' > ') || ', ' || array_to_string(col_path, ' > ') || ' is ' || raw || '.' FROM cells),
      x AS (SELECT table_id, count(*) AS n, count(*) FILTER (WHERE len(row_path) = 1) AS n_exact FROM (SELECT DISTINCT table_id, r, row_path FROM cells) GROUP BY table_id)
      SELECT scheme, table_id, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens, any_value(n) AS n, any_value(n_exact) AS n_exact FROM t JOIN x USING (table_id) GROUP BY scheme, table_id"""),
    "ir_comparison": f"""{RANKS}, {_per((20,))}, v AS ({_LONG}), l AS (SELECT metric, round(CAST(t - b AS DOUBLE), 12) AS d FROM v),
      s AS (SELECT metric, avg(b) AS base, avg(t) AS treat, count(*) AS n, count(*) FILTER (WHERE round(t - b, 12) > 0) AS gain, count(*) FILTER (WHERE round(t - b, 12) < 0) AS loss FROM v GROUP BY metric),
      r AS (SELECT metric, d, avg(k) OVER (PARTITION BY metric, abs(d)) AS mid, count(*) OVER (PARTITION BY metric, abs(d)) AS t FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY abs(d)) AS k FROM l WHERE d <> 0)),
      w AS (SELECT metric, CAST(count(*) AS DOUBLE) AS m, least(sum(mid) FILTER (WHERE d > 0), sum(mid) FILTER (WHERE d < 0)) AS w, sum(t * t - 1.0) AS ties FROM r GROUP BY metric),
      z AS (SELECT metric, gain + loss AS k, least(gain, loss) AS low, abs((w - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48)) / sqrt(2.0) AS x FROM w JOIN s USING (metric)),
      p AS (SELECT metric, CASE WHEN metric IN ('set_recall_20', 'hit_20') THEN least(1.0, 2 * {lower_sql('k', 'low')}) ELSE least(1.0, t * exp(-x * x + {_HORNER})) END AS p FROM (SELECT *, {_POLY} AS t FROM z))
      SELECT metric, round(base, 6) AS base, round(treat, 6) AS treat, n, gain, loss, round(p, 4) AS p FROM s JOIN p USING (metric)""",
    "completeness_depths": grid("""+ p AS (SELECT table_id, r, CASE WHEN table_id < 'F' THEN row_path[1:1] ELSE row_path END AS path FROM cells),
      depth AS (SELECT table_id, max(len(path)) AS d FROM p GROUP BY table_id), gold AS (SELECT DISTINCT table_id, r, r // 4 AS k, CASE WHEN path[1] = 'ASIA' THEN 1.0 ELSE 0.0 END AS hit FROM p WHERE r % 4 IN (1, 2)),
      q AS (SELECT table_id, k, min(hit) AS osc, avg(hit) AS recall FROM gold GROUP BY table_id, k)
      SELECT CASE WHEN d <= 1 THEN 'flat(d<=1)' ELSE 'd' || d END AS depth, count(*) AS n, round(avg(osc), 6) AS osc, round(avg(recall), 6) AS recall FROM q JOIN depth USING (table_id) GROUP BY 1"""),
    "parsed_labels": r"""WITH s AS (SELECT p_partkey, p_size, p_brand, p_retailprice AS x, CASE WHEN p_size % 2 = 0 THEN '($' ELSE '(' END || format('{:,.2f}', p_retailprice) || ')' AS neg FROM part),
      t AS (SELECT *, neg || CASE WHEN p_size % 5 > 0 THEN ' ' || p_size || ' %' ELSE '' END AS both_, CASE WHEN p_size % 3 = 0 THEN '-' ELSE p_brand END AS mark FROM s)
      SELECT p_partkey, round(x, 2) AS prefix, -round(x, 2) AS accounting, CAST(p_size AS DOUBLE) AS search, round(x, 2) AS last, CAST(len(regexp_extract_all(both_, '-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+\.?\d*')) AS INTEGER) AS n_numbers,
        regexp_full_match(neg, '[$(\-]?[\d,]+\.?\d*%?\)?') AS numeric, mark IN ('-', '..', 'n/a') OR regexp_full_match(mark, '[$(\-]?[\d,]+\.?\d*%?\)?') AS data FROM t""",
}
QUERIES = {f.__name__: f for f in (rerank_contrast, injected_answers, selector_policies, reconstruction_cost, ir_comparison, completeness_depths, parsed_labels)}
