"""Queries over what is fitted, stored or repeated: lexical index, quantile selector, repair rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admission, boosting, evaluation, repair
from ..plans import pipelines
from ..sources import commits, formats
from ..sources.lexical import LexicalIndex
from ..sources.shared import folder
from ..sources.vectors import VectorStore
from .base import RANKS, grid, rank_records, sales_cells, stored, table
from .retrieval import SQL as RETRIEVAL


def lexical_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage asked of an index of all documents."""
    index = LexicalIndex.build(table(spark, sf_dir, "documents").select("doc_id", "text"), folder(spark, "lexical"), key="doc_id")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return index.search(asked, 10, key="doc_id").select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 asked of a store of all vectors, of which a third were added twice."""
    v = table(spark, sf_dir, "embeddings").select(F.lit("t").alias("table_id"), F.col("vec_id").alias("chunk_id"), F.lit("").alias("text"), F.col("embedding").alias("v"))
    store = VectorStore(spark, folder(spark, "vectors"))
    wrong = F.when(F.col("chunk_id") % 3 == 0, F.reverse("v")).otherwise(F.col("v"))
    store.add("all", v.withColumn("v", wrong))
    store.add("all", v.filter("chunk_id % 3 = 0"))
    asked = v.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("v").alias("qv"))
    hits, _ = store.nearest("all", asked, 5)
    return hits.select("query_id", F.col("chunk_id").alias("vec_id"), "rank", F.round("score", 4).alias("score"))


def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as sample files of two splits, read as a data source: those of one split about five tables, with their answers."""
    formats.register(spark)
    at = folder(spark, "samples")
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_size").cast("string").alias("table_id"), F.col("p_name").alias("question"), F.array(F.col("p_brand"), F.col("p_size").cast("string")).alias("answer"))
    for k, split in enumerate(("dev", "train")):
        part.filter(F.substring("id", 2, 20).cast("long") % 2 == k).select(F.to_json(F.struct("*"))).write.text(f"{at}/{split}_samples")
    read = spark.read.format("table_samples").option("rangeBytes", 1 << 20).load(at)
    return read.filter(F.col("split").isin("dev") & F.col("table_id").isin("1", "7", "12", "30", "50")).select("split", "id", "table_id", "question", F.array_join("answer", "|").alias("answer"))


ALPHAS, ROUNDS, DEPTH, RATE, LEAST = (0.5, 0.8, 0.95), 5, 2, 0.3, 20
FEATURES = ["m", "prio", "yr", "band"]


def quantile_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks in rungs of ten: on a third of the orders each rung for all, the cheapest complete one, and those that quantile models of the other orders choose."""
    per = rank_records(spark, sf_dir).filter("arm = 'base'").groupBy("query_id").agg(F.count("*").alias("m"), F.max(F.coalesce("rank", F.lit(99))).alias("worst"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("prio"), F.year("o_orderdate").alias("yr"), F.least(F.floor(F.col("o_totalprice") / 20000), F.lit(20)).cast("int").alias("band"))
    rows = stored(per.join(o, "query_id").withColumn("y", F.when(F.col("worst") <= 60, F.ceil(F.col("worst") / 10.0).cast("int"))), "features")
    models = boosting.fit(rows.filter("query_id % 3 <> 0"), FEATURES, "y", ALPHAS, ROUNDS, DEPTH, RATE, least=LEAST)
    test = rows.filter("query_id % 3 = 0")
    ladder = test.select("query_id", "worst", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("rung")).select("query_id", "rung", (F.col("rung") * 10).alias("n_cells"), (F.col("worst") <= F.col("rung") * 10).alias("complete"))
    choose = {f"quantile_{m.alpha}": F.greatest(F.lit(1), F.least(F.lit(6), F.floor(m.prediction() + 0.5).cast("int"))) for m in models}
    t = pipelines.selector_policies(ladder, test, choose)
    return t.select("policy", F.round("mean_cells", 6).alias("mean_cells"), "median_cells", F.round("osc", 6).alias("osc"), "n")


def _fit_sql(source: str, features: list[str], alpha: float, rounds: int, depth: int, rate: float, least: int, name: str) -> str:
    """The same fit as DuckDB SQL, unrolled: a chain of tables whose last one, name, has (id, pred) of all rows of source (id, train, y, features).

    For features with few values, which are all cuts.
    """
    p = name
    out = [f"{p}_0 AS MATERIALIZED (SELECT s.*, (SELECT min(y) FROM (SELECT y, row_number() OVER (ORDER BY y) AS k, count(*) OVER () AS n FROM {source} WHERE train AND y IS NOT NULL) WHERE k >= ceil({alpha}::DOUBLE * n)) AS pred, 0 AS node FROM {source} s)"]
    for k in range(rounds):
        at = f"{p}_{k}"
        for d in range(depth):
            long = " UNION ALL ".join(f"SELECT node, {i} AS f, {f}::DOUBLE AS v, y > pred AS up FROM {at} WHERE train AND y IS NOT NULL" for i, f in enumerate(features))
            gain = f"(({alpha}::DOUBLE * ul - (1 - {alpha}::DOUBLE) * (nl - ul)) / nl - ({alpha}::DOUBLE * ur - (1 - {alpha}::DOUBLE) * (nr - ur)) / nr)"
            out += [
                f"{p}_{k}_{d}h AS (SELECT node, f, v, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE up) AS DOUBLE) AS u FROM ({long}) GROUP BY node, f, v)",
                f"{p}_{k}_{d}g AS (SELECT node, f, v, sum(n) OVER w AS nl, sum(u) OVER w AS ul, sum(n) OVER (PARTITION BY node, f) - sum(n) OVER w AS nr, sum(u) OVER (PARTITION BY node, f) - sum(u) OVER w AS ur FROM {p}_{k}_{d}h WINDOW w AS (PARTITION BY node, f ORDER BY v))",
                f"{p}_{k}_{d}s AS (SELECT node, f, v FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v) AS o FROM (SELECT *, nl * nr / (nl + nr) * ({gain} * {gain}) AS gain FROM {p}_{k}_{d}g WHERE nl >= {least} AND nr >= {least}) WHERE gain > 1e-12) WHERE o = 1)",
                f"{p}_{k}_{d} AS MATERIALIZED (SELECT a.* REPLACE (2 * a.node + CASE WHEN coalesce(CASE s.f {' '.join(f'WHEN {i} THEN a.{f}' for i, f in enumerate(features))} END > s.v, false) THEN 1 ELSE 0 END AS node) FROM {at} a LEFT JOIN {p}_{k}_{d}s s ON s.node = a.node)",
            ]
            at = f"{p}_{k}_{d}"
        out += [
            f"{p}_{k}l AS (SELECT node, min(r) AS leaf FROM (SELECT node, y - pred AS r, row_number() OVER (PARTITION BY node ORDER BY y - pred) AS k, count(*) OVER (PARTITION BY node) AS n FROM {at} WHERE train AND y IS NOT NULL) WHERE k >= ceil({alpha}::DOUBLE * n) GROUP BY node)",
            f"{p}_{k + 1} AS MATERIALIZED (SELECT a.* REPLACE (pred + {rate}::DOUBLE * coalesce(leaf, 0) AS pred, 0 AS node) FROM {at} a LEFT JOIN {p}_{k}l l ON l.node = a.node)",
        ]
    return ", ".join([*out, f"{p} AS (SELECT id, pred FROM {p}_{rounds})"])


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as calls of up to 198 tokens, 160 a day at most, some turned away once or more."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_id") % 100 * 2).alias("tokens"), F.when(F.col("event_id") % 11 == 0, 3).when(F.col("event_id") % 7 == 0, 1).otherwise(0).alias("failures"))
    t = admission.admitted(e, 160, "event_id", ["user_id"], failures="failures", seconds=86400)
    return t.select("user_id", "event_id", F.unix_micros("start").alias("start_us"), F.round("waited", 3).alias("waited"), "attempts", "failed")


def committed_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer, counted in batches that are committed: first of half of the customers, then of what is left."""
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders")

    def work(todo: DataFrame) -> DataFrame:
        return todo.join(o, todo["c_custkey"] == o["o_custkey"], "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"), F.max("o_orderkey").alias("last_order"))

    log = commits.CommitLog(spark, folder(spark, "commits"), "c_custkey", slices=3)
    log.run(c.filter("c_custkey % 2 = 0"), work)
    return log.run(c, work)


def repair_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups of all nations' cells by headers with up to three words too many, of which each repair drops one; some cells are empty for good."""
    c = sales_cells(spark, sf_dir).withColumn("num", F.when(F.col("r") % 5 != 1, F.col("num")))
    extra = F.array_join(F.array_repeat(F.lit(" > of"), (F.col("r") + F.col("c")) % 4), "")
    asked = c.filter("size(row_path) = 2 and col_path[1] <> 'N'").select(F.concat_ws("/", "table_id", "r", "c").alias("query_id"), "table_id", F.concat(F.lower(F.array_join("row_path", " > ")), extra).alias("row_header"), F.array_join("col_path", " > ").alias("col_header"))

    def attempt(rows: DataFrame) -> DataFrame:
        t = evaluation.traced_lookup(rows, c)
        step = F.struct(F.concat_ws(" | ", "row_header", "col_header").alias("step"), F.col("value").cast("string").alias("value"), F.col("flag").alias("flag"))
        return t.select("query_id", F.col("value").cast("long").cast("string").alias("result"), F.lit(None).cast("string").alias("error"), F.array(step).alias("trace"))

    drop_one = F.regexp_replace("row_header", " > of$", "")
    t = repair.repaired(asked, attempt, lambda rows: rows.withColumn("row_header", drop_one), folder(spark, "repair"))
    return t.select("query_id", "row_header", "result", F.col("trace")[0]["flag"].alias("flag"), "flagged", "n_repair")


_SELECTOR = f"""{RANKS}, p AS (SELECT query_id, count(*) AS m, max(coalesce(rank, 99)) AS worst FROM ranks WHERE arm = 'base' GROUP BY query_id),
  src AS MATERIALIZED (SELECT query_id AS id, query_id % 3 <> 0 AS train, worst, CAST(CASE WHEN worst <= 60 THEN ceil(worst / 10.0) END AS DOUBLE) AS y, m, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS prio, year(o_orderdate) AS yr, CAST(least(floor(o_totalprice / 20000), 20) AS INTEGER) AS band FROM p JOIN orders ON o_orderkey = query_id),
  {", ".join(_fit_sql("src", FEATURES, a, ROUNDS, DEPTH, RATE, LEAST, f"q{k}") for k, a in enumerate(ALPHAS))},
  t AS (SELECT id, worst FROM src WHERE NOT train),
  a AS (SELECT 'rung_' || g AS policy, g AS at_, worst FROM t, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS g) UNION ALL SELECT 'oracle', CASE WHEN worst <= 60 THEN ceil(worst / 10.0) ELSE 6 END, worst FROM t
    {" ".join(f"UNION ALL SELECT 'quantile_{a}', greatest(1, least(6, floor(pred + 0.5))), worst FROM t JOIN q{k} USING (id)" for k, a in enumerate(ALPHAS))})
  SELECT policy, round(avg(at_ * 10), 6) AS mean_cells, CAST(median(at_ * 10) AS DOUBLE) AS median_cells, round(avg(CASE WHEN worst <= at_ * 10 THEN 1.0 ELSE 0.0 END), 6) AS osc, count(*) AS n FROM a GROUP BY policy"""

_REPAIR = grid("""+ n AS (SELECT table_id, r, c, row_path, CASE WHEN r % 5 <> 1 THEN num END AS num, (r + c) % 4 AS k FROM cells WHERE len(row_path) = 2 AND col_path[2] <> 'N')
  SELECT table_id || '/' || r || '/' || c AS query_id, lower(array_to_string(row_path, ' > ')) || CASE WHEN k = 3 THEN ' > of' ELSE '' END AS row_header, CASE WHEN k < 3 THEN CAST(CAST(num AS BIGINT) AS VARCHAR) END AS result,
    CASE WHEN k = 3 THEN 'NO_MATCH' WHEN num IS NULL THEN 'EMPTY' END AS flag, k = 3 OR num IS NULL AS flagged, CAST(CASE WHEN num IS NULL THEN 2 ELSE least(k, 2) END AS INTEGER) AS n_repair FROM n""")

_ADMISSIONS = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS at_, event_id % 100 * 2 AS n, CASE WHEN event_id % 11 = 0 THEN 3 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS fails, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 0::BIGINT AS event_id, 0::BIGINT AS at_, 0 AS fails, 0::BIGINT AS start, 0::BIGINT AS free, []::STRUCT(t BIGINT, n BIGINT)[] AS log FROM e
    UNION ALL SELECT user_id, i, event_id, at_, fails, start, CASE WHEN start IS NULL THEN free ELSE start + 1000000 * ((1::BIGINT << least(fails, 3)) - 1) END,
      CASE WHEN start IS NULL THEN log ELSE list_append(list_filter(log, lambda x: start - x.t < 86400000000), {'t': start, 'n': n}) END
    FROM (SELECT *, CASE WHEN n <= 160 THEN list_min(list_filter(list_prepend(base, list_transform(log, lambda x: x.t + 86400000000)), lambda c: c >= base AND coalesce(list_sum(list_transform(log, lambda x: CASE WHEN c - x.t < 86400000000 THEN x.n ELSE 0 END)), 0) + n <= 160)) END AS start
      FROM (SELECT e.user_id, e.i, e.event_id, e.at_, e.fails, e.n, f.free, f.log, greatest(e.at_, f.free) AS base FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)))
  SELECT user_id, event_id, start AS start_us, round((start - at_) / 1000000, 3) AS waited, CAST(CASE WHEN start IS NULL THEN 0 ELSE least(fails, 2) + 1 END AS INTEGER) AS attempts, start IS NULL OR fails > 2 AS failed FROM f WHERE i > 0"""

SQL = {"sample_files": "SELECT 'dev' AS split, 'p' || p_partkey AS id, CAST(p_size AS VARCHAR) AS table_id, p_name AS question, p_brand || '|' || p_size AS answer FROM part WHERE p_partkey % 2 = 0 AND p_size IN (1, 7, 12, 30, 50)", "committed_work": "SELECT c_custkey, count(o_orderkey) AS n_orders, max(o_orderkey) AS last_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", "admissions": _ADMISSIONS, "lexical_index": RETRIEVAL["bm25_topk"], "vector_store": RETRIEVAL["dense_topk"], "quantile_selector": _SELECTOR, "repair_rounds": _REPAIR}

QUERIES = {f.__name__: f for f in (sample_files, lexical_index, vector_store, quantile_selector, admissions, committed_work, repair_rounds)}
