"""What the queries run on: relations derived from the driver's tables, and small literal lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a part that a table is dealt into by a key, about: what a task holds.
PART = 1 << 18


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """The table in parts by a key, as many as its rows call for, so that a task holds as much of a large table as of a small one.

    Groups and joins by the key, or by the key and more, need no further shuffle.
    """
    t = table(spark, sf_dir, name)
    return t.repartition(max(4, -(-t.count() // PART)), key)  # the count is read from the files' footers


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def sales_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hierarchical table for each market segment: rows region > nation with subtotals and a total, columns year > flag.

    Stored once: however often a query reads the cells, lines are summed once.
    """
    t = lambda n: table(spark, sf_dir, n)
    line = t("lineitem").select("l_orderkey", F.year("l_shipdate").alias("yr"), F.col("l_returnflag").alias("rf"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("v"))
    who = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    who = who.select("c_custkey", F.col("c_mktsegment").alias("seg"), F.col("r_name").alias("reg"), F.col("n_name").alias("nat"))
    # lines are summed to orders' customers before names are joined to them
    by_cust = line.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "yr", "rf").agg(F.sum("v").alias("v"))
    base = by_cust.join(who, F.col("o_custkey") == F.col("c_custkey"))
    c = F.col
    g = base.groupingSets([[c("seg"), c("reg"), c("nat"), c("yr"), c("rf")], [c("seg"), c("reg"), c("yr"), c("rf")], [c("seg"), c("yr"), c("rf")]], "seg", "reg", "nat", "yr", "rf").agg(F.sum("v").alias("v"))
    path = F.when(c("reg").isNull(), F.array(F.lit("total"))).when(c("nat").isNull(), F.array("reg")).otherwise(F.array("reg", "nat"))
    r = F.dense_rank().over(Window.partitionBy("seg").orderBy(c("reg").asc_nulls_last(), c("nat").asc_nulls_first())) - 1
    k = F.dense_rank().over(Window.partitionBy("seg").orderBy("yr", "rf")) - 1
    return stored(g.select(c("seg").alias("table_id"), F.concat(F.lit("Sales of "), "seg").alias("title"), r.alias("r"), k.alias("c"), c("v").cast("string").alias("raw"), c("v").cast("double").alias("num"), path.alias("row_path"), F.array(c("yr").cast("string"), "rf").alias("col_path")), "cells")


GRID = """WITH li AS (
  SELECT c_mktsegment AS seg, r_name AS reg, n_name AS nat, year(l_shipdate) AS yr, l_returnflag AS rf, CAST(round(l_extendedprice * 100) AS BIGINT) AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT seg, reg, nat, yr, rf, CAST(sum(v) AS BIGINT) AS v FROM li GROUP BY GROUPING SETS ((seg, reg, nat, yr, rf), (seg, reg, yr, rf), (seg, yr, rf))),
cells AS MATERIALIZED (SELECT seg AS table_id, 'Sales of ' || seg AS title,
  CAST(dense_rank() OVER (PARTITION BY seg ORDER BY reg ASC NULLS LAST, nat ASC NULLS FIRST) - 1 AS INTEGER) AS r,
  CAST(dense_rank() OVER (PARTITION BY seg ORDER BY yr, rf) - 1 AS INTEGER) AS c,
  CAST(v AS VARCHAR) AS raw, CAST(v AS DOUBLE) AS num,
  CASE WHEN reg IS NULL THEN ['total'] WHEN nat IS NULL THEN [reg] ELSE [reg, nat] END AS row_path,
  [CAST(yr AS VARCHAR), rf] AS col_path FROM g)"""


def grid(sql: str) -> str:
    """SQL over the sales cells (table_id, title, r, c, raw, num, row_path, col_path)."""
    return f"{GRID}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().removeprefix('+')}"


QUESTIONS = [
    "What is the total sales of ASIA in 1995?", "How many more sales in FRANCE than in GERMANY in 1996?", "which nation had the highest sales in 1994?",
    "difference between CHINA and JAPAN in 1993", "list the nations of EUROPE", "what percentage of total sales came from BRAZIL in 1995?",
    "ratio of CANADA to UNITED STATES in 1997", "average of sales in AFRICA", "who sold more, INDIA or INDONESIA?", "define a subtotal",
    "what is the value in row EGYPT?", "sales of IRAN in 1992 and 1993 divided by the total", "1994 - 1993 / 1993", "pre-war non-profit",
    "number of nations above 100", "top three regions by sales", "KENYA vs MOROCCO in 1996", "sales for every region in 1998", "what are the sales of PERU", "combined total of all nations",
    "what was the change and the average in 1997?", "explain the table", "MIDDLE EAST sales of 1995", "", "how much higher is AMERICA compared to ASIA?",
]
NUMBERS = ["1,234.5", "$1,350", "(451)", "15 to 19", "2017 actual", "5%", "-", "..", "n/a", "", None, "true", "nan", "1e5", "2004", "1899", "(3.2)", "$-5", "12%", "-7.25", " 42 ", "3.", ".5", "1,2,3", "about 1,000,000 people"]


def literal(spark: SparkSession, values: list, name: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), f"id int, {name} string")


def literal_sql(values: list, name: str) -> str:
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"(SELECT CAST(col0 AS INTEGER) AS id, CAST(col1 AS VARCHAR) AS {name} FROM (VALUES {', '.join(f'({i}, {text(v)})' for i, v in enumerate(values))}))"


#: In the texts that parts are given: what stands for the size of the part, and for its brand.
SIZE_MARKS, BRAND_MARK = ("1995", "5"), "ASIA"


def phrased(spark: SparkSession, sf_dir: str, values: list, name: str) -> DataFrame:
    """(id, name): for each part one of the texts, with the part's size and brand put in."""
    text, size = F.col(name), F.col("p_size").cast("string")
    for mark in SIZE_MARKS:
        text = F.replace(text, F.lit(mark), size)
    given = spark.createDataFrame(list(enumerate(values)), f"k int, {name} string")
    part = table(spark, sf_dir, "part").withColumn("k", F.pmod("p_partkey", F.lit(len(values))).cast("int"))
    return part.join(F.broadcast(given), "k").select(F.col("p_partkey").alias("id"), F.replace(text, F.lit(BRAND_MARK), "p_brand").alias(name))


def phrased_sql(values: list, name: str) -> str:
    text = name
    for mark in SIZE_MARKS:
        text = f"replace({text}, '{mark}', CAST(p_size AS VARCHAR))"
    return f"(SELECT p_partkey AS id, replace({text}, '{BRAND_MARK}', p_brand) AS {name} FROM part JOIN {literal_sql(values, name)} v ON v.id = p_partkey % {len(values)})"


def questions_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every literal question about every sales table: (query_id, table_id, question)."""
    seg = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("table_id")).distinct()
    asked = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(x).alias("question")) for i, x in enumerate(QUESTIONS)])
    return seg.select("table_id", F.explode(asked).alias("q")).select(F.concat("table_id", F.lit("/"), F.col("q.id").cast("string")).alias("query_id"), "table_id", "q.question")


def rank_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank records of two arms: an order is a query, its lines are gold cells; ranks past 60 are absent."""
    line = dealt(spark, sf_dir, "lineitem", "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("base"), F.min("l_suppkey").alias("treat"), F.min("l_returnflag").alias("flag"))
    arms = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("key")) for a in ("base", "treat")])).alias("x")
    t = line.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("cell"), (F.col("flag") == "R").alias("colliding"), arms)
    return t.select("x.arm", "query_id", "cell", F.when(F.col("x.key") % 71 < 60, F.col("x.key") % 71 + 1).cast("int").alias("rank"), "colliding")


RANKS = """WITH line AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS base, min(l_suppkey) AS treat, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_linenumber),
arms AS (SELECT 'base' AS arm, l_orderkey, l_linenumber, base AS key, flag FROM line UNION ALL SELECT 'treat', l_orderkey, l_linenumber, treat, flag FROM line),
ranks AS (SELECT arm, l_orderkey AS query_id, l_linenumber AS cell, CASE WHEN key % 71 < 60 THEN CAST(key % 71 + 1 AS INTEGER) END AS rank, flag = 'R' AS colliding FROM arms)"""


_COEF = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
#: SQL of t and of the polynomial in it, for a two-sided tail t * exp(-x * x + ...) at x, a deviate over the root of 2.
POLY = "1.0 / (1.0 + 0.5 * x)"
HORNER = reduce(lambda acc, k: f"({acc} * t + ({k}))", reversed(_COEF[:-1]), f"({_COEF[-1]})")


def upper_sql(z: str) -> str:
    """SQL of the probability that a standard normal lies above z."""
    x = f"(abs({z}) / sqrt(2.0))"
    tail = "(SELECT t * exp(-x * x + " + HORNER + f") / 2 FROM (SELECT x, {POLY} AS t FROM (SELECT {x} AS x)))"
    return f"(CASE WHEN {z} >= 0 THEN {tail} ELSE 1 - {tail} END)"


def lower_sql(n: str, k: str) -> str:
    """SQL of P(X <= k) for X binomial (n, 1/2)."""
    return f"(SELECT coalesce(sum(exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2.0))), 0) FROM (SELECT unnest(range(0, CAST({k} AS BIGINT) + 1)) AS i))"
