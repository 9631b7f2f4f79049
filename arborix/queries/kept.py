"""Queries over what sinks leave and readers take up again, and over what a model's replies hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, texts
from ..sources import sinks
from ..sources.shared import folder
from .base import RANKS, grid, rank_records, sales_cells, table
from .hits import _CHUNK


def stored_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the sales tables as texts of two conditions, written and read by condition."""
    c = sales_cells(spark, sf_dir)
    rows = texts.compact_rows(c).select(F.lit("rows").alias("condition"), "table_id", "text")
    values = c.select(F.lit("values").alias("condition"), "table_id", F.col("raw").alias("text"))
    at = folder(spark, "conditions")
    sinks.write_conditions(rows.unionByName(values), at)
    return spark.read.schema("table_id string, text string, condition string").json(at).groupBy("condition", "table_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


def stored_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many questions have how many operands, as the sink reports it, beside the operands that it wrote."""
    ops = sales_cells(spark, sf_dir).filter("(r * c) % 7 = 0").select(F.concat("table_id", F.lit("/"), F.col("r").cast("string")).alias("query_id"), "table_id", "r", "c", F.col("num").alias("value"), F.lit("number").alias("value_type"))
    at = folder(spark, "operands")
    counts = sinks.write_operands(ops, at)
    back = spark.read.schema("query_id string, value double").json(at).groupBy("query_id").agg(F.count("*").alias("m"), F.sum("value").alias("value"))
    return counts.join(back.groupBy("m").agg(F.sum("value").alias("value")), "m")


def stored_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header inventories in folders by names that are safe for files; the ids of some tables are not."""
    c = sales_cells(spark, sf_dir).withColumn("table_id", F.when(F.col("table_id") < "G", F.concat("table_id", F.lit(" (1)"))).otherwise(F.col("table_id")))
    at = folder(spark, "inventory")
    sinks.write_inventory(c, at)
    t = spark.read.schema("table_id string, row_depth int, col_depth int, row_paths array<string>, col_paths array<string>, name string").json(at)
    return t.select("table_id", "name", "row_depth", "col_depth", F.size("row_paths").alias("n_rows"), F.size("col_paths").alias("n_cols"))


def stored_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank records of two arms, written as the ranking leaves them and read as the metrics take them."""
    r = rank_records(spark, sf_dir).select(F.lit("S2").alias("scheme"), F.col("arm").alias("retriever"), "query_id", "cell", "rank", "colliding", F.lit(False).alias("total_like"))
    at = folder(spark, "ranks")
    r.withColumn("query_id", F.col("query_id").cast("string")).withColumn("cell", F.col("cell").cast("string")).write.json(at)
    t = sinks.ranks_by_query(sinks.read_ranks(spark, at))
    return t.select("scheme", "retriever", "query_id", F.array_join("ranks", ",", "-").alias("ranks"))


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("k"), F.col("p_size").cast("string").alias("s"))


def guarded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of generated code about each part: the value of those that are arithmetic, null for all else."""
    lit, rest = F.lit, F.col("id") % 6
    code = (
        F.when(rest == 0, F.concat(lit("print(("), "s", lit(" + "), "k", lit(") * 2)")))
        .when(rest == 1, F.concat(lit("result = "), "s", lit(" - "), "k"))
        .when(rest == 2, F.concat(lit("import os; os.remove('"), "k", lit("')")))
        .when(rest == 3, F.concat("s", lit(" / 0")))
        .when(rest == 4, F.concat(lit("x + "), "s"))
        .otherwise(F.concat(lit("```python\nanswer = "), "k", lit(" / "), "s", lit("\n```")))
    )
    return _part(spark, sf_dir).select("id", F.round(evaluation.guarded(code), 6).alias("value"))


def phased_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans in two replies about each part; of some a variable has no pair, of some there is no plan."""
    lit, rest = F.lit, F.col("id") % 3
    skeleton = F.when(rest == 0, F.concat(lit('The plan: {"expression": "x - y * '), "k", lit('", "variables": ["x", "y"]} as asked'))).when(rest == 1, F.concat(lit("no plan for "), "k")).otherwise(lit('{"expression": " ", "variables": ["x"]}'))
    pair = lambda v, c: F.concat(lit(f'"{v}": {{"row_header": "part '), c, lit('", "col_header": "size"}'))
    cells = F.concat(lit("{"), pair("x", F.col("k")), F.when(F.col("id") % 2 == 0, F.concat(lit(", "), pair("y", F.col("s")))).otherwise(lit("")), lit("}"))
    t = evaluation.adopted_plan(_part(spark, sf_dir).select(F.col("id").alias("query_id"), skeleton.alias("skeleton"), cells.alias("cells")))
    return t.select("query_id", "expression", F.array_join(F.transform("cells", lambda c: F.concat(c["var"], lit("="), c["row_header"], lit("/"), c["col_header"])), "|").alias("cells"), "complete")


SQL = {
    "stored_conditions": grid(f"+ {_CHUNK}, t AS (SELECT 'rows' AS condition, table_id, text FROM chunks UNION ALL SELECT 'values', table_id, raw FROM cells) SELECT condition, table_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM t GROUP BY ALL"),
    "stored_operands": grid("+ o AS (SELECT table_id, r, count(*) AS m, sum(num) AS value FROM cells WHERE (r * c) % 7 = 0 GROUP BY ALL) SELECT m, count(*) AS n, sum(value) AS value FROM o GROUP BY m"),
    "stored_inventory": grid("""+ t AS (SELECT CASE WHEN table_id < 'G' THEN table_id || ' (1)' ELSE table_id END AS table_id, row_path, col_path FROM cells), s AS (SELECT *, regexp_replace(table_id, '[^A-Za-z0-9_\\-]', '_', 'g') AS safe FROM t)
      SELECT table_id, CASE WHEN safe = table_id THEN safe ELSE safe[1:46] || '-' || md5(table_id)[1:16] END AS name, CAST(max(len(row_path)) AS INTEGER) AS row_depth, CAST(max(len(col_path)) AS INTEGER) AS col_depth, CAST(count(DISTINCT row_path) AS INTEGER) AS n_rows, CAST(count(DISTINCT col_path) AS INTEGER) AS n_cols FROM s GROUP BY table_id, safe"""),
    "stored_ranks": f"{RANKS} SELECT 'S2' AS scheme, arm AS retriever, CAST(query_id AS VARCHAR) AS query_id, string_agg(coalesce(CAST(rank AS VARCHAR), '-'), ',' ORDER BY CAST(cell AS VARCHAR)) AS ranks FROM ranks GROUP BY arm, query_id",
    "guarded_values": "SELECT p_partkey AS id, round(CASE p_partkey % 6 WHEN 0 THEN (p_size + p_partkey) * 2.0 WHEN 1 THEN p_size - p_partkey WHEN 5 THEN p_partkey / CAST(p_size AS DOUBLE) END, 6) AS value FROM part",
    "phased_plans": """WITH t AS (SELECT p_partkey AS id, 'x=part ' || p_partkey || '/size' AS x, CASE WHEN p_partkey % 2 = 0 THEN '|y=part ' || p_size || '/size' ELSE '' END AS y FROM part)
      SELECT id AS query_id, CASE id % 3 WHEN 0 THEN 'x - y * ' || id WHEN 2 THEN ' ' END AS expression, CASE id % 3 WHEN 0 THEN x || y WHEN 1 THEN '' ELSE x END AS cells, id % 6 = 0 AS complete FROM t""",
}
QUERIES = {f.__name__: f for f in (stored_conditions, stored_operands, stored_inventory, stored_ranks, guarded_values, phased_plans)}
