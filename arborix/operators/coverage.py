"""When retrieved cells are not enough, and what the reader then gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from .ranking import packed

TAU_COVERAGE, TAU_CONFIDENCE, SCORE_FLOOR = 0.7, 0.3, 0.3


def self_coverage(operands: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, n_operands, n_covered, coverage): decomposed operands whose tokens a retrieved path covers.

    operands: (query_id, operand, path: array); hits: (query_id, path: array).
    """
    tokens = lambda: F.flatten(F.transform("path", tx.norm_tokens))
    pair = operands.select("query_id", "operand", tokens().alias("a")).join(hits.select("query_id", tokens().alias("b")).distinct(), "query_id", "left")
    one = pair.groupBy("query_id", "operand").agg(F.max(F.coalesce(tx.tokens_covered("a", "b"), F.lit(False))).alias("ok"))
    return one.groupBy("query_id").agg(F.count("*").alias("n_operands"), F.count_if("ok").alias("n_covered"), F.avg(F.col("ok").cast("int")).alias("coverage"))


def reason(n_operands, coverage, confidence, tau_coverage: float = TAU_COVERAGE, tau_confidence: float = TAU_CONFIDENCE) -> Column:
    low_c, low_f = F.col(coverage) < tau_coverage, F.col(confidence) < tau_confidence
    return F.when(F.col(n_operands) == 0, "no_operands").when(low_c & low_f, "low_both").when(low_c, "low_coverage").when(low_f, "low_confidence").otherwise("ok")


def decided(reports: DataFrame, **thresholds) -> DataFrame:
    """Reports with the reason and whether to fall back; the ablation passes thresholds of 0."""
    r = reason("n_operands", "coverage", "confidence", **thresholds)
    return reports.withColumn("reason", r).withColumn("fallback", F.col("reason") != "ok")


def assessed(operands: DataFrame, tau_coverage: float = TAU_COVERAGE, tau_confidence: float = 0.0, floor: float = SCORE_FLOOR) -> DataFrame:
    """Coverage by the scores of decomposed operands (query_id, score) alone."""
    g = operands.groupBy("query_id").agg(F.count("score").alias("n_operands"), F.coalesce(F.avg((F.col("score") >= floor).cast("int")), F.lit(0.0)).alias("coverage"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("confidence"))
    say = F.array(F.when(F.col("n_operands") == 0, "no_operands"), F.when(F.col("coverage") < tau_coverage, f"coverage<{tau_coverage}"), F.when(F.col("confidence") < tau_confidence, f"confidence<{tau_confidence}"))
    why = F.array_join(F.filter(say, lambda s: s.isNotNull()), ",")
    return g.withColumn("reason", F.when(why == "", "ok").otherwise(why)).withColumn("fallback", why != "")


def extended(hits: DataFrame, reports: DataFrame, full: DataFrame, rows: DataFrame, tables: DataFrame, most: int = 60, enabled: bool = True) -> DataFrame:
    """Hits with the whole table behind them where a query falls back: one chunk, or its rows if there are many.

    hits: (query_id, table_id, chunk_id, position, text); full and rows: chunks;
    tables: (table_id, n_rows).  The ablation switches it off.
    """
    back = reports.filter("fallback" if enabled else "false").select("query_id").join(hits.select("query_id", "table_id").distinct(), "query_id").join(tables, "table_id")
    one = back.filter(F.col("n_rows") <= most).join(full.select("table_id", "chunk_id", "text"), "table_id")
    many = back.filter(F.col("n_rows") > most).join(rows.select("table_id", "chunk_id", "text"), "table_id")
    more = one.unionByName(many).select("query_id", "table_id", "chunk_id", F.lit(1 << 30).alias("position"), "text")
    new = more.join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return hits.select("query_id", "table_id", "chunk_id", "position", "text").unionByName(new.select("query_id", "table_id", "chunk_id", "position", "text"))


def built(hits: DataFrame, reports: DataFrame, table_rows: DataFrame, tokens: int = 4096, cells: int = 12, enabled: bool = True) -> DataFrame:
    """The chunks of a context: the best cells, or the table's rows on fallback, packed into a budget."""
    r = reports.select("query_id", (F.col("fallback") & F.lit(enabled)).alias("fallback"))
    few = hits.join(r.filter("not fallback"), "query_id").filter(F.col("position") <= cells).select("query_id", "chunk_id", "position", "text")
    whole = hits.select("query_id", "table_id").distinct().join(r.filter("fallback"), "query_id").join(table_rows, "table_id")
    whole = whole.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("r"))).select("query_id", "chunk_id", "position", "text")
    return packed(few.unionByName(whole), tokens, ["query_id"], "position")
