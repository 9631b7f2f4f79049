"""Repairing answers in rounds: what is still flagged is revised and tried again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import exists
from .evaluation import needs_repair

#: What a try gives beside query_id; a step of the trace is what was looked up, and what was wrong with it.
TRIED = "result string, error string, trace array<struct<step: string, value: string, flag: string>>"


def feedback(program: Column) -> Column:
    """What the model is told of a try: the program, each step with its flag, and the problems."""
    step = lambda t: F.concat(F.lit("  "), t["step"], F.lit(" -> "), F.coalesce(t["value"], F.lit("NO MATCH")), F.coalesce(F.concat(F.lit(" ["), t["flag"], F.lit("]")), F.lit("")))
    problems = F.concat_ws("; ", F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), "error")), F.when(F.col("result").isNull() | (F.trim("result") == ""), F.lit("no result")), F.when(F.exists("trace", lambda t: t["flag"].isNotNull()), F.lit("a lookup found nothing or an empty cell")))
    return F.concat(F.lit("program:\n"), program, F.lit("\ntrace:\n"), F.array_join(F.transform("trace", step), "\n"), F.lit("\nproblems: "), problems)


def repaired(asked: DataFrame, attempt: Callable[[DataFrame], DataFrame], revise: Callable[[DataFrame], DataFrame], path: str, rounds: int = 2) -> DataFrame:
    """(columns of asked, result, error, trace, flagged, n_repair): the last try of each query.

    attempt: rows like asked -> (query_id, TRIED).  revise: rows of asked with
    TRIED -> rows like asked, the next programs; a model call is a Column of
    :func:`feedback`.  Only what is flagged goes on, for ``rounds`` rounds at
    most.  Each round is stored below path before the next one begins, and one
    that is there already is not run again, so a run that died goes on where it
    was.  A query for which attempt gives no row has failed without a result.
    """
    spark, left, last = asked.sparkSession, asked, None
    done: list[DataFrame] = []
    for k in range(rounds + 1):
        at = f"{path}/round-{k}"
        if not exists(spark, f"{at}/_SUCCESS"):
            tried = left.join(attempt(left), "query_id", "left").withColumn("trace", F.coalesce("trace", F.array().cast(TRIED.split("trace ")[1])))
            flags = F.transform("trace", lambda t: t["flag"])
            tried.withColumn("flagged", needs_repair("result", "error", flags)).write.mode("overwrite").parquet(at)
        last = spark.read.parquet(at).withColumn("n_repair", F.lit(k))
        flagged = last.filter("flagged")
        if k == rounds or flagged.isEmpty():
            break
        done.append(last.filter("not flagged"))
        left = revise(flagged.drop("flagged", "n_repair")).select(*asked.columns)
    for rows in done:
        last = last.unionByName(rows)
    return last


def repair_traces(spark, path: str, rounds: int = 2) -> DataFrame:
    """(query_id, n_repair, result, error, trace): all tries of all rounds that are stored."""
    there = [k for k in range(rounds + 1) if exists(spark, f"{path}/round-{k}/_SUCCESS")]
    parts = [spark.read.parquet(f"{path}/round-{k}").select("query_id", F.lit(k).alias("n_repair"), "result", "error", "trace") for k in there]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
