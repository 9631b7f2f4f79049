"""The benchmarks' small SQL: a conjunction of conditions, one column, one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

AGGREGATES = ("", "max", "min", "count", "sum", "avg")
OPERATORS = ("=", ">", "<")


def condition(column: Column, op: str, value) -> Column:
    """``=`` compares trimmed lower-case text; ``>`` and ``<`` need numbers on both sides."""
    text = column.cast("string")
    if op == "=":
        return F.coalesce(F.lower(F.trim(text)) == str(value).strip().lower(), F.lit(False))
    a, b = tx.number_strict(text), tx.number_strict(F.lit(str(value)))
    return F.coalesce((a > b) if op == ">" else (a < b), F.lit(False))


def where(rows: DataFrame, conditions: list[tuple[str, str, object]]) -> DataFrame:
    """Rows that meet all conditions; a column that is not there is met by none."""
    out = rows
    for name, op, value in conditions:
        out = out.filter(condition(F.col(name), op, value) if name in rows.columns else F.lit(False))
    return out


def execute(rows: DataFrame, select: str, aggregate: str = "", conditions: list[tuple[str, str, object]] | None = None) -> DataFrame:
    """Picked values, or one row with the aggregate.

    count counts picked values, numbers or not; where no picked value is a
    number the other aggregates give null.
    """
    if aggregate not in AGGREGATES:
        raise ValueError(f"no such aggregate: {aggregate}")
    picked = where(rows, conditions or [])
    value = F.col(select)
    if not aggregate:
        return picked.select(value.alias("answer"))
    if aggregate == "count":
        return picked.agg(F.count("*").alias("answer"))
    n = value if dict(rows.dtypes)[select] in ("double", "int", "bigint", "float") else tx.number_strict(value)
    return picked.agg({"max": F.max, "min": F.min, "sum": F.sum, "avg": F.avg}[aggregate](n.cast("double")).alias("answer"))


def execute_all(tables: DataFrame, queries: DataFrame) -> DataFrame:
    """Many small queries over many small tables at once: (query_id, answers, row_ids).

    tables: (table_id, r, values: array<string>); queries: (query_id, table_id,
    sel, agg, conds: array<struct<col, op, value>>), numbered as in AGGREGATES
    and OPERATORS.
    """
    t = queries.join(tables, "table_id", "left")

    def holds(c):
        cell = F.get("values", c["col"])
        a, b = tx.number_strict(cell), tx.number_strict(c["value"])
        same = F.lower(F.trim(cell)) == F.lower(F.trim(c["value"]))
        return F.coalesce(F.when(c["op"] == 1, a > b).when(c["op"] == 2, a < b).otherwise(same), F.lit(False))

    ok = F.coalesce(F.forall("conds", holds), F.lit(False))
    v = F.get("values", F.col("sel"))
    picked = F.when(ok & F.col("r").isNotNull() & (F.col("sel") < F.size("values")), F.struct("r", v.alias("v")))
    g = t.groupBy("query_id", "agg").agg(F.array_sort(F.collect_list(picked)).alias("p"), F.array_sort(F.collect_list(F.when(ok, F.col("r")))).alias("row_ids"))
    raw = F.transform("p", lambda x: x["v"])
    n = F.filter(F.transform(raw, tx.number_strict), lambda x: x.isNotNull())
    total = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
    number = F.when(F.col("agg") == 1, F.array_max(n)).when(F.col("agg") == 2, F.array_min(n)).when(F.col("agg") == 4, total).when(F.col("agg") == 5, total / F.size(n))
    answers = F.when(F.col("agg") == 3, F.array(F.size("p").cast("string"))).when((F.col("agg") == 0) | (F.size(n) == 0), raw).otherwise(F.array(number.cast("string")))
    return g.select("query_id", answers.alias("answers"), "row_ids")
