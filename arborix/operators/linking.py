"""Joins that tie annotations to cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx


def attach(samples: DataFrame, tables: DataFrame) -> DataFrame:
    """Samples with their table, null if there is none."""
    return samples.join(tables, "table_id", "left")


def value_candidates(operands: DataFrame, cells: DataFrame, places: int = 4) -> DataFrame:
    """(operand columns..., r, c): cells whose rounded number is the operand's."""
    o = operands.withColumn("k", F.round("value", places))
    c = cells.filter(F.col("num").isNotNull()).select("table_id", "r", "c", "row_path", "col_path", F.round("num", places).alias("k"))
    return o.join(c, ["table_id", "k"]).drop("k")


def best_candidate(candidates: DataFrame, row_headers: str = "row_headers", col_headers: str = "col_headers", by: tuple[str, ...] = ("query_id", "operand")) -> DataFrame:
    """Of each operand's candidates the one whose leaf headers agree most with the linked ones; the first wins ties."""

    def agrees(path, given):
        own = F.lower(tx.leaf(path))
        return ((own != "") & F.exists(given, lambda h: F.contains(h, own) | F.contains(own, h))).cast("int")

    score = agrees("row_path", row_headers) + agrees("col_path", col_headers)
    w = Window.partitionBy(*by).orderBy(score.desc(), "r", "c")
    return candidates.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def offset(coords: DataFrame, cells: DataFrame, by: str = "table_id", most: int = 6) -> DataFrame:
    """(by, h, w): the first shift under which every annotated (i, j, value) is the cell (i - h, j - w).

    An equi-join on the value finds where each annotation could be; a shift
    holds if it does so for all.
    """
    keys = list(dict.fromkeys([by, "table_id"]))
    a = coords.select(*keys, "i", "j", F.col("value").alias("num")).distinct()
    n = a.groupBy(by).agg(F.count("*").alias("n"))
    hit = a.join(cells.select("table_id", "r", "c", "num"), ["table_id", "num"]).select(by, "i", "j", (F.col("i") - F.col("r")).alias("h"), (F.col("j") - F.col("c")).alias("w"))
    hit = hit.filter(F.col("h").between(0, most - 1) & F.col("w").between(0, most - 1))
    full = hit.groupBy(by, "h", "w").agg(F.count_distinct("i", "j").alias("k")).join(n, by).filter("k = n")
    return full.groupBy(by).agg(F.min(F.struct("h", "w")).alias("o")).select(by, "o.h", "o.w")


def pooled_offset(coords: DataFrame, cells: DataFrame) -> DataFrame:
    """(query_id, h, w): a table's shift from all its queries' annotations, else the query's own."""
    pooled = offset(coords, cells, "table_id")
    own = offset(coords, cells, "query_id")
    q = coords.select("query_id", "table_id").distinct().join(pooled.select("table_id", F.struct("h", "w").alias("p")), "table_id", "left").join(own.select("query_id", F.struct("h", "w").alias("o")), "query_id", "left")
    return q.select("query_id", F.coalesce("p", "o").alias("x")).select("query_id", "x.h", "x.w")


def evidence(texts: DataFrame, text: str = "evidence") -> DataFrame:
    """(query_id, table_id, row_name, col_name, value) of "the {row} of {col} is {value} ;"."""
    pattern = r"the\s+(.+?)\s+of\s+(.+?)\s+is\s+(.+?)\s*(?:;|$)"
    part = lambda k: F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(k))
    t = texts.select("query_id", "table_id", F.posexplode(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("v"))).alias("k", "x"))
    return t.select("query_id", "table_id", "k", tx.normal_label(F.col("x.a")).alias("row_name"), tx.normal_label(F.col("x.b")).alias("col_name"), F.col("x.v").alias("value"))


def contained(found: DataFrame, lines: DataFrame, name: str, at: str) -> DataFrame:
    """The first line of a table whose label equals, holds or is held by a name: found with column ``at``."""
    l = lines.select("table_id", F.col("at"), tx.normal_label("label").alias("label")).filter("label <> ''")  # noqa: E741
    near = found.join(l, "table_id").filter((F.col("label") == F.col(name)) | F.contains(F.col(name), F.col("label")) | F.contains(F.col("label"), F.col(name)))
    first = near.groupBy("query_id", "table_id", "k").agg(F.min("at").alias(at))
    return found.join(first, ["query_id", "table_id", "k"])


def evidence_operands(texts: DataFrame, row_labels: DataFrame, col_labels: DataFrame) -> DataFrame:
    """Operands of evidence sentences, each cell once: (query_id, table_id, r, c, value, value_type)."""
    both = contained(contained(evidence(texts), row_labels, "row_name", "r"), col_labels, "col_name", "c")
    first = both.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "r", "c").orderBy("k"))).filter("n = 1")
    v = tx.number_search("value")
    return first.select("query_id", "table_id", "r", "c", v.alias("value"), F.when(v.isNotNull(), "number").otherwise("string").alias("value_type"))


def covers(rows, cols, r, c) -> Column:
    return F.array_contains(rows, r) & F.array_contains(cols, c)


def covered(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """Gold cells (query_id, table_id, r, c) that any retrieved chunk (query_id, table_id, rows, cols) covers."""
    cells = hits.select("query_id", "table_id", F.explode("rows").alias("r"), "cols").select("query_id", "table_id", "r", F.explode("cols").alias("c"))
    return gold.join(cells, ["query_id", "table_id", "r", "c"], "left_semi")


def operand_recall(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, recall): the share of a query's gold cells that are covered."""
    hit = covered(gold, hits).select("query_id", "r", "c", F.lit(1).alias("hit"))
    return gold.join(hit, ["query_id", "r", "c"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def path_recall(gold: DataFrame, hits: DataFrame, k: int | None = None) -> DataFrame:
    """Recall by token cover: gold (query_id, g, path), hits (query_id, rank, path: arrays)."""
    near = hits if k is None else hits.filter(F.col("rank") <= k)
    tokens = lambda p: F.flatten(F.transform(p, tx.norm_tokens))
    pair = gold.select("query_id", "g", tokens("path").alias("a")).join(near.select("query_id", tokens("path").alias("b")), "query_id").filter(tx.tokens_covered("a", "b"))
    hit = pair.select("query_id", "g", F.lit(1).alias("hit")).distinct()
    return gold.join(hit, ["query_id", "g"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def attribution(operands: DataFrame, cells: DataFrame) -> DataFrame:
    """How often a gold value stands in one cell only: (n, ambiguous, share)."""
    n = value_candidates(operands, cells).groupBy("query_id", "operand").agg(F.count("*").alias("k"))
    return n.agg(F.count("*").alias("n"), F.count_if(F.col("k") > 1).alias("ambiguous"), (F.count_if(F.col("k") > 1) / F.count("*")).alias("share"))
