"""Readers that bring benchmark files into the canonical relations, and sinks.

Schemas are always given, never inferred; splits and identifiers are pushed to
the scan.  Readers make DataFrames: nothing is loaded until it is asked for.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions.udfs import html_to_grid
from ..operators import linking, minisql, structure

def _first(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.limit(limit)


SAMPLE = "id string, table_id string, question string, sub_sentence string, query string, answer array<string>, aggregation array<string>, answer_formulas array<string>, linked_cells string"
TREE_NODE = "table_id string, axis string, node string, parent string, name string, line int"


def question_of() -> Column:
    """The first of question, sub_sentence and query that is not empty."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in ("question", "sub_sentence", "query")], F.lit(""))


def samples(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Question samples of a JSONL file or folder."""
    return _first(spark.read.schema(SAMPLE).json(path), limit)


def sample_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(table_id, raw): one JSON document a file; of a table in several folders the first folder's counts."""
    parts = []
    for k, p in enumerate(paths):
        t = spark.read.text(p, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("table_id"), F.col("value").alias("raw"))
        parts.append(t.withColumn("k", F.lit(k)))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    w = Window.partitionBy("table_id").orderBy("k")
    return union.withColumn("n", F.row_number().over(w)).filter("n = 1").select("table_id", "raw")


_NODES = T.ArrayType(T.StructType([T.StructField(k, T.IntegerType() if k == "line" else T.StringType()) for k in ("axis", "node", "parent", "name", "line")]))


@pandas_udf(_NODES)
def _nodes_of(raw: pd.Series) -> pd.Series:
    """Nodes of the two header trees of a table's JSON; a node's id is its place, like 0.2.1."""

    def nodes(text):
        try:
            doc = json.loads(text)
        except (TypeError, ValueError, RecursionError):
            return []
        out = []
        for axis in ("top", "left"):
            todo = [("0", None, doc.get(f"{axis}_root"))] if isinstance(doc, dict) else []
            while todo:
                node, parent, x = todo.pop()
                if not isinstance(x, dict):
                    continue
                name = next((str(x[k]) for k in ("value", "name") if x.get(k) is not None), "")
                line = x.get("line_idx")
                out.append({"axis": axis, "node": node, "parent": parent, "name": name.strip(), "line": line if isinstance(line, int) else None})
                kids = next((x[k] for k in ("children_dict", "children") if isinstance(x.get(k), list)), [])
                todo += [(f"{node}.{k}", node, kid) for k, kid in enumerate(kids)]
        return out

    return raw.map(nodes)


def tree_nodes(tables: DataFrame) -> DataFrame:
    """Header-tree nodes of raw tables (table_id, raw), of any depth: (table_id, axis, node, parent, name, line)."""
    return tables.select("table_id", F.explode(_nodes_of("raw")).alias("x")).select("table_id", "x.axis", "x.node", "x.parent", "x.name", "x.line")


def tree_lines(tables: DataFrame) -> DataFrame:
    """(table_id, axis, line): the grid lines that the header trees touch."""
    return tree_nodes(tables).filter("line is not null").select("table_id", "axis", "line").distinct()


def tree_cells(tables: DataFrame) -> DataFrame:
    """Cells of raw tables with header trees: paths by line, or by the order of leaves if no lines are given."""
    nodes = tree_nodes(tables)
    paths = None
    for axis in ("top", "left"):
        n = nodes.filter(F.col("axis") == axis).drop("axis")
        inner = n.select(F.col("table_id"), F.col("parent").alias("node")).distinct()
        leaves = n.join(inner, ["table_id", "node"], "left_anti")
        order = F.row_number().over(Window.partitionBy("table_id").orderBy(F.transform(F.split("node", r"\."), lambda s: s.cast("int")))) - 1
        lined = n.groupBy("table_id").agg(F.max(F.col("line").isNotNull()).alias("has_lines"))
        numbered = n.join(leaves.select("table_id", "node", order.alias("k")), ["table_id", "node"], "left").join(lined, "table_id")
        numbered = numbered.withColumn("line", F.when(F.col("has_lines"), F.col("line")).otherwise(F.col("k")))
        p = structure.tree_paths(numbered.select("table_id", "node", "parent", "name", "line")).withColumn("axis", F.lit(axis))
        paths = p if paths is None else paths.unionByName(p)
    doc = tables.select("table_id", F.try_parse_json("raw").alias("v"))
    rows = doc.select("table_id", F.coalesce(F.try_variant_get("v", "$.title", "string"), F.lit("")).alias("title"), F.posexplode(F.try_variant_get("v", "$.data", "array<array<variant>>")).alias("r", "row"))
    plain = F.try_variant_get("x", "$", "string")  # of an object, its JSON: one without a value is an empty cell
    raw = F.coalesce(F.try_variant_get("x", "$.value", "string"), F.when(~plain.startswith("{"), plain))
    cells = rows.select("table_id", "title", "r", F.posexplode("row").alias("c", "x")).select("table_id", "title", "r", "c", raw.alias("raw"))
    side = lambda axis, at, name: paths.filter(F.col("axis") == axis).select("table_id", F.col("line").alias(at), F.col("path").alias(name))
    full = cells.join(side("left", "r", "row_path"), ["table_id", "r"], "left").join(side("top", "c", "col_path"), ["table_id", "c"], "left")
    none = F.array().cast("array<string>")
    return full.select("table_id", "title", "r", "c", "raw", tx.number_prefix("raw").alias("num"), F.coalesce("row_path", none).alias("row_path"), F.coalesce("col_path", none).alias("col_path"))


def linked_coordinates(rows: DataFrame) -> DataFrame:
    """(query_id, table_id, i, j, value) of the quantity links of samples."""
    kind = "struct<quantity_link: map<string, map<string, string>>>"
    buckets = rows.select(F.col("id").alias("query_id"), "table_id", F.explode(F.from_json("linked_cells", kind)["quantity_link"]).alias("bucket", "cells"))
    x = buckets.select("query_id", "table_id", F.explode("cells").alias("at", "value")).withColumn("rc", tx.coordinate("at"))
    return x.select("query_id", "table_id", F.col("rc.r").alias("i"), F.col("rc.c").alias("j"), tx.number_prefix("value").alias("value")).filter("value is not null and i is not null")


def hitab_of(s: DataFrame, tables: DataFrame, split: str = "dev") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, cells, operands) of samples (SAMPLE) and raw tables (table_id, raw): operands by the tables' pooled offset."""
    cells = tree_cells(tables)
    q = s.select(F.col("id").alias("query_id"), question_of().alias("question"), "table_id", "answer", F.array_join("aggregation", ",").alias("aggregation"), F.lit(split).alias("split"), F.lit("hitab").alias("source"))
    coords = linked_coordinates(s)
    shift = linking.pooled_offset(coords, cells)
    ops = coords.join(shift.filter("h is not null"), "query_id").select("query_id", "table_id", (F.col("i") - F.col("h")).alias("r"), (F.col("j") - F.col("w")).alias("c"), "value", F.lit("number").alias("value_type"))
    return q, cells, ops.distinct()


def hitab(spark: SparkSession, data: str, split: str = "dev", limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`hitab_of` the files of the hierarchical benchmark."""
    return hitab_of(samples(spark, f"{data}/{split}_samples.jsonl", limit), sample_tables(spark, [f"{data}/tables/hmt", f"{data}/tables/raw"]), split)


def finqa_of(t: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, cells, operands) of (id, question, answer, table, gold_evidence): row 0 holds the headers, column 0 the labels."""
    q = t.select(F.col("id").alias("query_id"), "question", F.col("id").alias("table_id"), F.array(F.col("answer").cast("string")).alias("answer"), F.lit("").alias("aggregation"), F.lit("").alias("split"), F.lit("finqa").alias("source"))
    body = t.filter(F.size("table") > 1).select(F.col("id").alias("table_id"), F.get("table", 0).alias("head"), F.posexplode(F.slice("table", 2, F.greatest(F.size("table") - 1, F.lit(1)))).alias("r", "row"))
    cells = body.select("table_id", "r", "row", "head", F.posexplode("row").alias("c", "raw")).select("table_id", F.lit("").alias("title"), "r", "c", "raw", tx.number_search("raw").alias("num"), F.array(F.get("row", 0)).alias("row_path"), F.array(F.get("head", F.col("c"))).alias("col_path"))
    rows = body.select("table_id", F.col("r").alias("at"), F.get("row", 0).alias("label"))
    cols = t.select(F.col("id").alias("table_id"), F.posexplode(F.get("table", 0)).alias("at", "label"))
    texts = t.select(F.col("id").alias("query_id"), F.col("id").alias("table_id"), F.array_join("gold_evidence", " ").alias("evidence"))
    return q, cells, linking.evidence_operands(texts, rows, cols)


def finqa(spark: SparkSession, path: str, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`finqa_of` the rows of Parquet files."""
    return finqa_of(_first(spark.read.parquet(path), limit))


def wikisql_of(t: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, cells, answers) of (question, table, sql): answers by running the questions' small SQL."""
    t = t.withColumn("query_id", F.sha2(F.concat_ws("|", "question", "table.id"), 256))
    conds = F.transform(F.arrays_zip(F.col("sql.conds.column_index").alias("col"), F.col("sql.conds.operator_index").alias("op"), F.col("sql.conds.condition").alias("value")), lambda x: F.struct(x["col"].cast("int").alias("col"), x["op"].cast("int").alias("op"), x["value"].cast("string").alias("value")))
    q = t.select("query_id", "question", F.col("table.id").alias("table_id"), F.col("sql.sel").cast("int").alias("sel"), F.col("sql.agg").cast("int").alias("agg"), conds.alias("conds"))
    rows = t.select(F.col("table.id").alias("table_id"), F.col("table.header").alias("head"), F.coalesce(F.nullif(F.col("table.caption"), F.lit("")), F.col("table.page_title"), F.lit("")).alias("title"), F.posexplode("table.rows").alias("r", "row")).dropDuplicates(["table_id", "r"])
    cells = rows.select("table_id", "title", "r", "head", F.posexplode("row").alias("c", "raw")).select("table_id", "title", "r", "c", "raw", tx.number_strict("raw").alias("num"), F.array().cast("array<string>").alias("row_path"), F.array(F.get("head", F.col("c"))).alias("col_path"))
    return q, cells, minisql.execute_all(rows.select("table_id", "r", F.col("row").alias("values")), q)


def wikisql(spark: SparkSession, path: str, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`wikisql_of` the rows of Parquet files."""
    return wikisql_of(_first(spark.read.parquet(path), limit))


QA = "uid string, tables array<string>, table_description map<string, string>, qa struct<question: string, question_type: string, program: string, table_evidence: array<string>, text_evidence: array<string>, answer: string>"


def multihiertt_of(docs: DataFrame, population: str = "arith_multi", tolerance: float = 1e-6, keep_as: Callable[[DataFrame, str], DataFrame] = lambda rows, _: rows) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, cells, funnel) of documents (QA): one population of questions, tables of all documents, and the counts along the filters.

    The last step checks the evidence: the numbers that its descriptions state
    must stand in the table.  keep_as(rows, label) may store what several of the
    three results need, so that tables are parsed once.
    """
    ev = F.coalesce("qa.table_evidence", F.array().cast("array<string>"))
    tables = F.array_distinct(F.transform(ev, lambda s: F.get(F.split(s, "-"), 0)))
    arithmetic = F.coalesce(F.trim("qa.program"), F.lit("")) != ""
    alone, one = F.coalesce(F.size("qa.text_evidence") <= 0, F.lit(True)), F.size(tables) == 1
    n = F.size(F.array_distinct(ev))
    table_id = F.concat("uid", F.lit("#"), F.get(tables, 0))
    html = docs.select("uid", F.posexplode("tables").alias("k", "html")).select(F.concat("uid", F.lit("#"), F.col("k").cast("string")).alias("table_id"), html_to_grid(F.col("html"), fill=True).alias("g"))
    head = html.select("table_id", F.lit("").alias("title"), F.col("g.grid").alias("grid"), F.col("g.n_span_rows").alias("n_header_rows"), F.lit(1).alias("n_header_cols"))
    cells = keep_as(structure.grid_cells(head), "cells")
    stated = docs.select("uid", table_id.alias("table_id"), F.explode(ev).alias("at"), "table_description").select("uid", "table_id", "at", F.try_element_at("table_description", "at").alias("description"))
    values = evidence_values(stated)
    near = values.join(cells.select("table_id", tx.number_accounting("raw").alias("num")), "table_id").filter(F.abs(F.col("num") - F.col("value")) <= tolerance * F.greatest(F.abs("value"), F.lit(1.0))).select("uid", "at").distinct()
    lost = values.filter("value is not null").join(near, ["uid", "at"], "left_anti").select("uid").distinct().withColumn("lost", F.lit(True))
    lost = keep_as(lost, "lost")
    # the steps of the funnel are cumulative: one pass counts them all
    steps = [arithmetic, arithmetic & alone, arithmetic & alone & one, arithmetic & alone & one & (n >= 2)]
    steps.append(steps[-1] & F.col("lost").isNull())
    checked = docs.join(lost, "uid", "left")
    names = ("arithmetic", "table_only", "single_table", "multi_operand", "value_validated")
    funnel = checked.agg(F.count("*").alias("questions"), *[F.count_if(s).alias(k) for s, k in zip(steps, names, strict=True)])
    if population not in ("arith_multi", "lookup_single"):
        raise ValueError(f"no such population: {population}")
    rows = checked.filter(steps[-1]) if population == "arith_multi" else docs.filter(~arithmetic & alone & (n == 1))  # lookups are not checked
    q = rows.select(F.col("uid").alias("query_id"), F.col("qa.question").alias("question"), table_id.alias("table_id"), F.array("qa.answer").alias("answer"), ev.alias("evidence"))
    return q, cells, funnel


def multihiertt(spark: SparkSession, path: str, population: str = "arith_multi") -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`multihiertt_of` the documents of a JSON file."""
    return multihiertt_of(spark.read.schema(QA).option("multiLine", True).json(path), population)


COLUMNS = ("original_table_id", "page_title", "section_title", "caption", "header", "rows")


def columns_to_rows(documents: DataFrame, columns: tuple[str, ...] = COLUMNS, value: str = "value") -> DataFrame:
    """Column-oriented JSON texts ({column: {row: value}}) -> one row (row, columns as JSON texts) for each row number."""
    maps = documents.select(F.from_json(value, ", ".join(f"{c} map<string, string>" for c in columns)).alias("doc"))
    key = columns[0]
    long = maps.select("doc", F.explode(f"doc.{key}").alias("row", key))
    return long.select("row", key, *[F.try_element_at(f"doc.{c}", "row").alias(c) for c in columns[1:]])


def openwikitable_of(documents: DataFrame) -> DataFrame:
    """Flat tables of column-oriented JSON texts (value): (table_id, page_title, section_title, caption, header, rows)."""
    rows = columns_to_rows(documents)
    return rows.select(F.col("original_table_id").alias("table_id"), "page_title", "section_title", "caption", F.from_json("header", "array<string>").alias("header"), F.from_json("rows", "array<array<string>>").alias("rows"))


def openwikitable(spark: SparkSession, path: str) -> DataFrame:
    """:func:`openwikitable_of` files that hold one JSON document each."""
    return openwikitable_of(spark.read.text(path, wholetext=True))


def evidence_values(stated: DataFrame) -> DataFrame:
    """Evidence with the value that its cell's description states: "... is {value}."."""
    return stated.withColumn("value", tx.number_accounting(F.regexp_extract("description", r"\bis\s+(.+?)\s*\.?\s*$", 1)))


REGISTRY: dict[str, tuple[Callable, str]] = {"hitab": (hitab, "dev"), "finqa": (finqa, "validation"), "wikisql": (wikisql, "validation"), "multihiertt": (multihiertt, "dev")}


def load(spark: SparkSession, name: str, path: str, **how):
    """A benchmark by name."""
    if name not in REGISTRY:
        raise ValueError(f"no such benchmark: {name}; there are {sorted(REGISTRY)}")
    reader, split = REGISTRY[name]
    if name == "hitab":
        how.setdefault("split", split)
    return reader(spark, path, **how)
