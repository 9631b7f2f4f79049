"""From cells to text: rows, cells and whole tables under the serialization schemes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx


def _ordered(value: Column, *by: str) -> Column:
    """Values of a group in the order of integer columns."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*by, value.alias("v")))), lambda x: x["v"])


def _lines(title: Column, body: Column) -> Column:
    return F.when(title != "", F.concat(title, F.lit("\n"), body)).otherwise(body)


def shown_title() -> Column:
    return tx.format_value("title")


def cell_line() -> Column:
    """``row > col: value``."""
    path, value = tx.path_text(F.concat("row_path", "col_path")), tx.format_value("raw")
    return F.when(path != "", F.concat(path, F.lit(": "), value)).otherwise(value)


def cell_sentence(length: str = "medium", title: Column | None = None) -> Column:
    """A caption sentence of a cell, short, medium or long."""
    row, col, v = tx.path_text("row_path"), tx.path_text("col_path"), tx.format_value("raw")
    cat = F.concat
    if length == "short":
        label = F.when(col != "", col).otherwise(row)
        return F.when((row != "") & (col != ""), cat(row, F.lit(" "), col, F.lit(": "), v, F.lit("."))).when(label != "", cat(label, F.lit(": "), v, F.lit("."))).otherwise(cat(v, F.lit(".")))
    if length == "medium":
        return (
            F.when((row != "") & (col != ""), cat(F.lit("For "), row, F.lit(", "), col, F.lit(" is "), v, F.lit(".")))
            .when(col != "", cat(col, F.lit(" is "), v, F.lit(".")))
            .when(row != "", cat(row, F.lit(" is "), v, F.lit(".")))
            .otherwise(cat(F.lit("The value is "), v, F.lit(".")))
        )
    if length != "long":
        raise ValueError(f"no such length: {length}")
    rest = cat(F.when(row != "", cat(F.lit("among "), row, F.lit(", "))).otherwise(""), F.when(col != "", cat(F.lit("the value of "), col)).otherwise("the value"), F.lit(" is "), v, F.lit("."))
    plain = cat(F.upper(F.substring(rest, 1, 1)), F.lower(F.substr(rest, F.lit(2))))
    if title is None:
        return plain
    return F.when(title != "", cat(F.lit("In the table '"), title, F.lit("', "), rest)).otherwise(plain)


def flat_rows(cells: DataFrame, with_title: bool = True) -> DataFrame:
    """S1: a small markdown table for each row, with leaf headers alone: (table_id, r, text)."""
    mark = lambda a: F.concat(F.lit("| "), F.array_join(a, " | "), F.lit(" |"))
    head = F.when(tx.leaf("col_path") != "", tx.leaf("col_path")).otherwise(F.concat(F.lit("col_"), F.col("c").cast("string")))
    rows = cells.groupBy("table_id", "title", "r").agg(_ordered(tx.format_value("raw"), "c").alias("vs"), _ordered(head, "c").alias("hs"), F.first("row_path").alias("row_path"))
    labelled = F.max(F.size("row_path") > 0).over(Window.partitionBy("table_id"))
    rows = rows.withColumn("labelled", labelled)
    hs = F.when(F.col("labelled"), F.concat(F.array(F.lit("row")), F.col("hs"))).otherwise(F.col("hs"))
    vs = F.when(F.col("labelled"), F.concat(F.array(tx.leaf("row_path")), F.col("vs"))).otherwise(F.col("vs"))
    text = F.concat(mark(hs), F.lit("\n"), mark(F.transform(hs, lambda _: F.lit("---"))), F.lit("\n"), mark(vs))
    return rows.select("table_id", "r", (_lines(shown_title(), text) if with_title else text).alias("text"))


def path_texts(cells: DataFrame, kind: str = "row", with_title: bool = True) -> DataFrame:
    """S2: header paths before each value, by row, cell or table."""
    return _grouped(cells, cell_line(), kind, with_title)


def sentences(cells: DataFrame, length: str = "medium", kind: str = "row", with_title: bool = True) -> DataFrame:
    """S3: caption sentences; a cell's own states the title, rows and tables state it once."""
    if kind == "cell":
        return cells.select("table_id", "r", "c", cell_sentence(length, shown_title() if with_title else None).alias("text"))
    return _grouped(cells, cell_sentence(length), kind, with_title)


def _grouped(cells: DataFrame, line: Column, kind: str, with_title: bool) -> DataFrame:
    title = shown_title() if with_title else F.lit("")
    if kind == "cell":
        return cells.select("table_id", "r", "c", _lines(title, line).alias("text"))
    keys, order = (["table_id", "title", "r"], ["c"]) if kind == "row" else (["table_id", "title"], ["r", "c"])
    body = cells.groupBy(*keys).agg(F.array_join(_ordered(line, *order), "\n").alias("body"))
    return body.select(*[k for k in keys if k != "title"], _lines(title, F.col("body")).alias("text"))


def serialize(cells: DataFrame, scheme: str = "S2", **how) -> DataFrame:
    """Text under a scheme's name."""
    schemes = {"S1": flat_rows, "S2": path_texts, "S3": sentences}
    if scheme not in schemes:
        raise ValueError(f"no such scheme: {scheme}")
    return schemes[scheme](cells, **how)


def compact_rows(cells: DataFrame, scheme: str = "s2_headerpath") -> DataFrame:
    """One line for each row, as chunks: (chunk_id, table_id, r, text, rows, cols)."""
    v = F.coalesce(F.col("raw"), F.lit(""))
    if scheme == "s1_flat":
        head = tx.leaf("col_path")
    elif scheme == "s2_headerpath":
        head = F.array_join(tx.full_path("row_path", "col_path"), " > ")
    else:
        raise ValueError(f"no such scheme: {scheme}")
    label = F.when(head != "", F.concat(head, F.lit(": "), v)).otherwise(v)
    rows = cells.groupBy("table_id", "title", "r").agg(F.array_join(_ordered(label, "c"), " | ").alias("body"), F.first("row_path").alias("row_path"), F.array_sort(F.collect_list("c")).alias("cols"))
    front = F.when(F.col("title") != "", F.concat("title", F.lit(" | "))).otherwise("")
    own = F.when(tx.leaf("row_path") != "", F.concat(tx.leaf("row_path"), F.lit(" | "))).otherwise("") if scheme == "s1_flat" else F.lit("")
    return rows.select(F.concat("table_id", F.lit("#r"), F.col("r").cast("string")).alias("chunk_id"), "table_id", "r", F.concat(front, own, F.col("body")).alias("text"), F.array("r").alias("rows"), "cols")


def whole_tables(cells: DataFrame, scheme: str = "s2_headerpath") -> DataFrame:
    """Compact rows of a table as one chunk that covers it."""
    rows = compact_rows(cells, scheme).join(cells.select("table_id", "title").distinct(), "table_id")
    t = rows.groupBy("table_id", "title").agg(F.array_join(_ordered(F.col("text"), "r"), "\n").alias("body"), F.array_sort(F.collect_list("r")).alias("rows"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cols")))).alias("cols"))
    return t.select(F.concat("table_id", F.lit("#full")).alias("chunk_id"), "table_id", _lines(F.coalesce("title", F.lit("")), F.col("body")).alias("text"), "rows", "cols")


def verbalized(cells: DataFrame, style: str = "long") -> DataFrame:
    """A sentence for each cell that is not empty: (chunk_id, table_id, r, c, text)."""
    clean = lambda p: F.filter(F.transform(F.col(p), lambda s: F.trim(s)), lambda s: s != "")
    part = (lambda p: F.array_join(clean(p), ", ")) if style == "long" else (lambda p: tx.leaf(clean(p)))
    col, row = part("col_path"), part("row_path")
    subject = F.when((col != "") & (row != ""), F.concat(col, F.lit(" for "), row)).when(col != "", col).when(row != "", row).otherwise("the value")
    title = F.trim(F.coalesce("title", F.lit("")))
    head = F.lit("") if style == "short" else F.when(title != "", F.concat(F.lit("In "), title, F.lit(", "))).otherwise("")
    full = cells.filter(F.trim(F.coalesce("raw", F.lit(""))) != "")
    name = F.concat(F.col("table_id"), F.lit("#c"), F.col("r").cast("string"), F.lit("_"), F.col("c").cast("string"))
    return full.select(name.alias("chunk_id"), "table_id", "r", "c", F.concat(head, subject, F.lit(" is "), F.trim("raw"), F.lit(".")).alias("text"))


def collision_text(scheme: str = "S2") -> Column:
    """A cell's text in the collision study: flat, S2, its order-destroyed control, or S3."""
    path = F.concat("row_path", "col_path")
    if scheme == "flat":
        return F.concat_ws(" ", tx.leaf("row_path"), tx.leaf("col_path"), tx.format_value("raw"))
    if scheme == "S2_shuf":
        path = F.transform(F.array_sort(F.transform(path, lambda s, i: F.struct(F.md5(F.concat(s, i.cast("string")).cast("binary")).alias("k"), s.alias("s")))), lambda x: x["s"])
    if scheme == "S3":
        return cell_sentence("medium")
    return F.concat(F.array_join(path, " > "), F.lit(": "), tx.format_value("raw"))


def markdown(cells: DataFrame, rows: int = 20) -> DataFrame:
    """The first rows of a table under its leaf headers: (table_id, text)."""
    one = lambda x: F.trim(F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(" ")))
    line = cells.filter(F.col("r") < rows).groupBy("table_id", "r").agg(F.array_join(_ordered(one(F.col("raw")), "c"), " | ").alias("line"), _ordered(one(tx.leaf("col_path")), "c").alias("hs"))
    t = line.groupBy("table_id").agg(F.array_join(_ordered(F.col("line"), "r"), "\n").alias("body"), F.first("hs").alias("hs"))
    return t.select("table_id", F.concat(F.array_join("hs", " | "), F.lit("\n"), F.array_join(F.transform("hs", lambda _: F.lit("---")), " | "), F.lit("\n"), F.col("body")).alias("text"))


def metadata(page: Column, section: Column, caption: Column) -> Column:
    """Title, section and caption, each on a line if there."""
    part = lambda name, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"{name}: "), x)).otherwise("")
    return F.array_join(F.filter(F.array(part("Title", page), part("Section", section), part("Caption", caption)), lambda s: s != ""), "\n")


def schema_blocks(cells: DataFrame, examples: int = 3) -> DataFrame:
    """Name, kind and first distinct values of each column: (table_id, text)."""
    value = F.trim(F.replace(F.coalesce(F.col("raw"), F.lit("")), F.lit("\n"), F.lit(" ")))
    col = cells.groupBy("table_id", "c").agg(F.first(tx.leaf("col_path")).alias("name"), _ordered(value, "r").alias("vs"), F.count("*").alias("n"))
    full = F.filter("vs", lambda v: v != "")
    number = F.size(F.filter(full, lambda v: F.replace(v, F.lit(" "), F.lit("")).rlike(r"^[\$\(\-]?[\d,]+\.?\d*%?\)?$")))
    kind = F.when((F.size(full) > 0) & (10 * number >= 7 * F.size(full)), "number").otherwise("text")
    shown = F.array_join(F.slice(F.array_distinct(full), 1, examples), "; ")
    line = F.concat(F.lit("- "), F.col("name"), F.lit(" ("), kind, F.lit(")"), F.when(shown != "", F.concat(F.lit(": e.g. "), shown)).otherwise(""))
    t = col.groupBy("table_id").agg(F.array_join(_ordered(line, "c"), "\n").alias("body"), F.count("*").alias("k"), F.max("n").alias("n"))
    return t.select("table_id", F.concat(F.lit("Columns ("), F.col("k").cast("string"), F.lit(" columns, "), F.col("n").cast("string"), F.lit(" rows):\n"), F.col("body")).alias("text"))


def path_blocks(cells: DataFrame, most: int = 30) -> DataFrame:
    """Distinct column paths and the first distinct row paths: (table_id, text)."""

    def listed(axis: str, path: str, cap: int | None):
        p = cells.select("table_id", axis, tx.path_text(path).alias("p")).filter("p <> ''").groupBy("table_id", "p").agg(F.min(axis).alias("at"))
        if cap:
            p = p.withColumn("k", F.row_number().over(Window.partitionBy("table_id").orderBy("at"))).filter(F.col("k") <= cap)
        return p.groupBy("table_id").agg(F.array_join(_ordered(F.concat(F.lit("- "), F.col("p")), "at"), "\n").alias(path))

    n = cells.groupBy("table_id").agg((F.max("c") + 1).alias("n"))
    t = n.join(listed("c", "col_path", None), "table_id", "left").join(listed("r", "row_path", most), "table_id", "left")
    head = F.concat(F.lit("Column header paths ("), F.col("n").cast("string"), F.lit(" columns):"))
    return t.select("table_id", F.concat_ws("\n", head, "col_path", F.when(F.col("row_path").isNotNull(), F.concat(F.lit("Row header paths:\n"), F.col("row_path")))).alias("text"))


def template_questions(cells: DataFrame, n: int = 3, seed: int = 7) -> DataFrame:
    """Questions from a sample of cells that have both headers: (table_id, k, question)."""
    both = cells.filter((F.size("row_path") > 0) & (F.size("col_path") > 0) & (F.coalesce("raw", F.lit("")) != ""))
    key = F.md5(F.concat_ws("|", "table_id", F.col("r").cast("string"), F.col("c").cast("string"), F.lit(str(seed))).cast("binary"))
    k = F.row_number().over(Window.partitionBy("table_id").orderBy(key))
    q = F.concat(F.lit("What is the "), tx.path_text("col_path"), F.lit(" for "), tx.path_text("row_path"), F.lit("?"))
    return both.select("table_id", k.alias("k"), q.alias("question")).filter(F.col("k") <= n)


def prepared(cells: DataFrame, condition: str = "C0", meta: DataFrame | None = None, rows: int = 20) -> DataFrame:
    """A table under the preparation ladder C0, C1, C2, C2h, C3: (table_id, text).

    meta has (table_id, block); C3 is the hierarchical block with questions.
    """
    parts = []
    t = cells.select("table_id").distinct()
    if condition != "C0" and meta is not None:
        t = t.join(meta.select("table_id", F.col("block").alias("b1")), "table_id", "left")
        parts.append("b1")
    if condition in ("C2", "C2h", "C3"):
        block = schema_blocks(cells) if condition == "C2" else path_blocks(cells)
        t = t.join(block.withColumnRenamed("text", "b2"), "table_id", "left")
        parts.append("b2")
    if condition == "C3":
        asked = template_questions(cells).groupBy("table_id").agg(F.concat(F.lit("Questions answerable from this table:\n"), F.array_join(_ordered(F.concat(F.lit("- "), F.col("question")), "k"), "\n")).alias("b3"))
        t = t.join(asked, "table_id", "left")
        parts.append("b3")
    t = t.join(markdown(cells, rows).withColumnRenamed("text", "b4"), "table_id", "left")
    blocks = F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in [*parts, "b4"]]), lambda s: s != "")
    return t.select("table_id", F.array_join(blocks, "\n\n").alias("text"))


def dual_orders(cells: DataFrame) -> DataFrame:
    """Row-major lines, then column-major lines: (table_id, text)."""
    t = cells.groupBy("table_id").agg(F.array_join(_ordered(cell_line(), "r", "c"), "\n").alias("a"), F.array_join(_ordered(cell_line(), "c", "r"), "\n").alias("b"))
    return t.select("table_id", F.concat("a", F.lit("\n\n"), F.col("b")).alias("text"))


def reader_view(cells: DataFrame, rows: int = 40, cols: int = 12) -> DataFrame:
    """The listing that a reader model sees, cut to rows and columns."""
    return path_texts(cells.filter((F.col("r") < rows) & (F.col("c") < cols)), "table")


def pivoted(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers of each row under named leaf columns: (table_id, line, ...)."""
    return cells.withColumn("leaf", tx.leaf("col_path")).groupBy("table_id", F.col("r").alias("line")).pivot("leaf", columns).agg(F.first("num", ignorenulls=True))


def chunk_value(text) -> Column:
    """The value at the end of a chunk: what follows the last ``: `` of its last line."""
    line = F.element_at(F.split(text if isinstance(text, Column) else F.col(text), "\n"), -1)
    return F.element_at(F.split(line, ": "), -1)


def inventory(cells: DataFrame) -> DataFrame:
    """Depths and distinct header paths of each table."""
    return cells.groupBy("table_id").agg(
        F.max(F.size("row_path")).alias("row_depth"),
        F.max(F.size("col_path")).alias("col_depth"),
        F.array_sort(F.collect_set(tx.path_text("row_path"))).alias("row_paths"),
        F.array_sort(F.collect_set(tx.path_text("col_path"))).alias("col_paths"),
    )


def candidate_paths(cells: DataFrame) -> DataFrame:
    """Distinct full paths with the rows and columns that they cover."""
    p = cells.withColumn("path", F.array_join(tx.full_path("row_path", "col_path"), " > ")).filter("path <> ''")
    return p.groupBy("table_id", "path").agg(F.array_sort(F.collect_set("r")).alias("rows"), F.array_sort(F.collect_set("c")).alias("cols"))


def node_candidates(cells: DataFrame, axis: str = "col", cap: int = 80) -> DataFrame:
    """Distinct header nodes of an axis, parents too, in the order met: (table_id, k, node)."""
    at, path = ("c", "col_path") if axis == "col" else ("r", "row_path")
    nodes = cells.select("table_id", F.col(at).alias("at"), F.posexplode(tx.path_prefixes(path)).alias("d", "p"))
    first = nodes.groupBy("table_id", F.array_join("p", " > ").alias("node")).agg(F.min(F.struct("at", "d")).alias("first"))
    k = F.row_number().over(Window.partitionBy("table_id").orderBy("first"))
    return first.select("table_id", k.alias("k"), "node").filter(F.col("k") <= cap)


def distinct_paths(cells: DataFrame, axis: str = "col", cap: int = 60) -> DataFrame:
    """Distinct whole paths of an axis in the order met: (table_id, k, path)."""
    at, path = ("c", "col_path") if axis == "col" else ("r", "row_path")
    first = cells.filter(F.size(path) > 0).groupBy("table_id", F.array_join(path, " > ").alias("path")).agg(F.min(at).alias("first"))
    k = F.row_number().over(Window.partitionBy("table_id").orderBy("first"))
    return first.select("table_id", k.alias("k"), "path").filter(F.col("k") <= cap)
