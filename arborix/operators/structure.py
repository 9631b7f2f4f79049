"""From grids to header paths, and back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from ..functions import text as tx


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _bind(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def transposed(rows: Column) -> Column:
    """Rows of equal length as columns."""
    return F.when(F.size(rows) > 0, F.transform(F.sequence(F.lit(0), F.size(F.get(rows, 0)) - 1), lambda i: F.transform(rows, lambda r: F.get(r, i)))).otherwise(F.array().cast("array<array<string>>"))


def carried(lines: Column) -> Column:
    """Header cells of each line, outermost first -> the path of each line.

    A blank repeats what stands above it in its depth; a new label ends all
    deeper ones.  One fold over the lines of a table.
    """
    blank = F.transform(F.get(lines, 0), lambda _: F.lit(""))

    def step(acc, line):
        last = F.coalesce(F.try_element_at(acc, F.lit(-1)), blank)
        first = F.coalesce(F.array_min(F.filter(F.transform(line, lambda s, i: F.when(F.trim(s) != "", i)), lambda i: i.isNotNull())), F.lit(1 << 20))
        return F.concat(acc, F.array(F.transform(line, lambda s, i: F.when(F.trim(s) != "", F.trim(s)).when(i > first, "").otherwise(F.get(last, i)))))

    folded = F.aggregate(lines, F.array().cast("array<array<string>>"), step)
    return F.when(F.size(lines) > 0, F.transform(folded, lambda p: F.filter(p, lambda s: s != ""))).otherwise(F.array().cast("array<array<string>>"))


def col_paths(grid, n_rows, n_cols) -> Column:
    """Paths of the data columns of a grid with so many header rows and columns."""
    g, nr, nc = _c(grid), _c(n_rows), _c(n_cols)
    return _bind(transposed(F.transform(F.slice(g, 1, F.greatest(nr, F.lit(1))), lambda r: F.slice(r, nc + 1, F.greatest(F.size(r) - nc, F.lit(0))))), carried)


def row_paths(grid, n_rows, n_cols) -> Column:
    """Paths of the data rows."""
    g, nr, nc = _c(grid), _c(n_rows), _c(n_cols)
    return _bind(F.transform(F.slice(g, nr + 1, F.greatest(F.size(g) - nr, F.lit(0))), lambda r: F.slice(r, 1, nc)), carried)


def merges_filled(grid, merges) -> Column:
    """A grid with each merged region's text in all its cells; later regions win, those that begin outside are skipped."""
    g, m = _c(grid), F.filter(_c(merges), lambda x: (x["r0"] >= 0) & (x["c0"] >= 0) & (x["r0"] < F.size(_c(grid))) & (x["c0"] < F.size(F.get(_c(grid), 0))))

    def cell(s, r, c):
        over = F.try_element_at(F.filter(m, lambda x: r.between(x["r0"], x["r1"]) & c.between(x["c0"], x["c1"])), F.lit(-1))
        return F.when(over.isNotNull(), F.get(F.get(g, over["r0"]), over["c0"])).otherwise(s)

    return F.transform(g, lambda row, r: F.transform(row, lambda s, c: cell(s, r, c)))


def _steps(path: Column) -> Column:
    """A path without blanks and without segments that repeat the one before."""
    kept = F.filter(F.transform(path, lambda s: F.trim(s)), lambda s: s != "")
    return _bind(kept, lambda p: F.filter(p, lambda s, i: (i == 0) | (s != F.get(p, i - 1))))


def merged_paths(grid, merges, n_rows, n_cols) -> Column:
    """struct(cols, rows): paths that use the merges.

    A header row with one distinct label over all data columns names no column;
    it is put in front of every row path.
    """
    nr, nc = _c(n_rows), _c(n_cols)

    def paths(g):
        data = lambda r: F.filter(F.array_distinct(F.transform(F.slice(r, nc + 1, F.greatest(F.size(r) - nc, F.lit(0))), lambda s: F.trim(s))), lambda s: s != "")
        head = F.slice(g, 1, nr)
        lifted = F.transform(F.filter(head, lambda r: F.size(data(r)) == 1), lambda r: F.get(data(r), 0))
        rest = F.filter(head, lambda r: F.size(data(r)) != 1)
        columns = F.transform(F.sequence(F.lit(0), F.greatest(F.size(F.get(g, 0)) - nc - 1, F.lit(0))), lambda i: _steps(F.transform(rest, lambda r: F.get(r, i + nc))))
        rows = F.transform(F.slice(g, nr + 1, F.greatest(F.size(g) - nr, F.lit(0))), lambda r: _steps(F.concat(lifted, F.slice(r, 1, nc))))
        return F.struct(columns.alias("cols"), rows.alias("rows"))

    return _bind(merges_filled(grid, merges), paths)


def _share(cells: Column, test) -> Column:
    """Whether at least half of the cells that are not blank pass."""
    filled = F.size(F.filter(cells, lambda s: F.trim(s) != ""))
    return (filled > 0) & (2 * F.size(F.filter(cells, lambda s: (F.trim(s) != "") & test(s))) >= filled)


def guessed_header_rows(grid, n_cols: int = 1, most: int = 8) -> Column:
    """How many rows are column headers: a blank corner ends them, else the first numeric row."""
    g = _c(grid)
    stub = lambda r: F.filter(F.transform(F.slice(r, 1, n_cols), lambda s: F.trim(s)), lambda s: s != "")
    limit = F.least(F.size(g), F.lit(most))
    note = lambda r: F.array_join(stub(r), " ").rlike(r"(?s)^\(.*\)$")
    labelled = F.transform(g, lambda r, i: F.when((i >= 1) & (i <= limit) & (F.size(stub(r)) > 0) & ~note(r), i))
    corner = F.when((F.lit(n_cols) > 0) & (F.size(stub(F.get(g, 0))) == 0), F.array_min(F.filter(labelled, lambda i: i.isNotNull())))
    numeric = F.transform(g, lambda r, i: F.when((i < limit) & _share(F.slice(r, n_cols + 1, F.greatest(F.size(r) - n_cols, F.lit(0))), tx.looks_numeric), i))
    return F.when(F.size(g) == 0, 0).otherwise(F.coalesce(corner, F.array_min(F.filter(numeric, lambda i: i.isNotNull())), limit))


def guessed_header_cols(grid, n_rows, most: int = 4) -> Column:
    """How many columns are row headers: leading blanks of the last header row, else the first data-like column."""
    g, nr = _c(grid), _c(n_rows)
    limit = F.least(F.size(F.get(g, 0)), F.lit(most))
    last = F.get(g, nr - 1)
    first = F.coalesce(F.array_min(F.filter(F.transform(last, lambda s, i: F.when((i < limit) & (F.trim(s) != ""), i)), lambda i: i.isNotNull())), limit)
    tail = F.when((nr >= 2) & (nr <= F.size(g)) & (first >= 1), first)
    body = F.slice(g, nr + 1, F.greatest(F.size(g) - nr, F.lit(0)))
    data = F.transform(F.sequence(F.lit(0), F.greatest(limit - 1, F.lit(0))), lambda c: F.when(_share(F.filter(F.transform(body, lambda r: F.get(r, c)), lambda s: s.isNotNull()), tx.data_like), c))
    scan = F.array_min(F.filter(data, lambda i: i.isNotNull()))
    return F.when((F.size(g) == 0) | (F.size(F.get(g, 0)) == 0), 1).otherwise(F.coalesce(tail, F.greatest(F.coalesce(scan, limit), F.lit(1))))


def flattened_headers(paths: Column, depth: Column) -> Column:
    """Paths -> header cells of each line: a label only where the prefix changes."""
    levels = F.sequence(F.lit(0), F.greatest(depth - 1, F.lit(0)))
    same = lambda a, b, d: F.coalesce(F.slice(a, 1, d + 1) == F.slice(b, 1, d + 1), F.lit(False)) & (F.size(b) > d)
    return F.transform(paths, lambda p, i: F.transform(levels, lambda d: F.when(F.size(p) <= d, "").when((i > 0) & same(p, F.get(paths, i - 1), d), "").otherwise(F.get(p, d))))


def grid_cells(tables: DataFrame) -> DataFrame:
    """(table_id, title, grid, n_header_rows, n_header_cols) -> cells with rebuilt paths."""
    t = tables.withColumn("tops", col_paths("grid", F.col("n_header_rows"), F.col("n_header_cols"))).withColumn("lefts", row_paths("grid", F.col("n_header_rows"), F.col("n_header_cols")))
    rows = t.select("table_id", "title", "tops", "lefts", "n_header_cols", F.posexplode(F.slice("grid", F.col("n_header_rows") + 1, F.greatest(F.size("grid") - F.col("n_header_rows"), F.lit(0)))).alias("r", "line"))
    cells = rows.select("table_id", "title", "r", "tops", "lefts", F.posexplode(F.slice("line", F.col("n_header_cols") + 1, F.greatest(F.size("line") - F.col("n_header_cols"), F.lit(0)))).alias("c", "raw"))
    return cells.select("table_id", "title", "r", "c", "raw", tx.number_prefix("raw").alias("num"), F.get("lefts", F.col("r")).alias("row_path"), F.get("tops", F.col("c")).alias("col_path"))


def sectioned_rows(rows: DataFrame) -> DataFrame:
    """(table_id, r, label, rest: array) -> path of each row: a label alone heads the rows after it."""
    alone = (F.trim("label") != "") & F.forall("rest", lambda s: F.coalesce(s, F.lit("")) == "")
    w = Window.partitionBy("table_id").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(alone, F.col("label")), ignorenulls=True).over(w)
    path = F.when(alone, F.array("label")).when((F.col("label") != "") & section.isNotNull(), F.array(section, F.col("label"))).when(F.col("label") != "", F.array("label")).otherwise(F.array().cast("array<string>"))
    return rows.select("table_id", "r", path.alias("row_path"))


#: Names of roots, which are not part of a path (fixed values).
SENTINELS = ("<TOP>", "<LEFT>", "<ROOT>", "")
_WALKED = T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("path", T.ArrayType(T.StringType()))]))


@pandas_udf(_WALKED)
def _walked(trees: pd.Series) -> pd.Series:
    """The lines of each tree, given as its nodes, with the names from the root down."""

    def lines(nodes):
        by = {n["node"]: n for n in nodes}
        known: dict = {None: []}
        for start in by:
            below = []  # nodes whose paths wait for those above; a parent that is missing or leads back has no path
            while start is not None and start not in known and start in by:
                known[start] = None
                below.append(start)
                start = by[start]["parent"]
            above = known.get(start)
            for at in reversed(below):
                name = by[at]["name"] or ""
                above = known[at] = None if above is None else above if name in SENTINELS else [*above, name]
        return [{"line": n["line"], "path": known[n["node"]]} for n in nodes if n["line"] is not None and known[n["node"]] is not None]

    return trees.map(lines)


def tree_paths(nodes: DataFrame) -> DataFrame:
    """Header-tree nodes (table_id, node, parent, name, line) -> (table_id, line, path).

    Nodes that own a line have its path, inner ones too; sentinels of roots are
    not part of a path.  The tree of a table, no larger than its headers, is
    walked in one place, whatever its depth; trees are dealt by table.
    """
    trees = nodes.groupBy("table_id").agg(F.collect_list(F.struct("node", "parent", "name", F.col("line").cast("int").alias("line"))).alias("tree"))
    return trees.select("table_id", F.explode(_walked("tree")).alias("x")).select("table_id", "x.line", "x.path")


def bad_lines(rebuilt: DataFrame, gold: DataFrame, at: str) -> DataFrame:
    """(table_id, at): lines whose rebuilt path is missing or not the gold one."""
    pair = gold.select("table_id", at, tx.normal_path("path").alias("g")).join(rebuilt.select("table_id", at, tx.normal_path("path").alias("p")), ["table_id", at], "left")
    return pair.filter(~F.coalesce(F.col("g") == F.col("p"), F.lit(False))).select("table_id", at)


def affected_operands(operands: DataFrame, bad_rows: DataFrame, bad_cols: DataFrame) -> DataFrame:
    """Operands (query_id, table_id, r, c) with whether a wrongly rebuilt line holds them."""
    rows, cols = bad_rows.select("table_id", "r", F.lit(True).alias("bad_row")), bad_cols.select("table_id", "c", F.lit(True).alias("bad_col"))
    t = operands.join(rows, ["table_id", "r"], "left").join(cols, ["table_id", "c"], "left")
    no = F.lit(False)
    return t.select("query_id", "table_id", "r", "c", F.coalesce("bad_row", no).alias("bad_row"), F.coalesce("bad_col", no).alias("bad_col"))


def size_bucket(n_rows, n_cols) -> Column:
    n = F.greatest(_c(n_rows), _c(n_cols))
    return F.when(n <= 10, "small").when(n <= 20, "medium").otherwise("large")


def complexity_bucket(n_header_rows, has_rowspan) -> Column:
    n = _c(n_header_rows)
    deep = F.when(n <= 1, "1").when(n <= 3, "2-3").otherwise("4+")
    return F.when(_c(has_rowspan), F.concat(deep, F.lit("+rowspan"))).otherwise(deep)


def segment_coverage(path, description) -> Column:
    """Share of the segments whose tokens are all in a description."""
    words = tx.norm_tokens(description)
    n = F.size(_c(path))
    return F.when(n > 0, F.size(F.filter(_c(path), lambda s: F.size(F.array_except(tx.norm_tokens(s), words)) == 0)) / n)


def path_agreement(rebuilt: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Exact agreement of normalised paths by table: (table_id, n, n_exact), over keys (table_id first)."""
    pair = gold.select(*keys, tx.normal_path("path").alias("g")).join(rebuilt.select(*keys, tx.normal_path("path").alias("p")), keys, "left")
    return pair.groupBy("table_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("g") == F.col("p"), F.lit(False))).alias("n_exact"))


def greedy_alignment(lines: DataFrame) -> DataFrame:
    """(table_id, gold: array, found: array) -> (table_id, at: array<int>): each gold label's line, in order.

    Monotone: a label takes the first equal line after the one before it; a
    label that is nowhere after it gets null.
    """

    def step(acc, label):
        after = F.coalesce(F.array_max(acc), F.lit(-1))
        at = F.array_min(F.filter(F.transform(F.col("found"), lambda s, i: F.when((i > after) & (tx.normal_value(s) == tx.normal_value(label)), i)), lambda i: i.isNotNull()))
        return F.concat(acc, F.array(at))

    return lines.select("table_id", F.aggregate("gold", F.array().cast("array<int>"), step).alias("at"))


def accepted_alignment(aligned: DataFrame, least: float = 0.9) -> DataFrame:
    """(table_id, gold_value, grid_value) -> tables where enough of the non-empty cells agree."""
    ok = F.avg((tx.normal_value("gold_value") == tx.normal_value("grid_value")).cast("int"))
    return aligned.filter(F.trim("gold_value") != "").groupBy("table_id").agg(ok.alias("agreement")).filter(F.col("agreement") >= least)
