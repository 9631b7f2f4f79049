"""Which cells a question needs: scopes, totals, siblings and injections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx


def rows_of(cells: DataFrame) -> DataFrame:
    """(table_id, r, row_path, parent, depth, any_number): one row for each table row."""
    t = cells.groupBy("table_id", "r").agg(F.first("row_path").alias("row_path"), F.max(F.col("num").isNotNull()).alias("any_number"))
    depth = F.size("row_path")
    return t.withColumn("depth", depth).withColumn("parent", F.when(depth > 0, F.slice("row_path", 1, F.greatest(depth - 1, F.lit(0)))))


def is_total_label(path, any_segment: bool = False) -> Column:
    """A row's own label names a total; a row without a path counts as one."""
    p = F.col(path) if isinstance(path, str) else path
    hit = lambda s: s.rlike(tx.ascii_pattern(r"(?i)\b(total|overall)\b|^all\b"))
    return (F.size(p) == 0) | (F.exists(p, hit) if any_segment else F.coalesce(hit(F.try_element_at(p, F.lit(-1))), F.lit(False)))


def keyword_totals(cells: DataFrame) -> DataFrame:
    """(table_id, r) of total rows by label that hold any number."""
    return rows_of(cells).filter(is_total_label("row_path") & F.col("any_number")).select("table_id", "r")


def children(rows: DataFrame) -> DataFrame:
    """(table_id, r, member): rows one level below each row."""
    a = rows.filter("depth > 0").select("table_id", F.col("r"), F.col("row_path").alias("parent"))
    return a.join(rows.filter("depth > 1").select("table_id", F.col("r").alias("member"), "parent"), ["table_id", "parent"]).filter("r <> member").select("table_id", "r", "member")


def siblings(rows: DataFrame) -> DataFrame:
    """(table_id, r, member): the other rows under the same parent, at the same depth."""
    a = rows.filter("depth > 0").select("table_id", "r", "parent", "depth")
    return a.join(a.withColumnRenamed("r", "member"), ["table_id", "parent", "depth"]).filter("r <> member").select("table_id", "r", "member")


def structural_totals(cells: DataFrame, tolerance: float = 0.02, least_members: int = 2, least_columns: int = 2) -> DataFrame:
    """(table_id, r) of rows that equal the sum of their children, or of their siblings.

    A column counts where the row and all members have a number; at least half
    of two or more such columns must agree.  Sums of a sibling group are taken
    once for the group, not for each member: a row's own value is subtracted.
    """
    rows = rows_of(cells)
    numbers = cells.select("table_id", "r", "c", "num")
    keyed = numbers.join(rows.filter("depth > 0").select("table_id", "r", "row_path", "parent", "depth"), ["table_id", "r"])
    size = rows.filter("depth > 0").groupBy("table_id", "parent", "depth").agg(F.count("*").alias("n"))
    # a member without a number in a column, or without a cell there, leaves the column out
    group = keyed.groupBy("table_id", "parent", "depth", "c").agg(F.sum("num").alias("s"), F.count("num").alias("k")).join(size, ["table_id", "parent", "depth"]).filter("k = n")
    mine = keyed.filter(F.col("num").isNotNull())
    beside = mine.join(group, ["table_id", "parent", "depth", "c"]).filter(F.col("n") - 1 >= least_members).select("table_id", "r", "c", "num", (F.col("s") - F.col("num")).alias("s"), F.lit("siblings").alias("kind"))
    below = mine.select("table_id", "r", "c", "num", F.col("row_path").alias("parent"), (F.col("depth") + 1).alias("depth")).join(group, ["table_id", "parent", "depth", "c"])
    below = below.filter(F.col("n") >= least_members).select("table_id", "r", "c", "num", "s", F.lit("children").alias("kind"))
    close = F.abs(F.col("num") - F.col("s")) <= F.greatest(F.abs("num"), F.abs("s"), F.lit(1.0)) * tolerance
    t = beside.unionByName(below).groupBy("table_id", "r", "kind").agg(F.count("*").alias("checked"), F.count_if(close).alias("matched"))
    return t.filter((F.col("checked") >= least_columns) & (2 * F.col("matched") >= F.col("checked"))).select("table_id", "r").distinct()


def totals(cells: DataFrame, detector: str = "hybrid") -> DataFrame:
    """Total rows by keyword, structure or either."""
    if detector == "keyword":
        return keyword_totals(cells)
    if detector == "structural":
        return structural_totals(cells)
    if detector != "hybrid":
        raise ValueError(f"no such detector: {detector}")
    return keyword_totals(cells).union(structural_totals(cells)).distinct()


def matched_lines(paths: DataFrame, cells: DataFrame, axis: str = "row") -> DataFrame:
    """(query_id, table_id, at): lines of an axis that any of a query's paths matches.

    paths: (query_id, table_id, path: array).  Distinct header lines are matched,
    not cells.
    """
    at, col = ("r", "row_path") if axis == "row" else ("c", "col_path")
    lines = cells.select("table_id", F.col(at).alias("at"), F.col(col).alias("line")).distinct()
    asked = paths.filter(F.size("path") > 0).select("query_id", "table_id", F.array_join("path", " > ").alias("asked")).distinct()
    return asked.join(lines, "table_id").filter(tx.path_matches("asked", "line")).select("query_id", "table_id", "at").distinct()


def with_siblings(matched: DataFrame, cells: DataFrame) -> DataFrame:
    """Matched rows and all rows that share the parent of one; rows of depth 1 have no such group."""
    rows = rows_of(cells).filter("depth >= 2").select("table_id", F.col("r").alias("at"), "parent")
    parents = matched.join(rows, ["table_id", "at"]).select("query_id", "table_id", "parent").distinct()
    return matched.unionByName(parents.join(rows, ["table_id", "parent"]).select("query_id", "table_id", "at")).distinct()


def last_numeric_column(cells: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """The rightmost column with a number, of whole tables or of the rows (query_id, table_id, at)."""
    full = cells.filter(F.col("num").isNotNull())
    if rows is None:
        return full.groupBy("table_id").agg(F.max("c").alias("at"))
    return rows.withColumnRenamed("at", "r").join(full, ["table_id", "r"]).groupBy("query_id", "table_id").agg(F.max("c").alias("at"))


def enumerated(queries: DataFrame, row_paths: DataFrame, col_paths: DataFrame, cells: DataFrame, add_totals: bool = False, expand: bool = False, col_fallback: str = "all", detector: str = "keyword") -> DataFrame:
    """(query_id, table_id, r, c, row_fallback, col_fallback): the numeric cells in a query's scope.

    An axis that no path matches is taken whole (or, for columns, only the last
    numeric one).  Totals and siblings are added only where rows did match.
    """
    rows, cols = matched_lines(row_paths, cells, "row"), matched_lines(col_paths, cells, "col")
    if expand:
        rows = with_siblings(rows, cells)
    if add_totals:
        found = rows.select("query_id", "table_id").distinct()
        rows = rows.unionByName(found.join(totals(cells, detector).withColumnRenamed("r", "at"), "table_id")).distinct()
    asked = queries.select("query_id", "table_id")
    flag = lambda lines, name: lines.select("query_id", F.lit(True).alias(name)).distinct()
    q = asked.join(flag(rows, "has_rows"), "query_id", "left").join(flag(cols, "has_cols"), "query_id", "left")
    q = q.select("query_id", "table_id", F.col("has_rows").isNull().alias("row_fallback"), F.col("has_cols").isNull().alias("col_fallback"))
    number = cells.filter(F.col("num").isNotNull()).select("table_id", "r", "c")
    t = q.join(number, "table_id")
    in_rows = rows.select("query_id", F.col("at").alias("r"), F.lit(True).alias("in_row"))
    in_cols = cols.select("query_id", F.col("at").alias("c"), F.lit(True).alias("in_col"))
    t = t.join(in_rows, ["query_id", "r"], "left").filter(F.col("row_fallback") | F.col("in_row"))
    t = t.join(in_cols, ["query_id", "c"], "left").filter(F.col("col_fallback") | F.col("in_col"))
    if col_fallback == "last":
        last = F.max("c").over(Window.partitionBy("query_id"))
        t = t.withColumn("last", last).filter(~F.col("col_fallback") | (F.col("c") == F.col("last")))
    return t.select("query_id", "table_id", "r", "c", "row_fallback", "col_fallback")


def axis_complete(seed: DataFrame, cells: DataFrame) -> DataFrame:
    """Whole rows and whole columns of the cells (query_id, table_id, r, c)."""
    rows = seed.select("query_id", "table_id", "r").distinct().join(cells.select("table_id", "r", "c"), ["table_id", "r"])
    cols = seed.select("query_id", "table_id", "c").distinct().join(cells.select("table_id", "r", "c"), ["table_id", "c"])
    return rows.select("query_id", "table_id", "r", "c").unionByName(cols.select("query_id", "table_id", "r", "c")).distinct()


def injected(retrieved: DataFrame, cells: DataFrame, columns: str = "all", detector: str = "hybrid", queries: DataFrame | None = None) -> DataFrame:
    """Retrieved cells with the total rows of their tables: in all columns, or in those touched.

    With queries (query_id, question), only ratio questions get totals.
    """
    from .questions import is_ratio

    tables = retrieved.select("query_id", "table_id").distinct()
    if queries is not None:
        tables = tables.join(queries.filter(is_ratio("question")).select("query_id"), "query_id", "left_semi")
    more = tables.join(totals(cells, detector), "table_id").join(cells.filter(F.col("num").isNotNull()).select("table_id", "r", "c"), ["table_id", "r"])
    if columns == "touched":
        more = more.join(retrieved.select("query_id", "table_id", "c").distinct(), ["query_id", "table_id", "c"], "left_semi")
    keep = ["query_id", "table_id", "r", "c"]
    return retrieved.select(*keep).unionByName(more.select(*keep)).distinct()


def row_failures(gold: DataFrame, scope: DataFrame, cells: DataFrame) -> DataFrame:
    """Why gold rows were missed: (query_id, bucket, missed, recoverable by totals).

    gold and scope: (query_id, table_id, r), distinct.
    """
    rows = rows_of(cells)
    g = gold.join(rows, ["table_id", "r"]).join(scope.select("query_id", "table_id", "r", F.lit(True).alias("hit")), ["query_id", "table_id", "r"], "left")
    total = is_total_label("row_path")
    per = g.groupBy("query_id", "table_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("hit").isNull()).alias("missed"),
        F.count_if(F.col("hit").isNull() & total).alias("missed_totals"),
        F.collect_set("parent").alias("parents"),
        F.min("depth").alias("least_depth"),
        F.array_sort(F.collect_set("r")).alias("gold_rows"),
    )
    kids = rows.filter("any_number").groupBy("table_id", F.col("parent").alias("the_parent")).agg(F.array_sort(F.collect_set("r")).alias("kids"))
    per = per.withColumn("the_parent", F.when((F.size("parents") == 1) & (F.col("least_depth") >= 2), F.get("parents", 0)))
    per = per.join(kids, ["table_id", "the_parent"], "left")
    bucket = F.when(F.col("missed_totals") > 0, "total_pairing").when(F.col("the_parent").isNotNull() & (F.col("gold_rows") == F.col("kids")), "parent_expandable").when(F.col("the_parent").isNotNull() | (F.col("n") == 1), "sibling_subset").otherwise("cross_parent")
    return per.filter("missed > 0").select("query_id", bucket.alias("bucket"), "missed", (F.col("missed") == F.col("missed_totals")).alias("recover_by_totals"))


def subtable(queries: DataFrame, cells: DataFrame, rows: int = 12, cols: int = 10) -> DataFrame:
    """(query_id, table_id, r, c): the part of a table that a question's words and numbers point to.

    Columns by a keyword in their headers; rows by one in theirs, or by a cell
    equal to a number of the question.  An axis without a match is taken from
    its start; a single match brings its neighbours.
    """
    from .questions import terms

    q = queries.select("query_id", "table_id", terms("question").alias("kw"), F.transform(tx.numbers("question"), lambda x: F.round(x, 3)).alias("nums"))
    has = lambda path: F.exists("kw", lambda k: F.contains(F.lower(F.array_join(path, " ")), k))

    def axis(at: str, path: str, cap: int, more: DataFrame | None = None):
        lines = cells.select("table_id", F.col(at).alias("at"), F.col(path).alias("p")).distinct()
        hit = q.join(lines, "table_id").filter(has(F.col("p"))).select("query_id", "table_id", "at")
        hit = hit if more is None else hit.unionByName(more).distinct()
        size = lines.groupBy("table_id").agg(F.max("at").alias("last"))
        n = q.select("query_id", "table_id").join(hit.groupBy("query_id").agg(F.count("*").alias("n"), F.min("at").alias("only")), "query_id", "left").join(size, "table_id")
        whole = n.filter("n is null").select("query_id", "table_id", F.explode(F.sequence(F.lit(0), F.least(F.col("last"), F.lit(cap - 1)))).alias("at"))
        near = n.filter("n = 1").select("query_id", "table_id", F.explode(F.sequence(F.greatest(F.col("only") - 1, F.lit(0)), F.least(F.col("only") + 1, F.col("last")))).alias("at"))
        many = hit.join(n.filter("n > 1").select("query_id"), "query_id")
        every = whole.unionByName(near).unionByName(many.select("query_id", "table_id", "at"))
        return every.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).filter(F.col("k") <= cap).drop("k")

    by_value = q.join(cells.filter(F.col("num").isNotNull()), "table_id").filter(F.array_contains("nums", F.round("num", 3))).select("query_id", "table_id", F.col("r").alias("at")).distinct()
    r = axis("r", "row_path", rows, by_value).withColumnRenamed("at", "r")
    return r.join(axis("c", "col_path", cols).withColumnRenamed("at", "c"), ["query_id", "table_id"])
