"""Queries of the benchmark readers and of table markup: documents are made of the driver's tables, read back and compared with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.udfs import html_to_grid
from ..operators import structure
from ..sources import benchmarks
from .base import dealt, grid, sales_cells, stored, table


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _sorted(*fields) -> Column:
    return F.array_sort(F.collect_list(F.struct(*fields)))


def _raw_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales tables as JSON documents with two header trees: (table_id, raw)."""
    c = sales_cells(spark, sf_dir)
    top = c.select("table_id", "c", F.get("col_path", 0).alias("y"), F.get("col_path", 1).alias("f")).distinct()
    years = top.groupBy("table_id", "y").agg(F.min("c").alias("c"), _sorted("c", "f").alias("x"))
    years = years.select("table_id", "c", F.struct(F.col("y").alias("value"), F.transform("x", lambda v: F.struct(v["f"].alias("value"), v["c"].alias("line_idx"))).alias("children")).alias("node"))
    top = years.groupBy("table_id").agg(F.transform(_sorted("c", "node"), lambda v: v["node"]).alias("tops"))
    left = c.select("table_id", "r", F.get("row_path", 0).alias("a"), F.get("row_path", 1).alias("b")).distinct()
    heads = left.groupBy("table_id", "a").agg(F.min("r").alias("r"), _sorted("r", "b").alias("x"))
    kids = F.transform(F.filter("x", lambda v: v["b"].isNotNull()), lambda v: F.struct(v["b"].alias("value"), v["r"].alias("line_idx")))
    heads = heads.select("table_id", "r", F.struct(F.col("a").alias("value"), F.col("r").alias("line_idx"), kids.alias("children")).alias("node"))
    left = heads.groupBy("table_id").agg(F.transform(_sorted("r", "node"), lambda v: v["node"]).alias("lefts"))
    body = c.groupBy("table_id", "title").agg(F.map_from_entries(F.collect_list(F.struct(F.col("r") * 10000 + F.col("c"), "raw"))).alias("m"), F.max("r").alias("nr"), F.max("c").alias("nc"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), n), f)
    data = each(F.col("nr"), lambda r: each(F.col("nc"), lambda k: F.struct(F.try_element_at("m", r * 10000 + k).alias("value"))))
    root = lambda name, kids: F.struct(F.lit(name).alias("value"), kids.alias("children"))
    doc = F.struct("title", root("<TOP>", F.col("tops")).alias("top_root"), root("<LEFT>", F.col("lefts")).alias("left_root"), data.alias("data"))
    return body.join(top, "table_id").join(left, "table_id").select("table_id", F.to_json(doc).alias("raw"))


def tree_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with the paths of header trees, from JSON documents."""
    c = benchmarks.tree_cells(_raw_tables(spark, sf_dir)).filter("raw is not null")
    return c.select("table_id", "title", "r", "c", "num", tx.path_text("row_path").alias("row_path"), tx.path_text("col_path").alias("col_path"))


def tree_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and lines of the header trees by axis."""
    raw = _raw_tables(spark, sf_dir)
    lines = benchmarks.tree_lines(raw).groupBy("table_id", "axis").agg(F.count("*").alias("n_lines"), F.sum("line").cast("long").alias("sum_lines"))
    nodes = benchmarks.tree_nodes(raw).groupBy("table_id", "axis").agg(F.count("*").alias("n_nodes"), F.max(F.size(F.split("node", r"\."))).alias("depth"))
    return lines.join(nodes, ["table_id", "axis"])


def linked_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operands of samples whose links are counted from a grid with two header rows and one header column."""
    c = sales_cells(spark, sf_dir)
    at = F.concat(F.lit("("), (F.col("r") + 2).cast("string"), F.lit(", "), (F.col("c") + 1).cast("string"), F.lit(")"))
    link = c.filter("(r + c) % 6 = 0").groupBy("table_id", (F.col("r") % 2).alias("k")).agg(F.map_from_entries(F.collect_list(F.struct(at, "raw"))).alias("m"))
    none = lambda t: F.lit(None).cast(t)
    s = link.select(F.concat("table_id", F.lit("/"), F.col("k").cast("string")).alias("id"), "table_id", F.lit(" ").alias("question"), F.concat(F.lit("sales of "), "table_id").alias("sub_sentence"), none("string").alias("query"), F.array(F.lit("1")).alias("answer"), F.array(F.lit("none")).alias("aggregation"), none("array<string>").alias("answer_formulas"), F.to_json(F.struct(F.create_map(F.lit("[ANSWER]"), "m").alias("quantity_link"))).alias("linked_cells"))
    q, _, ops = benchmarks.hitab_of(s, _raw_tables(spark, sf_dir))
    return ops.join(q, ["query_id", "table_id"]).select("query_id", "r", "c", "value", "question", "value_type")


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents with a table of their lines; every third states a value that its table does not hold."""
    line = dealt(spark, sf_dir, "lineitem", "l_orderkey").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.max("l_quantity").cast("long").alias("q"), F.max("l_returnflag").alias("f"))
    row = F.concat(F.lit("<tr><td>line "), F.col("n").cast("string"), F.lit("</td><td>"), F.col("q").cast("string"), F.lit("</td></tr>"))
    stated = F.when((F.col("k") % 3 == 0) & (F.col("n") == 1), F.col("q") + 5000).otherwise(F.col("q"))
    at = F.concat(F.lit("0-"), F.col("n").cast("string"), F.lit("-1"))
    said = F.concat(F.lit("The quantity of line "), F.col("n").cast("string"), F.lit(" is "), F.format_number(stated, 0), F.lit("."))
    d = line.groupBy("k").agg(_sorted("n", row.alias("row"), "f", at.alias("at"), said.alias("said")).alias("x"))
    pick = lambda c: F.transform("x", lambda v: v[c])
    ev = F.when(F.col("k") % 7 == 0, F.slice(pick("at"), 1, 1)).otherwise(pick("at"))
    html = F.concat(F.lit("<table><tr><td>item</td><td>quantity</td></tr>"), F.array_join(pick("row"), ""), F.lit("</table>"))
    qa = F.struct(F.lit("how many?").alias("question"), F.lit("arithmetic").alias("question_type"), F.when(F.col("k") % 5 != 0, "add(1,2)").otherwise("").alias("program"), ev.alias("table_evidence"), F.when(F.col("k") % 11 == 0, F.array(F.lit("t"))).otherwise(F.array().cast("array<string>")).alias("text_evidence"), F.lit("1").alias("answer"))
    return d.select(F.col("k").cast("string").alias("uid"), F.array(html).alias("tables"), F.map_from_entries(F.transform("x", lambda v: F.struct(v["at"], v["said"]))).alias("table_description"), qa.alias("qa"))


def evidence_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of documents along the filters, the last one that stated values stand in the table, and both populations."""
    d = stored(_filings(spark, sf_dir), "filings")
    q, cells, funnel = benchmarks.multihiertt_of(d, keep_as=stored)
    lookup, _, _ = benchmarks.multihiertt_of(d, "lookup_single")
    c = cells.agg(F.count("*").alias("n_cells"), F.sum("num").alias("total"))
    return funnel.crossJoin(c).crossJoin(q.agg(F.count("*").alias("arith_multi"))).crossJoin(lookup.agg(F.count("*").alias("lookup_single")))  # one row each


def flat_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that sentences about flat tables name: a table for each customer segment, nations by return flag."""
    c = sales_cells(spark, sf_dir).filter("size(row_path) = 2 and col_path[0] = '1995'").select("table_id", F.concat(tx.leaf("row_path"), F.lit(" state")).alias("a"), F.get("col_path", 1).alias("f"), "raw")
    rows = c.groupBy("table_id", "a").agg(F.transform(_sorted("f", "raw"), lambda v: v["raw"]).alias("v"), F.transform(_sorted("f", "raw"), lambda v: v["f"]).alias("fs"))
    t = rows.groupBy("table_id").agg(F.array_sort(F.collect_list(F.concat(F.array("a"), F.col("v")))).alias("body"), F.first("fs").alias("fs"))
    said = lambda r: F.concat(F.lit("the "), F.get(r, 0), F.lit(" of flag "), F.get("fs", 1), F.lit(" is "), F.get(r, 2), F.lit(" ;"))
    head = F.concat(F.array(F.lit("nation")), F.transform("fs", lambda f: F.concat(F.lit("flag "), f)))
    doc = t.select(F.col("table_id").alias("id"), F.lit("?").alias("question"), F.lit("1").alias("answer"), F.concat(F.array(head), F.col("body")).alias("table"), F.transform(F.filter("body", lambda r, i: i % 4 == 1), said).alias("gold_evidence"))
    _, _, ops = benchmarks.finqa_of(doc)
    return ops.select("query_id", "r", "c", "value", "value_type")


def sql_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of each region with a larger key than a bound, by the benchmark's small SQL."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.agg(F.transform(_sorted("n_nationkey", "n_name", "r_name"), lambda v: F.array(v["n_name"], v["n_nationkey"].cast("string"), v["r_name"])).alias("rows"))
    cond = F.struct(F.array(F.lit(2), F.lit(1)).alias("column_index"), F.array(F.lit(0), F.lit(1)).alias("operator_index"), F.array(F.concat(F.lit(" "), F.lower("r_name")), (F.col("r_regionkey") * 4).cast("string")).alias("condition"))
    aggs = F.explode(F.array(*[F.struct(F.lit(a).alias("agg"), F.lit(s).alias("sel")) for a, s in ((0, 0), (3, 0), (1, 1), (4, 1))])).alias("x")
    kind = F.struct(F.lit("nations").alias("id"), F.array(F.lit("name"), F.lit("key"), F.lit("region")).alias("header"), F.col("rows"), F.lit("").alias("caption"), F.lit("Nations").alias("page_title"))
    t = table(spark, sf_dir, "region").select("r_name", "r_regionkey", aggs).crossJoin(rows)  # one row
    t = t.select(F.concat("r_name", F.lit("/"), F.col("x.agg").cast("string")).alias("question"), kind.alias("table"), F.struct(F.col("x.sel").alias("sel"), F.col("x.agg").alias("agg"), cond.alias("conds")).alias("sql"))
    q, _, a = benchmarks.wikisql_of(t)
    return q.select("query_id", "question").join(a, "query_id").select("question", F.array_join("answers", "|").alias("answers"), F.array_join(F.transform("row_ids", lambda r: r.cast("string")), ",").alias("row_ids"))


def column_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat tables read from one column-oriented document: a table for each region."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    t = n.groupBy("r_regionkey", "r_name").agg(F.to_json(F.transform(_sorted("n_nationkey", "n_name"), lambda v: F.array(v["n_name"], v["n_nationkey"].cast("string")))).alias("rows"))
    t = t.withColumn("k", F.col("r_regionkey").cast("string"))
    column = lambda name, v: F.map_from_entries(F.collect_list(F.struct("k", v))).alias(name)
    doc = t.agg(column("original_table_id", F.concat(F.lit("t"), "k")), column("page_title", F.col("r_name")), column("section_title", F.lit("Nations")), column("caption", F.lit("")), column("header", F.lit('["name", "key"]')), column("rows", F.col("rows")))
    out = benchmarks.openwikitable_of(doc.select(F.to_json(F.struct("*")).alias("value")))
    return out.select("table_id", "page_title", "section_title", F.array_join("header", "|").alias("header"), F.size("rows").alias("n_rows"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "=")), "|").alias("body"))


def _markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation rows of the sales tables as HTML: regions span their rows, years their columns; (table_id, html, rows, cols)."""
    c = sales_cells(spark, sf_dir).filter("size(row_path) = 2")
    cell = lambda kind, text, span="": F.concat(F.lit(f"<{kind}{span}>"), text, F.lit(f"</{kind}>"))
    rows = c.groupBy("table_id", "row_path").agg(F.array_join(F.transform(_sorted("c", "raw"), lambda v: cell("td", v["raw"])), "").alias("tds"))
    blocks = rows.groupBy("table_id", F.get("row_path", 0).alias("a")).agg(_sorted(F.get("row_path", 1).alias("b"), "tds").alias("x"))
    head = F.concat(F.lit('<th rowspan="'), F.size("x").cast("string"), F.lit('">'), "a", F.lit("</th>"))
    block = F.array_join(F.transform("x", lambda v, i: F.concat(F.lit("<tr>"), F.when(i == 0, head).otherwise(""), cell("th", v["b"]), v["tds"], F.lit("</tr>"))), "")
    body = blocks.groupBy("table_id").agg(F.array_join(F.transform(_sorted("a", block.alias("s")), lambda v: v["s"]), "").alias("body"))
    years = c.select("table_id", "col_path", "c").distinct().groupBy("table_id", F.get("col_path", 0).alias("y")).agg(_sorted("c", F.get("col_path", 1).alias("f")).alias("x"))
    wide = F.concat(F.lit('<th colspan="'), F.size("x").cast("string"), F.lit('">'), "y", F.lit("</th>"))
    flags = F.array_join(F.transform("x", lambda v: cell("th", v["f"])), "")
    tops = years.groupBy("table_id").agg(_sorted("y", wide.alias("w"), flags.alias("f")).alias("h"))
    join = lambda name: F.array_join(F.transform("h", lambda v: v[name]), "")
    corner = F.lit('<table><tr><th rowspan="2" colspan="2"></th>')
    return tops.join(body, "table_id").select("table_id", F.concat(corner, join("w"), F.lit("</tr><tr>"), join("f"), F.lit("</tr>"), "body", F.lit("</table>")).alias("html"))


def markup_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header boundaries and paths of tables from their markup: from blanks, from filled spans, and by the spans themselves."""
    t = _markup(spark, sf_dir)
    plain = t.select("table_id", html_to_grid(F.col("html")).alias("g"))
    plain = plain.withColumn("nr", structure.guessed_header_rows("g.grid", 2)).withColumn("nc", structure.guessed_header_cols("g.grid", F.col("nr")))
    by_merge = structure.merged_paths("g.grid", "g.merges", F.col("nr"), F.col("nc"))
    arms = {
        "carried": plain.select("table_id", "nr", "nc", structure.col_paths("g.grid", F.col("nr"), F.col("nc")).alias("cols"), structure.row_paths("g.grid", F.col("nr"), F.col("nc")).alias("rows")),
        "merged": plain.select("table_id", "nr", "nc", by_merge["cols"].alias("cols"), by_merge["rows"].alias("rows")),
        "refilled": plain.select("table_id", "nr", "nc", structure.merges_filled("g.grid", "g.merges").alias("x")).select("table_id", "nr", "nc", structure.col_paths("x", F.col("nr"), F.col("nc")).alias("cols"), structure.row_paths("x", F.col("nr"), F.col("nc")).alias("rows")),
        "filled": t.select("table_id", html_to_grid(F.col("html"), True).alias("g")).select("table_id", F.lit(2).alias("nr"), F.lit(2).alias("nc"), structure.col_paths("g.grid", F.lit(2), F.lit(2)).alias("cols"), structure.row_paths("g.grid", F.lit(2), F.lit(2)).alias("rows")),
    }
    say = lambda p: F.array_join(F.transform(p, lambda x: F.array_join(x, ">")), "|")
    return _union([d.select(F.lit(k).alias("arm"), "table_id", "nr", "nc", say(F.col("cols")).alias("cols"), say(F.col("rows")).alias("rows")) for k, d in arms.items()])


_MARKED = """+ n AS (SELECT DISTINCT table_id, row_path FROM cells WHERE len(row_path) = 2), k AS (SELECT DISTINCT table_id, col_path FROM cells WHERE len(row_path) = 2)"""

SQL = {
    "tree_tables": grid("SELECT table_id, title, r, c, num, array_to_string(row_path, ' > ') AS row_path, array_to_string(col_path, ' > ') AS col_path FROM cells"),
    "tree_axes": grid("""+ t AS (SELECT DISTINCT table_id, c, col_path FROM cells), l AS (SELECT DISTINCT table_id, r, row_path FROM cells)
      SELECT table_id, 'top' AS axis, count(*) AS n_lines, CAST(sum(c) AS BIGINT) AS sum_lines, count(*) + count(DISTINCT col_path[1]) + 1 AS n_nodes, 3 AS depth FROM t GROUP BY table_id
      UNION ALL SELECT table_id, 'left', count(*), CAST(sum(r) AS BIGINT), count(*) + 1, 3 FROM l GROUP BY table_id"""),
    "linked_samples": grid("SELECT table_id || '/' || (r % 2) AS query_id, r, c, num AS value, 'sales of ' || table_id AS question, 'number' AS value_type FROM cells WHERE (r + c) % 6 = 0"),
    "evidence_funnel": """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY ALL), d AS (SELECT k, count(*) AS lines, min(n) = 1 AS first, max(CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END) = 1 AS one, k % 5 <> 0 AS ar, k % 11 <> 0 AS al FROM l GROUP BY k),
      e AS (SELECT *, CASE WHEN one THEN 1 ELSE lines END AS ev, NOT (k % 3 = 0 AND first) AS ok FROM d)
      SELECT count(*) AS questions, count(*) FILTER (WHERE ar) AS arithmetic, count(*) FILTER (WHERE ar AND al) AS table_only, count(*) FILTER (WHERE ar AND al) AS single_table, count(*) FILTER (WHERE ar AND al AND ev >= 2) AS multi_operand, count(*) FILTER (WHERE ar AND al AND ev >= 2 AND ok) AS value_validated,
        (SELECT count(*) FROM l) AS n_cells, (SELECT CAST(sum(q) AS DOUBLE) FROM l) AS total, count(*) FILTER (WHERE ar AND al AND ev >= 2 AND ok) AS arith_multi, count(*) FILTER (WHERE NOT ar AND al AND ev = 1) AS lookup_single FROM e""",
    "flat_evidence": grid("""+ f AS (SELECT table_id, row_path[2] AS a, col_path[2] AS f, num, dense_rank() OVER (PARTITION BY table_id ORDER BY row_path[2] || ' state') - 1 AS r, dense_rank() OVER (PARTITION BY table_id ORDER BY col_path[2]) AS k FROM cells WHERE len(row_path) = 2 AND col_path[1] = '1995')
      SELECT table_id AS query_id, CAST(r AS INTEGER) AS r, CAST(k AS INTEGER) AS c, num AS value, 'number' AS value_type FROM f WHERE r % 4 = 1 AND k = 2"""),
    "sql_answers": """WITH n AS (SELECT r_name, n_name, n_nationkey AS k, row_number() OVER (ORDER BY n_nationkey) - 1 AS r, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey), p AS (SELECT * FROM n WHERE k > r_regionkey * 4),
      g AS (SELECT r_name, string_agg(n_name, '|' ORDER BY r) AS names, count(*) AS n, max(k) AS top, sum(k) AS total, string_agg(CAST(r AS VARCHAR), ',' ORDER BY r) AS ids FROM p GROUP BY r_name)
      SELECT r_name || '/0' AS question, names AS answers, ids AS row_ids FROM g UNION ALL SELECT r_name || '/3', CAST(n AS VARCHAR), ids FROM g UNION ALL SELECT r_name || '/1', top || '.0', ids FROM g UNION ALL SELECT r_name || '/4', total || '.0', ids FROM g""",
    "column_documents": "SELECT 't' || r_regionkey AS table_id, r_name AS page_title, 'Nations' AS section_title, 'name|key' AS header, CAST(count(*) AS INTEGER) AS n_rows, string_agg(n_name || '=' || n_nationkey, '|' ORDER BY n_nationkey) AS body FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name",
    "markup_headers": grid(f"""{_MARKED}, s AS (SELECT table_id, string_agg(array_to_string(row_path, '>'), '|' ORDER BY row_path) AS rows FROM n GROUP BY table_id), t AS (SELECT table_id, string_agg(array_to_string(col_path, '>'), '|' ORDER BY col_path) AS cols FROM k GROUP BY table_id)
      SELECT arm, table_id, 2 AS nr, 2 AS nc, cols, rows FROM s JOIN t USING (table_id), (SELECT unnest(['carried', 'merged', 'refilled', 'filled']) AS arm)"""),
}
QUERIES = {f.__name__: f for f in (tree_tables, tree_axes, linked_samples, evidence_funnel, flat_evidence, sql_answers, column_documents, markup_headers)}
