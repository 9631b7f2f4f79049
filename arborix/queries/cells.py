"""Queries of structure and text over the sales tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import minisql, structure, texts
from .base import NUMBERS, grid, literal, literal_sql, phrased, phrased_sql, sales_cells, table


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def minisql_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return minisql.execute(e, "user_id", "", [("event_type", "=", " CLICK "), ("value", ">", 50)])


def minisql_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    one = lambda a: minisql.execute(e, "value", a, [("event_type", "=", "click"), ("user_id", "<", 500)]).select(F.lit(a).alias("agg"), F.round(F.col("answer").cast("double"), 4).alias("answer"))
    return _union([one(a) for a in ("max", "min", "count", "sum", "avg")])


def cells_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_cells(spark, sf_dir).select("table_id", "r", "c", "num", tx.path_text("row_path").alias("row_path"), tx.path_text("col_path").alias("col_path"), F.array_join(tx.full_path("row_path", "col_path"), " > ").alias("full_path"))


def serialize_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.serialize(sales_cells(spark, sf_dir), "S1")


def serialize_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sales_cells(spark, sf_dir)
    full = lambda k, *keys: texts.serialize(c, "S2", kind=k).select(F.lit(k).alias("kind"), "table_id", *[(F.col(x) if x in keys else F.lit(None).cast("int")).alias(x) for x in ("r", "c")], "text")
    return _union([full("row", "r"), full("cell", "r", "c"), full("table")])


def serialize_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sales_cells(spark, sf_dir)
    rows = [texts.serialize(c, "S3", length=n).select(F.lit(n).alias("length"), "table_id", "r", F.lit(None).cast("int").alias("c"), "text") for n in ("short", "medium", "long")]
    return _union([*rows, texts.serialize(c, "S3", length="long", kind="cell").select(F.lit("long cell").alias("length"), "table_id", "r", "c", "text")])


def compact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sales_cells(spark, sf_dir)
    return _union([texts.compact_rows(c, s).select(F.lit(s).alias("scheme"), "chunk_id", "text", F.size("cols").alias("n_cols")) for s in ("s1_flat", "s2_headerpath")])


def whole_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.whole_tables(sales_cells(spark, sf_dir)).select("chunk_id", "text", F.size("rows").alias("n_rows"), F.size("cols").alias("n_cols"))


def verbalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sales_cells(spark, sf_dir)
    return _union([texts.verbalized(c, s).select(F.lit(s).alias("style"), "chunk_id", "text") for s in ("short", "medium", "long")])


def collision_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sales_cells(spark, sf_dir)
    return c.select("table_id", "r", "c", *[texts.collision_text(s).alias(s.lower()) for s in ("flat", "S2", "S2_shuf", "S3")])


def prep_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sales_cells(spark, sf_dir)
    meta = c.select("table_id", texts.metadata(F.col("title"), F.lit(""), F.concat(F.lit("Segment "), "table_id")).alias("block")).distinct()
    return _union([texts.prepared(c, k, meta).select(F.lit(k).alias("condition"), "table_id", "text") for k in ("C0", "C1", "C2", "C2h", "C3")])


def header_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.inventory(sales_cells(spark, sf_dir)).select("table_id", "row_depth", "col_depth", F.array_join("row_paths", "|").alias("row_paths"), F.array_join("col_paths", "|").alias("col_paths"))


def candidate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.candidate_paths(sales_cells(spark, sf_dir)).select("table_id", "path", F.array_join(F.transform("rows", lambda x: x.cast("string")), ",").alias("rows"), F.array_join(F.transform("cols", lambda x: x.cast("string")), ",").alias("cols"))


def node_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sales_cells(spark, sf_dir)
    return _union([texts.node_candidates(c, a).select(F.lit(a).alias("axis"), "table_id", "k", "node") for a in ("row", "col")])


def distinct_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sales_cells(spark, sf_dir)
    return _union([texts.distinct_paths(c, a, 10).select(F.lit(a).alias("axis"), "table_id", "k", "path") for a in ("row", "col")])


def dual_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.dual_orders(sales_cells(spark, sf_dir))


def reader_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.reader_view(sales_cells(spark, sf_dir), 5, 4)


def chunk_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.serialize(sales_cells(spark, sf_dir), "S2").select("table_id", "r", texts.chunk_value("text").alias("value"))


def pivot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sales_cells(spark, sf_dir).filter(F.get("col_path", 0) == "1995")
    return texts.pivoted(c, ["A", "N", "R"]).select("table_id", "line", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("rr"))


def table_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sales_cells(spark, sf_dir)
    t = c.groupBy("table_id").agg(F.collect_set("row_path").alias("lefts"), F.collect_set("col_path").alias("tops"), F.max("r").alias("nr"), F.max("c").alias("nc"))
    return t.select("table_id", tx.paths_depth("tops", "lefts").alias("depth"), structure.size_bucket(F.col("nr") + 1, F.col("nc") + 1).alias("bucket"), F.array_join(tx.common_prefix(F.filter("lefts", lambda p: F.get(p, 0) == "ASIA")), ">").alias("prefix"))


def number_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All numeric readings of edge values into which the parts' sizes are put, side by side."""
    t = phrased(spark, sf_dir, NUMBERS, "v")
    nums = tx.numbers("v")
    return t.select(
        "id",
        tx.number_prefix("v").alias("prefix"),
        tx.number_search("v").alias("search"),
        tx.number_accounting("v").alias("accounting"),
        F.when(~F.isnan(tx.number_strict("v")), tx.number_strict("v")).alias("strict"),
        tx.number_magnitude("v").alias("magnitude"),
        tx.number_rounded("v").alias("rounded"),
        tx.bare_number("v").alias("bare"),
        tx.last_number("v").alias("last"),
        tx.tabulated_number("v").alias("tabulated"),
        F.size(nums).alias("n_numbers"),
        F.get(nums, 0).alias("first_number"),
        tx.looks_numeric("v").alias("looks_numeric"),
        tx.data_like("v").alias("data_like"),
    )


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, references, answers and token counts of questions and passages."""
    t = table(spark, sf_dir, "benchmark")
    return t.select(
        "item_id",
        tx.normal_label("text").alias("label"),
        tx.format_value("text").alias("value"),
        F.size(tx.alnum_tokens("text")).cast("int").alias("n_alnum"),
        F.size(tx.encoder_tokens("text")).cast("int").alias("n_encoder"),
        F.size(tx.norm_tokens("text")).cast("int").alias("n_norm"),
        tx.estimated_tokens("text").alias("tokens"),
        tx.collection_name("text").alias("collection"),
        tx.final_answer(F.concat(F.lit("so\nFinal answer: "), F.translate("text", "\n", " "), F.lit("."))).alias("answer"),
        tx.clean_span(F.concat(F.lit(" the "), "text", F.lit("?"))).alias("span"),
    )


def reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales headers flattened to a grid and rebuilt: agreement of paths by table and axis."""
    c = sales_cells(spark, sf_dir)
    out = []
    for axis, at, path in (("row", "r", "row_path"), ("col", "c", "col_path")):
        lines = c.groupBy("table_id", at).agg(F.first(path).alias("path"))
        t = lines.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct(at, "path"))).alias("x")).select("table_id", F.transform("x", lambda v: v["path"]).alias("paths"))
        t = t.select("table_id", structure.carried(structure.flattened_headers(F.col("paths"), F.lit(2))).alias("back"))
        rebuilt = t.select("table_id", F.posexplode("back").alias(at, "path"))
        gold = lines.withColumn(at, F.col(at).cast("int"))
        out.append(structure.path_agreement(rebuilt, gold, ["table_id", at]).select(F.lit(axis).alias("axis"), "table_id", "n", "n_exact"))
    return _union(out)


_P = "array_to_string(row_path, ' > ')"
_Q = "array_to_string(col_path, ' > ')"
_F = f"{_P} || ' > ' || {_Q}"
_LEAF = "row_path[-1]"
_CLEAF = "col_path[-1]"
_ROWS = "SELECT 'table' FROM cells"

_V = literal_sql(NUMBERS, "v")
_PV = phrased_sql(NUMBERS, "v")
_FLOAT = r"'^[+-]?(\d+\.?\d*|\.\d+)$'"
_FLOAT_E = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"

_MD = f"""
 md AS (SELECT table_id, h || chr(10) || s || chr(10) || b AS text FROM
   (SELECT table_id, string_agg(line, chr(10) ORDER BY r) AS b, any_value(h) AS h, any_value(s) AS s FROM
     (SELECT table_id, r, string_agg(raw, ' | ' ORDER BY c) AS line, string_agg({_CLEAF}, ' | ' ORDER BY c) AS h, string_agg('---', ' | ' ORDER BY c) AS s FROM cells WHERE r < 20 GROUP BY table_id, r) GROUP BY table_id))"""

SQL = {
    "minisql_select": "SELECT user_id AS answer FROM events WHERE lower(trim(event_type)) = 'click' AND value > 50",
    "minisql_aggregates": """WITH p AS (SELECT value FROM events WHERE event_type = 'click' AND user_id < 500)
      SELECT 'max' AS agg, round(max(value), 4) AS answer FROM p UNION ALL SELECT 'min', round(min(value), 4) FROM p UNION ALL SELECT 'count', CAST(count(*) AS DOUBLE) FROM p
      UNION ALL SELECT 'sum', round(sum(value), 4) FROM p UNION ALL SELECT 'avg', round(avg(value), 4) FROM p""",
    "cells_melt": grid(f"SELECT table_id, r, c, num, {_P} AS row_path, {_Q} AS col_path, {_F} AS full_path FROM cells"),
    "serialize_flat": grid(f"""SELECT table_id, r, title || chr(10) || '| row | ' || string_agg({_CLEAF}, ' | ' ORDER BY c) || ' |' || chr(10) || '| --- | ' || string_agg('---', ' | ' ORDER BY c) || ' |' || chr(10)
      || '| ' || any_value({_LEAF}) || ' | ' || string_agg(raw, ' | ' ORDER BY c) || ' |' AS text FROM cells GROUP BY table_id, title, r"""),
    "serialize_paths": grid(f"""+ l AS (SELECT *, {_F} || ': ' || raw AS line FROM cells)
      SELECT 'row' AS kind, table_id, r, NULL::INTEGER AS c, title || chr(10) || string_agg(line, chr(10) ORDER BY c) AS text FROM l GROUP BY table_id, title, r
      UNION ALL SELECT 'cell', table_id, r, c, title || chr(10) || line FROM l
      UNION ALL SELECT 'table', table_id, NULL, NULL, title || chr(10) || string_agg(line, chr(10) ORDER BY r, c) FROM l GROUP BY table_id, title"""),
    "serialize_captions": grid(f"""+ s AS (SELECT *, {_P} || ' ' || {_Q} || ': ' || raw || '.' AS short, 'For ' || {_P} || ', ' || {_Q} || ' is ' || raw || '.' AS medium, 'among ' || {_P} || ', the value of ' || {_Q} || ' is ' || raw || '.' AS rest FROM cells),
      u AS (SELECT 'short' AS length, table_id, title, r, c, short AS line FROM s UNION ALL SELECT 'medium', table_id, title, r, c, medium FROM s UNION ALL SELECT 'long', table_id, title, r, c, 'A' || lower(substr(rest, 2)) FROM s)
      SELECT length, table_id, r, NULL::INTEGER AS c, title || chr(10) || string_agg(line, chr(10) ORDER BY c) AS text FROM u GROUP BY length, table_id, title, r
      UNION ALL SELECT 'long cell', table_id, r, c, 'In the table ''' || title || ''', ' || rest FROM s"""),
    "compact_rows": grid(f"""SELECT 's1_flat' AS scheme, table_id || '#r' || r AS chunk_id, title || ' | ' || any_value({_LEAF}) || ' | ' || string_agg({_CLEAF} || ': ' || raw, ' | ' ORDER BY c) AS text, CAST(count(*) AS INTEGER) AS n_cols FROM cells GROUP BY table_id, title, r
      UNION ALL SELECT 's2_headerpath', table_id || '#r' || r, title || ' | ' || string_agg({_F} || ': ' || raw, ' | ' ORDER BY c), CAST(count(*) AS INTEGER) FROM cells GROUP BY table_id, title, r"""),
    "whole_tables": grid(f"""+ t AS (SELECT table_id, title, r, title || ' | ' || string_agg({_F} || ': ' || raw, ' | ' ORDER BY c) AS text FROM cells GROUP BY table_id, title, r)
      SELECT table_id || '#full' AS chunk_id, title || chr(10) || string_agg(text, chr(10) ORDER BY r) AS text, CAST(count(*) AS INTEGER) AS n_rows, CAST((SELECT count(DISTINCT c) FROM cells x WHERE x.table_id = t.table_id) AS INTEGER) AS n_cols FROM t GROUP BY table_id, title"""),
    "verbalize": grid(f"""+ n AS (SELECT *, table_id || '#c' || r || '_' || c AS chunk_id, {_CLEAF} || ' for ' || {_LEAF} || ' is ' || raw || '.' AS s, array_to_string(col_path, ', ') || ' for ' || array_to_string(row_path, ', ') || ' is ' || raw || '.' AS l FROM cells)
      SELECT 'short' AS style, chunk_id, s AS text FROM n UNION ALL SELECT 'medium', chunk_id, 'In ' || title || ', ' || s FROM n UNION ALL SELECT 'long', chunk_id, 'In ' || title || ', ' || l FROM n"""),
    "collision_texts": grid(f"""SELECT table_id, r, c, {_LEAF} || ' ' || {_CLEAF} || ' ' || raw AS flat, {_F} || ': ' || raw AS s2,
      (SELECT string_agg(x.s, ' > ' ORDER BY md5(x.s || CAST(x.i - 1 AS VARCHAR))) FROM (SELECT unnest(list_concat(row_path, col_path)) AS s, generate_subscripts(list_concat(row_path, col_path), 1) AS i) x) || ': ' || raw AS s2_shuf,
      'For ' || {_P} || ', ' || {_Q} || ' is ' || raw || '.' AS s3 FROM cells"""),
    "header_inventory": grid(f"SELECT table_id, CAST(max(len(row_path)) AS INTEGER) AS row_depth, CAST(max(len(col_path)) AS INTEGER) AS col_depth, string_agg(DISTINCT {_P}, '|' ORDER BY {_P}) AS row_paths, string_agg(DISTINCT {_Q}, '|' ORDER BY {_Q}) AS col_paths FROM cells GROUP BY table_id"),
    "candidate_paths": grid(f"SELECT table_id, {_F} AS path, string_agg(DISTINCT CAST(r AS VARCHAR), ',') AS rows, string_agg(DISTINCT CAST(c AS VARCHAR), ',') AS cols FROM cells GROUP BY table_id, {_F}"),
    "node_prefixes": grid("""+ p AS (SELECT 'row' AS axis, table_id, r AS pos, k AS d, array_to_string(row_path[1:k], ' > ') AS node FROM cells, (SELECT unnest([1, 2]) AS k) WHERE k <= len(row_path)
        UNION ALL SELECT 'col', table_id, c, k, array_to_string(col_path[1:k], ' > ') FROM cells, (SELECT unnest([1, 2]) AS k) WHERE k <= len(col_path)),
      f AS (SELECT axis, table_id, node, min(struct_pack(a := pos, d := d)) AS first FROM p GROUP BY ALL)
      SELECT axis, table_id, CAST(k AS INTEGER) AS k, node FROM (SELECT *, row_number() OVER (PARTITION BY axis, table_id ORDER BY first) AS k FROM f) WHERE k <= 80"""),
    "distinct_paths": grid(f"""+ f AS (SELECT 'row' AS axis, table_id, {_P} AS path, min(r) AS first FROM cells GROUP BY ALL UNION ALL SELECT 'col', table_id, {_Q}, min(c) FROM cells GROUP BY ALL)
      SELECT axis, table_id, CAST(k AS INTEGER) AS k, path FROM (SELECT *, row_number() OVER (PARTITION BY axis, table_id ORDER BY first) AS k FROM f) WHERE k <= 10"""),
    "dual_orders": grid(f"SELECT table_id, string_agg({_F} || ': ' || raw, chr(10) ORDER BY r, c) || chr(10) || chr(10) || string_agg({_F} || ': ' || raw, chr(10) ORDER BY c, r) AS text FROM cells GROUP BY table_id"),
    "reader_view": grid(f"SELECT table_id, title || chr(10) || string_agg({_F} || ': ' || raw, chr(10) ORDER BY r, c) AS text FROM cells WHERE r < 5 AND c < 4 GROUP BY table_id, title"),
    "chunk_values": grid("SELECT table_id, r, arg_max(raw, c) AS value FROM cells GROUP BY table_id, r"),
    "pivot_rows": grid(f"SELECT table_id, r AS line, max(num) FILTER (WHERE {_CLEAF} = 'A') AS a, max(num) FILTER (WHERE {_CLEAF} = 'N') AS n, max(num) FILTER (WHERE {_CLEAF} = 'R') AS rr FROM cells WHERE col_path[1] = '1995' GROUP BY table_id, r"),
    "table_depths": grid("""SELECT table_id, CAST(greatest(max(len(row_path)), max(len(col_path))) AS INTEGER) AS depth, CASE WHEN greatest(max(r), max(c)) + 1 <= 10 THEN 'small' WHEN greatest(max(r), max(c)) + 1 <= 20 THEN 'medium' ELSE 'large' END AS bucket,
      CASE WHEN max(CASE WHEN row_path[1] = 'ASIA' THEN 1 END) = 1 THEN 'ASIA' ELSE '' END AS prefix FROM cells GROUP BY table_id"""),
    "number_parsers": rf"""SELECT id, TRY_CAST(nullif(regexp_extract(replace(trim(v), ',', ''), '^-?\d+\.?\d*'), '') AS DOUBLE) AS prefix,
      TRY_CAST(nullif(regexp_extract(translate(v, ',$%', ''), '-?\d+\.?\d*'), '') AS DOUBLE) AS search,
      TRY_CAST(nullif(regexp_extract(replace(replace(trim(translate(v, ',$%', '')), '(', '-'), ')', ''), '-?\d+\.?\d*'), '') AS DOUBLE) AS accounting,
      CASE WHEN regexp_full_match(trim(translate(v, ',$', '')), {_FLOAT_E}) THEN TRY_CAST(trim(translate(v, ',$', '')) AS DOUBLE) END AS strict,
      CASE WHEN regexp_full_match(trim(trim(replace(trim(v), ',', ''), '()')), {_FLOAT_E}) THEN TRY_CAST(trim(trim(replace(trim(v), ',', ''), '()')) AS DOUBLE) END AS magnitude,
      CASE WHEN regexp_full_match(regexp_replace(v, '[$,%\s]', '', 'g'), {_FLOAT_E}) THEN CASE WHEN abs(TRY_CAST(regexp_replace(v, '[$,%\s]', '', 'g') AS DOUBLE)) > 1e15 THEN TRY_CAST(regexp_replace(v, '[$,%\s]', '', 'g') AS DOUBLE) ELSE round(TRY_CAST(regexp_replace(v, '[$,%\s]', '', 'g') AS DOUBLE), 4) END END AS rounded,
      TRY_CAST(nullif(replace(regexp_extract(trim(v), '^[$€£]?\s*(-?\d[\d,]*\.?\d*)\s*%?\.?$', 1), ',', ''), '') AS DOUBLE) AS bare,
      TRY_CAST(regexp_extract_all(replace(v, ',', ''), '-?\d[\d,]*\.?\d*')[-1] AS DOUBLE) AS last,
      CASE WHEN regexp_full_match(replace(regexp_replace(regexp_replace(lower(trim(v)), '^\(', ''), '[%)]$', ''), ',', ''), {_FLOAT_E}) THEN TRY_CAST(replace(regexp_replace(regexp_replace(lower(trim(v)), '^\(', ''), '[%)]$', ''), ',', '') AS DOUBLE) END AS tabulated,
      CAST(coalesce(len(regexp_extract_all(v, '-?\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|-?\d+\.?\d*')), 0) AS INTEGER) AS n_numbers,
      CAST(replace(regexp_extract_all(v, '-?\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|-?\d+\.?\d*')[1], ',', '') AS DOUBLE) AS first_number,
      coalesce(trim(v) <> '' AND NOT regexp_full_match(trim(v), '(?:19|20)\d{{2}}') AND regexp_full_match(trim(v), '[$(\-]?[\d,]+\.?\d*%?\)?'), false) AS looks_numeric,
      coalesce(trim(v) <> '' AND NOT regexp_full_match(trim(v), '(?:19|20)\d{{2}}') AND regexp_full_match(trim(v), '[$(\-]?[\d,]+\.?\d*%?\)?'), false) OR coalesce(lower(trim(v)) IN ('..', '...', '.', '-', '--', '–', '—', 'n/a', 'na', 'x', 'f', 'e', 'r', '*', '†', '‡', 'nil', 'none', 'not available'), false) AS data_like
      FROM {_PV}""",
    "text_functions": r"""SELECT item_id, regexp_replace(trim(lower(text)), '\s+', ' ', 'g') AS label, trim(regexp_replace(text, '\s+', ' ', 'g')) AS value,
      CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS INTEGER) AS n_alnum, CAST(len(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_&$%/.\-]*')) AS INTEGER) AS n_encoder,
      CAST(len(list_filter(string_split_regex(lower(text), '[^A-Za-z0-9]+'), lambda t: t <> '')) AS INTEGER) AS n_norm, CAST(greatest(1, len(text) // 4) AS INTEGER) AS tokens,
      substr(regexp_replace(text, '[^A-Za-z0-9_\-]', '_', 'g'), 1, 63) AS collection, trim(regexp_replace(regexp_replace(trim(replace(text, chr(10), ' ') || '.'), '(?i)^(answer|the answer is|=|:)\s*', ''), '\.+$', '')) AS answer,
      trim(regexp_replace(trim(' the ' || text || '?', ' ,.?'), '(?i)^(what|how|the|is|was|are|were|did|do|of)\b\s*', '')) AS span FROM benchmark""",
    "reconstruct": grid("SELECT 'row' AS axis, table_id, count(DISTINCT r) AS n, count(DISTINCT r) AS n_exact FROM cells GROUP BY table_id UNION ALL SELECT 'col', table_id, count(DISTINCT c), count(DISTINCT c) FROM cells GROUP BY table_id"),
    "prep_ladder": grid(f"""+ {_MD.strip()},
      m AS (SELECT DISTINCT table_id, 'Title: ' || title || chr(10) || 'Caption: Segment ' || table_id AS b1 FROM cells),
      colv AS (SELECT table_id, c, any_value({_CLEAF}) AS name, list(raw ORDER BY r) AS vs, count(*) AS n FROM cells GROUP BY table_id, c),
      ex AS (SELECT table_id, c, string_agg(v, '; ' ORDER BY r) AS e FROM (SELECT *, row_number() OVER (PARTITION BY table_id, c ORDER BY r) AS k FROM (SELECT table_id, c, raw AS v, min(r) AS r FROM cells GROUP BY table_id, c, raw)) WHERE k <= 3 GROUP BY table_id, c),
      c2 AS (SELECT table_id, 'Columns (' || count(*) || ' columns, ' || max(n) || ' rows):' || chr(10) || string_agg('- ' || name || ' (number): e.g. ' || e, chr(10) ORDER BY c) AS b2 FROM colv JOIN ex USING (table_id, c) GROUP BY table_id),
      rp AS (SELECT table_id, string_agg('- ' || p, chr(10) ORDER BY pos) AS t FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY pos) AS k FROM (SELECT table_id, {_P} AS p, min(r) AS pos FROM cells GROUP BY ALL)) WHERE k <= 30 GROUP BY table_id),
      cp AS (SELECT table_id, count(*) AS n, string_agg('- ' || p, chr(10) ORDER BY pos) AS t FROM (SELECT table_id, {_Q} AS p, min(c) AS pos FROM cells GROUP BY ALL) GROUP BY table_id),
      c2h AS (SELECT table_id, 'Column header paths (' || n || ' columns):' || chr(10) || cp.t || chr(10) || 'Row header paths:' || chr(10) || rp.t AS b2 FROM cp JOIN rp USING (table_id)),
      qs AS (SELECT table_id, string_agg('- What is the ' || {_Q} || ' for ' || {_P} || '?', chr(10) ORDER BY k) AS t FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY md5(table_id || '|' || r || '|' || c || '|7')) AS k FROM cells) WHERE k <= 3 GROUP BY table_id)
      SELECT 'C0' AS condition, table_id, text FROM md
      UNION ALL SELECT 'C1', table_id, b1 || chr(10) || chr(10) || text FROM m JOIN md USING (table_id)
      UNION ALL SELECT 'C2', table_id, b1 || chr(10) || chr(10) || b2 || chr(10) || chr(10) || text FROM m JOIN md USING (table_id) JOIN c2 USING (table_id)
      UNION ALL SELECT 'C2h', table_id, b1 || chr(10) || chr(10) || b2 || chr(10) || chr(10) || text FROM m JOIN md USING (table_id) JOIN c2h USING (table_id)
      UNION ALL SELECT 'C3', table_id, b1 || chr(10) || chr(10) || b2 || chr(10) || chr(10) || 'Questions answerable from this table:' || chr(10) || qs.t || chr(10) || chr(10) || text FROM m JOIN md USING (table_id) JOIN c2h USING (table_id) JOIN qs USING (table_id)"""),
}
QUERIES = {f.__name__: f for f in (minisql_select, minisql_aggregates, cells_melt, serialize_flat, serialize_paths, serialize_captions, compact_rows, whole_tables, verbalize, collision_texts, prep_ladder, header_inventory, candidate_paths, node_prefixes, distinct_paths, dual_orders, reader_view, chunk_values, pivot_rows, table_depths, number_parsers, text_functions, reconstruct)}
