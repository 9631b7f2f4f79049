"""Understanding of questions by rules: types, terms, spans and header paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions.udfs import store_similarity
from . import likeness


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _has(pattern: str, x: Column) -> Column:
    return x.rlike("(?i)" + tx.ascii_pattern(pattern))


#: Cue patterns of the classifier (fixed values).
ARG = r"\b(highest|lowest|largest|smallest|maximum|minimum|most|least|biggest|top|bottom|best|worst|peak|higher|lower|more|fewer|greater)\b"
PAIR = r"\b(which|who|or)\b.*\b(or)\b"
ENTITY = r"^\s*(?:who|which|what|where|in what|in which)\b"
COMPARE = r"\b(greater|less|more|fewer|higher|lower|exceed|exceeds|exceeded|bigger|smaller|above|below|than|compared|opposite|sign)\b"
COUNT = r"\b(how many|count|number of)\b"
ARITHMETIC = r"\b(sum of|combined|altogether|together|average|mean|difference|differ|differen|gap|change|increase|decrease|grew|drop|dropped|ratio|fraction|proportion|percentage|percent|per cent|share of|out of|divided by|multiplied|product|range|spread|how much (?:more|less|higher|lower))\b"
TOTAL = r"\btotal\b(?!\s+(?:row|column|col|cell|of\s+the))"
TRIGGER = r"\b(sum of|average|mean|difference|change|ratio|percentage|divided|times|gap|increase|decrease)\b"
MULTI = r"\b(and|plus)\b.*\b(divided|over|minus|less|times)\b"
DEFINITION = r"^\s*(what is|what are|define|explain|why does|describe|how does)\b"
TABLE_WORD = r"\b(table|row|column|cell|value|figure|chart|data)\b"


def query_type(question) -> Column:
    """One of six types, by the first rule that holds."""
    q = F.trim(F.coalesce(_c(question), F.lit("")))
    symbols = F.length(q) - F.length(F.translate(q, "+-*/", ""))
    triggers = F.size(F.array_distinct(F.regexp_extract_all(F.lower(q), F.lit(tx.ascii_pattern(TRIGGER)), F.lit(1))))
    return (
        F.when((symbols >= 2) | (triggers >= 2) | _has(MULTI, q), "multi_op_formula")
        .when(_has(ENTITY, q) & (_has(ARG, q) | _has(PAIR, q)), "single_arg")
        .when(_has(ARITHMETIC, q) | _has(TOTAL, q), "arithmetic_agg")
        .when(_has(PAIR, q) | _has(ARG, q), "single_arg")
        .when(_has(COMPARE, q) | _has(COUNT, q), "comparison_or_count")
        .when(_has(DEFINITION, q) & ~_has(TABLE_WORD, q), "reasoning_only")
        .otherwise("simple_lookup")
    )


def needs_symbolic(kind) -> Column:
    return _c(kind).isin("multi_op_formula", "arithmetic_agg")


def stages(kind) -> Column:
    """The stages that a question of a type runs through."""
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    return F.when(_c(kind) == "reasoning_only", a("llm_answer")).when(needs_symbolic(kind), a("retrieve", "symbolic", "llm_answer")).otherwise(a("retrieve", "llm_answer"))


def answer_strategy(kind) -> Column:
    return F.when(_c(kind).isin("single_arg", "simple_lookup", "reasoning_only"), "naive").when(_c(kind).isin("arithmetic_agg", "comparison_or_count"), "sc").otherwise("grounded")


#: Route patterns (fixed values).
ROUTE_COMPARE = (
    r"\bwhich\s+\w+\s+(had|has|have)\s+(the\s+)?(largest|smallest|highest|lowest|most|least|greater|fewer|more)\b",
    r"\bwhich\s+\w+\s+(is|was|were)\s+(the\s+)?(largest|smallest|highest|lowest|most|least|greater|fewer|more)\b",
    r"\b(higher|lower|larger|smaller|greater|fewer|more)\b.*\bthan\b",
)
ROUTE_ARITHMETIC = (
    r"\bratio\s+of\s+\w+.*\bto\s+\w+",
    r"\bmultiple\s+(of|relationship)\b",
    r"\b(times|fold)\s+(more|less|of|the|as)\b",
    r"\bfor\s+every\s+\w+",
    r"\bdifference\s+(between|of)\s+\w+\s+and\s+\w+",
    r"\btotal\s+(amount|number|sum|count)\s+of\s+all\b",
    r"\bsum\s+of\s+(all\s+)?\w+\s+and\s+\w+",
    r"\baverage\s+of\s+(all\s+)?\w+",
    r"\bmean\s+of\s+\w+",
    r"\baggregate\s+of\b",
    r"\bcombined\s+(total|amount|number)\b",
    r"\brange\s+of\b",
    r"\bwhich\s+\w+\s+(had|has|have|is|was|were)\s+the\s+(largest|smallest|highest|lowest|most|least|biggest|greatest)\b",
    r"\bcompare\s+\w+\s+(to|with|between|and)\b",
)
ROUTE_LIST = (r"\blist\b", r"\btop\s+\w+\b", r"\bwhich\s+(are|were|industries|countries|cities|sectors|groups|places)\b", r"\bwhat\s+are\s+the\b")


def route(question) -> Column:
    """Lists of cells go to beta, unless compared; all else, arithmetic included, to gamma."""
    q = F.lower(F.trim(_c(question)))
    any_of = lambda ps: F.coalesce(q.rlike(tx.ascii_pattern("|".join(f"(?:{p})" for p in ps))), F.lit(False))
    arithmetic = any_of(ROUTE_ARITHMETIC)
    return F.when(any_of(ROUTE_COMPARE), "gamma").when(arithmetic, "gamma").when(any_of(ROUTE_LIST), "beta").otherwise("gamma")


def formula_route(formulas) -> Column:
    """The route that an annotated formula calls for."""
    f = F.get(_c(formulas), 0)
    body = F.upper(F.regexp_replace(f, "^=", ""))
    return F.when(F.coalesce(body.rlike(r"[+\-*/:]|SUM|AVERAGE|AVG|COUNT|MAX|MIN|IF"), F.lit(False)), "gamma").otherwise("beta")


def difficulty(aggregation, formulas) -> Column:
    """One of seven classes by aggregation labels and the operators of the longest formula."""
    a = _c(aggregation)
    ops = F.coalesce(F.array_max(F.transform(_c(formulas), lambda f: F.length(f) - F.length(F.translate(f, "+-*/", "")))), F.lit(0))
    one = lambda *names: F.coalesce(F.arrays_overlap(a, F.array(*[F.lit(n) for n in names])), F.lit(False))
    return (
        F.when(ops >= 2, "multi_op_formula")
        .when(one("div", "sum", "diff", "average", "range"), "arithmetic_agg")
        .when(one("pair-argmax", "pair-argmin", "topk-argmax", "topk-argmin", "kth-argmax"), "pair_or_topk_arg")
        .when(one("argmax", "argmin", "max", "min"), "single_arg")
        .when(one("greater_than", "less_than", "opposite", "counta"), "comparison_or_count")
        .when(ops == 1, "single_op_formula")
        .otherwise("simple_lookup")
    )


#: Words of operations, not of headers (fixed values).
CUES = (
    "increase increased decrease decreased rise rose drop dropped grew grow change changed difference differ gap ratio fraction proportion percentage percent share "
    "sum total combined average mean range spread times more less fewer higher lower greater smaller larger highest lowest largest smallest maximum minimum most "
    "least biggest best worst peak top bottom compared than versus vs exceed exceeded above below count number how many much what which who where when value amount rate"
).split()
#: Words that carry no content (fixed values).
STOP = (
    "a an the of in on at for to from by with and or is was were be been are as it this that do does did has have had then into their there these those they them its his her our we "
    "but not all any each per out over about also between among within across during while whose whom"
).split()


def terms(question) -> Column:
    """Tokens that may be header text, once each, in order; years stay."""
    year = lambda t: t.rlike(r"^(1[89]\d{2}|20\d{2})$")
    return F.array_distinct(F.filter(tx.header_tokens(question), lambda t: year(t) | (~t.isin(*CUES, *STOP) & (F.length(t) >= 3))))


def expansion(question) -> Column:
    """Terms, then hints of the operation: a text that reads like header paths."""
    kind = query_type(question)
    hints = F.when(kind.isin("arithmetic_agg", "multi_op_formula"), F.array(F.lit("total"), F.lit("percent"))).when(kind == "comparison_or_count", F.array(F.lit("total"))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.array_distinct(F.concat(terms(question), hints)), " ")


def is_ratio(question) -> Column:
    return F.coalesce(_has(r"\b(percent|percentage|share|proportion|fraction|ratio|times|per\b|out of)\b", _c(question)), F.lit(False))


def is_comparison(question, aggregation=None) -> Column:
    cue = F.coalesce(_has(r"\b(times|ratio|relationship|for every|per\b|compared)\b", _c(question)) | _has(r"\b(vs\.?|versus|between)\b", _c(question)), F.lit(False))
    return cue if aggregation is None else cue | F.coalesce(_c(aggregation).isin("diff", "div", "range", "opposite"), F.lit(False))


def with_totals(question, ratio_only: bool = False) -> Column:
    """The rewriting baseline: total words after the question."""
    more = F.concat(_c(question), F.lit(" total overall"))
    return F.when(is_ratio(question), more).otherwise(_c(question)) if ratio_only else more


#: Comparison patterns, the first that gives two spans counts (fixed values).
SPLITS = (
    r"(?i)\bbetween\s+(.+?)\s+and\s+(.+?)(?:\?|$)",
    r"(?i)(.+?)\s+(?:vs\.?|versus)\s+(.+?)(?:\?|$)",
    r"(?i)(.+?)\s+compared\s+(?:to|with)\s+(.+?)(?:\?|$)",
    r"(?i)(.+?)\s+(?:more|less|higher|lower|greater)\s+.*?\bthan\s+(.+?)(?:\?|$)",
    r"(?i)(.+?)\s+(?:for every|per|to)\s+(.+?)(?:\?|$)",
)


def compared_spans(question) -> Column:
    """The two entities that a question compares, or the question alone."""
    q, out = _c(question), None
    for p in map(tx.ascii_pattern, SPLITS):
        a, b = tx.clean_span(F.regexp_extract(q, p, 1)), tx.clean_span(F.regexp_extract(q, p, 2))
        ok = q.rlike(p) & (a != "") & (b != "") & (F.lower(a) != F.lower(b))
        out = F.when(ok, F.array(a, b)) if out is None else out.when(ok, F.array(a, b))
    return out.otherwise(F.array(q))


def path_ranking(questions: DataFrame, paths: DataFrame, n: int, by: str = "store") -> DataFrame:
    """(query_id, path, score): the n paths of a question's table that are most like its terms.

    questions: (query_id, table_id, question), one row for each; paths: (table_id,
    path: array), distinct.  Only pairs that can be among the n best are compared.
    """
    asked = questions.select("query_id", "table_id", terms("question").alias("terms"))
    some = likeness.scored(asked, paths, n, by).withColumn("key", F.array_join("path", " > "))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "key")
    return some.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("query_id", "table_id", "path", "score", "rank")


def resolved(questions: DataFrame, cells: DataFrame, cols: int = 3, rows: int = 4) -> DataFrame:
    """(query_id, col_paths, row_paths): existing header paths that a question refers to."""

    def axis(path: str, n: int, name: str):
        distinct = cells.filter(F.size(path) > 0).select("table_id", F.col(path).alias("path")).distinct()
        best = path_ranking(questions, distinct, n)
        return best.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias(name))

    none = F.array().cast("array<array<string>>")
    both = questions.select("query_id").join(axis("col_path", cols, "col_paths"), "query_id", "left").join(axis("row_path", rows, "row_paths"), "query_id", "left")
    return both.select("query_id", F.coalesce("col_paths", none).alias("col_paths"), F.coalesce("row_paths", none).alias("row_paths"))


def validated(proposed: DataFrame, inventory: DataFrame, fallback: DataFrame, cap: int) -> DataFrame:
    """Proposed paths that exist, then the deterministic ones, without repeats, up to a cap.

    proposed and fallback: (query_id, table_id, k, path); inventory: (table_id, path).
    """
    real = proposed.join(inventory, ["table_id", "path"], "left_semi").withColumn("source", F.lit(0))
    both = real.unionByName(fallback.withColumn("source", F.lit(1)))
    first = both.groupBy("query_id", "table_id", "path").agg(F.min(F.struct("source", "k")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at", "path")
    return first.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= cap).select("query_id", "table_id", "path", "k")


def decomposed(resolved_paths: DataFrame, rows: int = 2, cols: int = 2) -> DataFrame:
    """Operands of a question: its first row paths by its first column paths, either alone if the other is missing."""
    some = lambda c, n: F.when(F.size(c) > 0, F.slice(c, 1, n)).otherwise(F.array(F.array().cast("array<string>")))
    r = resolved_paths.select("query_id", F.explode(some("row_paths", rows)).alias("row_path"), "col_paths")
    both = r.select("query_id", "row_path", F.explode(some("col_paths", cols)).alias("col_path"))
    return both.withColumn("path", F.concat("row_path", "col_path")).filter(F.size("path") > 0).dropDuplicates(["query_id", "path"])


def match_accuracy(ranked_paths: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of the gold paths among as many top paths: ranked (query_id, path, rank), gold (query_id, path)."""
    budget = gold.distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    hit = gold.distinct().join(ranked_paths, ["query_id", "path"]).join(budget, "query_id").filter(F.col("rank") <= F.col("n"))
    return budget.join(hit.groupBy("query_id").agg(F.count("*").alias("h")), "query_id", "left").select("query_id", (F.coalesce("h", F.lit(0)) / F.col("n")).alias("accuracy"))


def linked_operands(links: DataFrame) -> DataFrame:
    """(query_id, tops: array, lefts: array of leaf headers) -> a path for each pair, or for the one axis there is."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit("")))
    return links.select("query_id", F.explode(some("lefts")).alias("l"), "tops").select("query_id", "l", F.explode(some("tops")).alias("t")).select("query_id", F.filter(F.array("l", "t"), lambda s: s != "").alias("path")).filter(F.size("path") > 0).distinct()


def confidence(questions: DataFrame, operands: DataFrame) -> DataFrame:
    """(query_id, confidence): how well a question's terms match the paths of its decomposed operands, on average.

    operands: (query_id, row_path, col_path).  Of each operand the better of its
    two paths counts.  Questions without operands or terms have no confidence.
    """
    asked = questions.select("query_id", F.array_join(terms("question"), " ").alias("said"))
    like = lambda p: F.when(F.size(p) > 0, store_similarity("said", p)).otherwise(0.0)
    scored = operands.select("query_id", "row_path", "col_path").join(asked, "query_id").withColumn("s", F.greatest(like("row_path"), like("col_path")))
    mean = scored.groupBy("query_id").agg(F.avg("s").alias("s"))
    return questions.select("query_id").distinct().join(mean, "query_id", "left").select("query_id", F.coalesce("s", F.lit(0.0)).alias("confidence"))
