"""Arithmetic plans over cells: expressions as steps that columns fold, cell resolution, votes."""

from __future__ import annotations

import ast
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions.udfs import store_similarity

_FIELDS = {"op": T.StringType(), "value": T.DoubleType(), "name": T.StringType(), "n": T.IntegerType()}
#: A parsed expression: steps over a stack (null outside the grammar) and the names in it.
PARSED = T.StructType([T.StructField("steps", T.ArrayType(T.StructType([T.StructField(k, t) for k, t in _FIELDS.items()]))), T.StructField("names", T.ArrayType(T.StringType()))])
BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Pow: "**"}
#: Functions of the grammar with the numbers of arguments that they take.
CALLS = {"max": range(1, 99), "min": range(1, 99), "sum": range(1, 99), "abs": (1,), "int": (1,), "round": (1, 2)}


@lru_cache(1 << 14)
def parsed(text: str) -> tuple[list[dict] | None, list[str]]:
    """Steps and names of an expression.

    Grammar: numbers, names, ``+ - * / **``, unary signs and the functions max,
    min, abs, int, round and sum.  Nothing is ever executed.
    """
    steps: list[dict] = []
    step = lambda op, n=0, value=None, name=None: steps.append({"op": op, "value": value, "name": name, "n": n})

    def walk(node) -> None:
        match node:
            case ast.Constant(value=v) if isinstance(v, (int, float)) and not isinstance(v, bool):
                step("number", value=float(v))
            case ast.Name(id=name):
                step("name", name=name)
            case ast.UnaryOp(op=ast.USub() | ast.UAdd() as sign, operand=x):
                walk(x)
                if isinstance(sign, ast.USub):
                    step("neg", 1)
            case ast.BinOp(left=x, op=op, right=y) if type(op) in BINARY:
                walk(x)
                walk(y)
                step(BINARY[type(op)], 2)
            case ast.Call(func=ast.Name(id=f), args=xs, keywords=[]) if len(xs) in CALLS.get(f, ()):
                for x in xs:
                    walk(x)
                step(f, len(xs))
            case _:
                raise SyntaxError(f"{type(node).__name__} is not part of the grammar")

    try:
        walk(ast.parse(text.strip(), mode="eval").body)
    except (SyntaxError, ValueError, OverflowError, RecursionError, MemoryError):
        return None, []
    return steps, sorted({x["name"] for x in steps if x["op"] == "name"})


@pandas_udf(PARSED)
def steps_of(expression: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parsed(e or "") for e in expression], columns=["steps", "names"])


def folded(steps: Column, env: Column) -> Column:
    """The value of steps with names from a map; null where one is null or a division is by zero."""

    def apply(stack, x):
        args = F.slice(stack, F.size(stack) - x["n"] + 1, x["n"])
        a, b = F.get(args, 0), F.get(args, 1)
        scale = F.pow(F.lit(10.0), F.coalesce(b, F.lit(0.0)))
        by_op = {
            "name": F.try_element_at(env, x["name"]), "neg": -a, "+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b), "**": F.pow(a, b), "abs": F.abs(a),
            "int": a.try_cast("long").cast("double"), "round": F.rint(a * scale) / scale, "max": F.array_max(args), "min": F.array_min(args),
            "sum": F.aggregate(args, F.lit(0.0), lambda t, v: t + v),
        }
        value = x["value"]
        for op, result in by_op.items():
            value = F.when(x["op"] == op, result).otherwise(value)
        return F.concat(F.slice(stack, 1, F.size(stack) - x["n"]), F.array(value))

    return F.get(F.aggregate(steps, F.array().cast("array<double>"), apply), 0)


def resolve(pairs: DataFrame, cells: DataFrame, least: float = 0.4) -> DataFrame:
    """(pair columns..., r, c, value): the cell that a pair of headers names.

    pairs: (query_id, table_id, var, row_header, col_header).  A header matches
    lines by its words; of several, the one with the longest path, then the
    first.  Where none matches, the most similar line does, from a threshold on.
    A blank header stands for every line.
    """

    def axis(header: str, at: str, path: str, out: str):
        lines = cells.select("table_id", F.col(at).alias("at"), F.col(path).alias("path")).distinct()
        pair = pairs.select("query_id", "table_id", "var", header).join(lines, "table_id")
        blank = F.trim(F.coalesce(header, F.lit(""))) == ""
        exact = F.when(blank | tx.path_matches(header, "path"), F.aggregate(F.transform("path", F.length), F.lit(0), lambda a, x: a + x))
        any_exact = F.max(exact.isNotNull()).over(Window.partitionBy("query_id", "var"))
        t = pair.withColumn("long", exact).withColumn("found", any_exact)
        near = t.filter("not found").withColumn("like", store_similarity(header, "path")).filter(F.col("like") >= least)
        both = t.filter("long is not null").withColumn("like", F.lit(1.0)).unionByName(near)
        w = Window.partitionBy("query_id", "var").orderBy(F.col("long").desc_nulls_last(), F.col("like").desc(), "at")
        return both.withColumn("k", F.row_number().over(w)).filter("k = 1").select("query_id", "var", F.col("at").alias(out))

    r, c = axis("row_header", "r", "row_path", "r"), axis("col_header", "c", "col_path", "c")
    t = pairs.join(r, ["query_id", "var"], "left").join(c, ["query_id", "var"], "left")
    return t.join(cells.select("table_id", "r", "c", F.col("num").alias("value"), "raw"), ["table_id", "r", "c"], "left")


def evaluate(plans: DataFrame, resolved: DataFrame) -> DataFrame:
    """(query_id, expression, value, error) of plans (query_id, expression) over resolved variables.

    Each batch's distinct expressions are parsed once; values are a fold over
    their steps.  An expression outside the grammar is an error of its plans.
    """
    env = resolved.groupBy("query_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("var", "value")))).alias("env"),
        F.min(F.when(F.col("r").isNull() | F.col("c").isNull(), F.col("var"))).alias("lost"),
        F.min(F.when(F.col("r").isNotNull() & F.col("value").isNull(), F.col("var"))).alias("text"),
    )
    t = plans.withColumn("parsed", steps_of("expression")).join(env, "query_id", "left").withColumn("value", folded(F.col("parsed.steps"), F.col("env")))
    undefined = F.exists("parsed.names", lambda n: ~F.map_contains_key("env", n))
    error = F.when(F.col("parsed.steps").isNull(), "grammar").when(undefined, "undefined").when(F.col("value").isNull(), "division")
    none = (F.coalesce("expression", F.lit("")) == "") | F.col("env").isNull()
    code = (
        F.when(none, "empty_or_unparsed_plan")
        .when(F.col("lost").isNotNull(), F.concat(F.lit("unresolved_cell:"), F.col("lost")))
        .when(F.col("text").isNotNull(), F.concat(F.lit("non_numeric_cell:"), F.col("text")))
        .when(error.isNotNull(), F.concat(F.lit("eval_error:"), error))
    )
    return t.select("query_id", "expression", F.when(code.isNull(), F.col("value")).alias("value"), code.alias("error"))


#: The one line of code that an answer may hold instead of a number (fixed value).
CODE_LINE = r"(?s)^\s*(?:```(?:python)?\s*)?(?:(?:result|answer)\s*=\s*)?(?:print\s*\(\s*)?(.+?)(?:\s*\)\s*)?(?:```\s*)?$"


def guarded(code) -> Column:
    """The value of a line of generated code, if it is arithmetic of numbers: nothing is executed, all else is null."""
    code = F.col(code) if isinstance(code, str) else code
    whole, inner = steps_of(code), steps_of(F.regexp_extract(code, CODE_LINE, 1))
    none = F.create_map().cast("map<string, double>")
    return F.coalesce(*[F.when(F.size(p["names"]) == 0, folded(p["steps"], none)) for p in (whole, inner)])


def adopted_plan(phases: DataFrame) -> DataFrame:
    """Two-phase extraction: (query_id, expression, cells, complete) of what a model gave.

    phases: (query_id, skeleton: the model's JSON with an expression and the
    variables it needs, cells: its JSON from variables to header pairs).  A plan
    counts as parsed only if every variable has a pair.
    """
    need = F.from_json(tx.outer_json("skeleton"), "expression string, variables array<string>")
    got = F.from_json(tx.outer_json("cells"), "map<string, struct<row_header: string, col_header: string>>")
    t = phases.select("query_id", need.alias("need"), F.coalesce(got, F.create_map().cast("map<string, struct<row_header: string, col_header: string>>")).alias("got"))
    names = F.coalesce("need.variables", F.array().cast("array<string>"))
    pair = lambda v: F.try_element_at("got", v)
    cells = F.transform(F.filter(names, lambda v: pair(v).isNotNull()), lambda v: F.struct(v.alias("var"), pair(v)["row_header"].alias("row_header"), pair(v)["col_header"].alias("col_header")))
    complete = (F.coalesce(F.trim("need.expression"), F.lit("")) != "") & (F.size(names) > 0) & F.forall(names, lambda v: pair(v).isNotNull())
    return t.select("query_id", F.col("need.expression").alias("expression"), cells.alias("cells"), complete.alias("complete"))


def adopted(ok, expression, n_cells, kind) -> Column:
    """Whether a symbolic answer replaces the reader's: two operators, or one over two cells of an arithmetic question."""
    ops = F.length(expression) - F.length(F.translate(expression, "+-*/", ""))
    return F.col(ok) & ((ops >= 2) | ((F.col(kind) == "arithmetic_agg") & (ops >= 1) & (F.col(n_cells) >= 2)))


def traced_lookup(asked: DataFrame, cells: DataFrame) -> DataFrame:
    """(query_id, table_id, row_header, col_header) -> value and flag: NO_MATCH, EMPTY or none."""
    got = resolve(asked.withColumn("var", F.concat_ws("|", "row_header", "col_header")), cells, least=2.0)
    flag = F.when(F.col("r").isNull() | F.col("c").isNull(), "NO_MATCH").when(F.col("value").isNull(), "EMPTY")
    return got.select("query_id", "row_header", "col_header", "value", flag.alias("flag"))


def needs_repair(result, error, flags) -> Column:
    return F.col(error).isNotNull() | F.col(result).isNull() | (F.trim(F.col(result).cast("string")) == "") | F.exists(flags, lambda f: f.isNotNull())


def vote(samples: DataFrame, floor_weight: float = 1.6, clean: float = 1.0, dirty: float = 0.6, plain: bool = False) -> DataFrame:
    """(query_id, answer): votes of answers that agree within 2 %, sign aside, around a floor.

    samples: (query_id, k, pred, clean), k 0 is the floor.  The floor stays
    unless another group has strictly more weight.  plain: equal weights, no
    floor.  Groups form in order, so each query's few samples are folded once.
    """
    # a sample's number and text are read once, not at each comparison
    read = lambda p: F.struct(p.alias("rep"), F.get(tx.numbers(p), 0).alias("x"), F.lower(F.trim(p)).alias("t"))

    def same(a, b):
        x, y = a["x"], b["x"]
        d = 0.02 * F.greatest(F.abs(y), F.lit(1e-9))
        return F.coalesce((F.abs(x - y) <= d) | (F.abs(F.abs(x) - F.abs(y)) <= d), a["t"] == b["t"])

    weight = F.lit(1.0) if plain else F.when(F.col("k") == 0, floor_weight).when(F.col("clean"), clean).otherwise(dirty)
    ok = F.col("pred").isNotNull() & ~F.col("pred").isin("", "None")
    g = samples.withColumn("read", read(F.col("pred"))).groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(ok, F.struct("k", "pred", weight.alias("w"), F.col("read").alias("p"))))).alias("s"), F.max(F.when(F.col("k") == 0, F.col("pred"))).alias("floor"))

    def add(groups, x):
        at = F.array_min(F.filter(F.transform(groups, lambda g, i: F.when(same(x["p"], g["p"]), i)), lambda i: i.isNotNull()))
        grown = F.transform(groups, lambda g, i: F.struct(g["p"].alias("p"), (g["w"] + F.when(i == at, x["w"]).otherwise(0.0)).alias("w")))
        return F.when(at.isNull(), F.concat(groups, F.array(F.struct(x["p"].alias("p"), x["w"].cast("double").alias("w"))))).otherwise(grown)

    groups = F.aggregate("s", F.array().cast("array<struct<p: struct<rep: string, x: double, t: string>, w: double>>"), add)
    top = lambda gs: F.aggregate(gs, F.get(gs, 0), lambda a, x: F.when(x["w"] > a["w"], x).otherwise(a))
    t = g.select("query_id", "floor", read(F.col("floor")).alias("own"), groups.alias("gs"))
    best = top(F.col("gs"))
    own = F.get(F.filter("gs", lambda x: same(F.col("own"), x["p"])), 0)["w"]
    answer = best["p"]["rep"] if plain else F.when(own.isNotNull() & (best["w"] <= own + 1e-9), F.col("floor")).otherwise(best["p"]["rep"])
    return t.select("query_id", F.when(F.size("gs") == 0, F.lit("") if plain else F.col("floor")).otherwise(answer).alias("answer"))
