"""Ranks of gold cells, budgets, ladders, samples and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx


def gold_ranks(hits: DataFrame, gold: DataFrame, limit: int | None = None, keys: tuple[str, ...] = ("query_id", "cell")) -> DataFrame:
    """The rank of each gold cell, null if it is not among the hits (or beyond the limit)."""
    within = hits if limit is None else hits.filter(F.col("rank") <= limit)
    return gold.join(within.select(*keys, "rank"), list(keys), "left")


def competition_rank(scores: DataFrame, by: list[str], score: str = "score", base: int = 1, places: int = 6) -> DataFrame:
    """Optimistic rank: one more than how many are strictly better."""
    w = Window.partitionBy(*by).orderBy(F.round(score, places).desc())
    return scores.withColumn("rank", F.rank().over(w) + F.lit(base - 1))


def packed(chunks: DataFrame, budget: int, by: list[str], order: str, tokens: Column | None = None) -> DataFrame:
    """The longest prefix of chunks within a token budget; the first is always kept."""
    cost = tokens if tokens is not None else tx.estimated_tokens("text")
    w = Window.partitionBy(*by).orderBy(order)
    used = F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    t = chunks.withColumn("tokens", cost).withColumn("used", used).withColumn("place", F.row_number().over(w))
    return t.filter((F.col("used") <= budget) | (F.col("place") == 1)).drop("place")


def context(chunks: DataFrame, by: list[str], order: str, tokens: int = 4096) -> DataFrame:
    """Texts joined within a budget of four characters a token: (by..., context, truncated)."""
    w = Window.partitionBy(*by).orderBy(order)
    place = F.row_number().over(w)
    # a chunk needs its own length beside the lengths before it, each with a line break
    used = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + place - 1
    t = chunks.withColumn("place", place).withColumn("fits", (used <= tokens * 4) | (F.col("place") == 1))
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("place", "text")))), lambda x: x["text"])
    return t.groupBy(*by).agg(F.array_join(kept, "\n").alias("context"), (F.count_if("fits") < F.count("*")).alias("truncated"))


def budget_points(points: DataFrame, budgets: DataFrame, value: str, by: list[str]) -> DataFrame:
    """For each budget the value at the largest k whose tokens fit it.

    points: (by..., k, tokens, value); budgets: (budget), a short list.
    """
    fit = points.join(F.broadcast(budgets), points["tokens"] <= budgets["budget"])
    return fit.groupBy(*by, "budget").agg(F.max_by(value, "k").alias(value), F.max("k").alias("k"))


def first_complete_rung(found: DataFrame, gold: DataFrame) -> DataFrame:
    """The first rung of a ladder of cumulative sets that holds all gold cells, null if none.

    found: (query_id, cell, rung) where a cell first appears; gold: (query_id, cell).
    """
    first = found.groupBy("query_id", "cell").agg(F.min("rung").alias("rung"))
    g = gold.join(first, ["query_id", "cell"], "left").groupBy("query_id")
    return g.agg(F.when(F.count("*") == F.count("rung"), F.max("rung")).alias("rung"))


def policy(ladder: DataFrame, chosen: DataFrame) -> DataFrame:
    """Mean and median size and completeness of the rungs that a policy chooses.

    ladder: (query_id, rung, n_cells, complete); chosen: (query_id, rung).
    """
    t = ladder.join(chosen, ["query_id", "rung"])
    return t.agg(F.avg("n_cells").alias("mean_cells"), F.median("n_cells").alias("median_cells"), F.avg(F.col("complete").cast("int")).alias("osc"), F.count("*").alias("n"))


def cheapest_complete(configs: DataFrame) -> DataFrame:
    """(query_id, config, n_cells, complete) -> the cheapest complete configuration of each query."""
    best = F.min(F.when(F.col("complete"), F.struct("n_cells", "config")))
    return configs.groupBy("query_id").agg(best.alias("b")).select("query_id", F.col("b.config").alias("config"), F.col("b.n_cells").alias("n_cells"))


def throttled(calls: DataFrame, budget: float, ts: str = "ts", tokens: str = "tokens", by: list[str] | None = None, seconds: int = 60) -> DataFrame:
    """Tokens of the trailing window at each call, and whether they are within the budget.

    Time is cut into spans as long as the window, which are added up apart from
    each other: a span begins with the tokens of the one before it, whose calls
    leave one by one as the window moves on.  So each call is added once and
    taken off once, however many the window holds.  Whole numbers are exact;
    sums of fractions are rounded as they come and go.
    """
    by, width = by or [], seconds * 1_000_000
    rows = calls.withColumns({"_at": F.unix_micros(F.col(ts).cast("timestamp")), "_n": F.col(tokens), "_some": F.col(tokens).isNotNull().cast("long")})
    rows = rows.withColumn("_span", F.col("_at") - F.pmod("_at", F.lit(width)))
    past = rows.filter("_at is not null and _some = 1").select(*by, "_at", "_n", "_some", (F.col("_span") + width).alias("_span"))
    carried = past.groupBy(*by, "_span").agg(F.sum("_n").alias("_n"), F.sum("_some").alias("_some")).withColumn("_at", F.col("_span"))
    left = past.select(*by, "_span", (F.col("_at") + width + 1).alias("_at"), (-F.col("_n")).alias("_n"), (-F.col("_some")).alias("_some"))
    moved = rows.withColumn("_call", F.lit(True)).unionByName(carried, True).unionByName(left, True)
    w = Window.partitionBy(*by, "_span").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    t = moved.withColumn("window_tokens", F.when(F.sum("_some").over(w) > 0, F.sum("_n").over(w))).filter("_call")
    return t.drop("_at", "_n", "_some", "_span", "_call").withColumn("allowed", F.col("window_tokens") <= budget)


def stratified(rows: DataFrame, by: str, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows of each class in the order of a hash."""
    w = Window.partitionBy(by).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")))
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def quotas(sizes: DataFrame, total: int, by: str = "stratum", n: str = "n") -> DataFrame:
    """Largest-remainder quotas of a total in proportion to sizes (few strata)."""
    whole = Window.partitionBy()
    exact = total * F.col(n) / F.sum(n).over(whole)
    t = sizes.withColumn("floor", F.floor(exact).cast("long")).withColumn("rest", exact - F.floor(exact))
    t = t.withColumn("left", F.lit(total) - F.sum("floor").over(whole)).withColumn("place", F.row_number().over(whole.orderBy(F.round("rest", 9).desc(), by)))
    return t.select(by, n, (F.col("floor") + (F.col("place") <= F.col("left")).cast("long")).alias("quota"))


def pending(todo: DataFrame, done: DataFrame, key: str = "query_id") -> DataFrame:
    """What a resumed run still has to do."""
    return todo.join(done.select(key), key, "left_anti")


def flips_first(questions: DataFrame, base: str, treat: str, order: str) -> DataFrame:
    """Questions with their place in a run: those that a treatment completes first, those it breaks last, in order otherwise."""
    gain = F.col(treat).cast("int") - F.col(base).cast("int")
    # three groups, each in order: their places are shifted by the sizes of those before
    own = F.row_number().over(Window.partitionBy(gain).orderBy(order))
    sizes = questions.groupBy(gain.alias("gain")).agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy(F.col("gain").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # three rows
    t = questions.withColumn("gain", gain).withColumn("own", own).join(F.broadcast(sizes.select("gain", before.alias("before"))), "gain")
    return t.withColumn("place", F.col("before") + F.col("own")).drop("own", "before")


def prefix(ranked: DataFrame, k: int) -> DataFrame:
    """The best k of a stored ranking: one made at the largest k serves all smaller ones."""
    return ranked.filter(F.col("rank") <= k)
