"""Retrieval and answer metrics.  The two families are never mixed in one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

KS = (10, 20, 50)


def _hit(k: int) -> Column:
    return F.coalesce(F.col("rank") <= k, F.lit(False))


def per_query(ranks: DataFrame, ks: tuple[int, ...] = KS, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Of each query with its gold ranks (null: not retrieved), at every k in one pass.

    set_recall (all gold within k), coverage (share), hit (any), ndcg, and rr.
    """
    gain = 1.0 / (F.log(F.col("rank") + 1.0) / F.log(F.lit(2.0)))
    ideal = lambda n, k: F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n.cast("int"), F.lit(k)), F.lit(1))), F.lit(0.0), lambda a, i: a + F.log(F.lit(2.0)) / F.log(i + 1.0))
    aggs = [F.count("*").alias("m"), F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("rr")]
    for k in ks:
        h = _hit(k)
        aggs += [F.min(h.cast("int")).alias(f"set_recall_{k}"), F.avg(h.cast("int")).alias(f"coverage_{k}"), F.max(h.cast("int")).alias(f"hit_{k}"), F.sum(F.when(h, gain).otherwise(0.0)).alias(f"dcg_{k}")]
    t = ranks.groupBy(*by).agg(*aggs)
    return t.select(*by, "m", "rr", *[c for k in ks for c in (f"set_recall_{k}", f"coverage_{k}", f"hit_{k}")], *[(F.col(f"dcg_{k}") / ideal(F.col("m"), k)).alias(f"ndcg_{k}") for k in ks])


def summary(queries: DataFrame, ks: tuple[int, ...] = KS, by: tuple[str, ...] = ()) -> DataFrame:
    """Means over queries: n, set recall, coverage, partially covered, hit, ndcg and mrr."""
    aggs = [F.count("*").alias("n_queries"), F.round(F.avg("rr"), 4).alias("mrr")]
    for k in ks:
        aggs += [
            F.round(F.avg(f"set_recall_{k}"), 4).alias(f"set_recall_{k}"),
            F.round(F.avg(f"coverage_{k}"), 4).alias(f"coverage_{k}"),
            F.count_if((F.col(f"set_recall_{k}") == 0) & (F.col(f"coverage_{k}") > 0)).alias(f"n_partial_{k}"),
            F.round(F.avg(f"hit_{k}"), 4).alias(f"hit_{k}"),
            F.round(F.avg(f"ndcg_{k}"), 4).alias(f"ndcg_{k}"),
        ]
    return (queries.groupBy(*by) if by else queries).agg(*aggs)


def completeness(gold: DataFrame, retrieved: DataFrame, keys: tuple[str, ...] = ("query_id", "r", "c")) -> DataFrame:
    """(query_id, m, osc, recall): whether all gold cells are retrieved, and the share that is."""
    known = retrieved.select(*keys, F.lit(0).alias("gold"), F.lit(1).alias("hit")).dropna(subset=list(keys))
    # cells of both sides meet in groups: sides that are dealt out by query already stay where they are, which a join by all keys would undo
    cell = gold.select(*keys, F.lit(1).alias("gold"), F.lit(0).alias("hit")).unionByName(known).groupBy(*keys).agg(F.max("gold").alias("gold"), F.max("hit").alias("hit"))
    return cell.filter("gold = 1").groupBy("query_id").agg(F.count("*").alias("m"), F.min("hit").alias("osc"), F.avg("hit").alias("recall"))


def scope_bin(m) -> Column:
    m = F.col(m) if isinstance(m, str) else m
    return F.when(m <= 1, "1").when(m == 2, "2").when(m <= 4, "3-4").when(m <= 8, "5-8").otherwise("9+")


def depth_bin(d) -> Column:
    d = F.col(d) if isinstance(d, str) else d
    return F.when(d <= 1, "flat(d<=1)").when(d == 2, "d2").otherwise("d3+")


def stratified(records: DataFrame, dims: tuple[str, ...] = ("scope", "depth", "aggregation")) -> DataFrame:
    """Overall and by each dimension alone, in one pass: (dimension, value, n, osc, recall)."""
    sets = [[], *[[d] for d in dims]]
    g = records.groupingSets([[F.col(c) for c in s] for s in sets], *dims).agg(F.count("*").alias("n"), F.avg("osc").alias("osc"), F.avg("recall").alias("recall"), *[F.grouping(d).alias(f"g_{d}") for d in dims])
    name, value = F.lit("overall"), F.lit("all")
    for d in dims:
        name, value = F.when(F.col(f"g_{d}") == 0, d).otherwise(name), F.when(F.col(f"g_{d}") == 0, F.col(d)).otherwise(value)
    return g.select(name.alias("dimension"), value.alias("value"), "n", "osc", "recall")


def by_group(records: DataFrame, key: str) -> DataFrame:
    return records.groupBy(key).agg(F.count("*").alias("n"), F.avg("osc").alias("osc"), F.avg("recall").alias("recall"))


def macro(values: DataFrame, column: str) -> DataFrame:
    return values.agg(F.coalesce(F.avg(column), F.lit(0.0)).alias("macro"))


def strata_medians(ranks: DataFrame, k: int = 50) -> DataFrame:
    """Operands by whether their label collides: (colliding, n, median_rank, reached)."""
    return ranks.groupBy("colliding").agg(F.count("*").alias("n"), F.median("rank").alias("median_rank"), F.avg(_hit(k).cast("int")).alias("reached"))


def gain_decomposition(base: DataFrame, treat: DataFrame, k: int = 50) -> DataFrame:
    """What a treatment gains and loses, and whether the baseline lacked cells or ranked them too low.

    Both have (query_id, cell, rank) over the same queries and cells.
    """
    pair = base.select("query_id", "cell", F.col("rank").alias("b")).join(treat.select("query_id", "cell", F.col("rank").alias("t")), ["query_id", "cell"], "full")
    ok = lambda c: F.min(F.coalesce(F.col(c) <= k, F.lit(False)).cast("int"))
    q = pair.groupBy("query_id").agg(F.count("*").alias("m"), ok("b").alias("cb"), ok("t").alias("ct"), F.min(F.col("b").isNotNull().cast("int")).alias("pool"), F.count_if(F.col("b").isNull()).alias("absent"), F.count_if(F.col("b") > k).alias("low"))
    gain = (F.col("ct") == 1) & (F.col("cb") == 0)
    n = F.count("*")
    return q.agg(
        n.alias("n_queries"),
        F.sum("cb").alias("base_covered"),
        F.sum("ct").alias("treat_covered"),
        F.count_if(gain).alias("gain"),
        F.count_if((F.col("ct") == 0) & (F.col("cb") == 1)).alias("loss"),
        F.count_if(gain & (F.col("pool") == 0)).alias("gain_pool_limited"),
        F.count_if(gain & (F.col("pool") == 1)).alias("gain_rank_limited"),
        F.coalesce(F.sum(F.when(gain, F.col("absent"))), F.lit(0)).alias("cells_missing"),
        F.coalesce(F.sum(F.when(gain, F.col("low"))), F.lit(0)).alias("cells_ranked_out"),
        F.round(F.count_if((F.col("pool") == 1) & (F.col("m") <= k)) / n, 4).alias("oracle_base"),
    )


def predicted_decay(records: DataFrame) -> DataFrame:
    """Observed completeness by scope size against recall to the power of the size: (m, n, osc, predicted)."""
    r = records.agg((F.sum(F.col("recall") * F.col("m")) / F.sum("m")).alias("r"))
    return records.groupBy("m").agg(F.count("*").alias("n"), F.avg("osc").alias("osc")).crossJoin(F.broadcast(r)).select("m", "n", "osc", F.pow("r", "m").alias("predicted"))  # one row


def table_ranks(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10), by: tuple[str, ...] = (), ndcg: int = 10) -> DataFrame:
    """One gold table a query: recall at k, mrr, and ndcg at one k (its ideal is 1)."""
    aggs = [F.count("*").alias("n"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 4).alias("mrr")]
    aggs += [F.round(F.avg(_hit(k).cast("int")), 4).alias(f"recall_{k}") for k in ks]
    aggs.append(F.round(F.avg(F.when(_hit(ndcg), F.log(F.lit(2.0)) / F.log(F.col("rank") + 1.0)).otherwise(0.0)), 4).alias(f"ndcg_{ndcg}"))
    return (ranks.groupBy(*by) if by else ranks).agg(*aggs)


def omission(gold: DataFrame, hits: DataFrame, table_rank: DataFrame, k: int) -> DataFrame:
    """Gold cells missed though the gold table is within k: (n_queries, miss_rate, any_miss)."""
    from .linking import operand_recall

    q = operand_recall(gold, hits).join(table_rank.filter(F.col("rank") <= k).select("query_id"), "query_id")
    return q.agg(F.count("*").alias("n_queries"), F.avg(1 - F.col("recall")).alias("miss_rate"), F.avg((F.col("recall") < 1).cast("int")).alias("any_miss"))


# ---- answers --------------------------------------------------------------------


def numeric_match(pred, gold, tolerance: float = 0.02) -> Column:
    """Every gold number is near some number of the prediction, as is, times or over 100, or by magnitude.

    A gold without numbers must occur in the prediction.  gold: array of texts.
    """
    pred, gold = (F.col(x) if isinstance(x, str) else x for x in (pred, gold))
    p = F.lower(F.trim(pred))
    ps = tx.numbers(p)
    gs = F.flatten(F.transform(gold, tx.numbers))
    forms = lambda x: F.array(F.round(x, 2), F.round(x * 100, 2), F.round(x / 100, 4), F.round(F.abs(x), 2))
    near = lambda a, b: (a == b) | (F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-9)) < tolerance)
    every = F.flatten(F.transform(ps, forms))
    numbers = F.forall(gs, lambda g: F.exists(forms(g), lambda c: F.exists(every, lambda x: near(x, c))))
    words = F.exists(gold, lambda g: (F.trim(g) != "") & F.contains(p, F.lower(F.trim(g))))
    return F.coalesce((p != "") & F.when(F.size(gs) > 0, numbers).otherwise(words), F.lit(False))


def exact_match(pred, gold) -> Column:
    pred, gold = (F.col(x) if isinstance(x, str) else x for x in (pred, gold))
    return F.exists(gold, lambda g: F.lower(F.trim(g)) == F.lower(F.trim(F.coalesce(pred, F.lit("")))))


def official_match(pred, gold) -> Column:
    """The benchmark's own scorer: numbers to 1e-5, texts in lower case; lists element by element (arrays of texts)."""
    pred, gold = (F.col(x) if isinstance(x, str) else x for x in (pred, gold))

    def side(a):
        return F.arrays_zip(F.transform(a, tx.tabulated_number).alias("n"), F.transform(a, lambda s: F.lower(F.trim(s))).alias("t"))

    one = lambda a, b: F.when(a["n"].isNotNull() & b["n"].isNotNull(), F.abs(a["n"] - b["n"]) < 1e-5).otherwise(a["n"].isNull() & b["n"].isNull() & (a["t"] == b["t"]))
    return F.coalesce((F.size(pred) == F.size(gold)) & F.forall(F.zip_with(side(pred), side(gold), one), lambda x: x), F.lit(False))


def official_match_text(pred, gold) -> Column:
    """:func:`official_match` of single answers, with the scorer's full text normalisation."""
    from ..functions.udfs import answer_text_udf

    pred, gold = (F.col(x) if isinstance(x, str) else x for x in (pred, gold))
    a, b = tx.tabulated_number(pred), tx.tabulated_number(gold)
    words = answer_text_udf(F.lower(F.trim(pred))) == answer_text_udf(F.lower(F.trim(gold)))
    return F.coalesce(F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) < 1e-5).otherwise(a.isNull() & b.isNull() & words), F.lit(False))


def percent_match(pred, gold, tolerance: float = 1e-5) -> Column:
    """Equality without percent signs and commas, to a relative tolerance; texts exactly."""
    pred, gold = (F.col(x) if isinstance(x, str) else x for x in (pred, gold))
    number = lambda s: tx.number_strict(F.regexp_replace(F.trim(s), "%+$", ""))
    g, p = number(gold), number(pred)
    return F.coalesce(F.when(g.isNull(), F.lower(F.trim(pred)) == F.lower(F.trim(gold))).otherwise(F.abs(p - g) <= tolerance * F.greatest(F.abs(g), F.lit(1e-9))), F.lit(False))


def answer_bucket(pred, gold) -> Column:
    p = F.col(pred) if isinstance(pred, str) else pred
    return F.when(numeric_match(pred, gold), "correct").when(F.size(tx.numbers(p)) > 0, "silent_wrong").otherwise("non_number")


def failure_mode(pred, gold) -> Column:
    """correct, abstain, aggregation_failure, wrong_cell, off_by_small_factor or text_mismatch."""
    p, g = (F.col(x) if isinstance(x, str) else x for x in (pred, gold))
    ps, gs = tx.numbers(F.coalesce(p, F.lit(""))), F.flatten(F.transform(g, tx.numbers))
    first = F.get(gs, 0)
    near = F.aggregate(ps, F.get(ps, 0), lambda a, x: F.when(F.abs(x - first) < F.abs(a - first), x).otherwise(a))
    big = lambda x: F.greatest(F.abs(x), F.lit(1e-9))
    ratio = F.greatest(F.abs(first), F.abs(near)) / F.least(big(first), big(near))
    return (
        F.when(numeric_match(p, g, 0.01), "correct")
        .when((F.size(gs) > 0) & (F.size(ps) == 0), "abstain")
        .when((F.size(gs) > 1) & (F.size(ps) < F.size(gs)), "aggregation_failure")
        .when((F.size(gs) > 0) & (first == 0), "off_by_small_factor")
        .when((F.size(gs) > 0) & (ratio > 10), "wrong_cell")
        .when(F.size(gs) > 0, "off_by_small_factor")
        .otherwise("text_mismatch")
    )


def rescored(answers: DataFrame, tolerances: tuple[float, ...] = (0.0, 0.01, 0.02, 0.05), by: str = "bucket") -> DataFrame:
    """Accuracy for each tolerance and bucket: answers (bucket, pred, gold: array)."""
    t = answers.select(by, *[numeric_match("pred", "gold", x if x else 1e-12).alias(f"a{i}") for i, x in enumerate(tolerances)])
    long = t.select(by, F.explode(F.array(*[F.struct(F.lit(x).alias("tolerance"), F.col(f"a{i}").cast("int").alias("ok")) for i, x in enumerate(tolerances)])).alias("x"))
    return long.groupBy(by, "x.tolerance").agg(F.count("*").alias("n"), F.avg("x.ok").alias("accuracy"))


def confusion(pairs: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    return pairs.groupBy(gold, pred).agg(F.count("*").alias("n"))


def class_counters(rows: DataFrame, by: str, flags: list[str]) -> DataFrame:
    """Counts of flags by class and overall (class null)."""
    return rows.rollup(by).agg(F.count("*").alias("n"), *[F.count_if(F.col(f)).alias(f) for f in flags])


def condition_summary(rows: DataFrame, by: str) -> DataFrame:
    """Accuracy and lookup trouble of answers (correct, no_match, empty, failed) by condition; failed calls don't count."""
    t = rows.filter(~F.col("failed"))
    clean = ~F.col("no_match") & ~F.col("empty")
    share = lambda c: F.avg(c.cast("int"))
    return t.groupBy(by).agg(F.count("*").alias("n"), share(F.col("correct")).alias("accuracy"), share(F.col("no_match")).alias("no_match"), share(F.col("empty")).alias("empty"), share(clean).alias("clean"), F.avg(F.when(clean, F.col("correct").cast("int"))).alias("accuracy_clean"))


def sentence_scores(produced: DataFrame, gold: DataFrame) -> DataFrame:
    """Produced against gold sentences (table_id, r, c, text): counts, precision, recall, F1."""
    p, g = produced.select("table_id", "r", "c", F.col("text").alias("p")), gold.select("table_id", "r", "c", F.col("text").alias("g"))
    t = p.join(g, ["table_id", "r", "c"], "full").agg(
        F.count("p").alias("produced"),
        F.count("g").alias("gold"),
        F.count_if(F.col("p") == F.col("g")).alias("correct"),
        F.count_if(F.col("p").isNull()).alias("dropped"),
        F.count_if(F.col("g").isNull()).alias("spurious"),
    )
    return t.select("*", F.try_divide("correct", "produced").alias("precision"), F.try_divide("correct", "gold").alias("recall"), F.try_divide(2 * F.col("correct"), F.col("produced") + F.col("gold")).alias("f1"))
