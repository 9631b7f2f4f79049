"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed in the cells of source, language and topic.  Raking finds a
weight for each value of the three such that the weighted tokens have the
target shares in all of them; documents are then sampled by their cell's
calibrated probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import SPACE, SPACE_RUN
from .storage import columns, drop, save, scratch

#: Cells that are raked on the driver; more are raked by Spark.
DRIVER_CELLS = 50_000
ROUNDS = 25
DIMS = ("source", "lang", "topic")


def n_tokens(text: Column) -> Column:
    """Words of a text."""
    trimmed = F.trim(F.coalesce(text.cast("string"), F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACE_RUN))).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by form, the first that applies of code, table, web, question, figures and prose; pass any Column for a finer one."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return (
        F.when(F.instr(t, "```") > 0, "code")
        .when(F.instr(t, " | ") > 0, "table")
        .when(F.instr(t, "http") > 0, "web")
        .when(F.instr(t, "?") > 0, "question")
        .when(t.rlike("[0-9]"), "figures")
        .otherwise("prose")
    )


def _targets(given, observed: dict) -> dict:
    want = {k: given.get(k, 0.0) for k in observed} if isinstance(given, dict) else {k: v**given for k, v in observed.items()}
    total = sum(want.values())
    if total <= 0:
        raise ValueError("the targets name no value that occurs")
    return {k: v / total for k, v in want.items()}


def rake(cells: DataFrame, targets: dict, rounds: int = ROUNDS, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """cells (source, lang, topic, tokens) -> the same with their weight.

    targets: for each dimension a dict of weights, or the power to which the
    observed shares are raised.  Weighted shares agree with them in the last dimension exactly and
    in the others as far as fitting has converged.  Few cells are raked on the
    driver; beyond the bound each step is an aggregation and a join.
    """
    spark = cells.sparkSession
    margin = {d: {r[0]: r[1] for r in cells.groupBy(d).agg(F.sum("tokens")).collect()} for d in DIMS} if cells.limit(driver_cells + 1).count() <= driver_cells else None
    if margin is None:
        return _rake_spark(cells, targets, rounds)
    rows = [tuple(r) for r in cells.select(*DIMS, "tokens").orderBy(*DIMS).collect()]
    total = sum(r[3] for r in rows) or 1
    want = {d: _targets(targets[d], {k: v / total for k, v in margin[d].items()}) for d in DIMS} if rows else {}
    weight = [1.0] * len(rows)
    for _ in range(rounds if rows else 0):
        for k, d in enumerate(DIMS):
            now: dict = {}
            for r, w in zip(rows, weight, strict=True):
                now[r[k]] = now.get(r[k], 0.0) + r[3] * w
            weight = [w * (want[d][r[k]] * total / now[r[k]] if now[r[k]] else 0.0) for r, w in zip(rows, weight, strict=True)]
    return spark.createDataFrame([(*r, w) for r, w in zip(rows, weight, strict=True)], "source string, lang string, topic string, tokens long, weight double")


def _rake_spark(cells: DataFrame, targets: dict, rounds: int) -> DataFrame:
    now = save(cells.select(*DIMS, "tokens", F.lit(1.0).alias("weight")), "cells")
    total = now.agg(F.sum("tokens")).first()[0] or 1
    want = {}
    for d in DIMS:
        seen = now.groupBy(d).agg((F.sum("tokens") / total).alias("share"))
        if not isinstance(targets[d], dict):
            raw = seen.withColumn("want", F.pow("share", F.lit(float(targets[d]))))
        else:
            given = now.sparkSession.createDataFrame(list(targets[d].items()), f"{d} string, want double")
            raw = seen.join(given, d, "left").fillna(0.0, ["want"])
        mass = raw.agg(F.sum("want")).first()[0]
        if mass is not None and mass <= 0:
            raise ValueError("the targets name no value that occurs")
        want[d] = save(raw.select(d, (F.col("want") / mass).alias("want")), "targets")
    for _ in range(rounds):
        for d in DIMS:
            sums = now.groupBy(d).agg(F.sum(F.col("tokens") * F.col("weight")).alias("mass")).join(want[d], d)
            factor = F.when(F.col("mass") > 0, F.col("want") * total / F.col("mass")).otherwise(0.0)
            after = now.join(sums.select(d, factor.alias("factor")), d).select(*DIMS, "tokens", (F.col("weight") * F.col("factor")).alias("weight"))
            after = save(after, "cells")
            drop(now)
            now = after
    return now


def probabilities(weighted: DataFrame, share: float) -> DataFrame:
    """Weighted cells with the probability p of keeping a document.

    p is the weight times a constant, at most 1; the constant makes the
    expected tokens the given share of all (the largest that the weights allow
    if the share can't be met).  Found by eight rounds of sixteen sums, so that
    the cells, few or many, stay where they are.
    """
    total, top, least = weighted.agg(F.sum("tokens"), F.max("weight"), F.min(F.when(F.col("weight") > 0, F.col("weight")))).first()
    if not total or not top:
        return weighted.withColumn("p", F.lit(1.0))
    low, high = 0.0, 1.0 / least
    for _ in range(8):
        grid = [low + (high - low) * (k + 1) / 16 for k in range(16)]
        got = weighted.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * s)) for s in grid]).first()
        k = next((i for i, g in enumerate(got) if g >= share * total), 15)
        low, high = grid[k - 1] if k else low, grid[k]
    return weighted.withColumn("p", F.least(F.lit(1.0), F.col("weight") * high))


def uniform(id_col: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id (of rows without one, on the text) and the seed."""
    key = F.coalesce(id_col.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix(docs: DataFrame, targets: dict | None = None, share: float = 0.75, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, cells): rows (_row: the row of docs as a struct, n_tokens, topic, p, u, kept), and the cells with their weights.

    kept: u < p.  Null sources, languages and topics are values of their own ("").
    Repeated rows share their fate.  An empty table gives no rows.  The default
    targets flatten each dimension's shares by the power 0.7.
    """
    targets = dict.fromkeys(DIMS, 0.7) | (targets or {})
    text = F.col(text_col)
    plain = docs.select(
        F.struct(*columns(docs)).alias("_row"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce((topic if topic is not None else topic_of(text)).cast("string"), F.lit("")).alias("topic"),
        n_tokens(text).alias("n_tokens"),
        uniform(F.col(id_col), text, seed).alias("u"),
    )
    with scratch(docs.sparkSession) as keep:
        cells = save(plain.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "cells")
        weighted = keep(save(probabilities(save(rake(cells, targets), "raked"), share), "weights"))
    n = weighted.count()
    known = weighted.select(*DIMS, "p")
    rows = plain.join(F.broadcast(known) if n <= DRIVER_CELLS else known, list(DIMS))
    return rows.select("_row", "source", "lang", "topic", "n_tokens", "p", "u", (F.col("u") < F.col("p")).alias("kept")), weighted


def sample(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    rows, _ = mix(docs, **how)
    return rows.filter("kept").select(*[F.col("_row")[c].alias(c) for c in docs.columns])
