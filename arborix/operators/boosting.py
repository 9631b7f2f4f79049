"""Gradient boosting of quantiles: regression trees by histograms that Spark adds up.

A model predicts the value that a share ``alpha`` of the targets lies at or
below.  A tree is fitted to the gradient of the pinball loss (alpha above the
prediction, alpha - 1 else); what the driver gets of a level is one histogram
for each node and feature, whose size the parameters bound.  Leaves hold the
quantile of the residuals.  A fitted model is a Column, so predictions stay in
the plan of the rows that they are made for.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import folder, remove

#: Different rows up to which leaves' quantiles are exact; of the sketch beyond, ranks are right to one in so many.
EXACT, ACCURACY = 1 << 20, 1_000_000


@dataclass
class Tree:
    """splits: for each level, from node to (feature, cut); leaves: from node of the last level to value."""

    splits: list[dict[int, tuple[str, float]]] = field(default_factory=list)
    leaves: dict[int, float] = field(default_factory=dict)

    def node(self) -> Column:
        """The node of a row, 2 n + 1 for values above the cut of n, else 2 n."""
        at = F.lit(0)
        for level in self.splits:
            above = F.lit(0)
            for n, (name, cut) in level.items():
                above = F.when(at == n, F.coalesce((F.col(name) > F.lit(cut)).cast("int"), F.lit(0))).otherwise(above)
            at = at * 2 + above
        return at

    def value(self) -> Column:
        at, out = self.node(), F.lit(0.0)
        for n, v in self.leaves.items():
            out = F.when(at == n, F.lit(v)).otherwise(out)
        return out


@dataclass
class QuantileModel:
    alpha: float
    rate: float
    start: float
    trees: list[Tree] = field(default_factory=list)

    def prediction(self) -> Column:
        """The predicted quantile of a row with the features' columns."""
        out = F.lit(self.start)
        for t in self.trees:
            out = out + F.lit(self.rate) * t.value()
        return out


def cuts_of(rows: DataFrame, features: list[str], bins: int, different: DataFrame | None = None) -> dict[str, list[float]]:
    """Of each feature the values that may split it: all but the largest if there are few, else quantiles by a sketch; different: the rows without repeats, if they are known."""
    out = {}
    for name in features:
        few = [r[0] for r in (rows if different is None else different).select(F.col(name).cast("double")).filter(F.col(name).isNotNull()).distinct().limit(bins + 1).collect()]
        out[name] = sorted(few)[:-1] if len(few) <= bins else sorted(set(rows.approxQuantile(name, [k / bins for k in range(1, bins)], 0.1 / bins)))
    return out


def _bin(x: Column, cuts: list[float]) -> Column:
    """How many cuts lie below x."""
    return F.when(x.isNull(), 0).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: x > c))) if cuts else F.lit(0)


def best_split(counts: dict[str, list[tuple[int, int]]], alpha: float, least: int) -> tuple[str, int] | None:
    """(feature, bin) after which to split a node, from its (rows, rows above the prediction) by feature and bin; None if no split helps.

    The best one parts the mean gradients most; of equal ones the first.
    """
    best, found = 1e-12, None
    for name, own in counts.items():
        n, up = sum(c[0] for c in own), sum(c[1] for c in own)
        nl = ul = 0
        for b, (k, u) in enumerate(own[:-1]):
            nl, ul = nl + k, ul + u
            nr, ur = n - nl, up - ul
            if nl < least or nr < least:
                continue
            d = (alpha * ul - (1 - alpha) * (nl - ul)) / nl - (alpha * ur - (1 - alpha) * (nr - ur)) / nr
            gain = nl * nr / (nl + nr) * (d * d)
            if gain > best:
                best, found = gain, (name, b)
    return found


def _quantiles(rows: DataFrame, alphas: list[float], exact: bool) -> dict:
    """{(m, node): the alphas[m] quantile of v} of rows (m, node, v, _n), each counted _n times: the least value with so large a share at or below it."""
    if not exact:
        each = rows.select("m", "node", "v", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
        return {(r.m, r.node): r.q[r.m] for r in each.groupBy("m", "node").agg(F.percentile_approx("v", alphas, ACCURACY).alias("q")).collect()}
    own = Window.partitionBy("m", "node")
    alpha = F.element_at(F.array(*map(F.lit, alphas)), F.col("m") + 1)
    t = rows.groupBy("m", "node", "v").agg(F.sum("_n").alias("_n")).select("m", "node", "v", F.sum("_n").over(own.orderBy("v")).alias("upto"), F.sum("_n").over(own).alias("of"))
    return {(r.m, r.node): r.q for r in t.filter(F.col("upto") >= F.ceil(alpha * F.col("of"))).groupBy("m", "node").agg(F.min("v").alias("q")).collect()}


def fit(rows: DataFrame, features: list[str], target: str, alphas: tuple[float, ...], rounds: int = 8, depth: int = 2, rate: float = 0.3, bins: int = 32, least: int = 20) -> list[QuantileModel]:
    """One model for each alpha, all grown side by side: a level of a round is one aggregation for all of them.

    Rows without a target are left out; a null feature counts as not above any
    cut.  Without rows every model predicts 0.  Equal rows are counted and stored
    once, and levels and rounds read these; rows are read twice at least, so they
    should be stored or cheap.
    """
    rows = rows.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("_y")).filter("_y is not null")
    at = folder(rows.sparkSession, "boosting")
    rows.groupBy(*features, "_y").agg(F.count("*").alias("_n")).write.parquet(at)
    held_rows = rows.sparkSession.read.parquet(at)
    exact = held_rows.count() <= EXACT
    cuts = cuts_of(rows, features, bins, held_rows)
    own_alphas = [float(a) for a in alphas]
    first = _quantiles(held_rows.select(F.explode(F.sequence(F.lit(0), F.lit(len(alphas) - 1))).alias("m"), F.lit(0).alias("node"), F.col("_y").alias("v"), "_n"), own_alphas, exact)
    models = [QuantileModel(a, rate, first.get((m, 0), 0.0)) for m, a in enumerate(alphas)]
    cells = F.array(*[_bin(F.col(f), cuts[f]) for f in features])
    for _ in range(rounds):
        trees = [Tree() for _ in models]
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), t.prediction().alias("p")) for m, t in enumerate(models)])).alias("x")
        held = held_rows.select(*features, "_y", "_n", cells.alias("cells"), each)
        own = lambda make: F.coalesce(*[F.when(F.col("x.m") == m, make(t)) for m, t in enumerate(trees)])  # noqa: E731, B023
        for _ in range(depth):
            t = held.select("x.m", own(Tree.node).alias("node"), F.when(F.col("_y") > F.col("x.p"), F.col("_n")).otherwise(0).alias("up"), "_n", F.posexplode("cells").alias("f", "b"))
            table: dict = {}
            for r in t.groupBy("m", "node", "f", "b").agg(F.sum("_n").alias("n"), F.sum("up").alias("up")).collect():  # models x nodes x features x bins
                table.setdefault((r.m, r.node), {}).setdefault(r.f, {})[r.b] = (r.n, r.up)
            levels: list[dict] = [{} for _ in models]
            for (m, node), counts in table.items():
                full = {f: [counts[i].get(b, (0, 0)) for b in range(len(cuts[f]) + 1)] for i, f in enumerate(features)}
                if (split := best_split(full, alphas[m], least)) is not None:
                    levels[m][node] = (split[0], cuts[split[0]][split[1]])
            for tree, level in zip(trees, levels, strict=True):
                tree.splits.append(level)
        leaves = _quantiles(held.select("x.m", own(Tree.node).alias("node"), (F.col("_y") - F.col("x.p")).alias("v"), "_n"), own_alphas, exact)
        for (m, node), v in leaves.items():
            trees[m].leaves[node] = v
        for model, tree in zip(models, trees, strict=True):
            model.trees.append(tree)
    remove(rows.sparkSession, at)
    return models


def pinball(target: Column, prediction: Column, alpha: float) -> Column:
    """The loss that a quantile model lowers."""
    d = target - prediction
    return F.greatest(F.lit(alpha) * d, F.lit(alpha - 1) * d)
