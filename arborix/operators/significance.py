"""Paired tests and intervals, as aggregates and closed forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1, by Stirling's series eight places further on."""
    z = x + 8.0
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - 1 / (1680 * F.pow(z, F.lit(7.0)))
    return series - F.log(x * (x + 1) * (x + 2) * (x + 3)) - F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def _lower(n: Column, k: Column) -> Column:
    """P(X <= k) for X binomial (n, 1/2), at any size, by its terms from k downwards.

    Of k below the middle a term is smaller than the next by more than the last
    one was, so those beyond six roots of n (and sixty) add nothing that a double
    holds; above the middle it is 1 less the other tail.
    """
    up = 2 * k >= n
    j = F.when(up, n - k - 1).otherwise(k)
    m, i = n.cast("double"), j.cast("double")
    top = F.exp(_log_gamma(m + 1) - _log_gamma(i + 1) - _log_gamma(m - i + 1) - m * F.log(F.lit(2.0)))
    steps = F.least(j, F.lit(60) + F.ceil(6 * F.sqrt(m))).cast("int")
    back = F.when(steps > 0, F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def add(a, d):
        term = a["term"] * (i - d) / (m - i + d + 1)
        return F.struct((a["sum"] + term).alias("sum"), term.alias("term"))

    below = F.when(j < 0, 0.0).otherwise(top * F.aggregate(back, start, add)["sum"])
    return F.when(up, 1.0 - below).otherwise(below)


def mcnemar(b, c) -> Column:
    """Exact two-sided p of discordant counts, few or many; 1 without any."""
    b, c = _c(b).cast("long"), _c(c).cast("long")
    n = b + c
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * _lower(n, F.least(b, c))))


def sign_test(gain, loss) -> Column:
    """One-sided p that gains are more likely than losses; null without any."""
    g, n = _c(gain).cast("long"), (_c(gain) + _c(loss)).cast("long")
    return F.when(n > 0, F.least(F.lit(1.0), _lower(n, n - g)))


def flips(a: DataFrame, b: DataFrame, value: str = "osc", by: tuple[str, ...] = ()) -> DataFrame:
    """Gains and losses from a to b over the same queries, with exact p values."""
    pair = a.select("query_id", *by, F.col(value).alias("x")).join(b.select("query_id", F.col(value).alias("y")), "query_id")
    t = (pair.groupBy(*by) if by else pair).agg(F.count("*").alias("n"), F.sum("x").cast("long").alias("a_covered"), F.sum("y").cast("long").alias("b_covered"), F.count_if((F.col("y") == 1) & (F.col("x") == 0)).alias("gain"), F.count_if((F.col("x") == 1) & (F.col("y") == 0)).alias("loss"))
    return t.withColumn("p_two_sided", F.when(F.col("gain") + F.col("loss") > 0, mcnemar("gain", "loss"))).withColumn("p_gain", sign_test("gain", "loss"))


def wilson(p, n, z: float = 1.96) -> Column:
    """struct(low, high): the score interval of a share."""
    p, n = _c(p), _c(n).cast("double")
    mid, half, d = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), (mid - half) / d).alias("low"), F.least(F.lit(1.0), (mid + half) / d).alias("high")))


#: Groups of values that a round's draws are first split over; distinct values of a group, about.
GROUPS, GROUP = 64, 100_000


def bootstrap_means(values: DataFrame, value: str = "d", rounds: int = 10_000, seed: int = 42) -> DataFrame:
    """(b, mean, n): of each round the mean of n draws with replacement from the n values, nulls left out.

    Equal values are drawn together.  The driver splits a round's n draws over
    groups of values, by their sizes; a group's task splits its part over its
    values.  Both are binomials of what is left, so every round has n draws, and
    fixed functions of seed, group and values, so results repeat.  A task holds
    one group, of GROUP distinct values or so, and gives one sum a round.
    """
    import numpy as np

    spark = values.sparkSession
    counts = values.select(F.col(value).cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    distinct = counts.count()
    groups = max(GROUPS, -(-distinct // GROUP))
    counts = counts.withColumn("g", F.pmod(F.xxhash64("v"), F.lit(groups)).cast("int"))
    sizes = {r.g: r.n for r in counts.groupBy("g").agg(F.sum("n").alias("n")).collect()}  # one number a group
    kept, n = sorted(sizes), sum(sizes.values())
    if not n:
        return spark.createDataFrame([], "b int, mean double, n long")
    parts = np.random.default_rng([seed, groups]).multinomial(n, np.array([sizes[g] for g in kept]) / n, rounds)
    drawn = spark.sparkContext.broadcast(dict(zip(kept, parts.T, strict=True)))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def drawn_from(g, v, c):
            rng, m, total = np.random.default_rng([seed, groups, g]), drawn.value[g], np.zeros(rounds)
            step = max(1, (1 << 21) // len(v))
            for at in range(0, rounds, step):
                total[at : at + step] = rng.multinomial(m[at : at + step], c / c.sum()) @ v
            return pa.RecordBatch.from_arrays([pa.array(np.arange(rounds, dtype=np.int32)), pa.array(total), pa.array(m)], names=["b", "s", "m"])

        held, now = [], None
        for batch in batches:
            for g in pc.unique(batch.column(0)).to_pylist():
                own = batch.filter(pc.equal(batch.column(0), g))
                if held and g != now:
                    yield drawn_from(now, *(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                held.append((own.column(1).to_numpy(), own.column(2).to_numpy()))
                now = g
        if held:
            yield drawn_from(now, *(np.concatenate(x) for x in zip(*held, strict=True)))

    sums = counts.select("g", "v", "n").repartition("g").sortWithinPartitions("g", "v").mapInArrow(run, "b int, s double, m long")
    return sums.groupBy("b").agg((F.sum("s") / F.sum("m")).alias("mean"), F.sum("m").alias("n"))


def bootstrap(values: DataFrame, value: str = "d", rounds: int = 10_000, seed: int = 42) -> DataFrame:
    """Mean of a column with a 95 % percentile interval, interpolated: (mean, low, high); null without values."""
    own = values.agg(F.avg(F.col(value).cast("double")).alias("mean"))
    # rounded, since the order of the sums is not fixed
    m = bootstrap_means(values, value, rounds, seed).select(F.round("mean", 12).alias("mean"))
    ends = m.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
    return own.crossJoin(ends).select(F.round("mean", 12).alias("mean"), F.round("low", 12).alias("low"), F.round("high", 12).alias("high"))  # one row each


def paired_bootstrap(a: DataFrame, b: DataFrame, value: str = "osc", rounds: int = 10_000, seed: int = 42) -> DataFrame:
    """Of the difference a - b over the same queries."""
    pair = a.select("query_id", F.col(value).alias("x")).join(b.select("query_id", F.col(value).alias("y")), "query_id")
    return bootstrap(pair.select("query_id", (F.col("x") - F.col("y")).cast("double").alias("d")), "d", rounds, seed)


#: Ranges that values are cut into before they are put in order.
RANGES = 64


def midranks(values: DataFrame, value: str, *counts: Column) -> DataFrame:
    """(value, n, midrank, counts...): one row for each distinct value, ties sharing their mean rank.

    Rows are counted by value, distinct values are put in order range by range,
    and each range is shifted by the few sums of those before it.
    """
    g = values.groupBy(value).agg(F.count("*").alias("n"), *counts)
    cuts = sorted(set(values.select(F.col(value).cast("double").alias("v")).approxQuantile("v", [k / RANGES for k in range(1, RANGES)], 0.2 / RANGES)))
    at = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
    g = g.withColumn("range", F.size(F.filter(at, lambda c: c <= F.col(value).cast("double"))))
    before = F.sum("m").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # over RANGES rows at most
    shift = g.groupBy("range").agg(F.sum("n").alias("m")).select("range", F.coalesce(before, F.lit(0)).alias("shift"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = g.withColumn("inside_range", inside).join(F.broadcast(shift), "range")
    return ranked.withColumn("midrank", F.col("shift") + F.col("inside_range") + (F.col("n") + 1) / 2.0).drop("range", "inside_range", "shift")


def _normal_tail(z: Column) -> Column:
    """Two-sided p of a standard normal, by the complementary error function (fractional error below 1.2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.5 * x)
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(c[9])
    for k in reversed(c[:9]):
        poly = poly * t + k
    return t * F.exp(-x * x + poly)


def _upper(z: Column) -> Column:
    """P(Z > z) of a standard normal."""
    return F.when(z >= 0, _normal_tail(z) / 2).otherwise(1 - _normal_tail(z) / 2)


def mann_whitney(values: DataFrame, value: str = "rank", group: str = "colliding") -> DataFrame:
    """(n1, n2, u, p, p_greater, p_less) of the rows where the group holds, all from one ranking, by the normal approximation with corrections for ties and continuity.

    p_greater: that values of the group are larger.  For few rows see
    :func:`exact_rank_sum`.
    """
    r = midranks(values.filter(F.col(value).isNotNull()), value, F.count_if(group).alias("inside"))
    n = F.col("n").cast("double")
    s = r.agg(F.coalesce(F.sum("inside"), F.lit(0)).alias("n1"), F.coalesce(F.sum(F.col("n") - F.col("inside")), F.lit(0)).alias("n2"), F.sum(F.col("inside") * F.col("midrank")).alias("r1"), F.sum(n * n * n - n).alias("t"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")  # products of counts leave the range of a long
    u = F.col("r1") - n1 * (n1 + 1) / 2.0
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("t") / (n * (n - 1))))
    far = u - n1 * n2 / 2.0
    ok = (n1 > 0) & (n2 > 0) & (sd > 0)
    return s.select(
        "n1", "n2", u.alias("u"),
        F.when(ok, F.least(F.lit(1.0), _normal_tail(F.greatest((F.abs(far) - 0.5) / sd, F.lit(0.0))))).alias("p"),
        F.when(ok, _upper((far - 0.5) / sd)).alias("p_greater"),
        F.when(ok, _upper((-far - 0.5) / sd)).alias("p_less"),
    )


def wilcoxon(pairs: DataFrame, a: str, b: str, least: int = 5) -> DataFrame:
    """Signed ranks of a - b without zeros: (n, w, p, p_greater, p_less), p null for fewer than ``least`` pairs; p_greater: that a is larger."""
    d = pairs.select((F.col(a) - F.col(b)).cast("double").alias("d")).filter("d <> 0").withColumn("size", F.abs("d"))
    r = midranks(d, "size", F.count_if(F.col("d") > 0).alias("up"))
    k, zero = F.col("n").cast("double"), F.lit(0.0)
    s = r.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("up") * F.col("midrank")), zero).alias("plus"), F.coalesce(F.sum((F.col("n") - F.col("up")) * F.col("midrank")), zero).alias("minus"), F.coalesce(F.sum(k * k * k - k), zero).alias("t"))
    w, n = F.least("plus", "minus"), F.col("n").cast("double")  # its cube leaves the range of a long at 1.7 million
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("t") / 48.0)
    mean, ok = n * (n + 1) / 4.0, (n >= least) & (sd > 0)
    return s.select("n", w.alias("w"), F.when(ok, F.least(F.lit(1.0), _normal_tail((w - mean) / sd))).alias("p"), F.when(ok, _upper((F.col("plus") - mean) / sd)).alias("p_greater"), F.when(ok, _upper((F.col("minus") - mean) / sd)).alias("p_less"))


def exact_rank_sum(values: DataFrame, value: str, group: str, by: list[str]) -> DataFrame:
    """(by..., n1, n2, u, p, p_greater, p_less, exact): U of the rows of a stratum where the group holds, with its permutation distribution.

    Up to EXACT rows the ways to choose n1 rows with each sum of (doubled)
    mid-ranks are counted rank by rank, so ties are as they are; p is twice the
    smaller tail.  Beyond, p are those of the normal approximation and exact is
    false.  Where one side is empty they are null.
    """
    w = Window.partitionBy(*by, value)
    v = values.filter(F.col(value).isNotNull()).select(*by, value, F.coalesce(F.col(group), F.lit(False)).cast("int").alias("_in"))
    own = Window.partitionBy(*by)
    size = F.count("*").over(w)
    r = v.withColumn("r2", (2 * F.rank().over(own.orderBy(value)) + size - 1).cast("int")).withColumn("ties", (size * size - 1).cast("double")).withColumn("place", F.row_number().over(own.orderBy(value)))
    g = r.groupBy(*by).agg(F.sum("_in").cast("int").alias("n1"), F.sum(1 - F.col("_in")).cast("int").alias("n2"), F.sum(F.col("r2") * F.col("_in")).alias("sum2"), F.sum("ties").alias("ties"), F.collect_list(F.when(F.col("place") <= EXACT + 1, F.col("r2"))).alias("rs"))
    few = (F.size("rs") <= EXACT) & (F.col("n1") > 0) & (F.col("n2") > 0)
    rs, chosen = F.when(few, F.col("rs")).otherwise(F.array(F.lit(0))), F.when(few, F.col("n1")).otherwise(0)
    total = F.aggregate(rs, F.lit(0), lambda t, x: t + x)
    start = F.transform(F.sequence(F.lit(0), chosen), lambda j: F.transform(F.sequence(F.lit(0), total), lambda s: F.when((j == 0) & (s == 0), 1.0).otherwise(0.0)))
    # of all choices of j of the ranks so far: how many have each sum
    ways = F.aggregate(rs, start, lambda st, x: F.transform(st, lambda row, j: F.transform(row, lambda n, s: n + F.coalesce(F.get(F.get(st, j - 1), s - x), F.lit(0.0)))))
    t = g.withColumn("ways", F.when(few, F.element_at(ways, -1)))
    every = F.aggregate("ways", F.lit(0.0), lambda a, x: a + x)
    at = F.col("sum2").cast("int")
    greater = F.aggregate(F.slice("ways", at + 1, F.greatest(F.size("ways") - at, F.lit(0))), F.lit(0.0), lambda a, x: a + x) / every
    less = F.aggregate(F.slice("ways", 1, at + 1), F.lit(0.0), lambda a, x: a + x) / every
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")  # the product of two ints leaves their range
    u = F.col("sum2") / 2.0 - n1 * (n1 + 1) / 2.0
    n = n1 + n2
    far, sd = u - n1 * n2 / 2.0, F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    ok = (n1 > 0) & (n2 > 0) & (sd > 0)
    near = lambda x: F.when(ok, x)
    return t.select(
        *by, "n1", "n2", u.alias("u"),
        F.when(few, F.least(F.lit(1.0), 2 * F.least(greater, less))).otherwise(near(F.least(F.lit(1.0), _normal_tail(F.greatest((F.abs(far) - 0.5) / sd, F.lit(0.0)))))).alias("p"),
        F.when(few, greater).otherwise(near(_upper((far - 0.5) / sd))).alias("p_greater"),
        F.when(few, less).otherwise(near(_upper((-far - 0.5) / sd))).alias("p_less"),
        (F.size("rs") <= EXACT).alias("exact"),
    )


#: Pairs up to which signed ranks have an exact distribution here.
EXACT = 25


def exact_signed_rank(pairs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """(by..., n, w, p, exact): two-sided p of signed ranks, ties by their mid-ranks: exact up to EXACT pairs, beyond by the normal approximation, and exact is false.

    The 2^n signs of a stratum are not listed: the number of ways to reach each
    sum of (doubled) ranks is built up rank by rank.
    """
    by = by or []
    d = pairs.select(*by, (F.col(a) - F.col(b)).cast("double").alias("d")).filter("d <> 0")
    w = Window.partitionBy(*by, F.abs("d"))
    place = F.rank().over(Window.partitionBy(*by).orderBy(F.abs("d")))
    r = d.withColumn("r2", (2 * place + F.count("*").over(w) - 1).cast("int"))  # twice the mid-rank
    r = r.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.abs("d"))))  # one more than EXACT are enough to tell
    r = r.withColumn("ties", (F.count("*").over(w) * F.count("*").over(w) - 1).cast("double"))
    g = (r.groupBy(*by) if by else r).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r2"))), F.lit(0)).alias("up"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r2"))), F.lit(0)).alias("down"), F.collect_list(F.when(F.col("place") <= EXACT + 1, F.col("r2"))).alias("rs"), F.sum("ties").alias("ties"))
    none = F.array_repeat(F.lit(0.0), 1)

    def ways(rs):
        total = F.aggregate(rs, F.lit(0), lambda t, x: t + x)
        start = F.transform(F.sequence(F.lit(0), total), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
        return F.aggregate(rs, start, lambda c, x: F.transform(c, lambda v, i: v + F.coalesce(F.get(c, i - x), F.lit(0.0))))

    few = F.size("rs") <= EXACT
    t = g.withColumn("low", F.least("up", "down").cast("int")).withColumn("ways", F.when(few & (F.size("rs") > 0), ways(F.when(few, F.col("rs")))).otherwise(none))
    tail = F.aggregate(F.slice("ways", 1, F.col("low") + 1), F.lit(0.0), lambda s, x: s + x) / F.pow(F.lit(2.0), F.col("n"))
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0)
    normal = F.when(sd > 0, F.least(F.lit(1.0), _normal_tail((F.least("up", "down") / 2.0 - n * (n + 1) / 4.0) / sd)))
    return t.select(*by, "n", (F.least("up", "down") / 2.0).alias("w"), F.when(few, F.when(F.col("n") > 0, F.least(F.lit(1.0), 2 * tail))).otherwise(normal).alias("p"), few.alias("exact"))


def paired_metrics(base: DataFrame, treat: DataFrame, metrics: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., metric, n, delta, gain, loss, p): of each metric the paired test that suits it.

    metrics: from a column to "binary" (sign test of gains against losses) or
    "continuous" (normal approximation of signed ranks, by sums over midranks in
    one pass for each).  Both sides have (query_id, by..., metrics).
    """
    keys = ["query_id", *by]
    names = list(metrics)
    pair = base.select(*keys, *[F.col(m).cast("double").alias(f"a_{m}") for m in names]).join(treat.select(*keys, *[F.col(m).cast("double").alias(f"b_{m}") for m in names]), keys)
    long = pair.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.col(f"b_{m}") - F.col(f"a_{m}"), 12).alias("d")) for m in names])).alias("x")).select(*keys, "x.metric", "x.d").filter("d is not null")
    own = [*by, "metric"]
    t = long.groupBy(*own).agg(F.count("*").alias("n"), F.avg("d").alias("delta"), F.count_if(F.col("d") > 0).alias("gain"), F.count_if(F.col("d") < 0).alias("loss"))
    # equal differences share a rank: ranks are taken over distinct sizes
    sizes = long.filter("d <> 0").groupBy(*own, F.abs("d").alias("size")).agg(F.count("*").alias("k"), F.count_if(F.col("d") > 0).alias("up"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy(*own).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = sizes.withColumn("mid", before + (F.col("k") + 1) / 2.0)
    k = F.col("k").cast("double")
    w = r.groupBy(*own).agg(F.sum("k").alias("m"), F.sum(F.col("up") * F.col("mid")).alias("plus"), F.sum((F.col("k") - F.col("up")) * F.col("mid")).alias("minus"), F.sum(k * k * k - k).alias("ties"))
    m = F.col("m").cast("double")
    sd = F.sqrt(m * (m + 1) * (2 * m + 1) / 24.0 - F.col("ties") / 48.0)
    z = (F.least("plus", "minus") - m * (m + 1) / 4.0) / sd
    signed = F.when(sd > 0, F.least(F.lit(1.0), _normal_tail(z)))
    binary = F.col("metric").isin(*[x for x in names if metrics[x] == "binary"])
    both = t.join(w, own, "left")
    return both.select(*own, "n", "delta", "gain", "loss", F.when(binary, mcnemar("gain", "loss")).otherwise(signed).alias("p"))
