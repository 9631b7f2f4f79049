"""Lexical index, quantile boosting, repair rounds and exact tests against plain Python."""

import math
import os
from fractions import Fraction
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from arborix.functions import text as tx
from arborix.operators import boosting, repair, scoring, significance
from arborix.sources.lexical import LexicalIndex

SF = "/root/testdata/sf0.001"


def rows_of(df, key="chunk_id"):
    return sorted((r.query_id, r[key], r["rank"], round(r.score, 6)) for r in df.collect())


def test_lexical_index_finds_what_a_full_scan_finds(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "the")], docs.schema))
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 40).alias("question"))
    asked = asked.unionByName(spark.createDataFrame([(900, ""), (901, None), (902, "nosuchword"), (903, "the the")], asked.schema))
    index = LexicalIndex.build(docs, f"{tmp_path}/index", range_size=4)
    for k in (1, 10):
        assert rows_of(index.search(asked, k)) == rows_of(scoring.bm25_topk(asked, docs, k))
    audit = index.audit(asked, 1).collect()
    assert all(0 < r.blocks_read <= r.blocks for r in audit) and sum(r.blocks_read for r in audit) < 0.8 * sum(r.blocks for r in audit)
    again = LexicalIndex(spark, f"{tmp_path}/index")  # opened, not built
    assert rows_of(again.search(asked, 3)) == rows_of(scoring.bm25_topk(asked, docs, 3))
    assert "text" not in again.blocks.columns


def test_lexical_index_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "chunk_id long, text string")
    index = LexicalIndex.build(docs, f"{tmp_path}/none")
    assert index.search(spark.createDataFrame([(1, "a")], "query_id long, question string"), 3).count() == 0


def shuffled_records(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_lexical_index_moves_chunks_not_postings(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")
    before = shuffled_records(spark)
    index = LexicalIndex.build(docs, f"{tmp_path}/index")
    # chunks, their keys and counts of words move; postings alone would be more
    assert shuffled_records(spark) - before < index.terms.agg(F.sum("df")).first()[0]


def test_lexical_index_takes_any_words_and_keys(spark, tmp_path):
    texts = ["a1-B2 a1", "\u0130stanbul \u212aelvin b2", "", None, "x", "x--x_x", "\u00e9t\u00e9 a1 b2 long " + "word " * 50, "b2"]
    docs = spark.createDataFrame([(f"k{9 - i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    asked = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(["a1 b2", "stanbul kelvin", "X x", "word long t", ""])], "query_id string, question string")
    for i, words in enumerate((tx.alnum_tokens, tx.word_tokens)):
        index = LexicalIndex.build(docs, f"{tmp_path}/{i}", tokenize=words, range_size=2)
        want = rows_of(scoring.bm25_topk(asked, docs, 2, tokenize=words))
        assert want and rows_of(index.search(asked, 2, tokenize=words)) == want
        assert {r.term for r in index.terms.collect()} == {w for r in docs.select(words("text").alias("w")).collect() for w in r.w}


def brute_fit(rows, alpha, rounds, depth, rate, least):
    """rows: (features, y); predictions of all rows."""
    quantile = lambda v: sorted(v)[math.ceil(alpha * len(v)) - 1]
    pred = [quantile([y for _, y in rows])] * len(rows)
    for _ in range(rounds):
        node = [0] * len(rows)
        for _ in range(depth):
            splits = {}
            for n in set(node):
                own = [i for i in range(len(rows)) if node[i] == n]
                best = 1e-12
                for f in range(len(rows[0][0])):
                    for cut in sorted({rows[i][0][f] for i in range(len(rows))})[:-1]:
                        g = ([], [])
                        for i in own:
                            g[rows[i][0][f] > cut].append(rows[i][1] > pred[i])
                        nl, nr = len(g[0]), len(g[1])
                        if min(nl, nr) < least:
                            continue
                        d = (alpha * sum(g[0]) - (1 - alpha) * (nl - sum(g[0]))) / nl - (alpha * sum(g[1]) - (1 - alpha) * (nr - sum(g[1]))) / nr
                        if nl * nr / (nl + nr) * (d * d) > best:
                            best, splits[n] = nl * nr / (nl + nr) * (d * d), (f, cut)
            node = [2 * n + (n in splits and rows[i][0][splits[n][0]] > splits[n][1]) for i, n in enumerate(node)]
        leaf = {n: quantile([rows[i][1] - pred[i] for i in range(len(rows)) if node[i] == n]) for n in set(node)}
        pred = [p + rate * leaf[n] for p, n in zip(pred, node, strict=True)]
    return pred


def test_quantile_boosting_is_the_brute_force(spark):
    rng = __import__("random").Random(4)
    rows = [((float(rng.randint(0, 5)), float(rng.randint(0, 3))), 0.0) for _ in range(300)]
    rows = [(x, float(round(x[0] * 2 - x[1] + abs(rng.gauss(0, 1 + x[1]))))) for x, _ in rows]
    df = spark.createDataFrame([(i, *x, y) for i, (x, y) in enumerate(rows)], "i int, a double, b double, y double")
    models = boosting.fit(df.unionByName(spark.createDataFrame([(999, 1.0, 1.0, None)], df.schema)), ["a", "b"], "y", (0.5, 0.9), rounds=4, least=5)
    losses = []
    for m in models:
        got = [r.p for r in df.select("i", m.prediction().alias("p")).orderBy("i").collect()]
        assert got == pytest.approx(brute_fit(rows, m.alpha, 4, 2, 0.3, 5), abs=1e-9)
        one = df.select(F.avg(boosting.pinball(F.col("y"), F.lit(m.start), m.alpha)), F.avg(boosting.pinball(F.col("y"), m.prediction(), m.alpha))).first()
        losses.append(one)
        assert one[1] < one[0]
    below = df.select(F.avg((F.col("y") <= models[1].prediction() + 1e-9).cast("int"))).first()[0]
    assert 0.8 < below <= 1


def test_quantile_boosting_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), (2.0, 3.0), (None, 1.0), (5.0, 9.0)] * 10, "a double, y double")
    (m,) = boosting.fit(df, ["a"], "y", (0.5,), rounds=2, least=2)
    assert df.select(m.prediction().alias("p")).filter("p is null").count() == 0
    (none,) = boosting.fit(df.limit(0), ["a"], "y", (0.5,), rounds=1)
    assert none.start == 0.0 and df.select(none.prediction().alias("p")).distinct().count() == 1


def test_repair_goes_on_where_it_died(spark, tmp_path):
    """Each round is stored; a run after a failure tries again only what the failed round held."""
    asked = spark.createDataFrame([(f"q{i}", i) for i in range(12)], "query_id string, need int")
    log = f"{tmp_path}/tried"
    os.makedirs(log)
    fail = {"now": True}

    def attempt(rows):
        for r in rows.select("query_id").collect():
            with open(f"{log}/{r.query_id}", "a") as f:
                f.write("x")
        if fail["now"] and rows.count() < 12:
            raise RuntimeError("lost")
        step = F.struct(F.lit("s").alias("step"), F.lit(None).cast("string").alias("value"), F.when(F.col("need") > 0, "NO_MATCH").alias("flag"))
        return rows.filter("query_id <> 'q3'").select("query_id", F.when(F.col("need") <= 0, F.lit("ok")).alias("result"), F.when(F.col("query_id") == "q5", "boom").alias("error"), F.array(step).alias("trace"))

    revise = lambda rows: rows.withColumn("need", F.col("need") - 1).withColumn("said", repair.feedback(F.lit("p")))
    with pytest.raises(RuntimeError):
        repair.repaired(asked, attempt, revise, f"{tmp_path}/run", rounds=3)
    fail["now"] = False
    got = {r.query_id: r for r in repair.repaired(asked, attempt, revise, f"{tmp_path}/run", rounds=3).collect()}
    assert len(got) == 12
    for i in range(12):
        r = got[f"q{i}"]
        clean = i not in (3, 5) and i <= 3
        assert (r.n_repair, r.flagged) == (i if clean else 3, not clean), i
    tries = {f: len(open(f"{log}/{f}").read()) for f in os.listdir(log)}
    assert tries["q0"] == 1 and tries["q1"] == 3  # q1: once in round 0, twice in round 1, whose first run died
    traces = repair.repair_traces(spark, f"{tmp_path}/run", 3)
    assert traces.count() == 12 + 11 + 10 + 9
    said = spark.createDataFrame([("r", None, [("look", None, "NO_MATCH")])], "result string, error string, trace array<struct<step:string,value:string,flag:string>>").select(repair.feedback(F.lit("p")).alias("f")).first().f
    assert "look -> NO MATCH [NO_MATCH]" in said and "a lookup found nothing" in said


@pytest.mark.parametrize(("b", "c"), [(0, 0), (0, 1), (3, 3), (5, 2), (70, 40), (130, 131), (300, 240), (1000, 1100), (4000, 3600)])
def test_binomial_tails_at_any_size(spark, b, c):
    n = b + c
    tail = lambda low, high: float(sum(Fraction(math.comb(n, i)) for i in range(low, high + 1)) / 2**n)
    got = spark.range(1).select(significance.mcnemar(F.lit(b), F.lit(c)).alias("m"), significance.sign_test(F.lit(b), F.lit(c)).alias("s")).first()
    assert got.m == pytest.approx(min(1.0, 2 * tail(0, min(b, c))) if n else 1.0, rel=1e-8)
    assert got.s is None if not n else got.s == pytest.approx(tail(b, n), rel=1e-8)


def test_binomial_tails_of_huge_counts(spark):
    n = 10**9
    z = 2.5
    b = int(n / 2 - z * math.sqrt(n) / 2)
    got = spark.range(1).select(significance.mcnemar(F.lit(b), F.lit(n - b)).alias("m")).first().m
    assert got == pytest.approx(math.erfc((z - 1 / math.sqrt(n)) / math.sqrt(2)), rel=1e-3)


def test_exact_rank_sums_are_all_choices(spark):
    rng = __import__("random").Random(8)
    data = {g: [(rng.randint(0, 4), rng.random() < 0.4) for _ in range(n)] for g, n in (("a", 9), ("b", 5), ("c", 12), ("e", 60))}
    data["d"] = [(1, True), (2, True)]
    df = spark.createDataFrame([(g, v, x) for g, ps in data.items() for v, x in ps], "g string, v int, x boolean")
    got = {r.g: r for r in significance.exact_rank_sum(df, "v", "x", ["g"]).collect()}
    for g in ("a", "b", "c"):
        ps = data[g]
        mid = [sum(w < v for w, _ in ps) + (sum(w == v for w, _ in ps) + 1) / 2 for v, _ in ps]
        own = [i for i, (_, x) in enumerate(ps) if x]
        s = sum(mid[i] for i in own)
        sums = [sum(mid[i] for i in pick) for pick in combinations(range(len(ps)), len(own))]
        up, low = (sum(t >= s for t in sums) / len(sums), sum(t <= s for t in sums) / len(sums))
        assert got[g].u == s - len(own) * (len(own) + 1) / 2 and got[g].exact
        assert (got[g].p_greater, got[g].p_less, got[g].p) == pytest.approx((up, low, min(1, 2 * min(up, low))))
    assert got["d"].p is None and not got["e"].exact and 0 < got["e"].p <= 1
    whole = significance.mann_whitney(df.filter("g = 'e'"), "v", "x").first()
    assert (got["e"].p, got["e"].p_greater, got["e"].p_less) == pytest.approx((whole.p, whole.p_greater, whole.p_less))
    assert whole.p_greater + whole.p_less > 1  # both hold the value itself


def test_signed_ranks_beyond_the_exact_range(spark):
    rng = __import__("random").Random(5)
    pairs = spark.createDataFrame([("a", float(rng.randint(0, 9)), float(rng.randint(0, 12))) for _ in range(80)], "g string, x double, y double")
    got, one = significance.exact_signed_rank(pairs, "x", "y", ["g"]).first(), significance.wilcoxon(pairs, "x", "y").first()
    assert not got.exact and got.p == pytest.approx(one.p) and got.w == one.w
    assert min(one.p_greater, one.p_less) == pytest.approx(one.p / 2) and one.p_greater + one.p_less == pytest.approx(1)


def test_vector_store_reads_only_cells_that_matter(spark, tmp_path):
    import numpy as np

    from arborix.sources.vectors import VectorStore

    rng = np.random.default_rng(6)
    centers = rng.standard_normal((20, 12))
    vs = [(centers[i % 20] + 0.05 * rng.standard_normal(12)).tolist() for i in range(600)] + [[0.0] * 12] * 2
    rows = spark.createDataFrame([("t%d" % (i % 7), f"c{i:03}", f"text {i}", v) for i, v in enumerate(vs)], "table_id string, chunk_id string, text string, v array<double>")
    asked = spark.createDataFrame([(k, vs[k * 13]) for k in range(15)] + [(99, [0.0] * 12), (100, rng.standard_normal(12).tolist())], "query_id int, qv array<double>")
    store = VectorStore(spark, str(tmp_path))
    store.add("a b", rows.withColumn("v", F.when(F.col("chunk_id") < "c100", F.reverse("v")).otherwise(F.col("v"))))
    store.add("a b", rows.filter("chunk_id < 'c100'"))

    def same(k):
        hits, audit = store.nearest("a b", asked, k)
        assert rows_of(hits) == rows_of(scoring.dense_topk(asked, rows, k))
        return {r.query_id: r.cells_read / r.cells for r in audit.collect()}

    share = same(5)
    assert max(share[k] for k in range(15)) < 0.5 and share[99] == 1.0
    assert max(same(700).values()) == 1.0  # more than there are
    assert store.read("a b").count() == 602
    store.compact("a b")
    assert len(store.versions("a b")) == 1 and store.read("a b").count() == 602
    same(5)
    with pytest.raises(ValueError):
        store.read("other")
    store.add("none", rows.limit(0))
    assert store.nearest("none", asked, 3)[0].count() == 0
    store.add("none", rows.limit(3))  # begun without a sample: one cell without a direction
    assert rows_of(store.nearest("none", asked, 3)[0]) == rows_of(scoring.dense_topk(asked, rows.limit(3), 3))


def test_admissions_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    from datetime import datetime, timedelta, timezone

    from arborix.operators import admission

    rng = __import__("random").Random(11)
    start = datetime(2024, 5, 1, tzinfo=timezone.utc)
    rows = [(f"k{rng.randint(0, 3)}", i, start + timedelta(seconds=i * 2 + rng.random()), rng.randint(0, 70) if i % 19 else 500, (0, 0, 0, 1, 4)[rng.randint(0, 4)]) for i in range(150)]
    schema = "who string, id long, ts timestamp, tokens int, failures int"
    calls = spark.createDataFrame(rows, schema)
    how = {"budget": 100, "key": "id", "by": ["who"], "failures": "failures"}
    got = {r.id: r for r in admission.admitted(calls, **how).collect()}
    # one second at a time, as a poller would do it, but for the parts of a second
    for who in {r[0] for r in rows}:
        log, free = [], start
        for _, i, ts, n, fails in sorted((r for r in rows if r[0] == who), key=lambda r: (r[2], r[1])):
            r = got[i]
            if n > 100:
                assert r.start is None and r.failed
                continue
            now = max(ts, free)
            inside = lambda t: sum(x for s, x in log if (t - s).total_seconds() < 60)  # noqa: E731, B023
            while inside(now) + n > 100:
                now = min(s for s, _ in log if (now - s).total_seconds() < 60) + timedelta(seconds=60)
            log.append((now, n))
            free = now + timedelta(seconds=2 ** min(fails, 3) - 1)
            assert r.start.replace(tzinfo=timezone.utc) == now and (r.attempts, r.failed) == (min(fails, 2) + 1, fails > 2)
            assert r.waited == pytest.approx((now - ts).total_seconds())
    assert sum(r.waited > 30 for r in got.values() if r.start) > 20
    for k in range(3):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = admission.admitted_stream(stream, **how)
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination(200)
    streamed = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {r.id: tuple(r) for r in streamed} == {i: tuple(r) for i, r in got.items()} and len(streamed) == len(got)


def test_bootstrap_draws_as_many_as_there_are(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    xs = np.concatenate([rng.integers(-3, 4, 300).astype(float), rng.standard_normal(400)]).round(3).tolist()
    df = spark.createDataFrame([(x,) for x in [*xs, None]], "d double")
    means = significance.bootstrap_means(df, rounds=3000).collect()
    assert len(means) == 3000 and {r.n for r in means} == {700}
    m = np.array([r["mean"] for r in means])
    assert abs(m.mean() - np.mean(xs)) < 4 * np.std(xs) / 700**0.5 / 3000**0.5 and m.std() == pytest.approx(np.std(xs) / 700**0.5, rel=0.06)
    got = significance.bootstrap(df, rounds=3000).first()
    assert (got.low, got.high) == pytest.approx(tuple(np.percentile(m, [2.5, 97.5])), abs=1e-9)
    assert tuple(got) == tuple(significance.bootstrap(df.repartition(5), rounds=3000).first())
    assert tuple(significance.bootstrap(df.limit(0), rounds=10).first()) == (None, None, None)


def test_quantile_models_read_equal_rows_once(spark, monkeypatch):
    rows = [(float(i % 4), float(i % 3), float((i % 4) * 2 + i % 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    seen = []
    monkeypatch.setattr(boosting, "_quantiles", lambda t, alphas, exact, own=boosting._quantiles: seen.append(t.count()) or own(t, alphas, exact))
    models = boosting.fit(df, ["a", "b"], "y", (0.5, 0.9), rounds=3, least=5)
    assert max(seen) == 2 * len(set(rows))
    monkeypatch.setattr(boosting, "EXACT", 0)
    assert boosting.fit(df, ["a", "b"], "y", (0.5, 0.9), rounds=3, least=5) == models  # by the sketch, which is exact here
