"""Metrics, tests of significance and budgets against known values and plain Python."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborix.operators import coverage, linking, metrics, minisql, ranking, scoring, significance

RANKS = "query_id int, cell int, rank int"


def ranks(spark, d):
    return spark.createDataFrame([(q, c, r) for q, cells in d.items() for c, r in cells.items()], RANKS)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.tuples(*[st.one_of(st.none(), st.integers(1, 12))] * 2), min_size=1, max_size=4), min_size=1, max_size=8))
def test_gain_decomposition_is_the_definition(spark, pairs):
    """Queries of cells with their ranks in both arms, counted one by one."""
    arm = lambda i: ranks(spark, {q: {c: p[i] for c, p in enumerate(cells)} for q, cells in enumerate(pairs)})
    got = metrics.gain_decomposition(arm(0), arm(1), 5).first()
    within = lambda r: r is not None and r <= 5
    full = [[all(within(p[i]) for p in cells) for i in (0, 1)] for cells in pairs]
    gains = [cells for cells, (b, t) in zip(pairs, full, strict=True) if t and not b]
    pooled = [cells for cells in gains if all(p[0] is not None for p in cells)]
    assert (got.gain, got.loss) == (len(gains), sum(b and not t for b, t in full))
    assert (got.gain_rank_limited, got.gain_pool_limited) == (len(pooled), len(gains) - len(pooled))
    assert got.cells_missing == sum(p[0] is None for cells in gains for p in cells)
    assert got.cells_ranked_out == sum(p[0] is not None and p[0] > 5 for cells in gains for p in cells)
    assert got.oracle_base == pytest.approx(sum(len(cells) <= 5 and all(p[0] is not None for p in cells) for cells in pairs) / len(pairs), abs=1e-4)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(1, 60)), min_size=1, max_size=6))
def test_rank_metrics_are_the_definitions(spark, rs):
    got = metrics.per_query(ranks(spark, {0: dict(enumerate(rs))}), ks=(10,)).first()
    hit = [r is not None and r <= 10 for r in rs]
    ideal = sum(1 / math.log2(i + 1) for i in range(1, min(len(rs), 10) + 1))
    assert got.set_recall_10 == int(all(hit)) and got.hit_10 == int(any(hit))
    assert got.coverage_10 == pytest.approx(sum(hit) / len(rs))
    assert got.ndcg_10 == pytest.approx(sum(1 / math.log2(r + 1) for r, h in zip(rs, hit, strict=True) if h) / ideal)
    assert got.rr == pytest.approx(max((1 / r for r in rs if r), default=0))
    assert got.set_recall_10 <= got.coverage_10 <= got.hit_10


@pytest.mark.parametrize(("b", "c", "p"), [(6, 1, 0.125), (11, 2, 0.0224609), (0, 0, 1.0), (5, 5, 1.0)])
def test_mcnemar(spark, b, c, p):
    assert spark.range(1).select(significance.mcnemar(F.lit(b), F.lit(c)).alias("p")).first().p == pytest.approx(p, abs=1e-6)


def test_rank_tests(spark):
    v = spark.createDataFrame([(x, g) for x, g in [(1, True), (2, True), (2, False), (4, False), (5, False), (3, True)]], "rank int, colliding boolean")
    r = significance.mann_whitney(v).first()
    assert (r.n1, r.n2, r.u) == (3, 3, 1.5) and 0.1 < r.p < 0.4
    w = significance.wilcoxon(spark.createDataFrame([(float(i + 1), float(i)) for i in range(8)], "a double, b double"), "a", "b").first()
    assert (w.n, w.w) == (8, 0.0) and w.p < 0.02


def test_rank_tests_of_more_rows_than_a_long_holds_the_cube_of(spark):
    n = 1_800_000
    w = significance.wilcoxon(spark.range(n).select((F.col("id") % 2 * 2 - 1).cast("double").alias("a"), F.lit(0.0).alias("b")), "a", "b").first()
    assert (w.n, w.w) == (n, n / 2 * (n + 1) / 2) and w.p == pytest.approx(1, abs=1e-6)
    v = spark.range(100_000).select(F.lit(1).alias("g"), (F.col("id") % 7).cast("int").alias("rank"), (F.col("id") % 2 == 0).alias("colliding"))
    u, e = significance.mann_whitney(v).first(), significance.exact_rank_sum(v, "rank", "colliding", ["g"]).first()
    assert not e.exact and (e.n1, e.n2, e.u) == (u.n1, u.n2, u.u) and e.p == pytest.approx(u.p)


def test_exact_signed_ranks(spark):
    from itertools import product

    rng = __import__("random").Random(3)
    data = {g: [(float(rng.randint(0, 6)), float(rng.randint(0, 6))) for _ in range(n)] for g, n in (("a", 9), ("b", 5), ("c", 1), ("d", 40))}
    df = spark.createDataFrame([(g, x, y) for g, ps in data.items() for x, y in ps], "g string, x double, y double")
    got = {r.g: r for r in significance.exact_signed_rank(df, "x", "y", ["g"]).collect()}
    for g, ps in data.items():
        d = [x - y for x, y in ps if x != y]
        if not d:
            assert g not in got
            continue
        mid = [sum(abs(e) < abs(v) for e in d) + (sum(abs(e) == abs(v) for e in d) + 1) / 2 for v in d]
        w = min(sum(m for m, v in zip(mid, d) if v > 0), sum(m for m, v in zip(mid, d) if v < 0))
        assert (got[g].n, got[g].w) == (len(d), w)
        if len(d) <= 12:
            hits = sum(sum(m for m, s in zip(mid, signs) if s) <= w for signs in product((0, 1), repeat=len(d)))
            assert got[g].p == pytest.approx(min(1, 2 * hits / 2 ** len(d)))
        else:
            assert not got[g].exact and 0 < got[g].p <= 1  # by the normal approximation


def test_midranks_of_continuous_values(spark):
    rng = __import__("random").Random(4)
    values = [rng.choice([rng.random(), 0.5, float(rng.randint(0, 3))]) for _ in range(500)]
    got = {r.v: r.midrank for r in significance.midranks(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()}
    assert got == {v: sum(x < v for x in values) + (values.count(v) + 1) / 2 for v in values}


def test_bootstrap(spark):
    v = spark.createDataFrame([(i, float(i % 2)) for i in range(100)], "query_id int, d double")
    r = significance.bootstrap(v, rounds=400).first()
    assert r.mean == 0.5 and 0.38 < r.low < 0.47 and 0.53 < r.high < 0.62
    assert significance.bootstrap(v, rounds=400).first() == r
    assert significance.bootstrap(v.filter("d > 9"), rounds=10).first().low is None


def test_bootstrap_delta_resamples_every_order(spark, monkeypatch):
    from arborix.queries import evaluation

    seen, real = [], significance.bootstrap
    monkeypatch.setattr(significance, "bootstrap", lambda v, *a, **k: seen.append((v, a, k)) or real(v, *a, **k))
    records = evaluation.rank_records(spark, "/root/testdata/sf0.001")
    r = evaluation.bootstrap_delta(spark, "/root/testdata/sf0.001").first()
    (v, (_, rounds, _), _), = seen
    assert v.count() == records.select("query_id").distinct().count() > 200 and rounds == 10_000
    d = [x.d for x in v.collect()]
    mean = sum(d) / len(d)
    half = 1.96 * math.sqrt(sum((x - mean) ** 2 for x in d)) / len(d)
    assert r.mean == pytest.approx(mean)
    assert (r.low, r.high) == (pytest.approx(mean - half, abs=0.2 * half), pytest.approx(mean + half, abs=0.2 * half))


@pytest.mark.parametrize(
    ("pred", "gold", "want"),
    [("12", ["12.1"], True), ("0.12", ["12"], True), ("-12", ["12"], True), ("13", ["12"], False), ("", ["quebec"], False), (None, ["1"], False), ("in Quebec", ["quebec"], True), ("que", ["quebec"], False), ("3 and 4", ["3", "4"], True), ("3", ["3", "4"], False)],
)
def test_numeric_match(spark, pred, gold, want):
    df = spark.createDataFrame([(pred, gold)], "pred string, gold array<string>")
    assert df.select(metrics.numeric_match("pred", "gold").alias("x")).first().x is want


def test_failure_modes(spark):
    rows = [("12", ["12"], "correct"), ("no", ["12"], "abstain"), ("3", ["3", "4"], "aggregation_failure"), ("5000", ["12"], "wrong_cell"), ("15", ["12"], "off_by_small_factor"), ("x", ["y"], "text_mismatch")]
    df = spark.createDataFrame(rows, "pred string, gold array<string>, want string")
    assert all(r.got == r.want for r in df.select("want", metrics.failure_mode("pred", "gold").alias("got")).collect())


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=8), st.integers(1, 30))
def test_packing_is_the_greedy_loop(spark, lengths, budget):
    df = spark.createDataFrame([("q", i, "x" * n) for i, n in enumerate(lengths)], "q string, i int, text string")
    used, want = 0, []
    for i, n in enumerate(lengths):
        used += max(1, n // 4)
        if i and used > budget:
            break
        want.append(i)
    assert sorted(r.i for r in ranking.packed(df, budget, ["q"], "i").collect()) == want


def test_ladders(spark):
    found = spark.createDataFrame([("a", 1, 1), ("a", 2, 3), ("b", 1, 2)], "query_id string, cell int, rung int")
    gold = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 9)], "query_id string, cell int")
    assert {r.query_id: r.rung for r in ranking.first_complete_rung(found, gold).collect()} == {"a": 3, "b": None}


def test_minisql(spark):
    t = spark.createDataFrame([("t", 0, ["Ann", "G", "10"]), ("t", 1, ["Bob", "F", "20"]), ("t", 2, ["Cy", "G", "30"])], "table_id string, r int, values array<string>")
    q = spark.createDataFrame([("a", "t", 1, 0, [(0, 0, " bob ")]), ("b", "t", 2, 4, [(1, 0, "G")]), ("c", "t", 0, 4, []), ("d", "t", 2, 3, [(2, 1, "15")]), ("e", "t", 9, 0, [(9, 0, "x")]), ("f", "none", 0, 0, [])], "query_id string, table_id string, sel int, agg int, conds array<struct<col: int, op: int, value: string>>")
    got = {r.query_id: (r.answers, r.row_ids) for r in minisql.execute_all(t, q).collect()}
    assert got["a"] == (["F"], [1]) and got["b"] == (["40.0"], [0, 2]) and got["c"][0] == ["Ann", "Bob", "Cy"] and got["d"] == (["2"], [1, 2]) and got["e"] == ([], []) and got["f"][0] == []


def test_links(spark):
    t = spark.createDataFrame([("q", "t", "the payments volume ( billions ) of visa is 1,234 ; the cards of nobody is 5 ;")], "query_id string, table_id string, evidence string")
    rows = spark.createDataFrame([("t", 0, "Payments volume (billions)"), ("t", 1, "cards"), ("t", 2, "payments volume ( billions )")], "table_id string, at int, label string")
    cols = spark.createDataFrame([("t", 0, "company"), ("t", 1, "Visa")], "table_id string, at int, label string")
    assert [tuple(r) for r in linking.evidence_operands(t, rows, cols).select("r", "c", "value").collect()] == [(2, 1, 1234.0)]
    cells = spark.createDataFrame([("t", r, c, float(10 * r + c)) for r in range(4) for c in range(4)], "table_id string, r int, c int, num double")
    coords = spark.createDataFrame([("q", "t", r + 2, c + 1, float(10 * r + c)) for r, c in [(0, 0), (1, 2), (3, 3)]], "query_id string, table_id string, i int, j int, value double")
    assert tuple(linking.offset(coords, cells).first())[1:] == (2, 1)
    assert linking.offset(coords.unionByName(spark.createDataFrame([("q", "t", 2, 1, 99.0)], coords.schema)), cells).count() == 0


def test_fallback_reasons(spark):
    r = spark.createDataFrame([("a", 0, 0.0, 0.0), ("b", 2, 0.5, 0.1), ("c", 2, 0.5, 0.9), ("d", 2, 1.0, 0.1), ("e", 2, 1.0, 0.9)], "query_id string, n_operands int, coverage double, confidence double")
    assert {x.query_id: x.reason for x in coverage.decided(r).collect()} == {"a": "no_operands", "b": "low_both", "c": "low_coverage", "d": "low_confidence", "e": "ok"}


def test_scores(spark):
    q = spark.createDataFrame([("q", "bonds 2023")], "query_id string, question string")
    c = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(["cash 2022 2023", "bonds 2022 2023", "stocks 2022 2023"])], "chunk_id string, text string")
    assert scoring.top_k(scoring.bm25(q, c), 1, ["query_id"], "chunk_id").first().chunk_id == "c1"
    same = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 1.0)], "query_id string, chunk_id string, score double")
    assert {r.score for r in scoring.minmax(same, ["query_id"]).collect()} == {0.0}
    assert scoring.top_k(same, 9, ["query_id"], "chunk_id").count() == 2
    f = {r.chunk_id: r.score for r in scoring.rrf([same, same]).collect()}
    assert f["a"] == pytest.approx(2 / 61) and f["b"] == pytest.approx(2 / 62)
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "chunk_id int, v array<double>")
    near = scoring.dense_topk(v.select(F.col("chunk_id").alias("query_id"), F.col("v").alias("qv")).filter("query_id = 7"), v, 3)
    assert [r.chunk_id for r in near.orderBy("rank").collect()] == [7, 8, 6]


def test_block_scores_are_those_of_pairs(spark, monkeypatch):
    """BM25 and hashed vectors in small blocks and several passes, against the joins; ties go to the least key."""
    rng = __import__("random").Random(5)
    text = lambda n: " ".join(rng.choice(["cash", "bonds", "2022", "2023", "total", "tax", "of", "a"]) for _ in range(n))
    chunks = spark.createDataFrame([(i, text(rng.randint(0, 9))) for i in range(300)] + [(400, None)], "chunk_id int, text string")
    queries = spark.createDataFrame([(f"q{i}", text(rng.randint(1, 4))) for i in range(30)] + [("none", "zebra"), ("empty", "")], "query_id string, question string")
    for name, value in (("ROWS", 16), ("WEIGHTS", 40), ("QUERIES", 7), ("CHUNKS", 50)):
        monkeypatch.setattr(scoring, name, value)
    for best, scores in ((scoring.bm25_topk, scoring.bm25), (scoring.hashed_topk, scoring.hashed_cosine)):
        want = {(r.query_id, r["rank"]): (r.chunk_id, round(r.score, 6)) for r in scoring.top_k(scores(queries, chunks), 5, ["query_id"], "chunk_id").collect()}
        got = {(r.query_id, r["rank"]): (r.chunk_id, round(r.score, 6)) for r in best(queries, chunks, 5).collect()}
        assert got == want and len(want) >= 150


def test_encoders_are_named_and_fall_back_only_if_allowed(spark):
    with pytest.raises(ValueError):
        scoring.chosen_encoder()
    own = ("lengths", lambda rows, key, text: rows.select(key, F.array(F.length(text).cast("double"), F.lit(1.0)).alias("v")))
    assert scoring.chosen_encoder(own) is own and scoring.chosen_encoder(allow_fallback=True)[0] == "hashing-512"
    q = spark.createDataFrame([("q", "abc")], "query_id string, question string")
    c = spark.createDataFrame([("c1", "abcd"), ("c2", "xyz"), ("c3", "")], "chunk_id string, text string")
    got = scoring.encoded_topk(q, c, 2, own).collect()
    assert [(r.chunk_id, r.encoder) for r in sorted(got, key=lambda r: r["rank"])] == [("c2", "lengths"), ("c1", "lengths")]


def test_throttled_windows_are_the_brute_force_in_running_sums(spark):
    from datetime import datetime, timedelta

    rng = __import__("random").Random(5)
    t0, second = datetime(1969, 12, 31, 23, 59, 50), 1_000_000
    rows = [(i, rng.choice("ab"), None if i % 17 == 0 else rng.choice((0, 1, second, 3 * second, rng.randrange(20 * second))), None if i % 5 == 0 else rng.randrange(-3, 40)) for i in range(300)] + [(300, "c", 0, None)]
    df = spark.createDataFrame([(i, k, None if u is None else t0 + timedelta(microseconds=u), n) for i, k, u, n in rows], "i long, k string, ts timestamp, tokens int")
    got = ranking.throttled(df, 60, by=["k"], seconds=2)
    for r in got.collect():
        _, k, u, _ = rows[r.i]
        inside = [n for _, k2, v, n in rows if k2 == k and n is not None and (v is None if u is None else v is not None and u - 2 * second <= v <= u)]
        assert r.window_tokens == (sum(inside) if inside else None) and r.allowed == (None if not inside else sum(inside) <= 60)
    assert got.count() == len(rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, unboundedpreceding" in plan and "RangeFrame, -" not in plan  # no window is added up anew for each call


def test_copies_of_queries_never_pass_the_driver(spark):
    """Each block of chunks meets all queries: their copies grow with both sides."""
    v = spark.range(300).select(F.col("id").alias("chunk_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    q = v.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("v").alias("qv"))
    t = scoring.dense_topk(q, v, 2)
    assert t.count() == 30
    t.collect()
    assert "BroadcastExchange" not in t._jdf.queryExecution().executedPlan().toString()
