"""The pruned join by words holds the n best of all pairs, and nothing is compared that can't be among them."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborix.functions.udfs import path_similarity, store_similarity
from arborix.operators import likeness, questions

WORDS = "sales net total asia europe japan 1995 1996 gross unit été k9 x".split()


@pytest.fixture(scope="module")
def relations(spark):
    rng = random.Random(3)
    ask = [(f"q{i}", f"t{i % 3}", " ".join(rng.choices(WORDS, k=rng.randint(1, 5)))) for i in range(30)]
    ask += [("empty", "t0", ""), ("null", "t0", None), ("apart", "t1", "qqq www"), ("long", "t2", "sales " * 3 + "zz " * 150), ("lost", "t9", "sales")]
    paths = {(f"t{rng.randint(0, 2)}", tuple(rng.choices(WORDS, k=rng.randint(1, 6)))) for _ in range(150)}
    paths |= {("t0", ("--",)), ("t2", ("sales", "ab " * 120)), ("t2", ("Sales", "b" * 250)), ("t0", ())}
    return spark.createDataFrame(ask, "query_id string, table_id string, question string"), spark.createDataFrame([(t, list(p)) for t, p in sorted(paths)], "table_id string, path array<string>")


@pytest.mark.parametrize("by", likeness.BY)
@pytest.mark.parametrize("n", [1, 4, 500])
def test_same_ranking_as_all_pairs(relations, by, n):
    q, p = relations
    every = q.select("query_id", "table_id", questions.terms("question").alias("terms")).join(p, "table_id")
    like = store_similarity(F.array_join("terms", " "), "path") if by == "store" else path_similarity("terms", F.array_join("path", " > "))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.array_join("path", " > "))
    want = every.withColumn("score", like).filter("score > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    rows = lambda d: sorted((r.query_id, r["rank"], tuple(r.path), round(r.score, 12)) for r in d.collect())
    got = rows(questions.path_ranking(q, p, n, by))
    assert got == rows(want) and len(got) > 20


def test_bounds_hold_and_prune(relations):
    q, p = relations
    asked = q.select("query_id", "table_id", questions.terms("question").alias("terms"))
    for by in likeness.BY:
        for r in likeness.candidates(asked, p, 500, by).collect():
            score = 0.7 * r.n_shared / max(r.n_of, 1) + 0.3 * SequenceMatcher(None, r.a, r.b).ratio()
            assert r.low - 1e-12 <= score <= r.high + 1e-12
    cost = {r.query_id: (r.n_pairs, r.n_scored) for r in likeness.pruning(asked, p, 2).collect()}
    assert "empty" not in cost and "null" not in cost and cost["apart"][1] == 0
    assert sum(n for _, n in cost.values()) < 0.4 * sum(n for n, _ in cost.values())


def test_unknown_likeness(relations):
    with pytest.raises(ValueError, match="no such likeness"):
        likeness.candidates(*relations, 3, "other")


def test_empty_tables(relations):
    q, p = relations
    assert questions.path_ranking(q.limit(0), p, 3).count() == questions.path_ranking(q, p.limit(0), 3, "decomposer").count() == 0
