"""Tables dealt into parts by their rows, policies and completeness without joins by more than the query."""

import math

from pyspark.sql import functions as F

from arborix.operators import metrics
from arborix.plans import pipelines
from arborix.queries import base, hits

DIR = "/root/testdata/sf0.001"


def test_tasks_hold_as_many_lines_of_large_tables_as_of_small_ones(spark, monkeypatch):
    n = base.table(spark, DIR, "lineitem").count()
    monkeypatch.setattr(base, "PART", 500)
    ranks = base.rank_records(spark, DIR)
    assert ranks.rdd.getNumPartitions() == math.ceil(n / 500)
    per = metrics.per_query(ranks, by=("arm", "query_id"))
    assert per._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert per.count() == ranks.select("arm", "query_id").distinct().count()
    assert hits._lines(spark, DIR).rdd.getNumPartitions() == math.ceil(n / 500)


def test_policies_of_a_ladder(spark):
    ladder = spark.createDataFrame([(1, 1, 10, False), (1, 2, 20, True), (1, 3, 30, True), (2, 1, 11, False), (2, 2, 21, False), (3, 1, 12, None)], "query_id long, rung int, n_cells int, complete boolean")
    features = spark.createDataFrame([(1, 3), (2, 9), (4, 1)], "query_id long, m int")
    t = pipelines.selector_policies(ladder, features, {"own": F.col("m")})
    assert sorted(tuple(r) for r in t.collect()) == [("oracle", 53 / 3, 20.0, 0.5, 3), ("own", 30.0, 30.0, 1.0, 1), ("rung_1", 11.0, 11.0, 0.0, 3), ("rung_2", 20.5, 20.5, 0.5, 2), ("rung_3", 30.0, 30.0, 1.0, 1)]
    assert t._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_completeness_without_a_join(spark):
    cells = lambda *rows: spark.createDataFrame(rows, "query_id long, r int, c int")
    t = metrics.completeness(cells((1, 1, 1), (1, 1, 1), (1, 1, 2), (2, 0, None), (3, 0, 0)), cells((1, 1, 1), (1, 1, 1), (2, 0, None), (3, 0, 0), (3, 5, 5), (4, 0, 0)))
    assert sorted(tuple(r) for r in t.collect()) == [(1, 2, 0, 0.5), (2, 1, 0, 0.0), (3, 1, 1, 1.0)]
    assert "Join" not in t._jdf.queryExecution().optimizedPlan().toString()


def test_votes_read_a_number_once_for_each_sample_and_floor(spark):
    from arborix.operators import evaluation

    s = spark.createDataFrame([(1, 0, "50", True), (1, 1, "49.5", True), (1, 2, "-50", False), (2, 0, "a", True), (2, 1, " B", True), (2, 2, "b", True), (3, 1, None, True)], "query_id long, k int, pred string, clean boolean")
    t = evaluation.vote(s)
    assert sorted((r.query_id, r.answer) for r in t.collect()) == [(1, "50"), (2, " B"), (3, None)]
    assert t._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 2


def test_the_funnel_parses_tables_once(spark, monkeypatch):
    from arborix.queries import sources

    kept = []
    monkeypatch.setattr(sources, "stored", lambda rows, label, own=sources.stored: kept.append(label) or own(rows, label))
    t = sources.evidence_funnel(spark, DIR)
    assert kept == ["filings", "cells", "lost"]
    assert "Python" not in t._jdf.queryExecution().optimizedPlan().toString()  # all that is parsed is stored


def test_sales_cells_are_summed_once_for_all_rounds_of_repair(spark, monkeypatch):
    from arborix.queries import served

    plan = base.sales_cells(spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    kept = []
    monkeypatch.setattr(base, "stored", lambda rows, label, own=base.stored: kept.append(label) or own(rows, label))
    assert served.repair_rounds(spark, DIR).count() > 0 and kept == ["cells"]
