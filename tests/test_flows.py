"""Sources, sinks, streams, pipelines and the entry module."""

import argparse
import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from arborix.operators import texts
from arborix.plans import pipelines
from arborix.sources import benchmarks, sinks
from arborix.sources import vectors as vector_sources
from arborix.streaming import live

REPO = Path(__file__).resolve().parent.parent


def test_hierarchical_benchmark(spark, tmp_path):
    node = lambda v, line=None, kids=(): {"value": v, "line_idx": line, "children": list(kids)}
    table = {"title": "demo", "top_root": node("<TOP>", None, [node("year", None, [node("2013", 0), node("2014", 1)])]), "left_root": node("<LEFT>", None, [node("industry", 0, [node("mining", 1)])]), "data": [[{"value": 10}, {"value": "12"}], [{"value": 5.5}, {"value": None}]]}
    (tmp_path / "tables/hmt").mkdir(parents=True)
    (tmp_path / "tables/raw").mkdir()
    (tmp_path / "tables/hmt/t1.json").write_text(json.dumps(table))
    (tmp_path / "tables/raw/t1.json").write_text("{}")
    sample = {"id": "q1", "table_id": "t1", "question": "", "sub_sentence": "mining in 2013?", "answer": ["5.5"], "aggregation": ["none"], "answer_formulas": ["=B4"], "linked_cells": json.dumps({"quantity_link": {"[ANSWER]": {"(3, 1)": 5.5, "(2, 2)": 12}}})}
    (tmp_path / "dev_samples.jsonl").write_text(json.dumps(sample))
    q, cells, ops = benchmarks.load(spark, "hitab", str(tmp_path))
    assert q.first().question == "mining in 2013?"
    got = {(r.r, r.c): (r.raw, r.num, r.row_path, r.col_path) for r in cells.collect()}
    assert got[1, 0] == ("5.5", 5.5, ["industry", "mining"], ["year", "2013"])
    assert got[0, 1][2:] == (["industry"], ["year", "2014"]) and got[1, 1][1] is None
    assert {(r.r, r.c, r.value) for r in ops.collect()} == {(1, 0, 5.5), (0, 1, 12.0)}
    with pytest.raises(ValueError):
        benchmarks.load(spark, "none", "")


def test_flat_benchmarks(spark, tmp_path):
    spark.createDataFrame([("q", "what?", "5", [["company", "visa", "mc"], ["cards", "10", "20"], ["volume", "$1,5", ""]], ["the cards of visa is 10 ;"])], "id string, question string, answer string, table array<array<string>>, gold_evidence array<string>").write.parquet(f"{tmp_path}/f")
    _, cells, ops = benchmarks.finqa(spark, f"{tmp_path}/f")
    assert cells.count() == 6 and tuple(ops.select("r", "c", "value").first()) == (0, 1, 10.0)
    table, sql = ("w", ["Name", "Pos"], [["Ann", "G"], ["Bob", "F"]], "cap", "page"), (1, 0, ([0], [0], ["Bob"]))
    spark.createDataFrame([("Bob?", table, sql)], "question string, table struct<id: string, header: array<string>, rows: array<array<string>>, caption: string, page_title: string>, sql struct<sel: int, agg: int, conds: struct<column_index: array<int>, operator_index: array<int>, condition: array<string>>>").write.parquet(f"{tmp_path}/w")
    _, cells, answers = benchmarks.wikisql(spark, f"{tmp_path}/w")
    assert answers.first().answers == ["F"] and cells.count() == 4
    doc = {"uid": "u", "tables": ["<table><tr><td>x</td><td>2019</td></tr><tr><td>a</td><td>(1)</td></tr></table>"], "table_description": {}, "qa": {"question": "?", "question_type": "arithmetic", "program": "add(1,2)", "table_evidence": ["0-1-1", "0-1-0"], "text_evidence": [], "answer": "3"}}
    (tmp_path / "m.json").write_text(json.dumps([doc]))
    q, cells, funnel = benchmarks.multihiertt(spark, f"{tmp_path}/m.json")
    assert q.first().table_id == "u#0" and funnel.first().multi_operand == 1
    assert [(r.row_path, r.col_path, r.raw) for r in cells.collect()] == [(["a"], ["2019"], "(1)")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("S2", "bm25", "q", "c1", 3, True, False), ("S2", "bm25", "q", "c2", None, False, False)], "scheme string, retriever string, query_id string, cell string, rank int, colliding boolean, total_like boolean")
    rows.write.json(f"{tmp_path}/ranks")
    assert sinks.ranks_by_query(sinks.read_ranks(spark, f"{tmp_path}/ranks")).first().ranks == [3, None]
    store = vector_sources.VectorStore(spark, str(tmp_path))
    store.add("a b", spark.createDataFrame([("t1", "c1", "x", [1.0, 0.0]), ("t2", "c2", "y", [0.0, 1.0])], "table_id string, chunk_id string, text string, v array<double>"))
    near = store.search("a b", spark.createDataFrame([("q", [1.0, 0.1])], "query_id string, qv array<double>"))
    assert near.filter("rank = 1").first().table_id == "t1"
    calls = []
    encode = lambda d: calls.append(1) or d.withColumn("v", F.lit(1))
    for _ in range(2):
        assert sinks.cached(spark, str(tmp_path / "cache"), rows.select("cell"), "e", encode).count() == 2
    assert len(calls) == 1
    todo = spark.createDataFrame([("a",), ("b",)], "query_id string")
    done = [sinks.resumed(spark, todo.limit(n), str(tmp_path / "out"), "query_id string, x int", lambda d: d.withColumn("x", F.lit(1))).count() for n in (1, 2, 2)]
    assert done == [1, 2, 2]
    cells = spark.createDataFrame([("t/1", "x", 0, 0, "1", 1.0, ["a"], ["b"])], "table_id string, title string, r int, c int, raw string, num double, row_path array<string>, col_path array<string>")
    sinks.write_inventory(cells, str(tmp_path / "inv"))
    assert spark.read.json(str(tmp_path / "inv")).first()["name"].startswith("t_1-")


def test_record_sinks(spark, tmp_path):
    t = spark.createDataFrame([("C0", "t1", "a"), ("C1", "t1", "b"), ("C1", "t2", "c")], "condition string, table_id string, text string")
    sinks.write_conditions(t, str(tmp_path / "texts"))
    assert {r.text for r in spark.read.json(str(tmp_path / "texts/condition=C1")).collect()} == {"b", "c"}
    ops = spark.createDataFrame([("q1", 0, 0), ("q1", 0, 1), ("q2", 1, 1)], "query_id string, r int, c int")
    assert {(r.m, r.n) for r in sinks.write_operands(ops, str(tmp_path / "ops")).collect()} == {(2, 1), (1, 1)}
    assert spark.read.json(str(tmp_path / "ops")).count() == 3


def test_config():
    p = argparse.ArgumentParser()
    p.add_argument("--k", type=int, default=5)
    p.add_argument("--name", default="x")
    assert vars(sinks.merged_config(p, {"k": 9, "name": "y"}, ["--name", "z"])) == {"k": 9, "name": "z"}
    with pytest.raises(ValueError):
        sinks.merged_config(p, {"nope": 1}, [])


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rec = lambda t, rank: json.dumps({"scheme": "S2", "retriever": "bm25", "query_id": "q", "cell": t, "rank": rank, "ts": f"2024-01-01T00:{t}:00"})
    (tmp_path / "in/a.json").write_text("\n".join([rec("00", 1), rec("00", 20), rec("30", 2), rec("50", 3)]))
    q = live.append_results(live.windowed_metrics(live.rank_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {r.start.minute: (r.n, r.coverage) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[0] == (2, 0.5)


def test_streams_of_calls_and_repeats(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:05", 10), ("b", "2024-01-01 00:00:15", 20), ("a", "2024-01-01 00:00:20", 30), ("c", "2024-01-01 01:00:00", 1)], "key string, ts string, tokens long").selectExpr("key", "timestamp(ts) ts", "tokens")
    rows.coalesce(1).write.parquet(str(tmp_path / "calls"))
    calls = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "calls"))
    for name, stream in (("use", live.token_use(calls(), 20, 10)), ("new", live.new_only(calls(), ["key"]))):
        live.append_results(stream, str(tmp_path / name), str(tmp_path / f"{name}-cp")).awaitTermination(120)
    use = {r.start.strftime("%M:%S"): (r.tokens, r.calls) for r in spark.read.parquet(str(tmp_path / "use")).collect()}
    assert use["00:00"] == (30, 2) and use["00:10"] == (50, 2) and use["00:20"] == (30, 1)
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "new")).collect()) == ["a", "b", "c"]


def test_evidence_is_checked_by_value(spark):
    html = "<table><tr><td>x</td><td>2019</td></tr><tr><td>a</td><td>(1)</td></tr><tr><td>b</td><td>7</td></tr></table>"
    doc = lambda uid, said: (uid, [html], {"0-1-1": "The a of 2019 is (1).", "0-2-1": said}, ("?", "arithmetic", "add(1,2)", ["0-1-1", "0-2-1"], [], "3"))
    docs = spark.createDataFrame([doc("u", "The b of 2019 is 7."), doc("v", "The b of 2019 is 70."), doc("w", "nothing")], benchmarks.QA)
    q, _, funnel = benchmarks.multihiertt_of(docs)
    f = funnel.first()
    assert (f.questions, f.multi_operand, f.value_validated) == (3, 3, 2)
    assert {r.query_id for r in q.collect()} == {"u", "w"}


def test_deep_trees(spark):
    node = {"value": "leaf", "line_idx": 0}
    for k in range(40):
        node = {"name": f"n{k}", "children": [node]}
    raw = spark.createDataFrame([("t", json.dumps({"title": "", "top_root": node, "left_root": {"value": "<LEFT>", "children": [{"value": "r", "line_idx": 0}]}, "data": [[{"value": 1}, {}]]})), ("bad", "{"), ("none", None)], "table_id string, raw string")
    cells = {r.c: r for r in benchmarks.tree_cells(raw).collect()}
    assert cells[0].col_path == [f"n{k}" for k in reversed(range(40))] + ["leaf"] and cells[0].row_path == ["r"] and cells[1].raw is None
    assert benchmarks.tree_nodes(raw).count() == 43
    loop = spark.createDataFrame([("t", "1", "2", "a", 0), ("t", "2", "1", "b", 1), ("t", "3", "9", "c", 2), ("t", "4", None, "d", 3)], "table_id string, node string, parent string, name string, line int")
    assert {r.line: r.path for r in benchmarks.structure.tree_paths(loop).collect()} == {3: ["d"]}


def test_pipelines(spark):
    cells = spark.createDataFrame(
        [("t", "holdings", r, c, str(10 * (r + 1) + c), float(10 * (r + 1) + c), ["assets", n], ["year", y]) for r, n in enumerate(["cash", "bonds", "stocks"]) for c, y in enumerate(["2022", "2023"])],
        "table_id string, title string, r int, c int, raw string, num double, row_path array<string>, col_path array<string>",
    )
    q = spark.createDataFrame([("q", "t", "bonds in 2023", ["21"])], "query_id string, table_id string, question string, answer array<string>")
    gold = spark.createDataFrame([("q", "t", 1, 1)], "query_id string, table_id string, r int, c int")
    ranks = pipelines.collision_study(q, cells, gold).collect()
    assert len(ranks) == 9 and all(r.rank <= 2 for r in ranks if r.scheme != "flat" and r.retriever == "bm25")
    recall = {(r["mode"], r.k): r.recall for r in pipelines.operand_retrieval(q, cells, gold).collect()}
    assert recall["plain", 1] == 1.0 and recall["operand", 1] == 1.0
    plans = spark.createDataFrame([("q", "x - y", [("x", "bonds", "2023"), ("y", "cash", "2022")])], "query_id string, expression string, cells array<struct<var: string, row_header: string, col_header: string>>")
    a = pipelines.agent_evaluation(q, cells, plans, pipelines.mock_reader).first()
    assert (a.source, a.error) == ("reader", None) and a.pred == "10"
    assert texts.whole_tables(cells).count() == 1


def test_readers_and_synthetic_questions(spark):
    cells = spark.createDataFrame([("t", "holdings", r, c, str(10 * (r + 1) + c), float(10 * (r + 1) + c), ["assets", n], ["year", y]) for r, n in enumerate(["cash", "bonds", "stocks"]) for c, y in enumerate(["2022", "2023"])], "table_id string, title string, r int, c int, raw string, num double, row_path array<string>, col_path array<string>")
    q = spark.createDataFrame([("a", "t", "list the bonds in 2023"), ("b", "t", "stocks in 2022?"), ("c", "t", "difference between cash and bonds")], "query_id string, table_id string, question string")
    code = lambda question, context: F.when(F.contains(question, F.lit("difference")), "print(20 - 10)").otherwise("import os")
    got = {r.query_id: (r.route, r.source, r.pred) for r in pipelines.routed_answers(q, cells, pipelines.Reader(code_for_query=code)).collect()}
    assert got == {"a": ("beta", "subtable", "10"), "b": ("gamma", "full", "10"), "c": ("gamma", "code", "10")}
    assert pipelines.synthetic_questions("template", cells, n=2).count() == 2
    made = pipelines.synthetic_questions("llm:stub", cells, lambda text: F.lit("one?\n\n two? \nthree?\nfour?")).orderBy("k").collect()
    assert [(r.k, r.question) for r in made] == [(1, "one?"), (2, "two?"), (3, "three?")]
    with pytest.raises(ValueError):
        pipelines.synthetic_questions("llm:stub", cells)


def test_entry_imports_without_a_session_and_without_the_corpus_operators(tmp_path):
    code = "import sys; sys.modules['arborix.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op1_') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], cwd=REPO, check=True)
