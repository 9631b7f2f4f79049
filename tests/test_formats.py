"""Benchmark files through spark.read.format: every line once whatever the ranges, files pruned by pushed filters."""

import io
import json

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from arborix.sources import benchmarks, formats


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    formats.register(spark)
    at = tmp_path_factory.mktemp("bench")
    for split, n in (("dev", 40), ("train", 7), ("test", 0)):
        rows = [{"id": f"{split}{i}", "table_id": str(i % 5), "question": "é " * (i % 9) + str(i), "answer": [i, "x", 1.5], "aggregation": ["sum"], "linked_cells": {"quantity_link": {"a": {"(1, 2)": "3"}}}} for i in range(n)]
        (at / f"{split}_samples.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + ("\n\nnot json\n[1]\n" if split == "train" else ""), encoding="utf-8")
    for k, name in (("first", "a"), ("second", "b")):
        (at / k).mkdir()
        for i in range(4) if k == "first" else range(2, 6):
            (at / k / f"{i}.json").write_text(json.dumps({"title": name * (i + 1)}))
    return str(at)


@pytest.mark.parametrize("size", [301, 1 << 20])
def test_each_line_once(spark, folder, size):
    got = spark.read.format("table_samples").option("rangeBytes", size).load(folder)
    rows = got.filter("split = 'dev'").orderBy("id").collect()
    assert len(rows) == 40 and len({r.id for r in rows}) == 40
    want = {r.id: r for r in benchmarks.samples(spark, f"{folder}/dev_samples.jsonl").collect()}
    assert all((r.question, r.answer, r.aggregation, r.query, json.loads(r.linked_cells)) == (w.question, w.answer, w.aggregation, w.query, json.loads(w.linked_cells)) for r in rows for w in [want[r.id]])
    assert got.filter("split = 'train' and id is null").count() == 2 and got.filter("split = 'test'").count() == 0


@pytest.mark.parametrize("size", [1, 2, 5, 100])
def test_lines_of_ranges(size):
    text = b"a\n\nlonger line\n\xc3\xa9\nend"
    parts = [list(formats._lines(io.BufferedReader(io.BytesIO(text)), a, min(a + size, len(text)))) for a in range(0, len(text), size)]
    assert b"".join(x for p in parts for x in p) == text


def test_filters_are_pushed(spark, folder, capsys):
    d = spark.read.format("table_samples").load(folder).filter("split = 'dev' and table_id in ('1', '2') and length(question) > 2")
    d.explain("formatted")
    plan = capsys.readouterr().out
    pushed = plan.split("PushedFilters:")[1].split("\n")[0]
    assert "EqualTo(split,dev)" in pushed and "In(table_id, [1,2])" in pushed
    after = plan.split("Condition :")[1].split("\n")[0]
    assert "dev" not in after and "table_id" not in after and "length" in after
    assert {r.table_id for r in d.collect()} == {"1", "2"}


def test_reader_prunes_files(folder):
    r = formats.SamplesReader({"path": folder, "rangeBytes": "100"})
    left = list(r.pushFilters([EqualTo(("split",), "train"), In(("id",), ("train1", "dev2")), EqualTo(("id",), "train1"), GreaterThan(("id",), "a")]))
    assert len(left) == 1 and isinstance(left[0], GreaterThan)
    parts = r.partitions()
    assert {p.split for p in parts} == {"train"} and len(parts) > 3
    assert [x[0] for p in parts for x in r.read(p)] == ["train1"]
    with pytest.raises(ValueError, match="positive"):
        formats.SamplesReader({"path": folder, "rangeBytes": "0"})


def test_documents(spark, folder):
    d = spark.read.format("table_documents").option("otherwise", f"{folder}/second").load(f"{folder}/first")
    title = {r.table_id: json.loads(r.raw)["title"] for r in d.collect()}
    assert title == {"0": "a", "1": "aa", "2": "aaa", "3": "aaaa", "4": "bbbbb", "5": "bbbbbb"}
    assert [r.table_id for r in d.filter("table_id = '5'").collect()] == ["5"]
    r = formats.DocumentsReader({"path": f"{folder}/first", "rangeBytes": "20"})
    list(r.pushFilters([In(("table_id",), ("1", "3", "9"))]))
    assert [p.paths[0][-6:] for p in r.partitions()] == ["1.json", "3.json"]
