"""Work that is done once for each key, and vectors that are encoded once for each text."""

import pytest
from pyspark.sql import functions as F

from arborix.operators import scoring
from arborix.sources import commits


def test_a_killed_run_leaves_each_key_once(spark, tmp_path):
    todo = spark.createDataFrame([(f"q{i}", i) for i in range(40)] + [("q1", 1)], "query_id string, n int")
    log = commits.CommitLog(spark, str(tmp_path / "log"), slices=4)
    assert log.read() is None
    calls = {"n": 0}

    def work(rows):
        calls["n"] += 1
        if calls["n"] == 3:
            raise RuntimeError("killed")
        return rows.select("query_id", (F.col("n") * 2).alias("twice"))

    with pytest.raises(RuntimeError):
        log.run(todo, work)
    assert 0 < log.read().count() < 40
    # a slice that was written but not committed is not read
    todo.select("query_id", F.lit(-1).alias("twice")).write.parquet(str(tmp_path / "log/gen-0/slice-3-lost"))
    got = log.run(todo, work)
    assert sorted((r.query_id, r.twice) for r in got.collect()) == sorted((f"q{i}", 2 * i) for i in range(40))
    assert calls["n"] == 5  # two slices, one that died, and the two that were left
    assert log.vacuum() == 1 and log.read().count() == 40
    again = commits.CommitLog(spark, str(tmp_path / "log"), slices=4)
    grown = todo.unionByName(spark.createDataFrame([("new", 7)], todo.schema))
    got = again.run(grown, lambda rows: rows.select("query_id", (F.col("n") * 2).alias("twice")))
    assert got.count() == 41 and got.filter("query_id = 'new'").first().twice == 14
    assert again.run(grown, None).count() == 41  # nothing is left: no work


def test_two_runs_commit_a_slice_once(spark, tmp_path):
    todo = spark.createDataFrame([(i,) for i in range(20)], "query_id int")
    first, second = (commits.CommitLog(spark, str(tmp_path / "log"), slices=2) for _ in range(2))

    def work(rows):  # while the first is at work, the second does all
        if second.read() is None:
            second.run(todo, lambda r: r.withColumn("by", F.lit("second")))
        return rows.withColumn("by", F.lit("first"))

    got = first.run(todo, work)
    assert got.count() == 20 and {r.by for r in got.collect()} == {"second"}


def test_a_grown_corpus_encodes_what_is_new(spark, tmp_path):
    name, encode = scoring.hashing_encoder()
    seen = []

    def counting(rows, key, text):
        seen.append(rows.count())
        return encode(rows, key, text)

    rows = [(1, "a b c"), (2, "a b c"), (3, None), (4, "d e")]
    corpus = spark.createDataFrame(rows, "chunk_id int, text string")
    got = {r.chunk_id: r.v for r in commits.cached_vectors(corpus, str(tmp_path), (name, counting)).collect()}
    want = {r.chunk_id: r.v for r in encode(corpus.fillna(""), "chunk_id", "text").collect()}
    assert got == want and seen == [3]
    more = corpus.unionByName(spark.createDataFrame([(5, "f"), (6, "d e")], corpus.schema))
    assert commits.cached_vectors(more, str(tmp_path), (name, counting)).count() == 6 and seen == [3, 1]
    commits.cached_vectors(more, str(tmp_path), (name, counting)).count()
    assert seen == [3, 1]
    commits.cached_vectors(more, str(tmp_path), ("another", counting)).count()
    assert seen == [3, 1, 4]
