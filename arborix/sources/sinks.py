"""What runs leave behind: records, metadata, vectors, caches and checkpoints."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import texts
from ..schema import RANKS, conform


def write_conditions(texts_by_condition: DataFrame, path: str) -> None:
    """Serialized tables as JSON lines, a folder for each condition."""
    texts_by_condition.write.mode("overwrite").partitionBy("condition").json(path)


def write_operands(operands: DataFrame, path: str) -> DataFrame:
    """Operands as JSON lines; gives the histogram of operands per query."""
    operands.write.mode("overwrite").json(path)
    return operands.groupBy("query_id").agg(F.count("*").alias("m")).groupBy("m").agg(F.count("*").alias("n"))


def write_inventory(cells: DataFrame, path: str) -> None:
    """The header inventory of each table, in a folder by a name that is safe for files; where that changes the id, a hash of it parts the names."""
    safe = tx.collection_name("table_id")
    name = F.when(safe == F.col("table_id"), safe).otherwise(F.concat(F.substring(safe, 1, 46), F.lit("-"), F.substring(F.md5(F.col("table_id").cast("binary")), 1, 16)))
    texts.inventory(cells).withColumn("name", name).write.mode("overwrite").partitionBy("name").json(path)


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """Rank records: the contract between ranking and all metrics."""
    return conform(spark.read.schema(RANKS).json(path), RANKS)


def ranks_by_query(ranks: DataFrame) -> DataFrame:
    """(scheme, retriever, query_id, ranks): the few ranks of each query together, absent ones as null."""
    t = ranks.groupBy("scheme", "retriever", "query_id").agg(F.array_sort(F.collect_list(F.struct("cell", "rank"))).alias("x"))
    return t.select("scheme", "retriever", "query_id", F.transform("x", lambda v: v["rank"]).alias("ranks"))


def cached(spark: SparkSession, path: str, corpus: DataFrame, encoder: str, encode) -> DataFrame:
    """encode(corpus), kept in a folder by encoder and corpus; made again when either differs.

    The corpus is known by its size and a hash of its rows, whatever their order.
    """
    mark = corpus.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*corpus.columns)), F.lit(0)).alias("h")).first()
    at = f"{path}/{encoder}-{mark.n}-{mark.h & 0xFFFFFFFFFFFFFFFF:016x}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        encode(corpus).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def resumed(spark: SparkSession, todo: DataFrame, path: str, schema: str, work, key: str = "query_id") -> DataFrame:
    """Run work on what the sink at path does not hold yet, append it, and give all of it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    left = todo.join(spark.read.schema(schema).json(path).select(key), key, "left_anti") if there else todo
    work(left).write.mode("append").json(path)
    return spark.read.schema(schema).json(path)


def once_per_key(rows: DataFrame, keys: list[str], apply) -> DataFrame:
    """apply on distinct keys only, joined back: an expensive call is made once for equal inputs."""
    return rows.join(apply(rows.select(*keys).distinct()), keys)


def merged_config(parser: argparse.ArgumentParser, config: dict, argv: list[str]) -> argparse.Namespace:
    """Options from a config where the command line does not name them; unknown keys are an error."""
    known = {a.dest for a in parser._actions}
    if unknown := set(config) - known:
        raise ValueError(f"unknown options: {sorted(unknown)}")
    given = vars(parser.parse_args(argv))
    blank = argparse.ArgumentParser(argument_default=argparse.SUPPRESS, add_help=False)
    for a in parser._actions:
        if a.option_strings and a.dest != "help":
            blank._add_action(type(a)(**{k: getattr(a, k) for k in ("option_strings", "dest", "nargs", "const", "type", "choices") if getattr(a, k, None) is not None and not (type(a).__name__ in ("_StoreTrueAction", "_StoreFalseAction") and k in ("nargs", "const"))}, default=argparse.SUPPRESS))
    named = vars(blank.parse_known_args(argv)[0])
    return argparse.Namespace(**{**given, **{k: v for k, v in config.items() if k not in named}})


def report(rows: DataFrame) -> str:
    """A small result as JSON text (summaries only)."""
    return json.dumps([r.asDict(recursive=True) for r in rows.collect()], default=str)
