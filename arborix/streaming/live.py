"""Metrics and throttling over streams of rank records.  An extension: nothing here has a batch-only meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RANKS


def rank_stream(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """New JSONL files of rank records with their event time ``ts``."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in RANKS), "ts timestamp"])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def windowed_metrics(ranks: DataFrame, k: int = 10, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Coverage and reciprocal rank of operands by event-time window, scheme and retriever."""
    hit = F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")
    t = ranks.withWatermark("ts", late).groupBy(F.window("ts", window), "scheme", "retriever")
    out = t.agg(F.count("*").alias("n"), F.avg(hit).alias("coverage"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "scheme", "retriever", "n", "coverage", "mrr")


def token_use(calls: DataFrame, seconds: int = 60, slide: int = 10, late: str = "2 minutes") -> DataFrame:
    """Tokens in sliding windows of calls (ts, tokens): what a throttle watches."""
    t = calls.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds", f"{slide} seconds"))
    return t.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls")).select(F.col("window.start").alias("start"), "tokens", "calls")


def new_only(records: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Records whose key has not been seen within the watermark."""
    return records.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def append_results(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream's rows to a Parquet sink, each once, for all that is there now."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
