"""The queries of this subpackage: thin adapters from the operators to fixed result columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes: (doc_id, fingerprint, component_id)."""
    from .simhash import near_duplicates

    found = near_duplicates(_docs(spark, sf_dir), shingle=3, n_words=1, distance=2)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked sampling: (doc_id, source, lang, topic, n_tokens, kept)."""
    from .mixing import mix

    rows, _ = mix(_docs(spark, sf_dir))
    return rows.select(F.col("_row.doc_id").alias("doc_id"), "source", "lang", "topic", "n_tokens", "kept")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Virtual slots: (doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot)."""
    from .sharding import shard

    rows, _ = shard(_docs(spark, sf_dir), shards=24)
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE round trip: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    from .bpe import default_vocabulary, round_trip

    return round_trip(_docs(spark, sf_dir), default_vocabulary()).withColumnRenamed("id", "doc_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line chunks: (doc_id, n_lines, n_removed, kept_md5)."""
    from .lines import dedup_lines

    rows = dedup_lines(_docs(spark, sf_dir), keep_columns=False)
    return rows.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kneser-Ney scores: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    from .language_model import fold, score, train

    docs = _docs(spark, sf_dir)
    held = fold(F.col("doc_id"), 7) == 2
    model = train(docs.filter(~held))
    rows = score(docs, model).withColumnRenamed("id", "doc_id")
    return rows.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores: (doc_id, held_out, score, predicted, flagged)."""
    from .toxicity import held_out, score, train_whole

    docs, labels = _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = train_whole(docs, labels.filter(~held_out(F.col("doc_id"))))
    rows = score(docs, net).withColumnRenamed("id", "doc_id")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "flagged")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak supervision: measures, base_failed and the posterior's verdict."""
    from .quality import quality

    rows = quality(_docs(spark, sf_dir))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated windows: (doc_id, n_words, n_removed, kept_sha256)."""
    from .substring import remove_repeats

    return remove_repeats(_docs(spark, sf_dir)).select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op10_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector classes: (vec_id, n_links, component_id, kept)."""
    from .nn_descent import near_duplicates

    found = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op11_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated byte strings: (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    from .suffixes import remove_repeated

    return remove_repeated(_docs(spark, sf_dir)).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw towards the benchmark's texts: (doc_id, n_features, weight, score, rank)."""
    from .importance import resample

    return resample(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters in every order: (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    from .audit import audit

    return audit(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline: (doc_id, source, lang, ids, n_tokens, text)."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_mixing, op3_sharding, op4_bpe, op5_line_dedup, op6_lm, op7_toxicity, op8_quality, op9_substring, op10_embedding, op11_suffix_array, op12_importance, op13_audit, pipeline)}
