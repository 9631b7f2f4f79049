"""A corpus pipeline: quality, line dedup, near dedup, mixing and tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps;
the last one returns the ids of their tokens and the texts decoded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborix.llm import bpe, lines, mixing, quality, simhash, storage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed votes call bad go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line passages go; n_chars follows the text."""
    out = lines.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id, stays.

    Links are pairs with a Jaccard similarity of 0.8 of their five-word shingles.
    Of 512 bits 78 differ there on average, with a deviation of 8: candidates may
    differ in 96.
    """
    return simhash.keep_one(docs, shingle=5, n_words=8, distance=96, jaccard=0.8)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and topics have their target shares."""
    return mixing.sample(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, ids, n_tokens, text): text is decoded from the ids."""
    coded = bpe.encode(docs.select("doc_id", "source", "lang", "text"), bpe.default_vocabulary(), decoded_col="text")
    return coded.select("doc_id", "source", "lang", "ids", F.size("ids").cast("long").alias("n_tokens"), "text")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_dedup),
    ("mixing", mixing_sources),
    ("bpe", bpe_tokens),
]

#: Near duplicates and token ids have no SQL; tests hold the pipeline against SQL of its verdicts, lines and
#: mixture, all pairs of shingles and the tokenizers library, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each written and read again; what a stage leaves besides its result is deleted.

    Nulls may stand in any column: a null text counts as empty, which the
    quality rules reject; rows without an id are told apart by their texts;
    null sources and languages are values of their own.  Rows that repeat an id
    and a text count once from near-dedup on.  Other columns, whatever they are
    called, are kept up to the last stage.  An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        with storage.scratch(spark) as keep:
            after = keep(storage.save(stage(spark, docs, sf_dir), name.replace(" ", "_")))
        if k:
            storage.drop(docs)
        docs = after
    return docs
