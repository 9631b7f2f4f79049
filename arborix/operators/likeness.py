"""Which paths are most like a question's terms: a join by words, pruned by bounds before any two strings are compared.

A score has a part of words shared, which is counted, and a part of likeness of
two strings, which costs Python.  A pair is found at the least word that its two
sides share, so it is met once and no pair without a shared word becomes a row.
The likeness lies between the longest shared word and the letters that both
strings have; a pair whose upper bound is below the n-th lower bound of its
question can't be among the n best and is not compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.udfs import blended, found_words, likeness

#: Letters counted one by one; all others are counted together, which only raises the upper bound.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
#: Rankings may round scores to six places.
SLACK = 1e-6
#: Strings of so many characters are compared without their frequent letters, so a shared word bounds nothing there.
LONG = 200
BY = ("store", "decomposer")


def letter_counts(text) -> Column:
    """How often each of the letters stands in a text, and how many other characters there are."""
    t = F.col(text) if isinstance(text, str) else text
    each = [F.length(t) - F.length(F.replace(t, F.lit(x), F.lit(""))) for x in LETTERS]
    return F.array(*each, F.length(F.translate(t, LETTERS, "")))


def most_alike(a: str, b: str) -> Column:
    """Upper bound of the likeness of two texts, from their letters (columns of texts; counts are in ``{a}_n`` and ``{b}_n``)."""
    both = F.aggregate(F.zip_with(f"{a}_n", f"{b}_n", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return 2.0 * both / (F.length(a) + F.length(b))


def least_alike(a: str, b: str, shared: str) -> Column:
    """Lower bound of the likeness of two texts that both hold the words ``shared``."""
    longest = F.array_max(F.transform(shared, lambda x: F.length(x)))
    return F.when(F.length(b) < LONG, 2.0 * longest / (F.length(a) + F.length(b))).otherwise(0.0)


def _sides(asked: DataFrame, paths: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(query_id, table_id, aw, a, a_n) and (table_id, path, bw, b, b_n): words of both sides and the texts that are compared."""
    if by not in BY:
        raise ValueError(f"no such likeness: {by}; there are {BY}")
    if by == "store":
        aw = F.array_sort(F.array_distinct(found_words(F.array_join("terms", " "), "a-z0-9")))
        said = found_words(F.array_join("path", " "), "a-z0-9")
        bw = F.array_distinct(said)
    else:
        aw = F.array_sort(F.array_distinct(F.transform("terms", lambda x: F.lower(x))))
        said = bw = F.array_sort(F.array_distinct(found_words(F.array_join("path", " > "), r"\p{L}\p{N}")))
    left = asked.select("query_id", "table_id", aw.alias("aw"), F.array_join(aw, " ").alias("a")).filter("size(aw) > 0")
    right = paths.select("table_id", "path", bw.alias("bw"), F.array_join(said, " ").alias("b")).filter("size(bw) > 0")
    return left.withColumn("a_n", letter_counts("a")), right.withColumn("b_n", letter_counts("b"))


def candidates(asked: DataFrame, paths: DataFrame, n: int, by: str = "store") -> DataFrame:
    """(query_id, table_id, path, a, b, n_shared, n_of, low, high): the pairs that can be among the n best of their question.

    asked: (query_id, table_id, terms: array), one row for each question; paths:
    (table_id, path: array), distinct.  With "store" only pairs that share a
    word count; with "decomposer" others do too, and meet only the questions
    whose n-th lower bound they could pass.  Null terms or paths, and those
    without a word, have no pairs.
    """
    left, right = _sides(asked, paths, by)
    of = F.size("aw") if by == "store" else F.size("bw")
    out = ["query_id", "table_id", "path", "a", "b", "n_shared", "n_of", "low", "high"]
    met = left.withColumn("word", F.explode("aw")).join(right.withColumn("word", F.explode("bw")), ["table_id", "word"])
    met = met.withColumn("shared", F.array_intersect("aw", "bw")).filter(F.col("word") == F.array_min("shared"))
    part = lambda like: blended(F.size("shared"), of, like)
    met = met.select("*", F.size("shared").alias("n_shared"), of.alias("n_of"), part(least_alike("a", "b", "shared")).alias("low"), part(most_alike("a", "b")).alias("high")).select(out)
    w = Window.partitionBy("query_id").orderBy(F.col("low").desc())
    nth = F.coalesce(F.nth_value("low", n).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))
    kept = met.withColumn("nth", nth).filter(F.col("high") >= F.col("nth") - SLACK).drop("nth")
    if by == "store":
        return kept
    floor = met.withColumn("k", F.row_number().over(w)).filter(F.col("k") == n).select("query_id", F.col("low").alias("nth"))
    apart = left.join(floor, "query_id", "left").withColumn("nth", F.coalesce("nth", F.lit(0.0)))
    apart = apart.filter(F.col("nth") - SLACK <= blended(F.lit(0), F.lit(1), F.lit(1.0))).join(right, "table_id").filter(~F.arrays_overlap("aw", "bw"))
    none = apart.select("*", F.lit(0).alias("n_shared"), of.alias("n_of"), F.lit(0.0).alias("low"), blended(F.lit(0), of, most_alike("a", "b")).alias("high"))
    return kept.unionByName(none.filter((F.col("high") > 0) & (F.col("high") >= F.col("nth") - SLACK)).select(out))


def scored(asked: DataFrame, paths: DataFrame, n: int, by: str = "store") -> DataFrame:
    """(query_id, table_id, path, score) of the candidates, scores above 0."""
    c = candidates(asked, paths, n, by)
    return c.select("query_id", "table_id", "path", blended(F.col("n_shared"), F.col("n_of"), likeness("a", "b")).alias("score")).filter("score > 0")


def pruning(asked: DataFrame, paths: DataFrame, n: int, by: str = "store") -> DataFrame:
    """(query_id, n_pairs, n_scored): paths of a question's table that have words, and how many of them are compared with it."""
    left, right = _sides(asked, paths, by)
    sizes = right.groupBy("table_id").agg(F.count("*").alias("n_pairs"))
    some = candidates(asked, paths, n, by).groupBy("query_id").agg(F.count("*").alias("n_scored"))
    return left.join(sizes, "table_id").join(some, "query_id", "left").select("query_id", "n_pairs", F.coalesce("n_scored", F.lit(0)).alias("n_scored"))
