"""Which header paths a question names: by words, by an encoder, by a pair scorer, or by one where another finds nothing.

Candidates are the paths of a table and the nodes above them; a question meets
the candidates of its own table only.  Scores are columns (query_id, table_id,
path, score); ties are broken by the path's text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.udfs import store_similarity
from . import likeness, scoring
from . import questions as qs

MODES = ("lexical", "embed", "cross", "cascade", "cross_cascade")


def node_paths(cells: DataFrame, axis: str, parents: bool = True) -> DataFrame:
    """(table_id, path): distinct header paths of an axis ("row" or "col"), with the nodes above them."""
    path = F.col(f"{axis}_path")
    each = F.explode(tx.path_prefixes(path)) if parents else path
    return cells.filter(F.size(path) > 0).select("table_id", each.alias("path")).distinct()


def pairs(questions: DataFrame, paths: DataFrame) -> DataFrame:
    """(query_id, table_id, question, path): each question with the candidates of its table."""
    return questions.select("query_id", "table_id", "question").join(paths, "table_id")


def lexical(questions: DataFrame, paths: DataFrame) -> DataFrame:
    """Scores by the likeness of the question's terms; candidates that share no word have 0."""
    return pairs(questions, paths).select("query_id", "table_id", "path", store_similarity(F.array_join(qs.terms("question"), " "), "path").alias("score"))


def embedded(questions: DataFrame, paths: DataFrame, encoder: scoring.Encoder) -> DataFrame:
    """Cosine of the encoded question and path; each distinct text is encoded once."""
    _, encode = encoder
    q = encode(questions.select("question").distinct(), "question", "question").select("question", scoring.unit("v").alias("qv"))
    named = paths.withColumn("name", tx.path_text("path"))
    p = encode(named.select("name").distinct(), "name", "name").select("name", scoring.unit("v").alias("pv"))
    t = pairs(questions, named).join(q, "question").join(p, "name")
    return t.select("query_id", "table_id", "path", scoring.dot("qv", "pv").alias("score"))


def crossed(questions: DataFrame, paths: DataFrame, scorer: Callable[[Column, Column], Column]) -> DataFrame:
    """Scores of question and path together, by a given Column function of both texts."""
    return pairs(questions, paths).select("query_id", "table_id", "path", scorer(F.col("question"), tx.path_text("path")).cast("double").alias("score"))


def best(scores: DataFrame, n: int, over: float | None = None) -> DataFrame:
    """(query_id, table_id, path, rank): the n best candidates of each question, those above a score if one is given."""
    some = scores if over is None else scores.filter(F.col("score") > over)
    named = some.withColumn("name", tx.path_text("path"))
    return scoring.top_k(named, n, ["query_id"], "name").select("query_id", "table_id", "path", "rank")


def allowed_paths(paths: DataFrame, cells: DataFrame, allowed: DataFrame) -> DataFrame:
    """Column candidates under which one of the allowed columns (table_id, c) stands."""
    kept = cells.join(allowed, ["table_id", "c"], "left_semi").select("table_id", F.explode(tx.path_prefixes("col_path")).alias("path")).distinct()
    return paths.join(kept, ["table_id", "path"], "left_semi")


def resolved(questions: DataFrame, paths: DataFrame, mode: str = "lexical", n: int = 3, encoder: scoring.Encoder | None = None, scorer: Callable[[Column, Column], Column] | None = None, leaves: DataFrame | None = None, n_cross: int = 2) -> DataFrame:
    """(query_id, table_id, path, rank) by a mode.

    lexical ranks whole paths (``leaves``, else the candidates) that share a
    word; embed and cross rank all candidates; cross gives ``n_cross``, and the
    lexical ones where there is no scorer.  The cascades take the lexical ones
    where there are any, else two by the encoder or ``n_cross`` by the scorer.
    """
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}; there are {MODES}")
    words = best(likeness.scored(questions.select("query_id", "table_id", qs.terms("question").alias("terms")), paths if leaves is None else leaves, n), n)
    if mode == "lexical" or (mode.startswith("cross") and scorer is None):
        return words
    if mode.startswith("cross"):
        other = best(crossed(questions, paths, scorer), n_cross)
    else:
        other = best(embedded(questions, paths, encoder or scoring.chosen_encoder()), n if mode == "embed" else min(2, n))
    if mode in ("embed", "cross"):
        return other
    return words.unionByName(other.join(words.select("query_id").distinct(), "query_id", "left_anti"))


def mixed(questions: DataFrame, paths: DataFrame, encoder: scoring.Encoder, n: int, alpha: float = 0.5) -> DataFrame:
    """(query_id, table_id, path, rank): candidates by alpha of the scaled encoder's and the rest of the scaled lexical score."""
    named = lambda s: s.withColumn("name", tx.path_text("path"))
    words, near = named(lexical(questions, paths)), named(embedded(questions, paths, encoder))
    both = scoring.hybrid_minmax(near, words, key="name", alpha=alpha)
    return scoring.top_k(both.join(words.select("query_id", "name", "table_id", "path"), ["query_id", "name"]), n, ["query_id"], "name").select("query_id", "table_id", "path", "rank")
