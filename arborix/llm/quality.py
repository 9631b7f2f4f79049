"""Quality by weak supervision: rules vote or abstain, EM weighs the votes.

Native: only DataFrame functions touch rows.  Each rule says good (1), bad (-1)
or nothing (0) about a text.  The corpus is reduced to counts of vote patterns,
of which there are at most 3 to the number of rules; on these few rows
expectation-maximisation estimates how often each rule errs on good and on bad
texts.  The posterior probability of a good text, from all votes together,
replaces the demand that all rules pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import columns, save

SPACE = " \t\n\x0b\f\r"
SPACE_RUN = "[ \\t-\\r]+"
#: Frequent function words of English, German, Spanish and French (fixed values).
FUNCTION_WORDS = (
    "the of and to in a is that for it as was with be on are this by an or "
    "der die das und ist von zu den mit für des ein eine im nicht auf sich auch "
    "el la de que y en los se del las por un una con para su no lo "
    "le les et à est dans une qui pour ce pas sur au par"
).split()
RULES = ("length", "symbols", "letters", "capitals", "repeats", "variety", "lines", "function_words", "word_length")


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def words_col(text: Column) -> Column:
    """Maximal runs of anything but the six ASCII space characters."""
    trimmed = F.trim(F.coalesce(text.cast("string"), F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def repeated_words(words: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more, first occurrences included.

    Windows are sorted by a 64-bit hash with their place, so equal ones are
    neighbours; the places found, in order, are then measured as intervals.
    """
    n = F.size(words)

    def cover(at):  # sorted places of repeated windows -> words in their union
        step = F.transform(at, lambda p, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(at, i - 1))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def places(w):
        same = lambda s, i, j: F.coalesce(F.get(s, j)["h"] == F.get(s, i)["h"], F.lit(False))
        found = F.filter(w, lambda x, i: same(w, i, i - 1) | same(w, i, i + 1))
        return let(F.array_sort(F.transform(found, lambda x: x["p"])), cover)

    def windows(w):
        made = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))
        return let(F.sort_array(made), places)

    return F.when(n < 4, F.lit(0)).otherwise(let(words, windows)).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[Column] | None = None) -> DataFrame:
    """docs -> (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and what the votes need)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), *(carry or []), text.alias("t"), words_col(F.col(text_col)).alias("w"), F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "").alias("lines"))
    t, w = F.col("t"), F.col("w")
    less = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    return rows.select(
        "id",
        *[c for c in rows.columns if c not in ("id", "t", "w", "lines")],
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        less("[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
        less("\\P{L}+").cast("long").alias("n_letters"),
        less("\\P{Lu}+").cast("long").alias("n_capitals"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter(w, lambda x: x.isin(FUNCTION_WORDS))).cast("long").alias("n_function_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def votes() -> dict[str, Column]:
    """The rules, over the columns of :func:`measures`."""
    c, n = F.col, F.greatest(F.col("n_words"), F.lit(1))
    say = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    return dict(
        zip(
            RULES,
            (
                say((c("n_words") < 50) | (c("n_words") > 1000000), c("n_words") >= 100),
                say(c("n_symbols") * 10 > n, c("n_symbols") * 100 <= n),
                say(c("n_letters") * 100 < c("word_chars") * 85, c("n_letters") * 100 >= c("word_chars") * 95),
                say(c("n_capitals") * 10 > c("n_letters") * 3, c("n_capitals") * 100 <= c("n_letters") * 15),
                say(c("n_repeat_words") * 10 > n * 3, c("n_repeat_words") * 10 <= n),
                say(c("n_distinct") * c("n_distinct") < 4 * n, c("n_distinct") * c("n_distinct") >= 25 * n),
                say(c("n_dup_lines") * 10 > c("n_lines") * 4, c("n_dup_lines") * 10 <= c("n_lines")),
                say((c("n_function_words") * 200 < n), c("n_function_words") * 20 >= n),
                say((c("word_chars") >= 8 * n) | (c("word_chars") * 2 <= 5 * n), (c("word_chars") >= 3 * n) & (c("word_chars") < 7 * n)),
            ),
            strict=True,
        )
    )


@dataclass
class VoteModel:
    """good: share of good texts; wrong: for each rule, P(votes bad | good text) and P(votes good | bad text), where it votes."""

    good: float
    wrong: dict[str, tuple[float, float]]

    def weights(self, rule: str) -> tuple[float, float]:
        """Log-likelihood ratios of a vote for bad and of a vote for good."""
        a, b = self.wrong[rule]
        return math.log(a / (1 - b)), math.log((1 - a) / b)

    def log_odds(self) -> Column:
        total = F.lit(math.log(self.good / (1 - self.good)))
        for rule in self.wrong:
            bad, good = self.weights(rule)
            total = total + F.when(F.col(f"vote_{rule}") < 0, bad).when(F.col(f"vote_{rule}") > 0, good).otherwise(0.0)
        return total


def fit(patterns: list[tuple[tuple[int, ...], int]], rules: tuple[str, ...] = RULES, rounds: int = 60, start: tuple[float, float, float] = (0.85, 0.02, 0.6), weight: float = 20.0) -> VoteModel:
    """EM over counts of vote patterns.

    start: share of good texts, P(bad vote | good), P(good vote | bad).  A bad
    text passes most rules, a good one fails few; the start says so, and counts
    as ``weight`` texts in each estimate, which keeps the classes from changing
    places on small corpora.
    """
    good, wrong = start[0], [(start[1], start[2])] * len(rules)
    for _ in range(rounds):
        tally, n_good, n = [[[0.0, 0.0], [0.0, 0.0]] for _ in rules], 0.0, 0
        for vote, count in patterns:
            s = math.log(good / (1 - good))
            for v, (a, b) in zip(vote, wrong, strict=True):
                s += math.log(a / (1 - b)) if v < 0 else math.log((1 - a) / b) if v > 0 else 0.0
            p = 1 / (1 + math.exp(-s)) if s > -500 else 0.0
            n_good += p * count
            n += count
            for v, t in zip(vote, tally, strict=True):
                if v:
                    t[0][v < 0] += p * count
                    t[1][v < 0] += (1 - p) * count
        good = (n_good + weight * start[0]) / (n + weight)
        wrong = [
            (
                min(0.5, max(1e-4, (t[0][1] + weight * start[1]) / (sum(t[0]) + weight))),
                min(0.98, max(1e-3, (t[1][0] + weight * start[2]) / (sum(t[1]) + weight))),
            )
            for t in tally
        ]
    return VoteModel(good, dict(zip(rules, wrong, strict=True)))


def judge(measured: DataFrame) -> tuple[DataFrame, VoteModel]:
    """measured with vote_<rule>, base_failed, p_good and kept; and the model.

    kept is false if a base rule fails, else whether the posterior is at least
    one half.  An empty table gives no rows and the starting model.
    """
    voted = measured.select("*", *[v.alias(f"vote_{k}") for k, v in votes().items()])
    counts = voted.groupBy(*[f"vote_{r}" for r in RULES]).count().collect()  # at most 3 ** len(RULES) rows
    model = fit([(tuple(r[:-1]), r[-1]) for r in sorted(map(tuple, counts))])
    p = 1 / (1 + F.exp(-model.log_odds()))
    out = voted.withColumn("base_failed", base_failed()).withColumn("p_good", p)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5)), model


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, the measures, votes, base_failed, p_good, kept): one for each row of docs.

    A null text counts as empty; a text without words fails the base rules.
    Repeated rows get equal verdicts, ids may be null.  The measures are kept
    in the shared folder, so that texts are read once.
    """
    return judge(save(measures(docs, id_col, text_col), "quality"))[0]


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns, whatever they are called."""
    row = F.struct(*columns(docs)).alias("_arborix_row")
    measured = save(measures(docs, text_col, text_col, carry=[row]).drop("id"), "quality")
    kept = judge(measured)[0].filter("kept")
    return kept.select(*[F.col("_arborix_row")[c].alias(c) for c in docs.columns])
