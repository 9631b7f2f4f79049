"""An interpolated modified Kneser-Ney bigram model, counted by Spark and mapped by workers.

Words are hashes, and the vocabulary is the sorted array of them; a word's
number is its place.  Bigrams are 64-bit keys, mixed one-to-one so that shards
are even, in sorted arrays beside their counts.  What a context or a
continuation needs is summed from the distinct bigrams of every shard and
stored in arrays in the order of the vocabulary.  Workers map all arrays into
memory to score whole texts; nothing of the size of the corpus passes through
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .simhash import words_of
from .sorted_runs import PACKED, Sorted, WordHashes, by_shard, distinct, mix64, n_shards, packed, portions, record_batch, spans, unmix64, unsmall
from .storage import drop, make_dir, new_path, save, write_array

#: What stands for the end of a text; no word holds a line break.
END = b"\n"
#: Counts of bigrams from here on are kept apart.
MANY = 255


def with_end(text: str | None) -> list[bytes]:
    """The tokens of a text: its words, A-Z lower-cased, then one end."""
    return [*words_of(text), END]


def _flat(words: list[list[bytes]], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.empty(0, np.uint64), *(hashes.of(w) for w in words)]), np.array([len(w) for w in words], np.int64)


@dataclass(frozen=True)
class Discounts:
    """Of a level: the discounts of counts 1, 2 and 3 or more.

    They are the closed forms of the modified scheme, held within 0.05 and 95 %
    of the count they are taken from; one half where nothing is counted once or
    nothing twice.  Held so, every probability is positive and they sum to 1.
    """

    one: float
    two: float
    more: float

    @classmethod
    def of(cls, n: tuple[int, int, int, int]) -> Discounts:
        """From the numbers of items counted once to four times."""
        n1, n2, n3, n4 = n
        if not n1 or not n2:
            return cls(0.5, 0.5, 0.5)
        y = n1 / (n1 + 2 * n2)
        d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.0)
        return cls(*(min(k, max(0.05, x)) for k, x in zip((0.95, 1.9, 2.85), d, strict=True)))

    def from_counts(self, c: np.ndarray) -> np.ndarray:
        return np.where(c >= 3, self.more, np.where(c == 2, self.two, np.where(c == 1, self.one, 0.0)))


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the few numbers that all shards share."""

    uri: str
    shards: int
    offsets: tuple[int, ...]  # number of the first word of each shard
    vocabulary: int
    tokens: int
    bigrams: int
    high: Discounts
    low: Discounts
    spread: float  # mass that the lowest level leaves to all words alike, unknown ones too


@cache
def _open(uri: str, shards: int) -> tuple[Sorted, Sorted, Sorted]:
    return (
        Sorted(uri, "word", shards, keys="<u8", counts="<i8", total="<u8", n1="<u4", n2="<u4", n3="<u4", before="<u4"),
        Sorted(uri, "pair", shards, keys="<u8", counts="u1"),
        Sorted(uri, "many", shards, keys="<u8", counts="<u8"),
    )


def _numbers(h: np.ndarray, words: Sorted, offsets, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (numbers, places of the tokens in them) of token hashes; words not in the vocabulary are number n + 1."""
    keys, back = np.unique(h, return_inverse=True)
    number = np.full(len(keys), n + 1, np.int64)
    for s, part, i, ok in words.find(keys):
        number[part] = np.where(ok, i + offsets[s], n + 1)
    return number, back


def _pairs(number: np.ndarray, lens: np.ndarray, n: int) -> np.ndarray:
    """Keys of the bigrams; the first word of a text follows the start, which is number n."""
    before = np.concatenate([[n], number[:-1]]) if len(number) else number
    before[np.cumsum(lens)[:-1]] = n
    return mix64((before.astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64))


#: What is kept of each word: the tokens that follow it, the distinct words that do so once, twice, and more
#: often, and the distinct words before it.  Distinct words are fewer than 2 ** 32, tokens need not be.
STATS = {"total": "<u8", "n1": "<u4", "n2": "<u4", "n3": "<u4", "before": "<u4"}


def stats_of(first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(sorted words, the STATS of each) of distinct bigrams."""
    ids, at = np.unique(np.concatenate([first, second]), return_inverse=True)
    x, y = at[: len(first)], at[len(first) :]
    total = np.zeros(len(ids), np.uint64)
    np.add.at(total, x, counts.astype(np.uint64))  # not by floats, which hold 53 bits
    return ids, [total, *(np.bincount(x, w, minlength=len(ids)) for w in (counts == 1, counts == 2, counts >= 3)), np.bincount(y, minlength=len(ids))]


def summed_stats(rows: list[tuple[bytes, bytes]], first: int, last: int) -> dict[str, np.ndarray]:
    """The sums of packed (words, STATS) for the words from first to last - 1."""
    sums = {name: np.zeros(last - first, kind) for name, kind in STATS.items()}
    for k, c in rows:
        ids, at = np.frombuffer(k, "<u4").astype(np.int64) - first, 0
        for name, kind in STATS.items():
            sums[name][ids] += np.frombuffer(c, kind, len(ids), at)
            at += len(ids) * np.dtype(kind).itemsize
    return sums


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Count all rows of docs; an empty table gives a model of nothing.

    A null text counts as empty, which is one end; repeated rows count again.
    """
    spark = docs.sparkSession
    uri = make_dir(spark, new_path(spark, "lm"))
    texts = docs.select(F.lit(0).alias("id"), F.col(text_col).cast("string").alias("t"))
    shards = n_shards(texts, "t")

    def words(arrow: Iterator) -> Iterator:
        hashes = WordHashes()
        for _, w in portions(arrow, with_end):
            yield record_batch(packed(*distinct(_flat(w, hashes)[0]), shards))

    def merge_words(shard: int, rows: Iterator) -> Iterator:
        import pyarrow as pa

        rows = list(rows)
        keys, counts = distinct(np.concatenate([np.empty(0, "<u8"), *(np.frombuffer(k, "<u8") for _, k, _ in rows)]), np.concatenate([np.empty(0, np.int64), *(unsmall(c) for _, _, c in rows)]))
        write_array(f"{uri}/word-{shard}.keys", keys)
        write_array(f"{uri}/word-{shard}.counts", counts.astype("<i8"))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([shard], [len(keys)], [int(counts.sum())])], names=["s", "v", "n"])

    sizes = {r.s: r for r in by_shard(texts.mapInArrow(words, PACKED), shards, merge_words, "s long, v long, n long").collect()}
    offsets = tuple(int(x) for x in np.cumsum([0, *(sizes[s].v for s in range(shards))]))
    n, tokens = offsets[-1], sum(r.n for r in sizes.values())
    if n + 2 >= 1 << 32:
        raise ValueError("numbers of words need more than 32 bits")

    def pairs(arrow: Iterator) -> Iterator:
        hashes, known = WordHashes(), _open(uri, shards)[0]
        for _, w in portions(arrow, with_end):
            h, lens = _flat(w, hashes)
            number, back = _numbers(h, known, offsets, n)
            yield record_batch(packed(*distinct(_pairs(number[back], lens, n)), shards))

    def merge_pairs(shard: int, rows: Iterator) -> Iterator:
        rows = list(rows)
        keys, counts = distinct(np.concatenate([np.empty(0, "<u8"), *(np.frombuffer(k, "<u8") for _, k, _ in rows)]), np.concatenate([np.empty(0, np.int64), *(unsmall(c) for _, _, c in rows)]))
        del rows
        write_array(f"{uri}/pair-{shard}.keys", keys)
        # one byte a count; the few larger ones stand in arrays of their own
        write_array(f"{uri}/pair-{shard}.counts", np.minimum(counts, MANY).astype("u1"))
        many = counts >= MANY
        write_array(f"{uri}/many-{shard}.keys", keys[many])
        write_array(f"{uri}/many-{shard}.counts", counts[many].astype("<u8"))
        both = unmix64(keys)
        a, b = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        some = np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype("<i8")
        out = [(-1, 0, len(keys).to_bytes(8, "little"), some.tobytes())]
        ids, stats = stats_of(a, b, counts)
        home = np.minimum(np.searchsorted(np.array(offsets[1:]), ids, side="right"), shards - 1)
        for s, i, j in spans(home):  # ids are sorted, so homes are
            out.append((s, 0, ids[i:j].astype("<u4").tobytes(), b"".join(v[i:j].astype(kind).tobytes() for v, kind in zip(stats, STATS.values(), strict=True))))
        yield record_batch(out)

    counted = save(by_shard(texts.mapInArrow(pairs, PACKED), shards, merge_pairs, PACKED), "lm")
    few = counted.filter("shard < 0").collect()  # one row for each shard
    bigrams = sum(int.from_bytes(r.k, "little") for r in few)
    high = Discounts.of(tuple(int(x) for x in sum([np.frombuffer(r.c, "<i8") for r in few], np.zeros(4, np.int64))))

    def merge_stats(shard: int, rows: Iterator) -> Iterator:
        import pyarrow as pa

        first, last = offsets[shard], offsets[shard + 1] + (shard == shards - 1)  # the start has the last place
        sums = summed_stats([r[1:] for r in rows], first, last)
        for name, v in sums.items():
            write_array(f"{uri}/word-{shard}.{name}", v)
        some = np.bincount(np.minimum(sums["before"], 5).astype(np.int64), minlength=6)
        yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in (*some[1:5], some[3:].sum())], names=["a", "b", "c", "d", "more"])

    got = by_shard(counted.filter("shard >= 0"), shards, merge_stats, "a long, b long, c long, d long, more long").agg(*[F.sum(c) for c in ("a", "b", "c", "d", "more")]).first()
    drop(counted)
    low = Discounts.of(tuple(got[:4]))
    spread = (low.one * got[0] + low.two * got[1] + low.more * got[4]) / bigrams if bigrams else 1.0
    return Model(uri, shards, offsets, n, tokens, bigrams, high, low, spread)


class Scorer:
    """log10 probabilities of tokens, by arrays mapped into memory."""

    def __init__(self, m: Model):
        self.m, self.hashes = m, WordHashes()
        self.words, self.pairs, self.many = _open(m.uri, m.shards)
        self.ends = np.array(m.offsets[1:])

    def _of(self, numbers: np.ndarray, column: str) -> np.ndarray:
        """A column of the vocabulary at sorted numbers; 0 for unknown words."""
        out = np.zeros(len(numbers), np.int64)
        known = numbers[: np.searchsorted(numbers, self.m.vocabulary + (column != "counts"))]  # the start has no count, and the last place
        home = np.minimum(np.searchsorted(self.ends, known, side="right"), self.m.shards - 1)
        for s, a, b in spans(home):
            out[a:b] = self.words.column(s, column)[known[a:b] - self.m.offsets[s]]
        return out

    def score(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, known tokens, base score, score) of each text."""
        m = self.m
        h, lens = _flat(words, self.hashes)
        found, back = _numbers(h, self.words, m.offsets, m.vocabulary)
        numbers, place = np.unique(np.append(found, m.vocabulary), return_inverse=True)
        back = place[:-1][back]
        c = self._of(numbers, "counts")
        base = np.log10((c + 1) / (m.tokens + m.vocabulary + 1))
        before = self._of(numbers, "before")
        low = (before - m.low.from_counts(before)) / max(1, m.bigrams) + m.spread / (m.vocabulary + 1)
        total = self._of(numbers, "total")
        n1, n2, n3 = (self._of(numbers, k) for k in ("n1", "n2", "n3"))
        gamma = np.where(total > 0, (m.high.one * n1 + m.high.two * n2 + m.high.more * n3) / np.maximum(total, 1), 1.0)
        keys, pair = np.unique(_pairs(numbers[back], lens, m.vocabulary), return_inverse=True)
        count = np.zeros(len(keys), np.int64)
        for s, part, i, ok in self.pairs.find(keys):
            own = self.pairs.column(s, "counts")
            count[part] = np.where(ok, own[np.minimum(i, max(0, len(own) - 1))] if len(own) else 0, 0)
        large = np.flatnonzero(count == MANY)
        for s, part, i, ok in self.many.find(keys[large]):
            count[large[part][ok]] = self.many.column(s, "counts")[i[ok]]
        both = unmix64(keys)
        a = np.searchsorted(numbers, (both >> np.uint64(32)).astype(np.int64))
        b = np.searchsorted(numbers, (both & np.uint64(0xFFFFFFFF)).astype(np.int64))
        p = np.log10((count - m.high.from_counts(count)) / np.maximum(total[a], 1) + gamma[a] * low[b])
        first = np.cumsum(lens) - lens  # every text has an end, so none is empty
        return lens, np.add.reduceat((c > 0)[back].astype(np.int64), first), np.add.reduceat(base[back], first), np.add.reduceat(p[pair], first)


@cache
def _scorer(m: Model) -> Scorer:
    return Scorer(m)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, n_known, base_score, score, perplexity): one for each row of docs.

    A null text counts as empty: one token, the end.  base_score is the sum of
    the log10 of add-one unigram probabilities, score the model's.
    """
    import pyarrow as pa

    def run(arrow: Iterator) -> Iterator:
        scorer = _scorer(model)
        for part, words in portions(arrow, with_end):
            n, known, base, own = scorer.score(words)
            cols = [part.column(0), pa.array(n), pa.array(known), pa.array(base), pa.array(own), pa.array(10.0 ** (-own / n))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "id long, n_tokens long, n_known long, base_score double, score double, perplexity double")


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(folds))
