"""Importance resampling towards a target corpus by hashed n-grams, in two Arrow passes.

The first pass counts, with ``np.bincount``, how often each of 10,000 buckets is
met by the runs of one to three words of a partition; a partition gives one
vector, and ``treeReduce`` adds them.  From the vectors of the documents and of
the target each bucket gets a gain, and the 10,000 gains are broadcast.  The
second pass gathers the gains of a document's features and sums them by
``np.bincount`` with weights.  Gumbel noise from a hash of the id turns the sums
into a draw without replacement: the highest scores are drawn.

The bucket of a run is the CRC-32 of its bytes.  A CRC is linear, so that of a
longer run is had from that of the shorter one and that of the next word, by
tables, for all words of a batch at once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import save, scratch

BUCKETS, SEED = 10_000, 42
#: Words of a batch handled at once; a longer text is handled alone.
WORDS = 200_000
#: Words longer than this are hashed one by one.
LONG = 63
_KEEP = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else c + 32 if chr(c).isupper() and c < 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters (A-Z lower-cased), digits and all characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


def _zero_tables() -> np.ndarray:
    """For 0 to LONG + 1 zero bytes: what they make of each byte of a CRC."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    x = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    out = [x]
    for _ in range(LONG + 1):
        x = (x >> np.uint32(8)) ^ step[x & np.uint32(255)]
        out.append(x)
    return np.concatenate(out)


class Features:
    """Buckets of the runs of one to three words."""

    def __init__(self):
        self.tables, self.known = _zero_tables(), {}

    def _word(self, w: bytes) -> int:
        if len(self.known) > 300_000:
            self.known.clear()
        x = self.known[w] = zlib.crc32(w) | zlib.crc32(b" " + w) << 32
        return x

    def _joined(self, crc: np.ndarray, n: np.ndarray, spaced: np.ndarray, words: list[bytes]) -> np.ndarray:
        """CRCs of runs that go on with a space and these words, n bytes in all each."""
        at = np.minimum(n, LONG + 1) << 10
        out = spaced.copy()
        for k in range(4):
            out ^= self.tables[at + (256 * k) + ((crc >> np.uint32(8 * k)) & np.uint32(255))]
        for i in np.flatnonzero(n > LONG + 1).tolist():
            out[i] = zlib.crc32(b" " + words[i], int(crc[i]))
        return out

    def of(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, text of each) of all runs of the texts, whose words are given."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        flat = [w for t in words for w in t]
        known = self.known
        both = np.fromiter((known.get(w) or self._word(w) for w in flat), np.uint64, len(flat))
        one, spaced = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), (both >> np.uint64(32)).astype(np.uint32)
        size = np.fromiter(map(len, flat), np.int64, len(flat)) + 1
        text = np.repeat(np.arange(len(words)), lens)
        two = self._joined(one[:-1], size[1:], spaced[1:], flat[1:])
        three = self._joined(two[:-1], size[2:], spaced[2:], flat[2:])
        pair, triple = text[:-1] == text[1:], text[:-2] == text[2:]
        return np.concatenate([one, two[pair], three[triple]]) % np.uint32(BUCKETS), np.concatenate([text, text[:-1][pair], text[:-2][triple]])


def _portions(batches: Iterator) -> Iterator:
    """Record batches whose last column is the text -> (slice, words of each row)."""
    for batch in batches:
        start, words, n = 0, [], 0
        for k, t in enumerate(batch.column(batch.num_columns - 1)):
            words.append(words_of(t.as_py()))
            n += len(words[-1])
            if n >= WORDS or k + 1 == batch.num_rows:
                yield batch.slice(start, k + 1 - start), words
                start, words, n = k + 1, [], 0


def _counted(batches: Iterator) -> Iterator:
    import pyarrow as pa

    features, total = Features(), np.zeros(BUCKETS, np.int64)
    for _, words in _portions(batches):
        total += np.bincount(features.of(words)[0], minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall in each bucket."""
    parts = texts.select(F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(_counted, "v binary").rdd
    n = parts.getNumPartitions()
    if not n:
        return np.zeros(BUCKETS, np.int64)
    return parts.map(lambda r: np.frombuffer(r.v, np.int64)).treeReduce(lambda a, b: a + b, depth=2 if n < 10_000 else 3)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket 1000 times the log ratio of its smoothed shares in the target and the source, rounded down."""
    all_s, all_t = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1) * all_s / ((s + 1) * all_t))) for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.float64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """1000 times a Gumbel variate that the seed and the id decide, rounded down."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight: sum of the gains of the features, score: weight and noise), one for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        features, own = Features(), shared.value
        for part, words in _portions(batches):
            buckets, text = features.of(words)
            n = np.bincount(text, minlength=len(words))
            weight = np.bincount(text, weights=own[buckets], minlength=len(words)).astype(np.int64)
            score = weight + np.array([noise(i, seed) for i in part.column(0).to_pylist()], np.int64)
            cols = [np.fromiter(map(len, words), np.int64, len(words)), n.astype(np.int64), weight, score]
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, cols)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(run, SCORED)


def ranked(rows: DataFrame, drawn: int, slack: float = 0.01) -> DataFrame:
    """rows (doc_id, score, ...) with a rank, 1, 2, 3 ... for the ``drawn`` highest scores (ties: smaller doc_id first, null last), else null.

    rows are read several times, so they should be stored.  A quantile sketch
    says what surely lies below the draw, and that is neither sorted nor
    ranked.  The rest is range-partitioned by score and id and stored in order;
    a row's rank is its place in its part and the number of rows in the parts
    before, of which the driver gets one number each.
    """
    total = rows.count()
    if not drawn:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    low = rows.approxQuantile("score", [max(0.0, 1 - drawn / total - slack)], slack / 2)[0]
    if rows.filter(F.col("score") >= low).count() < drawn:
        low = float(-(1 << 62))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]
    top = rows.filter(F.col("score") >= low).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*order)
    top = save(top, "drawn")
    before, sizes = 0, []
    for part, n in sorted(map(tuple, top.groupBy("_part").count().collect())):
        sizes.append((part, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(sizes, "_part int, _before long")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    top = top.join(F.broadcast(offsets), "_part").withColumn("rank", own).drop("_part", "_before")
    top = top.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    return top.unionByName(rows.filter(F.col("score") < low).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight, score, rank): one for each row of docs.

    Of the N documents of min_words words or more, floor(percent * N / 100) are
    drawn, and have a rank.  A null or empty text has no feature, weight 0 and
    its noise as score.  A row without an id takes the noise of an empty id and
    comes last among ties; rows that repeat an id have the same noise.  An empty
    table gives no rows, an empty target gains by the source alone.  Ids are
    cast to long; other columns are not read.
    """
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    with scratch(docs.sparkSession) as keep:
        rows = keep(save(scored(docs, gain, seed, id_col, text_col), "scored"))
        fit = rows.filter(F.col("n_words") >= min_words)
        n = fit.count()
        out = ranked(fit, percent * n // 100)
        short = rows.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
        return keep(save(out.unionByName(short), "resampled"))
