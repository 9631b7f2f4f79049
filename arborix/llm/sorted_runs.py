"""Sorted arrays of 64-bit keys, dealt to shards by range, merged by tasks and mapped by workers.

Map tasks reduce what they read to sorted distinct keys with counts and pack
them in one row for each shard; a shard's rows meet in one task, which merges
them and writes plain sorted arrays to the shared folder.  Keys are hashes, so
ranges are of even size whatever the data: a frequent word or passage is one
key in each packed row.  Keys that are minima of hashes are mixed once more, or
they would crowd the first shards.  There are as many shards as the texts need
for a shard to hold about the same everywhere, and each has a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import exists, map_array

#: Tokens that a map task handles at once; a longer text is handled alone.
TOKENS = 400_000
#: Characters of text for each shard.
SHARD_CHARS = 1 << 24
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_I1, _I2 = (np.uint64(pow(int(m), -1, 1 << 64)) for m in (_M1, _M2))
_S = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit integers."""
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def unmix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _I2
    x = (x ^ (x >> _S)) * _I1
    return x ^ (x >> _S)


def n_shards(texts: DataFrame, text_col: str) -> int:
    """So many shards that each stands for about SHARD_CHARS characters of text."""
    chars = texts.agg(F.sum(F.length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0
    return max(4, -(-chars // SHARD_CHARS))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key: key * shards / 2 ** 64, rounded down, for fewer than 2 ** 32 shards."""
    n, half = np.uint64(shards), np.uint64(32)
    return ((keys >> half) * n + (((keys & np.uint64(0xFFFFFFFF)) * n) >> half)) >> half


def spans(of: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of each run of a sorted array: shards that hold nothing cost nothing."""
    if len(of):
        edge = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        yield from zip(of[edge[:-1]].tolist(), edge[:-1], edge[1:], strict=True)


class WordHashes(dict):
    """Hashes of words, kept for those met; begun anew when it has grown too large."""

    def __init__(self, most: int = 300_000):
        from xxhash import xxh64_intdigest

        super().__init__()
        self.most, self.digest = most, xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = self.digest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def portions(batches: Iterator, split: Callable[[str | None], list[bytes]]) -> Iterator:
    """Arrow batches (id, text) -> (record batch slice, words of each row), about TOKENS words at once."""
    for batch in batches:
        start, words, n = 0, [], 0
        for k, t in enumerate(batch.column(1)):
            words.append(split(t.as_py()))
            n += len(words[-1])
            if n >= TOKENS or k + 1 == batch.num_rows:
                yield batch.slice(start, k + 1 - start), words
                start, words, n = k + 1, [], 0


def distinct(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if counts is None:
        found, n = np.unique(keys, return_counts=True)
        return found, n.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first) if len(keys) else np.empty(0, np.int64)


def small(counts: np.ndarray) -> bytes:
    """Counts in the narrowest integers that hold them, after one byte that says which."""
    kind = next(k for k in ("u1", "u2", "u4", "u8") if not len(counts) or counts.max() < 1 << (8 * int(k[1])))
    return kind[1].encode() + counts.astype("<" + kind).tobytes()


def unsmall(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u" + data[:1].decode(), offset=1).astype(np.int64)


def packed(keys: np.ndarray, counts: np.ndarray, shards: int, batch: int = 0) -> list[tuple[int, int, bytes, bytes]]:
    """Rows (shard, batch, keys, counts) of sorted distinct keys."""
    return [(s, batch, keys[a:b].tobytes(), small(counts[a:b])) for s, a, b in spans(shard_of(keys, shards))]


PACKED = "shard int, batch int, k binary, c binary"


def record_batch(rows: list[tuple]):
    import pyarrow as pa

    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["shard", "batch", "k", "c"])


def by_shard(rows: DataFrame, shards: int, work: Callable[[int, Iterator], Iterator], schema: str) -> DataFrame:
    """work(shard, iterator of (batch, k, c) in order of batch), for every shard.

    work yields Arrow record batches.  It may be repeated when an executor is
    lost, so it must write the same files again from the same input.
    """

    def run(batches: Iterator) -> Iterator:
        def each():
            for b in batches:
                s, n = b.column(0).to_pylist(), b.column(1).to_pylist()
                for k in range(b.num_rows):
                    yield s[k], n[k], b.column(2)[k].as_py(), b.column(3)[k].as_py()

        from itertools import groupby

        for s, group in groupby(each(), key=lambda x: x[0]):
            yield from work(s, (x[1:] for x in group if x[2]))

    spark = rows.sparkSession
    every = spark.range(shards).selectExpr("cast(id as int) shard", "-1 batch", "cast('' as binary) k", "cast('1' as binary) c")
    dealt = rows.select("shard", "batch", "k", "c").unionByName(every).repartitionById(shards, "shard").sortWithinPartitions("shard", "batch")
    return dealt.mapInArrow(run, schema)


class Sorted:
    """The sorted arrays <uri>/<name>-<shard>.<column> of all shards, mapped when first asked for."""

    def __init__(self, uri: str, name: str, shards: int, **columns: str):
        self.uri, self.name, self.shards, self.columns = uri, name, shards, columns
        self._open: dict = {}

    def column(self, shard: int, name: str) -> np.ndarray:
        at = (shard, name)
        if at not in self._open:
            uri = f"{self.uri}/{self.name}-{shard}.{name}"
            self._open[at] = map_array(uri, self.columns[name]) if exists(uri) else np.empty(0, self.columns[name])
        return self._open[at]

    def find(self, keys: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
        """For sorted keys: (shard, slice of keys, places in the shard, whether found there)."""
        for s, a, b in spans(shard_of(keys, self.shards)):
            own, part = self.column(s, "keys"), keys[a:b]
            i = np.searchsorted(own, part)
            ok = np.zeros(len(part), bool)
            inside = i < len(own)
            ok[inside] = own[i[inside]] == part[inside]
            yield s, slice(a, b), i, ok

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        for _, part, _, ok in self.find(keys):
            out[part] = ok
        return out
