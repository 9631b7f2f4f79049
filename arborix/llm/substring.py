"""Repeated passages by a log-structured index of window hashes.

Documents arrive in batches.  Each batch leaves, in every shard, one immutable
sorted run of hashes, and is merge-joined with the runs before it to find what
repeats.  Runs of one level are merged into one of the next when there are FAN
of them; all others stay as they are, so an increment writes its own run and,
now and then, a compacted one.  A manifest names the shards and the runs of
each version.

So that the index stays small it holds, of each window of 35 words, only the
hash of one of its 16-word grams, the least of them: equal windows have equal
least grams, so a window can only repeat where its gram does.  Those windows
are then verified by a 128-bit hash of their bytes.  With postings the index
also knows which documents hold a gram, so that an increment reads only the
older documents in which one of its grams stands.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sorted_runs import PACKED, Sorted, WordHashes, by_shard, distinct, mix64, n_shards, packed, portions, record_batch, shard_of, spans, unsmall
from .storage import delete_file, exists, make_dir, map_array, new_path, read_text, write_array, write_text

WINDOW, GRAM = 35, 16
BATCHES = 4
#: Runs of one level that are merged into one of the next.
FAN = 4
_BASE = 0x9E3779B97F4A7C15
_MOST = np.uint64((1 << 64) - 1)
#: Takes the place of the id of a row without one.
NO_ID = -(1 << 63)


def split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def rolled(h: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hashes of all windows of so many words, by prefix sums of a polynomial."""
    n = len(h)
    if n < length:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))
        back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - length, pow(base, -1, 1 << 64), np.uint64)]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power)])
        return mix64((sums[length:] - sums[:-length]) * back)


def _rolling(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over each n neighbours."""
    width = 1
    while width * 2 <= n:
        x = op(x[:-width], x[width:])
        width *= 2
    return op(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def _grams(words: list[list[bytes]], hashes: WordHashes):
    """(lens, ok: whether a window starts at a place, least gram of each window, grams)."""
    lens = np.array([len(w) for w in words], np.int64)
    h = np.concatenate([np.empty(0, np.uint64), *(hashes.of(w) for w in words)])
    if len(h) < WINDOW:
        return lens, np.zeros(0, bool), np.empty(0, np.uint64), np.empty(0, np.uint64)
    end = np.repeat(np.cumsum(lens), lens)
    place = np.arange(len(h))
    grams = rolled(h, GRAM, _BASE)
    grams[(place + GRAM > end)[: len(grams)]] = _MOST
    ok = (place + WINDOW <= end)[: len(h) - WINDOW + 1]
    return lens, ok, _rolling(grams, WINDOW - GRAM + 1, np.minimum), grams


def _taken(ok: np.ndarray, least: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Places of the grams that are the least of a window which holds them."""
    n = WINDOW - GRAM
    low = np.zeros(len(grams) + n, np.uint64)
    low[n : n + len(least)] = np.where(ok, least, np.uint64(0))
    return np.flatnonzero((_rolling(low, n + 1, np.maximum)[: len(grams)] == grams) & (grams != _MOST))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))


def _fingerprints(texts: DataFrame, shards: int, batches: int) -> DataFrame:
    """Packed keys of the documents (id, t), by batch."""

    def run(arrow: Iterator) -> Iterator:
        hashes = WordHashes()
        for part, words in portions(arrow, split):
            of = np.asarray(part.column(2))
            for b in np.unique(of):
                _, ok, least, grams = _grams([w for w, x in zip(words, of, strict=True) if x == b], hashes)
                if ok.any():
                    keys, counts = distinct(mix64(grams[_taken(ok, least, grams)]))
                    yield record_batch(packed(keys, np.minimum(counts, 2), shards, int(b)))

    return texts.select("id", "t", F.pmod(F.xxhash64("id", "t"), F.lit(batches)).cast("int").alias("batch")).mapInArrow(run, PACKED)


def _postings(texts: DataFrame, shards: int) -> DataFrame:
    """Rows (shard, batch, k: keys, c: ids) of the documents (id, t), keys sorted."""

    def run(arrow: Iterator) -> Iterator:
        hashes = WordHashes()
        for part, words in portions(arrow, split):
            lens, ok, least, grams = _grams(words, hashes)
            if ok.any():
                at = _taken(ok, least, grams)
                ids = np.repeat(part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False), lens)[at]
                pairs = np.unique(np.stack([mix64(grams[at]), ids.astype(np.int64).view(np.uint64)], 1), axis=0)
                yield record_batch([(s, 0, pairs[a:b, 0].tobytes(), pairs[a:b, 1].tobytes()) for s, a, b in spans(shard_of(pairs[:, 0], shards))])

    return texts.mapInArrow(run, PACKED)


class FingerprintIndex:
    """Sorted immutable runs of gram hashes in a shared folder, shard by shard.

    Files are never changed, and a task that is repeated writes the same files
    again.  A manifest for each version names the number of shards and the runs
    (name, level); opening a folder takes the latest.  With ``postings`` each
    append also leaves the ids of the documents of each hash.
    """

    def __init__(self, spark: SparkSession, uri: str | None = None, shards: int | None = None, postings: bool = False):
        self.spark, self.uri = spark, uri or make_dir(spark, new_path(spark, "runs"))
        self.version, self.shards, self.runs, self.postings = 0, shards, [], postings
        while exists(f"{self.uri}/manifest-{self.version + 1}.json"):
            self.version += 1
        if self.version:
            known = json.loads(read_text(f"{self.uri}/manifest-{self.version}.json"))
            if shards not in (None, known["shards"]):
                raise ValueError(f"this index has {known['shards']} shards")
            self.shards, self.runs, self.postings = known["shards"], [tuple(r) for r in known["runs"]], known["postings"]

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> int:
        """Add documents in batches; gives the number of distinct hashes of theirs that repeat.

        Each batch makes a run and is merge-joined with the runs there.  Only
        runs that are new are written: the batches', or what they are merged
        to, with old ones if those complete a level.
        """
        texts, version = _texts(docs, id_col, text_col), self.version + 1
        self.shards = self.shards or n_shards(texts, "t")
        uri, before, shards = self.uri, list(self.runs), self.shards
        plan = _compaction(before, version, batches)

        def work(shard: int, rows: Iterator) -> Iterator:
            from itertools import groupby

            import pyarrow as pa

            runs = {name: map_array(f"{uri}/{name}-{shard}.keys", "<u8") for name, _ in before}
            repeats, none = [], np.empty(0, "<u8")
            groups = groupby(rows, key=lambda r: r[0])
            batch, group = next(groups, (batches, ()))
            for b, (name, merges) in enumerate(plan):
                keys, counts = none, none
                if batch == b:
                    group = list(group)
                    keys, counts = distinct(np.concatenate([np.frombuffer(k, "<u8") for _, k, _ in group]), np.concatenate([unsmall(c) for _, _, c in group]))
                    batch, group = next(groups, (batches, ()))
                twice = counts >= 2
                for run in runs.values():
                    at = np.searchsorted(run, keys)
                    inside = at < len(run)
                    twice[inside] |= run[at[inside]] == keys[inside]
                repeats.append(keys[twice])
                runs[name] = keys
                for made, parts in merges:
                    runs[made] = np.unique(np.concatenate([runs.pop(p) for p in parts]))
            found = np.unique(np.concatenate([none, *repeats]))
            old = {name for name, _ in before}
            for name, keys in runs.items():
                if name not in old:
                    write_array(f"{uri}/{name}-{shard}.keys", keys)
            write_array(f"{uri}/repeat{version}-{shard}.keys", found)
            yield pa.RecordBatch.from_arrays([pa.array([len(found)], pa.int64())], names=["n"])

        n = by_shard(_fingerprints(texts, shards, batches), shards, work, "n long").agg(F.sum("n")).first()[0]
        if self.postings:
            self._post(texts, version)
        self.runs = _runs_after(before, plan)
        self.version = version
        write_text(f"{uri}/manifest-{version}.json", json.dumps({"shards": shards, "runs": self.runs, "postings": self.postings}))
        self.vacuum()
        return n or 0

    def vacuum(self) -> int:
        """Delete the runs that neither this version nor the one before names, and the repeats of versions before those; gives the number of files.

        A reader of the version before may still be at work; older ones must have ended.
        """
        uri, shards = self.uri, self.shards
        named = [json.loads(read_text(f"{uri}/manifest-{v}.json")) for v in range(max(1, self.version - 2), self.version + 1)]
        live = {name for m in named[-2:] for name, _ in m["runs"]}
        gone = [name for m in named[:-2] for name, _ in m["runs"] if name not in live] + [f"repeat{self.version - 2}"] * (self.version > 2)
        if not gone:
            return 0

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                n = sum(delete_file(f"{uri}/{name}-{s}.keys") for s in batch.column(0).to_pylist() for name in gone)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

        return self.spark.range(shards).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0

    def _post(self, texts: DataFrame, version: int) -> None:
        uri = self.uri

        def work(shard: int, rows: Iterator) -> Iterator:
            import pyarrow as pa

            none = np.empty(0, "<u8")
            rows = list(rows)
            keys, ids = (np.concatenate([none, *(np.frombuffer(r[i], "<u8") for r in rows)]) for i in (1, 2))
            order = np.argsort(keys, kind="stable")
            write_array(f"{uri}/posting{version}-{shard}.keys", keys[order])
            write_array(f"{uri}/posting{version}-{shard}.ids", ids[order])
            yield pa.RecordBatch.from_arrays([pa.array([len(keys)], pa.int64())], names=["n"])

        by_shard(_postings(texts, self.shards), self.shards, work, "n long").agg(F.sum("n")).first()

    def holders(self) -> DataFrame:
        """Rows (id): the documents of earlier appends that hold a hash which repeats in the last one, and rows without an id."""
        uri, version = self.uri, self.version

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    want = map_array(f"{uri}/repeat{version}-{shard}.keys", "<u8")
                    for v in range(1, version):
                        keys, ids = (map_array(f"{uri}/posting{v}-{shard}.{c}", "<u8") for c in ("keys", "ids"))
                        a, b = (np.searchsorted(keys, want, side=s) for s in ("left", "right"))
                        hit = np.repeat(a, b - a) + np.arange(int((b - a).sum())) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
                        yield pa.RecordBatch.from_arrays([pa.array(np.unique(ids[hit].view(np.int64)))], names=["id"])

        shards = self.spark.range(self.shards).selectExpr("cast(id as int) shard").repartitionById(self.shards, "shard")
        return shards.mapInArrow(run, "id long").distinct()


def _compaction(before: list[tuple[str, int]], version: int, batches: int) -> list[tuple[str, list]]:
    """For each batch its run's name and the merges (made, parts) that follow it."""
    runs, out = list(before), []
    for b in range(batches):
        runs.append((f"run{version}.{b}.0", 0))
        merges, level = [], 0
        while sum(at == level for _, at in runs) >= FAN:
            parts = [name for name, at in runs if at == level]
            level += 1
            runs = [r for r in runs if r[0] not in parts] + [(f"run{version}.{b}.{level}", level)]
            merges.append((runs[-1][0], parts))
        out.append((f"run{version}.{b}.0", merges))
    return out


def _runs_after(before: list[tuple[str, int]], plan: list[tuple[str, list]]) -> list[tuple[str, int]]:
    level = dict(before)
    for name, merges in plan:
        level[name] = 0
        for made, parts in merges:
            level[made] = 1 + max(level.pop(p) for p in parts)
    return list(level.items())


@cache
def _mapped(uri: str, name: str, shards: int, columns: tuple[str, ...]) -> Sorted:
    return Sorted(uri, name, shards, **dict.fromkeys(columns, "<u8"))


def _window_hashes(words: list[list[bytes]], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of the 128-bit hash of the bytes of the windows that start at these places."""
    from xxhash import xxh3_128_digest as digest

    flat = [w for t in words for w in t]
    text = b" ".join(flat)
    ends = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])[at].tolist()
    made = b"".join([digest(text[a:e]) for a, e in zip(first, ends[at + WINDOW - 1].tolist(), strict=True)])
    both = np.frombuffer(made, "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _suspects(words: list[list[bytes]], hashes: WordHashes, index: Sorted):
    """(lens, places of windows whose least gram repeats, their two hashes)."""
    lens, ok, least, _ = _grams(words, hashes)
    at = np.flatnonzero(ok)
    if len(at):
        keys, back = np.unique(mix64(least[at]), return_inverse=True)
        at = at[index.has(keys)[back]]
    if not len(at):
        return lens, at, np.empty(0, np.uint64), np.empty(0, np.uint64)
    return lens, at, *_window_hashes(words, at)


def repeated_windows(texts: DataFrame, index: FingerprintIndex) -> str:
    """Write the hashes of windows that occur twice or more in texts (id, t); gives their folder."""
    uri, shards, repeats = index.uri, index.shards, f"repeat{index.version}"
    out = make_dir(index.spark, new_path(index.spark, "windows"))

    def emit(arrow: Iterator) -> Iterator:
        hashes, known = WordHashes(), _mapped(uri, repeats, shards, ("keys",))
        for _, words in portions(arrow, split):
            _, _, a, b = _suspects(words, hashes, known)
            if len(a):
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                first = np.flatnonzero(new)
                n = np.minimum(np.diff([*first, len(a)]), 2)
                a, b = a[first], b[first]
                yield record_batch([(s, 0, a[i:j].tobytes(), b[i:j].tobytes() + n[i:j].astype("u1").tobytes()) for s, i, j in spans(shard_of(a, shards))])

    def work(shard: int, rows: Iterator) -> Iterator:
        import pyarrow as pa

        a, b, n = ([np.empty(0, kind)] for kind in ("<u8", "<u8", "u1"))
        for _, k, c in rows:
            a.append(np.frombuffer(k, "<u8"))
            b.append(np.frombuffer(c, "<u8", len(k) // 8))
            n.append(np.frombuffer(c, "u1", offset=len(k)))
        a, b, n = np.concatenate(a), np.concatenate(b), np.concatenate(n).astype(np.int64)
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)])
        twice = first[np.add.reduceat(n, first) >= 2] if len(first) else first
        # of windows with equal first hashes, one entry; the second hash tells them apart
        write_array(f"{out}/window-{shard}.keys", a[twice])
        write_array(f"{out}/window-{shard}.second", b[twice])
        yield pa.RecordBatch.from_arrays([pa.array([len(twice)], pa.int64())], names=["n"])

    by_shard(texts.mapInArrow(emit, PACKED), shards, work, "n long").agg(F.sum("n")).first()
    return out


def _is_repeated(windows: Sorted, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    order = np.argsort(a, kind="stable")
    out = np.zeros(len(a), bool)
    for s, part, i, ok in windows.find(a[order]):
        own, second = windows.column(s, "keys"), windows.column(s, "second")
        mine, want, key = order[part], b[order[part]], a[order[part]]
        while ok.any():
            out[mine[ok]] |= second[i[ok]] == want[ok]
            i = i + 1
            more = ok & (i < len(own))
            more[more] = own[i[more]] == key[more]
            ok = more
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """Rows (id, n_words, n_removed, kept, kept_sha256): one for each row of docs.

    Every word that a window of 35 words covers goes, if the window's words
    also start anywhere else, in the same text too.  kept: the other words,
    joined by one space.  Null, empty and short texts lose nothing; rows that
    repeat a long text lose all of it.  An empty table gives no rows.

    For increments pass the index of the documents before, and their table as
    history; the rows returned are those of docs.  Of the history only the
    documents that hold a hash of the new ones are verified, if the index has
    postings, else all.
    """
    index = index or FingerprintIndex(docs.sparkSession)
    index.append(docs, id_col, text_col, batches)
    texts = _texts(docs, id_col, text_col)
    every = texts
    if history is not None:
        old = _texts(history, id_col, text_col)
        if index.postings:
            old = old.withColumn("k", F.coalesce("id", F.lit(NO_ID))).join(index.holders().withColumnRenamed("id", "k"), "k", "left_semi").select("id", "t")
        every = texts.unionByName(old)
    out = repeated_windows(every, index)
    uri, shards, repeats = index.uri, index.shards, f"repeat{index.version}"

    def cut(arrow: Iterator) -> Iterator:
        import pyarrow as pa

        hashes = WordHashes()
        known = _mapped(uri, repeats, shards, ("keys",))
        windows = _mapped(out, "window", shards, ("keys", "second"))
        for part, words in portions(arrow, split):
            lens, at, a, b = _suspects(words, hashes, known)
            at = at[_is_repeated(windows, a, b)] if len(at) else at
            step = np.zeros(int(lens.sum()) + 1, np.int64)
            np.add.at(step, at, 1)
            np.add.at(step, at + WINDOW, -1)
            gone = np.cumsum(step)[:-1] > 0
            ends = np.cumsum(lens)
            kept, removed = [], []
            for w, e in zip(words, ends, strict=True):
                g = gone[e - len(w) : e]
                n = int(g.sum())
                removed.append(n)
                kept.append(b" ".join(w) if not n else b" ".join([w[i] for i in np.flatnonzero(~g)]))
            cols = [part.column(0), pa.array(lens), pa.array(removed, pa.int64()), pa.array([k.decode("utf-8", "replace") for k in kept], pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_words", "n_removed", "kept", "kept_sha256"])

    return texts.mapInArrow(cut, "id long, n_words long, n_removed long, kept string, kept_sha256 string")
