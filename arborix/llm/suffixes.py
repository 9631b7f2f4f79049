"""Repeated byte strings by a sparse, range-partitioned suffix array.

Of each string of ``length`` bytes the least gram (by hash, leftmost) is its
anchor: equal strings have equal anchors at equal places.  So it is enough to
sort the suffixes that begin at anchors, one byte in a dozen, each with the
bytes of the strings that share the anchor.

1. Grams of anchors are counted by hash.  A string can only repeat where its
   anchor's gram stands in two documents.
2. The suffixes at such anchors are written to the shared folder and
   range-partitioned by their leading bytes, between splitters that Spark
   samples.  Equal leading grams are never split, so what two buckets hold
   is told apart by their first bytes; nothing is equal across a border.
3. A bucket is sorted piece by piece by multikey quicksort with eight bytes as
   one character.  Equal suffixes fall together; those that share the gram only
   are compared string by string, by the same sort.

Hot groups: of the equal suffixes that a map task meets, one row travels, with
the smallest id, and what stands in documents of larger ids is decided there.
Grams of very many rows (at most PART of them can exist) are dealt string by
string, by the hash of each string, instead of by the gram.
"""

from __future__ import annotations

import gc
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import PART, drop, release, save, scratch

LENGTH, GRAM = 50, 16
#: Grams of fewer rows than this are never dealt string by string.
HOT = 1 << 14
#: Bytes of text handled at once, and of suffixes kept by a map task or sorted at once by a bucket.
BLOCK, PIECE = 1 << 18, 1 << 22
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
#: Takes the place of the id of a row without one: larger than any other.
LAST = (1 << 63) - 1

SUFFIXES = "lead long, h long, s binary, off int, id long, places binary, dk long, p long, n long"
RANGES = "dk long, p long, n long"


def _key(id_col: str, text_col: str) -> list[Column]:
    """(dk: tells documents apart, id, t: bytes of the text)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    row = F.col(f"`{id_col}`").cast("long")
    return [F.xxhash64(row, text).alias("dk"), F.coalesce(row, F.lit(LAST)).alias("id"), text.alias("t")]


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def grams(data: np.ndarray) -> np.ndarray:
    """Hashes of all grams of GRAM bytes, a multiple of eight."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)).astype(np.uint64)
    n = len(data) - GRAM + 1
    h = eight[:n] * _ODD[0]
    for k in range(1, GRAM // 8):
        h += eight[8 * k : 8 * k + n] * _ODD[k % len(_ODD)]
        h ^= h >> np.uint64(29)
    h *= _ODD[-1]
    h ^= h >> np.uint64(32)
    return h


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: (starts of the texts, and of each run of strings that share an anchor: text, first string, last string, anchor's place, hash)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return begin, none, none, none, none, none.astype(np.uint64)
    h, width = grams(data), LENGTH - GRAM + 1
    least = _least(h, width)
    change = np.empty(len(least) + 1, bool)
    np.not_equal(least[1:], least[:-1], out=change[1:-1])
    change[begin[:-1][begin[:-1] < len(least)]] = True
    change[[0, -1]] = True
    # no string begins in the last places of a text
    tail = np.maximum(begin[1:, None] - np.arange(1, LENGTH), 0).ravel()
    open_ = np.ones(len(least) + 1, bool)
    open_[tail[tail < len(least)]] = False
    change[:-1] &= open_[:-1]
    change[1:-1] |= open_[1:-1] != open_[:-2]
    edge = np.flatnonzero(change)
    first, last = edge[:-1], edge[1:] - 1
    first, last = first[open_[first]], last[open_[first]]
    v = least[first]
    # the anchor of a string is its leftmost least gram
    at = first + np.argmax(np.lib.stride_tricks.sliding_window_view(h, width)[first] == v[:, None], 1)
    if (more := np.flatnonzero(at < last)).size:  # the least gram stands again behind its place, as in periodic text: another run begins there
        parts = []
        for k in more.tolist():
            places = first[k] + np.flatnonzero(h[first[k] : last[k] + width] == v[k])
            own = np.concatenate([[first[k]], places[places < last[k]] + 1])
            parts.append((own, np.concatenate([own[1:] - 1, [last[k]]]), places[np.searchsorted(places, own)], np.full(len(own), v[k])))
        alone = np.ones(len(first), bool)
        alone[more] = False
        first, last, at, v = (np.concatenate([x[alone], *y]) for x, y in zip((first, last, at, v), zip(*parts, strict=True), strict=True))
        order = np.argsort(first, kind="stable")
        first, last, at, v = first[order], last[order], at[order], v[order]
    return begin, np.searchsorted(begin, first, side="right") - 1, first, last, at, v


def _blocks(batches: Iterator, *columns: str) -> Iterator[tuple]:
    """Arrow batches -> lists of the columns, about BLOCK bytes of the text, the last column, at once."""
    import pyarrow.compute as pc

    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        start = size = 0
        lengths = pc.binary_length(cols[-1]).to_numpy(zero_copy_only=False)
        for k in range(batch.num_rows):
            size += int(lengths[k])
            if size >= BLOCK or k + 1 == batch.num_rows:
                yield tuple(c.slice(start, k + 1 - start) for c in cols)
                start, size = k + 1, 0


def _batch(schema: str, **columns):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    n = max(len(c) for c in columns.values())
    return pa.RecordBatch.from_arrays([pa.array(columns[f], kinds[k]) if f in columns else pa.nulls(n, kinds[k]) for f, k in fields], names=[f for f, _ in fields])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _counted(batches: Iterator) -> Iterator:
    """(dk, t) -> (h, dk, n): n documents of a block hold the gram h; one of them travels, the others have n 0 and repeat it."""
    for dk, t in _blocks(batches, "dk", "t"):
        _, of, _, _, _, h = anchors(t.to_pylist())
        if not len(h):
            continue
        order = np.argsort(h, kind="stable")  # texts come in order
        h, of = h[order], of[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
        h, of = h[new], of[new]
        first = np.concatenate([[True], h[1:] != h[:-1]])
        n = np.zeros(len(h), np.int64)
        n[first] = np.diff([*np.flatnonzero(first), len(h)])
        yield _batch("h long, dk long, n long", h=_signed(h), dk=dk.to_numpy()[of], n=n)


def _repeated(hot_rows: int, batches: Iterator) -> Iterator:
    """Rows (h, dk, n) in order of h -> (h, dk, null) where h is held by two documents or more, and (h, null, number) for those of hot_rows rows or more."""

    def decided(h, dk, n):
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        total = np.add.reduceat(n, first)
        rows = np.diff([*first, len(h)])
        yes = np.repeat(total >= 2, rows)
        yield _batch("h long, dk long, n long", h=h[yes], dk=dk[yes])
        if (total >= hot_rows).any():
            yield _batch("h long, dk long, n long", h=h[first[total >= hot_rows]], n=total[total >= hot_rows])

    kept: list[np.ndarray] = [np.empty(0, np.int64)] * 3
    for batch in batches:
        h, dk, n = (c.to_numpy() for c in batch.columns)
        alone = n == 0
        if alone.any():
            yield _batch("h long, dk long, n long", h=h[alone], dk=dk[alone])
            h, dk, n = h[~alone], dk[~alone], n[~alone]
        if not len(h):
            continue
        h, dk, n = (np.concatenate(x) for x in zip(kept, (h, dk, n), strict=True))
        cut = int(np.searchsorted(h, h[-1]))  # the last gram may go on in the next batch: one row for each block
        kept = [h[cut:], dk[cut:], n[cut:]]
        if cut:
            yield from decided(h[:cut], dk[:cut], n[:cut])
    if len(kept[0]):
        yield from decided(*kept)


def _suffixes(hot: np.ndarray, batches: Iterator) -> Iterator:
    """(dk, id, hs, t) -> suffixes to compare, with the places where they stand, and ranges that are decided."""
    firsts: dict[bytes, list] = {}  # string -> [smallest id, anchor's offset, hash, places in documents of that id: dk, p, dk, p ...]
    gone: list[int] = []  # dk, p, n, dk, p, n ...
    size = 0

    def flush():
        nonlocal size
        if firsts:
            strings, values = list(firsts), list(firsts.values())
            lead = np.frombuffer(b"".join([s[v[1] : v[1] + 8] for s, v in firsts.items()]), ">u8") ^ np.uint64(1 << 63)
            lead, h = _signed(lead), np.array([v[2] for v in values], np.int64)
            if len(hot):  # dealt by the string itself
                for k in np.flatnonzero(np.isin(h, hot)).tolist():
                    lead[k] = int.from_bytes(hashlib.blake2b(strings[k], digest_size=8).digest(), "little", signed=True)
            step = 1 << 15
            for k in range(0, len(strings), step):
                v = values[k : k + step]
                yield _batch(SUFFIXES, lead=lead[k : k + step], h=h[k : k + step], s=strings[k : k + step], off=[x[1] for x in v], id=[x[0] for x in v], places=[array("q", x[3]).tobytes() for x in v])
        if gone:
            yield _batch(SUFFIXES, **dict(zip(("dk", "p", "n"), merged(*np.array(gone, np.int64).reshape(-1, 3).T), strict=True)))
        firsts.clear()
        gone.clear()
        size = 0

    for dks, ids, hs, ts in _blocks(batches, "dk", "id", "hs", "t"):
        texts, dks, ids = ts.to_pylist(), dks.to_pylist(), ids.to_pylist()
        begin, of, first, last, at, h = anchors(texts)
        own = np.repeat(np.arange(len(texts)), hs.value_lengths().to_numpy())
        hit = np.flatnonzero(np.isin(_told(of, h), _told(own, hs.flatten().to_numpy().view(np.uint64))))
        of, base, h = of[hit].tolist(), begin[of[hit]], _signed(h[hit])
        single = np.isin(h, hot).tolist() if len(hot) else [False] * len(hit)
        for k, f, e, x, g, one in zip(of, (first[hit] - base).tolist(), (last[hit] - base).tolist(), (at[hit] - base).tolist(), h.tolist(), single, strict=True):
            dk, doc, text = dks[k], ids[k], texts[k]
            for p, q in ((p, p) for p in range(f, e + 1)) if one else ((f, e),):
                s = text[p : q + LENGTH]
                was = firsts.get(s)
                if was is None:
                    firsts[s] = [doc, x - p, g, [dk, p]]
                    size += len(s) + 150
                elif doc > was[0]:
                    gone += (dk, p, q - p + 1)
                elif doc == was[0]:
                    was[3] += (dk, p)
                else:
                    for r in range(0, len(was[3]), 2):
                        gone += (was[3][r], was[3][r + 1], q - p + 1)
                    was[0], was[3] = doc, [dk, p]
        if size > 4 * PIECE or len(gone) > PIECE // 4:
            yield from flush()
    yield from flush()


def _told(of: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One number for a hash in a text of the block; two that fall together cost a comparison."""
    return (h ^ (of.astype(np.uint64) * _ODD[0])) * _ODD[1]


def merged(dk: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (dk, first string, number of strings), those that touch made one."""
    order = np.lexsort((p, dk))
    dk, p, n = dk[order], p[order], n[order]
    new = np.concatenate([[True], (dk[1:] != dk[:-1]) | (p[1:] > p[:-1] + n[:-1])])[: len(dk)]
    first = np.flatnonzero(new)
    end = np.maximum.reduceat(p + n, first) if len(first) else p
    return dk[first], p[first], end - p[first]


def multikey_order(digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows of digits, whether a row in that order differs from the one before).

    Multikey quicksort: all groups that are equal up to a digit are sorted by
    the next one, and what is equal there as well goes on.  The groups of a
    depth are sorted together.
    """
    n, depth = digits.shape
    order = np.argsort(digits[:, 0], kind="stable")
    new = np.ones(n, bool)
    new[1:] = digits[order[1:], 0] != digits[order[:-1], 0]
    for d in range(1, depth):
        alone = new & np.concatenate([new[1:], [True]])
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        group = np.cumsum(new)[at]
        rows = order[at]
        key = digits[rows, d]
        by = np.lexsort((key, group))
        order[at] = rows[by]
        key, group = key[by], group[by]
        new[at[1:]] |= (key[1:] != key[:-1]) & (group[1:] == group[:-1])
    return order, new


def _digits(padded: np.ndarray, at: np.ndarray, length: np.ndarray | int, width: int) -> np.ndarray:
    """The bytes from each place on, as big-endian numbers of eight; zeros stand behind the length."""
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[at]
    rows *= np.arange(width) < np.reshape(length, (-1, 1))
    return rows.view(">u8").astype(np.uint64)


def _ramp(n: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... for each length."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def compared(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, off: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (string, first part, number of parts): the parts of LENGTH bytes that stand in a string of a smaller id as well.

    String k is the sizes[k] bytes of data from begin[k] on; its anchor is off[k] bytes behind.
    """
    left, right = -(-(LENGTH - GRAM) // 8) * 8, -(-LENGTH // 8) * 8
    padded = np.concatenate([data, np.zeros(right, np.uint8)])
    back = np.concatenate([data[::-1], np.zeros(left, np.uint8)])
    tail = _digits(padded, begin + off, sizes - off, right)
    head = _digits(back, len(data) - (begin + off), off, left)
    order, new = multikey_order(np.concatenate([tail, head, (sizes * 64 + off).astype(np.uint64)[:, None]], 1))
    # equal strings are one, with the smallest id
    first = np.flatnonzero(new)
    low = np.minimum.reduceat(ids[order], first)
    of = np.empty(len(begin), np.int64)
    of[order] = np.cumsum(new) - 1
    rep = order[first]
    lead = tail[rep][:, : GRAM // 8]
    shared = np.zeros(len(rep) + 1, bool)
    shared[1:-1] = (lead[1:] == lead[:-1]).all(1)
    shared = shared[1:] | shared[:-1]
    parts = sizes - LENGTH + 1
    alone = np.flatnonzero(~shared[of] & (low[of] < ids))
    out = [(alone, np.zeros(len(alone), np.int64), parts[alone])]
    some = np.flatnonzero(shared)
    if len(some):
        # strings that share the gram only: part by part
        n = parts[rep[some]]
        by, fresh = multikey_order(_digits(padded, np.repeat(begin[rep[some]], n) + _ramp(n), LENGTH, right))
        start = np.flatnonzero(fresh)
        found = np.repeat(low[some], n)
        found[by] = np.repeat(np.minimum.reduceat(found[by], start), np.diff([*start, len(by)]))
        at = np.full(len(rep), -1)
        at[some] = np.cumsum(n) - n
        rows = np.flatnonzero(shared[of])
        own = parts[rows]
        k = _ramp(own)
        bad = found[np.repeat(at[of[rows]], own) + k] < np.repeat(ids[rows], own)
        edge = np.flatnonzero(bad & ((k == 0) | np.concatenate([[True], ~bad[:-1]])))
        stop = np.flatnonzero(bad & np.concatenate([~bad[1:] | (k[1:] == 0), [True]]))
        out.append((np.repeat(rows, own)[edge], k[edge], stop - edge + 1))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, begin, sizes) of an Arrow column of bytes without nulls."""
    ends = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends[:-1] - ends[0], np.diff(ends)


def _sorted(batches: Iterator) -> Iterator:
    """Suffixes of a bucket in order of their leading bytes -> ranges (dk, p, n) to remove."""
    import pyarrow as pa

    def decided(pieces):
        rows = pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]
        off, ids = rows.column(3).to_numpy().astype(np.int64), rows.column(4).to_numpy()
        row, part, n = compared(*_bytes_of(rows.column(2)), off, ids)
        raw, begin, sizes = _bytes_of(rows.column(5))
        places = np.frombuffer(raw.tobytes(), "<i8").reshape(-1, 2)
        times = sizes[row] // 16
        run = np.repeat(np.arange(len(row)), times)
        at = begin[row][run] // 16 + _ramp(times)
        if len(run):
            yield _batch(RANGES, dk=places[at, 0], p=places[at, 1] + part[run], n=n[run])

    held, size, before = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([c.to_numpy() for c in batch.columns[:2]], 1)
        sizes = np.cumsum(_bytes_of(batch.column(2))[2])
        change = np.flatnonzero(np.concatenate([[before is None or (keys[0] != before).any()], (keys[1:] != keys[:-1]).any(1)]))
        at = done = 0
        while True:  # cut where PIECE is full and the key changes
            k = int(np.searchsorted(sizes, PIECE - size + done))
            k = int(change[i]) if (i := int(np.searchsorted(change, k))) < len(change) else batch.num_rows
            if k >= batch.num_rows:
                break
            if k > at:
                held.append(batch.slice(at, k - at))
            if held:
                yield from decided(held)
            held, size, at = [], 0, k
            done = int(sizes[k - 1]) if k else 0
            change = change[change > k]
        held.append(batch.slice(at))
        size += int(sizes[-1]) - done
        before = keys[-1]
    if held:
        yield from decided(held)


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT) -> DataFrame:
    """Rows (dk, p, n): in the document dk the strings that begin at p and the n - 1 places behind it stand in one with a smaller id; stored."""
    spark, texts = docs.sparkSession, docs.select(*_key(id_col, text_col)).filter(F.length("t") >= LENGTH)
    with scratch(spark) as keep:
        seen = texts.select("dk", "t").mapInArrow(_counted, "h long, dk long, n long")
        # what is decided goes to any task; the others meet by gram
        dealt = seen.repartition(F.when(F.col("n") == 0, F.xxhash64("h", "dk")).otherwise(F.col("h"))).sortWithinPartitions("h")
        grams_ = save(dealt.mapInArrow(lambda b: _repeated(hot_rows, b), "h long, dk long, n long"), "grams")
        held = grams_.filter("dk is not null")
        most = max(hot_rows, held.count() // PART)
        hot = np.array([r.h for r in grams_.filter(F.col("dk").isNull() & (F.col("n") >= most)).select("h").collect()], np.int64)
        wanted = held.groupBy("dk").agg(F.collect_list("h").alias("hs"))
        pieces = save(texts.join(wanted, "dk").select("dk", "id", "hs", "t").mapInArrow(lambda b: _suffixes(hot, b), SUFFIXES), "suffixes")
        drop(grams_)
        spark.range(1).count()  # the session holds on to its last query, and with it to that query's shuffle
        gc.collect()
        release(spark)
        dealt = pieces.filter("s is not null").drop("dk", "p", "n").repartitionByRange("lead", "h").sortWithinPartitions("lead", "h")
        found = dealt.mapInArrow(_sorted, RANGES)
        return keep(save(found.unionByName(pieces.filter("s is null").select("dk", "p", "n")), "ranges"))


def _cut(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        out = []
        for text, ps, ns in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            if not ps:
                out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), text))
                continue
            p, n = np.array(ps, np.int64), np.array(ns, np.int64)
            step = np.zeros(len(text) + 1, np.int64)
            np.add.at(step, p, 1)
            np.add.at(step, p + n + LENGTH - 1, -1)
            gone = np.cumsum(step)[:-1] > 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
            out.append((len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT) -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept_sha256, kept: bytes): one for each row of docs.

    Every byte goes that a string of 50 bytes covers which also starts in a
    document with a smaller id.  Strings are those of the input, overlaps count,
    and none crosses documents.

    A null text is empty.  Rows without an id come after all others and are not
    smaller than each other, nor are rows that repeat an id: they keep what
    they share.  Texts below 50 bytes keep all.  An empty table gives no rows;
    other columns are not read.  Ids are cast to long.
    hot_rows: grams of more rows are dealt string by string.
    """
    ranges = repeated_ranges(docs, id_col, text_col, hot_rows).groupBy("dk").agg(F.collect_list("p").alias("ps"), F.collect_list("n").alias("ns"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), *_key(id_col, text_col))
    return rows.join(ranges, "dk", "left").select("doc", "t", "ps", "ns").mapInArrow(_cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
