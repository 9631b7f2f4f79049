"""How filters interact: what each removes, alone and in every order.

Each document gets a mask of the filters that it fails.  Exact copies are found
by an RDD routed by the xxhash of the text: a partition keeps, for each
fingerprint, a chain of the full texts that have it with the smallest id of
each, and every other id fails.  Of the copies that a map task meets only one
row travels with the text, that of the smallest id; the others are decided
there.  ``combineByKey`` then adds up, for each part of the corpus, a vector of
the counts of all masks, and everything asked for follows from the vector.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Bytes of text whose chains one task keeps, and of text that a map task looks through for copies at once.
CHAINS, PORTION = 1 << 23, 1 << 24
#: Takes the place of the id of a row without one: larger than any other.
LAST = (1 << 63) - 1
_SYMBOL = re.compile(r"[#$%&*|]")
_CAPITALS = bytes(range(65, 91))


def mask_of(text: str, raw: bytes) -> int:
    """Bits of the filters that the text fails by itself: A, B, C, D."""
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * capitals > 5 * len(text)) << 2 | bool(_SYMBOL.search(text)) << 3


def _routed(rows: Iterator) -> Iterator:
    """Rows (id, part, text) -> (route, (text or None, id, part, mask, number)): None where a copy of a smaller id has been met."""
    from xxhash import xxh64_intdigest as digest

    held: dict[bytes, list] = {}
    size = 0

    def decided(i, part, mask, n):
        return digest(f"{i}:{part}".encode()), (None, i, part, mask | COPY, n)

    def flush():
        for raw, (low, mask, parts) in held.items():
            h = digest(raw)
            for part, n in parts.items():
                yield h, (raw, low, part, mask, n)
        held.clear()

    for i, part, text in rows:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        i = LAST if i is None else i
        was = held.get(raw)
        if was is None:
            held[raw] = [i, mask_of(text, raw), {part: 1}]
            size += len(raw) + 200
        elif i > was[0]:
            yield decided(i, part, was[1], 1)
        elif i == was[0]:
            was[2][part] = was[2].get(part, 0) + 1
        else:
            for p, n in was[2].items():
                yield decided(was[0], p, was[1], n)
            was[0], was[2] = i, {part: 1}
        if size >= PORTION:
            yield from flush()
            size = 0
    yield from flush()


def _chained(rows: Iterator) -> Iterator:
    """Routed rows -> (id, part, mask, number): ids that are not the smallest of their text fail."""
    chains: dict[int, list] = {}
    for h, (raw, i, part, mask, n) in rows:
        if raw is None:
            yield i, part, mask, n
            continue
        chain = chains.setdefault(h, [])
        for link in chain:
            if link[0] == raw:
                break
        else:
            link = [raw, i, mask, []]
            chain.append(link)
        link[1] = min(link[1], i)
        link[3].append((i, part, n))
    for chain in chains.values():
        for _, low, mask, met in chain:
            for i, part, n in met:
                yield i, part, mask | (COPY if i > low else 0), n


def masks(docs: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, part, mask, n): n rows of docs have this id, part and mask of failed filters.

    The texts travel once, to tasks of CHAINS bytes of text each.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // CHAINS))
    met = rows.rdd.mapPartitions(_routed).partitionBy(tasks, lambda h: h).mapPartitions(_chained)
    out = spark.createDataFrame(met, "id long, part string, mask int, n long")
    return out.withColumn("id", F.when(F.col("id") != LAST, F.col("id")))


def _labelled(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """rows with good and toxic, 1 where a label of the id says so; rows without an id have no label."""
    of = labels.groupBy(F.col(f"`{id_col}`").cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    named = rows.filter("id is not null").join(of, "id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return named.unionByName(rows.filter("id is null").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic")))


def mask_counts(rows: DataFrame):
    """An RDD of (part, array [rows, good, toxic] x masks) from rows (part, mask, n, good, toxic)."""
    size = 1 << len(FILTERS)

    def add(v: np.ndarray, x: tuple) -> np.ndarray:
        mask, n, good, toxic = x
        v[:, mask] += (n, n * good, n * toxic)
        return v

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a += b
        return a

    pairs = rows.select("part", "mask", "n", "good", "toxic").rdd.map(lambda r: (r[0], (r[1], r[2], r[3], r[4])))
    return pairs.combineByKey(lambda x: add(np.zeros((3, size), np.int64), x), add, join)


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit_rows(part: str, counts: np.ndarray) -> list[tuple]:
    """One row of AUDIT for each order of the filters and each step in it, from the counts of the masks."""
    orders = list(permutations(range(len(FILTERS))))
    fails = np.array([[m >> k & 1 for m in range(counts.shape[1])] for k in range(len(FILTERS))], bool)
    lost = np.zeros(len(FILTERS), np.int64)
    steps = []
    for order in orders:
        gone = np.zeros(counts.shape[1], bool)
        for k in order:
            now = fails[k] & ~gone
            again = int(counts[0, fails[k] & gone].sum())
            gone |= now
            removed, good, toxic = (int(x) for x in counts[:, now].sum(1))
            lost[k] += removed
            steps.append((k, int(counts[0, ~gone].sum()), removed, again, good, toxic))
    alone = [int(counts[0, 1 << k]) for k in range(len(FILTERS))]
    rows = zip(((o, s) for o in orders for s in range(len(FILTERS))), steps, strict=True)
    return [(part, "".join(FILTERS[f] for f in o), s + 1, kept, removed, again, alone[k], good, toxic, int(lost[k])) for (o, s), (k, kept, removed, again, good, toxic) in rows]


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of AUDIT: for each part, order of the five filters and step, what the step keeps and removes.

    A: under 50 words.  B: fewer than 65 % of the words distinct.  C: over 5 %
    of the characters are A-Z.  D: one of #$%&*| stands in it.  E: the text of a
    document with a smaller id.

    A null text is empty, a null part the empty string.  Rows without an id come
    after all others: they fail E where a row with an id has their text, and not
    by each other, nor do rows that repeat an id.  Several labels of an id count
    if one of them says so; rows without a label are neither good nor toxic.  An
    empty table gives no rows.  Ids are cast to long.
    """
    rows = _labelled(masks(docs, part_col, id_col, text_col), labels, id_col)
    found = mask_counts(rows).flatMap(lambda kv: audit_rows(*kv))
    return docs.sparkSession.createDataFrame(found, AUDIT)
