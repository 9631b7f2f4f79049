"""Near duplicates by SimHash with deletion-variant signatures.

A fingerprint is cut into segments of 32 bits, half as many as the usual
pigeonhole argument needs, so that of fingerprints which differ in fewer bits
than twice the number of segments at least one segment differs in at most one
bit.  Every distinct segment value is indexed under its 32 one-wildcard
variants (one bit cleared); two values of a segment that differ in exactly one
bit share exactly one variant, and no variant holds more than two values.  So
the index gives pairs of adjacent segment values without any large group.
Documents below equal or adjacent values are then verified in blocks by the
number of differing bits.

A group of many near copies makes large blocks, not many rows: a block gives a
spanning forest of its links, and two blocks the few links that join what the
forests of each connect, never the pairs.

Segments alone are sure for few differing bits.  For a bound on the Jaccard
similarity of the shingles, bands of min-hashes are further segments, links of
fingerprints give way by more than their error, and the links of the forests
are compared by the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected_components
from .storage import arrow_rows, columns, named, save, scratch

BLOCK = 256
#: Of documents at Jaccard 0.8 1 - (1 - 0.8 ** ROWS) ** BANDS share a band, 0.992.
BANDS, ROWS = 16, 6
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of anything but the six ASCII space characters, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fingerprint(text: str | None, shingle: int = 3, n_words: int = 1) -> list[int]:
    """The fingerprint as ``n_words`` signed 64-bit integers.

    The first is the majority vote of the bits of XXH64 (seed 42) over all word
    shingles, repeats included; further ones vote over mixes of the same
    hashes.  Fewer words than a shingle make one shingle; no words give zero.
    """
    from xxhash import xxh64_intdigest as digest

    words = words_of(text)
    if not words:
        return [0] * n_words
    if len(words) < shingle:
        hashes = [digest(b" ".join(words), 42)]
    else:
        hashes = [digest(b" ".join(t), 42) for t in zip(*(words[i:] for i in range(shingle)))]
    h, counts = np.array(hashes, dtype="<u8"), np.zeros((n_words, 64), dtype=np.int64)
    for start in range(0, len(h), 1 << 15):
        part = h[start : start + (1 << 15)]
        for k in range(n_words):
            x = part
            if k:
                x = part * np.uint64(_ODD[(k - 1) % len(_ODD)])
                x = (x ^ (x >> np.uint64(29))) * np.uint64(_ODD[k % len(_ODD)])
                x ^= x >> np.uint64(32)
            counts[k] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(h)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").reshape(-1).tolist()


def shingles_of(text: str | None, shingle: int) -> set[int]:
    """The XXH64 hashes of the distinct shingles."""
    from xxhash import xxh64_intdigest as digest

    words = words_of(text)
    if 0 < len(words) < shingle:
        return {digest(b" ".join(words), 42)}
    return {digest(b" ".join(t), 42) for t in zip(*(words[i:] for i in range(shingle)))}


def jaccard_of(a: set[int], b: set[int]) -> float:
    """Similarity of two sets; two empty ones are equal."""
    common = len(a & b)
    return common / (len(a) + len(b) - common) if a or b else 1.0


def bands_of(shingles: set[int]) -> list[int]:
    """BANDS signed 64-bit keys, each of ROWS min-hashes; no shingles give zeros."""
    from xxhash import xxh64_intdigest as digest

    if not shingles:
        return [0] * BANDS
    rng = np.random.default_rng(5)
    odd, add = (rng.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64) for _ in range(2))
    h, least = np.fromiter(shingles, np.uint64, len(shingles)), None
    for start in range(0, len(h), 1 << 10):
        part = (h[None, start : start + (1 << 10)] * (odd | np.uint64(1)) + add).min(1)
        least = part if least is None else np.minimum(least, part)
    keys = [digest(x.tobytes()) for x in least.reshape(BANDS, ROWS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, n_words: int = 1, bands: bool = False) -> DataFrame:
    """Rows (id, text_key, fp): fp is an array of ``n_words`` longs, one row for each row of docs.

    With bands, a column of that name has the keys of the min-hash bands.
    """
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle, n_words) for t in batch.column(1)]
            made = [pa.array(fps, pa.list_(pa.int64()))]
            if bands:
                made.append(pa.array([bands_of(shingles_of(t.as_py(), shingle)) for t in batch.column(1)], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *made], names=["id", "text_key", "fp", "bands"][: 2 + len(made)])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"))
    return rows.mapInArrow(run, "id long, text_key long, fp array<long>" + (", bands array<long>" if bands else ""))


def _links(nodes: DataFrame, n_words: int, distance: int, index_words: int | None = None) -> DataFrame:
    """nodes (node, fp), distinct -> edges (a, b) that keep every connection of links.

    Two nodes link at ``distance`` or fewer differing bits, if a segment of them
    differs in at most one bit (always so up to ``4 * n_words - 1``).  Segments
    are taken of the first ``index_words`` words.  If nodes have bands, two that
    share one link too, and links at fewer bits keep their own connections.
    """
    import pyarrow as pa

    low, banded = F.lit(0xFFFFFFFF), "bands" in nodes.columns
    index_words = n_words if index_words is None else index_words
    tiers = [distance * 3 // 5, distance * 4 // 5, distance] if banded else [distance]
    parts = [F.struct(F.lit(2 * k + s).alias("s"), F.shiftrightunsigned(F.col("fp")[k], 32 * s).bitwiseAND(low).alias("g")) for k in range(index_words) for s in (0, 1)]
    keys = F.array(*parts)
    if banded:
        keys = F.concat(keys, F.transform("bands", lambda g, i: F.struct((i + 2 * index_words).alias("s"), g.alias("g"))))
    members = nodes.select("node", F.explode(keys).alias("p")).select("node", "p.s", "p.g")
    sizes = save(members.groupBy("s", "g").agg(F.count("*").alias("n")), "segments")
    # a key is the segment's number, the wildcard's place and the other bits
    # a small table that grows 32-fold: dealt out first
    spread = sizes.filter(F.col("s") < 2 * index_words).repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    wild = spread.select("s", "g", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("j"))
    bit = F.expr("shiftleft(1L, j)")
    wild = wild.select((F.col("s") * 32 + F.col("j")).alias("sj"), F.col("g").bitwiseAND(F.bitwise_not(bit)).alias("rest"), "g")
    beside = wild.groupBy("sj", "rest").agg(F.min("g").alias("g1"), F.max("g").alias("g2")).filter("g1 < g2")
    beside = beside.select(F.expr("cast(sj div 32 as int)").alias("s"), "g1", "g2")
    pairs = save(beside.unionByName(sizes.filter("n > 1").select("s", F.col("g").alias("g1"), F.col("g").alias("g2"))), "adjacent")
    used = pairs.select("s", F.explode(F.array("g1", "g2")).alias("g")).distinct()
    # blocks of about BLOCK members, so that no array grows with a group
    # fingerprints follow the few members that stay
    blocks = members.join(sizes.join(used, ["s", "g"]), ["s", "g"]).join(nodes.select("node", "fp"), "node").withColumn("k", F.expr(f"pmod(xxhash64(node), ceil(n / {BLOCK}))"))
    blocks = save(blocks.groupBy("s", "g", "k").agg(F.array_sort(F.collect_list(F.struct("node", "fp"))).alias("m")), "blocks")
    left = blocks.select("s", F.col("g").alias("g1"), F.col("k").alias("k1"), F.col("m").alias("m1"))
    right = blocks.select("s", F.col("g").alias("g2"), F.col("k").alias("k2"), F.col("m").alias("m2"))
    # pairs of blocks are made of numbers first, so that those of one large value are dealt to many tasks
    held = lambda i: sizes.select("s", F.col("g").alias(f"g{i}"), F.ceil(F.col("n") / BLOCK).cast("long").alias(f"n{i}"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    both = pairs.join(held(1), ["s", "g1"]).join(held(2), ["s", "g2"]).withColumn("k1", each("n1")).withColumn("k2", each("n2")).filter("g1 < g2 or k1 <= k2")
    work = both.select("s", "g1", "k1", "g2", "k2").join(left, ["s", "g1", "k1"]).join(right, ["s", "g2", "k2"])
    same = (F.col("g1") == F.col("g2")) & (F.col("k1") == F.col("k2"))
    work = work.select(F.col("m1.node").alias("n1"), F.flatten("m1.fp").alias("f1"), F.col("m2.node").alias("n2"), F.flatten("m2.fp").alias("f2"), same.alias("same"))

    def verify(batches: Iterator) -> Iterator:
        for batch in batches:
            a, b = [], []
            offsets = [np.asarray(batch.column(i).offsets) for i in range(4)]
            values = [np.asarray(batch.column(i).values) for i in range(4)]
            one = batch.column(4).to_pylist()
            for r in range(batch.num_rows):
                n1, f1, n2, f2 = (values[i][offsets[i][r] : offsets[i][r + 1]] for i in range(4))
                f1, f2 = (f.reshape(-1, n_words).view(np.uint64) for f in (f1, f2))
                off = bits_apart(f1, f2)
                if one[r]:
                    pairs = [forest(off <= tier) for tier in tiers]
                else:  # each block keeps its own links: what the least tier connects there counts once
                    pairs = joined(off, *(parts_of(bits_apart(f, f) <= tiers[0]) for f in (f1, f2)), tiers)
                for x, y in pairs:
                    a.append(n1[x])
                    b.append(n2[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *v])) for v in (a, b)], names=["a", "b"])

    return work.mapInArrow(verify, "a long, b long").filter("a <> b").distinct()


def bits_apart(f1: np.ndarray, f2: np.ndarray) -> np.ndarray:
    """Numbers of differing bits of the rows of two arrays of 64-bit words."""
    return sum(np.bitwise_count(f1[:, None, k] ^ f2[None, :, k]).astype(np.int32) for k in range(f1.shape[1]))


def parts_of(linked: np.ndarray) -> np.ndarray:
    """The component of each row of a symmetric matrix of links, numbered from 0."""
    label = np.arange(len(linked))
    linked = linked | np.eye(len(linked), dtype=bool)
    while True:
        low = np.where(linked, label[None, :], len(label)).min(1)
        low = low[low]  # where the least neighbour points to
        if (low == label).all():
            return np.unique(label, return_inverse=True)[1]
        label = low


def joined(off: np.ndarray, rows: np.ndarray, cols: np.ndarray, tiers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each tier links between rows and columns that join their components as all links would: the closest pair of two components.

    So two blocks of a large group give few links, not some for each member.
    """
    by_row, by_col = np.argsort(rows, kind="stable"), np.argsort(cols, kind="stable")
    first = lambda x: np.searchsorted(x, np.arange(x[-1] + 1))
    at = np.arange(off.size, dtype=np.int64).reshape(off.shape)
    code = (off.astype(np.int64) * off.size + at)[by_row][:, by_col]
    least = np.minimum.reduceat(np.minimum.reduceat(code, first(rows[by_row]), 0), first(cols[by_col]), 1)
    near, place = least // off.size, least % off.size
    out = []
    for tier in tiers:
        x, y = forest(near <= tier)
        out.append(np.divmod(place[x, y], off.shape[1]))
    return out


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a matrix of links between rows and columns, few links that connect the same.

    Rows take the least label that a column passes on; the links that passed it
    are returned, so each row stays connected to the row that its label names.
    """
    rows, cols = linked.shape
    label, a, b = np.arange(rows), [], []
    while True:
        own = np.where(linked, label[:, None], rows)
        top = own.argmin(0)
        low = own[top, np.arange(cols)]
        c = np.flatnonzero(low < rows)
        to = np.where(linked, low[None, :], rows)
        best = to.argmin(1)
        new = to[np.arange(rows), best]
        r = np.flatnonzero(new < label)
        a += [top[c], r]
        b += [c, best[r]]
        if not len(r):
            return np.divmod(np.unique(np.concatenate(a) * cols + np.concatenate(b)), cols)
        label[r] = new[r]


def _similar(edges: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, jaccard: float) -> DataFrame:
    """The edges between nodes whose texts' shingles have at least this similarity.

    A tree, the edge of each node to its least neighbour, is compared first; of
    the others then only those that still lie between two components.
    """
    text = F.col(text_col).cast("string")
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "of.id", "of.text_key"), "node")
    # of equal texts only the row that stands for the node travels
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("t"))
    texts = save(ends.join(texts, ["id", "text_key"]).dropDuplicates(["node"]).select("node", "t"), "texts")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    tree = edges.groupBy("a").agg(F.min("b").alias("b"))
    with arrow_rows(docs.sparkSession, 128):
        sure = save(_compared(tree, texts, shingle, jaccard), "similar")
        part = save(connected_components(sure), "similar_parts")
        of = lambda c: part.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
        left = edges.join(tree, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
        left = left.filter(F.coalesce("a_part", "a") != F.coalesce("b_part", "b")).select("a", "b")
        return sure.unionByName(save(_compared(left, texts, shingle, jaccard), "similar"))


def _compared(edges: DataFrame, texts: DataFrame, shingle: int, jaccard: float) -> DataFrame:
    import pyarrow as pa

    both = edges.join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a")

    def run(batches: Iterator) -> Iterator:
        last, of = None, set()
        for batch in batches:
            a, keep = batch.column(0).to_pylist(), []
            for r in range(batch.num_rows):
                if a[r] != last:
                    last, of = a[r], shingles_of(batch.column(2)[r].as_py(), shingle)
                keep.append(jaccard_of(of, shingles_of(batch.column(3)[r].as_py(), shingle)) >= jaccard)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


NO_ID = -(1 << 63)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, n_words: int = 1, distance: int = 2, jaccard: float | None = None
) -> DataFrame:
    """Rows (id, text_key, fp, part, component): one for each row of docs.

    fp is the fingerprint (array of longs), part a label of the component, and
    component the smallest id that can be reached over links, the row's own
    included.  text_key is a hash of the text.  Texts that are null or have no
    words have fingerprint zero and link like any other.  Rows with a null id
    take part; their component is the smallest id that is not null, or null if
    the whole component has none.  Repeated rows fall in one component.  An
    empty table gives no rows.  With ``jaccard`` a link is a pair whose shingles
    have that similarity; bits and bands only find it.
    """
    with scratch(docs.sparkSession) as keep:
        rows = simhash(docs, id_col, text_col, shingle, n_words, jaccard is not None)
        if jaccard is None:
            rows = keep(save(rows, "simhash"))
        else:
            with arrow_rows(docs.sparkSession, 512):
                rows = keep(save(rows, "simhash"))
        more = [F.min(F.struct(F.coalesce("id", F.lit(NO_ID)).alias("id"), "text_key", "bands")).alias("of")] if jaccard is not None else []
        nodes = rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"), *more)
        if n_words == 1:
            nodes = nodes.withColumn("node", F.col("fp")[0])
        else:  # fingerprints whose hashes are equal are told apart
            again = F.row_number().over(Window.partitionBy("node").orderBy("fp"))
            nodes = nodes.withColumn("node", F.xxhash64("fp")).withColumn("again", again).withColumn("node", F.when(F.col("again") == 1, F.col("node")).otherwise(F.xxhash64("fp", "again"))).drop("again")
        nodes = save(nodes, "nodes")
        if jaccard is None:
            links = _links(nodes.select("node", "fp"), n_words, distance)
        else:
            with arrow_rows(docs.sparkSession, 64):
                links = save(_links(nodes.select("node", "fp", "of.bands"), n_words, distance, min(n_words, 2)), "candidates")
            links = _similar(links, nodes, docs, id_col, text_col, shingle, jaccard)
        found = connected_components(links)
        part = save(nodes.join(found, "node", "left").select("fp", "n", "least", F.coalesce("component", "node").alias("part")), "parts")
        least = part.groupBy("part").agg(F.min("least").alias("component"))
        of = keep(save(part.join(least, "part").select("fp", "n", "part", "component"), "classes"))
    return named(rows.select("id", "text_key", "fp"), of, "fp").select("id", "text_key", "fp", "part", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Of each component the row with the smallest id (rows without an id come last, then by text).

    Rows that repeat the same id and text count once.  All columns of docs are
    returned, whatever they are called.
    """
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_arborix_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_arborix_text")]
    rows = docs.select(F.struct(*columns(docs)).alias("_arborix_row"), *key)
    found = near_duplicates(docs, id_col, text_col, **how)
    stay = found.groupBy("part").agg(F.min(F.struct(F.isnull("id").alias("no"), "id", "text_key")).alias("w"))
    stay = stay.select(F.coalesce("w.id", F.lit(NO_ID)).alias("_arborix_id"), F.col("w.text_key").alias("_arborix_text"))
    once = rows.join(stay, ["_arborix_id", "_arborix_text"], "left_semi").groupBy("_arborix_id", "_arborix_text").agg(F.first("_arborix_row").alias("r"))
    return once.select(*[F.col("r")[c].alias(c) for c in docs.columns])
