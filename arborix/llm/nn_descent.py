"""Near-duplicate vectors by NN-descent.

Equal vectors are one node.  A neighbour graph is begun from a forest of random
projection trees and refined by joining neighbours of neighbours: around each
node, the vectors in its list and those that list it are compared with each
other, until few links are new.

A list that is full of links is saturated: it is enlarged by further links.  A
group may still have more than it can hold, so components of the links are
joined by passes over new trees in which lists hold only members of other
components, until a pass finds no link and an audit against brute force finds
enough of them connected.
Components are compared in blocks, so a large group gives sums of links for
each vector and a spanning forest, never its pairs.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected_components
from .simhash import forest
from .storage import arrow_rows, drop, named, save, scratch

LOG = logging.getLogger(__name__)
THRESHOLD = 0.95
#: Length of a neighbour list, trees, vectors in a leaf, vectors in a block.
K, TREES, LEAF, BLOCK = 12, 8, 384, 512
#: A list that is full of links grows to so many times its length, by further links only.
GROWTH = 4
#: Share of pairs at the threshold that no tree of a forest puts in one leaf.
MISS = 0.01
#: Vectors that are audited against all others: so many, or so many times the root of their number; links that an audit needs.
AUDIT, AUDIT_ROOT, AUDIT_LINKS = 64, 8, 100
#: Vectors of a pass of the audit.
AUDIT_PASS = 1 << 13
#: Neighbours less similar than this don't join others: they lead to no links.
FLOOR = 0.5
ROUNDS = 6
_LISTS = "node long, near array<struct<sim: float, other: long>>"


def _nodes(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows (id, key), nodes (node, mult, dim, v)): v is the unit vector of doubles."""
    e = F.col("e")
    sound = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    top = F.array_max(F.transform(e, F.abs))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("e"))
    rows = rows.select("id", "e", F.coalesce(sound & (top > 0) & F.col("id").isNotNull(), F.lit(False)).alias("sound"))
    groups = rows.filter("sound").groupBy("e").agg(F.min("id").alias("node"), F.count("*").alias("mult"))
    # scaled first, so that squares neither vanish nor overflow
    scaled = groups.withColumn("s", F.transform("e", lambda x: x / F.array_max(F.transform("e", F.abs))))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x))
    return rows, scaled.select("node", "mult", F.size("e").alias("dim"), F.transform("s", lambda x: x / norm).alias("v"))


def _best(ids: np.ndarray, sims: np.ndarray, k: int, threshold: float):
    """For each row of a similarity matrix its k largest, and further ones while they are links: (numbers, ids, similarities)."""
    most = min(GROWTH * k, sims.shape[1])
    at = np.argpartition(-sims, most - 1, axis=1)[:, :most]
    top = np.take_along_axis(sims, at, 1)
    order = np.argsort(-top, axis=1, kind="stable")
    at, top = np.take_along_axis(at, order, 1), np.take_along_axis(top, order, 1)
    held = ((np.arange(most) < k) | (top >= threshold)) & (top > -2.0)
    return held.sum(1), ids[at][held], top[held]


def _lists(node: list, n: list, other: list, sim: list):
    """A record batch of neighbour lists: for each node the number of its neighbours, which stand in a row."""
    import pyarrow as pa

    flat = lambda xs, kind: np.concatenate([np.empty(0, kind), *(x.astype(kind) for x in xs)])
    ends = np.concatenate([[0], np.cumsum(flat(n, np.int64))]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(flat(sim, np.float32)), pa.array(flat(other, np.int64))], names=["sim", "other"])
    return pa.RecordBatch.from_arrays([pa.array(flat(node, np.int64)), pa.ListArray.from_arrays(ends, pairs)], names=["node", "near"])


def _compare(groups: DataFrame, k: int, threshold: float) -> DataFrame:
    """groups (m: array<struct<node, v, tag>>) -> for each member the most similar ones with other tags."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            members = batch.column(0)
            ends, ids, tags = np.asarray(members.offsets), np.asarray(members.values.field("node")), np.asarray(members.values.field("tag"))
            vs = members.values.field("v")
            flat, off = np.asarray(vs.values, np.float32), np.asarray(vs.offsets)
            node, n, other, sim = [], [], [], []
            for a, b in zip(ends, ends[1:], strict=False):
                if b - a < 2:
                    continue
                x = flat[off[a] : off[b]].reshape(b - a, -1)
                s = x @ x.T
                s[tags[a:b, None] == tags[None, a:b]] = -2.0
                found = _best(ids[a:b], s, k, threshold - 1e-5)
                node.append(ids[a:b])
                for part, value in zip((n, other, sim), found, strict=True):
                    part.append(value)
            yield _lists(node, n, other, sim)

    return groups.select("m").mapInArrow(run, _LISTS)


def _merge(parts: DataFrame, k: int, threshold: float) -> DataFrame:
    """One list for each node: the k largest of all its lists, and further ones, up to GROWTH times k, while they are links.

    A node that very many others list is no large group: of each node every
    task passes on its best entries only.
    """
    pairs = parts.select("node", F.explode("near").alias("x")).groupBy("node", F.col("x.other").alias("other")).agg(F.max("x.sim").alias("sim"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.col("sim").desc(), "other"))
    best = pairs.withColumn("place", place).filter(F.col("place") <= GROWTH * k).filter((F.col("place") <= k) | (F.col("sim") >= threshold - 1e-5))
    return best.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("sim", "other")), asc=False).alias("near"))


def _chunks(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Groups by keys of (node, v), dealt by the node into parts of about ``most``."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("node", *keys), F.ceil(F.col("n") / most)).alias("part")
    held = ["node", "v", *(["tag"] if "tag" in rows.columns else [])]
    return rows.join(sizes, keys).select(*keys, part, *held).groupBy(*keys, "part").agg(F.collect_list(F.struct(*held)).alias("m"))


def _paired(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Groups that hold each two parts of a group of _chunks together."""
    pick = lambda s: blocks.filter("parts > 1").select(*keys, F.col("part").alias(f"p{s}"), F.col("m").alias(f"m{s}"))
    parts = blocks.groupBy(*keys).agg(F.count("*").alias("parts"))
    blocks = save(blocks.join(parts, keys), "leaves")
    part = lambda s: blocks.filter("parts > 1").select(*keys, F.col("part").alias(f"p{s}"))
    pairs = part(1).join(part(2), keys).filter("p1 < p2")  # of numbers, so that large leaves are dealt to many tasks
    both = pairs.join(pick(1), [*keys, "p1"]).join(pick(2), [*keys, "p2"])
    return blocks.filter("parts = 1").select("m").unionByName(both.select(F.concat("m1", "m2").alias("m")))


def _trees(n: int, threshold: float) -> tuple[int, int]:
    """(depth, number) of the trees for n nodes: a deeper one parts more pairs, so there are more."""
    depth = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))
    share = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** depth
    return depth, max(TREES, int(np.ceil(np.log(MISS) / np.log(1 - min(share, 1 - MISS)))))


def _forest(nodes: DataFrame, depth: int, k: int, trees: range, threshold: float, seed: int = 7) -> DataFrame:
    """Lists from leaves of random projection trees: the nearest of other tags."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            node, dim, v, tag = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2), batch.column(3)
            off, flat = np.asarray(v.offsets), np.asarray(v.values)
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                x = np.stack([flat[off[i] : off[i + 1]] for i in at])
                keep = pa.array(at)
                for t in trees:
                    planes = np.random.default_rng((seed, t, int(d))).standard_normal((int(d), max(1, depth)))
                    code = ((x @ planes > 0) @ (1 << np.arange(max(1, depth), dtype=np.int64))) if depth else np.zeros(len(at), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t), pa.int32()), pa.array(np.full(len(at), d), pa.int32()), pa.array(code), pa.array(node[at]), v.take(keep), tag.take(keep)], names=["tree", "dim", "code", "node", "v", "tag"])

    rows = nodes.select("node", "dim", F.col("v").cast("array<float>").alias("v"), "tag").mapInArrow(run, "tree int, dim int, code long, node long, v array<float>, tag long")
    keys = ["tree", "dim", "code"]
    return _compare(_paired(_chunks(rows, keys, 2 * LEAF), keys), k, threshold)


def _descend(graph: DataFrame, nodes: DataFrame, k: int, threshold: float) -> DataFrame:
    """Lists from one join of neighbours of neighbours."""
    edges = graph.select("node", F.explode("near").alias("x")).filter(F.col("x.sim") >= FLOOR).select("node", F.col("x.other").alias("other"))
    around = edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other"))).unionByName(edges.select("node", F.col("node").alias("other"))).distinct()
    # members of saturated nodes' groups are dealt to parts by _chunks
    held = around.select(F.col("node").alias("pivot"), F.col("other").alias("node")).join(nodes.select("node", "dim", F.col("v").cast("array<float>").alias("v"), "tag"), "node")
    return _compare(_chunks(held, ["pivot", "dim"], LEAF), k, threshold)


def _links_of(graph: DataFrame, threshold: float) -> DataFrame:
    """Candidate links (a < b) of the lists; single precision gives way a little."""
    near = graph.select("node", F.explode("near").alias("x")).filter(F.col("x.sim") >= threshold - 1e-5)
    return near.select(F.least("node", "x.other").alias("a"), F.greatest("node", "x.other").alias("b")).filter("a < b").distinct()


def audit(nodes: DataFrame, n: int, threshold: float = THRESHOLD) -> float | None:
    """Share of the links of some queries, found by brute force over all nodes, inside the components (tags); None if they have no link.

    The queries are drawn by a hash, in passes of AUDIT_PASS or so, which bounds
    what the driver holds of them.  There are as many passes as AUDIT_ROOT times
    the root of n asks for, and 64 times as many while the queries have few links.
    """
    few = max(AUDIT, int(AUDIT_ROOT * n**0.5))
    slices = max(1, n // AUDIT_PASS)
    want = hit = 0
    for k in range(slices):
        w, h = _audited(nodes, k, slices, threshold)
        want, hit, seen = want + w, hit + h, (k + 1) * max(1, n // slices)
        if seen >= few and want >= AUDIT_LINKS or seen >= 64 * few:
            break
    return hit / want if want else None


def _told(share: float | None) -> float:
    """The share, logged; no link counts as none lost."""
    LOG.info("the audited queries have no link" if share is None else "%.4f of the audited links are found", *([] if share is None else [share]))
    return 1.0 if share is None else share


def _audited(nodes: DataFrame, k: int, slices: int, threshold: float) -> tuple[int, int]:
    """Links of the k-th slice of the nodes, and those between nodes of one tag."""
    picked = nodes.filter(F.pmod(F.xxhash64("node", F.lit(11)), F.lit(slices)) == k).select("node", "tag", "v").collect()  # AUDIT_PASS or so, two times at most
    ids, tags = (np.array([r[c] for r in picked], np.int64) for c in ("node", "tag"))
    by = {d: np.array([i for i, r in enumerate(picked) if len(r.v) == d]) for d in {len(r.v) for r in picked}}
    vs = {d: np.array([picked[i].v for i in at]) for d, at in by.items()}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        want = hit = 0
        for batch in batches:
            node, tag, v = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2)
            off, flat = np.asarray(v.offsets), np.asarray(v.values)
            dims = np.diff(off)
            for d in set(dims.tolist()) & set(by):
                rows = np.flatnonzero(dims == d)
                x = np.stack([flat[off[i] : off[i + 1]] for i in rows])
                for at in range(0, len(by[d]), 4096):
                    mine = by[d][at : at + 4096]
                    linked = (vs[d][at : at + 4096] @ x.T >= threshold) & (ids[mine, None] != node[None, rows])
                    want += int(linked.sum())
                    hit += int((linked & (tags[mine, None] == tag[None, rows])).sum())
        yield pa.RecordBatch.from_arrays([pa.array([want]), pa.array([hit])], names=["want", "hit"])

    got = nodes.select("node", "tag", "v").mapInArrow(run, "want long, hit long").agg(F.sum("want"), F.sum("hit")).first()
    return got[0] or 0, got[1] or 0


def neighbour_graph(nodes: DataFrame, k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """Lists (node, near) of the k most similar nodes found; lists that are full of links are longer."""
    depth, trees = _trees(nodes.count(), threshold)
    nodes = nodes.withColumn("tag", F.col("node"))
    with arrow_rows(nodes.sparkSession, 256):
        graph = save(_merge(_forest(nodes, depth, k, range(trees), threshold), k, threshold), "graph")
        links = _links_of(graph, threshold).count()
        for _ in range(ROUNDS):
            after = save(_merge(graph.unionByName(_descend(graph, nodes, k, threshold)), k, threshold), "graph")
            drop(graph)
            graph, before = after, links
            links = _links_of(graph, threshold).count()
            if links <= 1.002 * before:
                break
    return graph


def connected(nodes: DataFrame, k: int = K, threshold: float = THRESHOLD, recall: float = 0.97) -> DataFrame:
    """Components (node, component) of the links; an error if an audit finds less than ``recall`` of them inside."""
    n = nodes.count()
    depth, trees = _trees(n, threshold)
    links = save(_links_of(neighbour_graph(nodes, k, threshold), threshold), "links")
    parts = save(connected_components(links), "parts")
    for turn in range(1, 2 * ROUNDS + 1):
        tagged = save(nodes.join(parts, "node", "left").withColumn("tag", F.coalesce("component", "node")).drop("component"), "tagged")
        with arrow_rows(nodes.sparkSession, 256):
            across = save(_links_of(_merge(_forest(tagged, depth, k, range(turn * trees, (turn + 1) * trees), threshold), k, threshold), threshold), "links")
            if across.isEmpty() and _told(audit(tagged, n, threshold)) >= recall:
                return parts
        links = links.unionByName(across)
        parts = save(connected_components(links), "parts")
    with arrow_rows(nodes.sparkSession, 256):
        share = _told(audit(nodes.join(parts, "node", "left").withColumn("tag", F.coalesce("component", "node")), n, threshold))
    if share < recall:
        raise RuntimeError(f"{share:.3f} of the audited links are found, {recall} are asked for")
    return parts


def _within(nodes: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """Compare components in blocks: rows (node, n, other).

    With other null, n is what the node links to in a pair of blocks, copies
    counted; with other set, (node, other) is one link of a spanning forest.
    """
    import pyarrow as pa

    held = nodes.join(parts, "node").withColumn("v", F.struct("mult", "v"))
    blocks = save(_chunks(held, ["component", "dim"], BLOCK), "blocks")
    pick = lambda s: blocks.select("component", "dim", F.col("part").alias(f"p{s}"), F.col("m.node").alias(f"n{s}"), F.col("m.v.mult").alias(f"c{s}"), F.flatten("m.v.v").alias(f"v{s}"))
    # pairs of numbers first: a large component's blocks are dealt to many tasks
    part = lambda s: blocks.select("component", "dim", F.col("part").alias(f"p{s}"))
    pairs = part(1).join(part(2), ["component", "dim"]).filter("p1 <= p2")
    work = pairs.join(pick(1), ["component", "dim", "p1"]).join(pick(2), ["component", "dim", "p2"]).select(*(f"{c}{s}" for s in (1, 2) for c in "pncv"))

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            node, n, other, mask = [], [], [], []
            get = lambda i, r: np.asarray(batch.column(i)[r].values)
            for r in range(batch.num_rows):
                same = batch.column(0)[r].as_py() == batch.column(4)[r].as_py()
                n1, c1, v1, n2, c2, v2 = (get(i, r) for i in (1, 2, 3, 5, 6, 7))
                linked = v1.reshape(len(n1), -1) @ v2.reshape(len(n2), -1).T >= threshold
                if same:
                    np.fill_diagonal(linked, False)
                x, y = forest(linked)
                node += [n1, n1[x]] if same else [n1, n2, n1[x]]
                n += [linked @ c2, np.zeros(len(x), np.int64)] if same else [linked @ c2, c1 @ linked, np.zeros(len(x), np.int64)]
                other += [np.full(len(n1) + (0 if same else len(n2)), -1), n2[y]]
                mask.append(np.concatenate([np.ones(len(n1) + (0 if same else len(n2)), bool), np.zeros(len(x), bool)]))
            cat = lambda xs, kind: np.concatenate([np.empty(0, kind), *xs]).astype(kind)
            yield pa.RecordBatch.from_arrays([pa.array(cat(node, np.int64)), pa.array(cat(n, np.int64)), pa.array(cat(other, np.int64), mask=cat(mask, bool))], names=["node", "n", "other"])

    with arrow_rows(nodes.sparkSession, 16):
        return save(work.mapInArrow(run, "node long, n long, other long"), "links")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, k: int = K) -> DataFrame:
    """Rows (id, n_links, component, kept): one for each row of vectors.

    n_links counts the other vectors at a cosine of ``threshold`` or more,
    component is the smallest id reachable by links, kept whether that is the
    row's own.  Vectors that are null, empty, zero or hold null or non-finite
    numbers link with nothing, nor do rows without an id (their component is
    null); vectors of different lengths don't link.  Equal vectors link, equal
    ids are told apart by nothing but their vectors.  An empty table gives no
    rows.
    """
    with scratch(vectors.sparkSession) as keep:
        rows, nodes = _nodes(vectors, id_col, vector_col)
        nodes = save(nodes, "nodes")
        parts = connected(nodes, k, threshold)
        found = _within(nodes, parts, threshold)
        counts = found.filter("other is null").groupBy("node").agg(F.sum("n").alias("n"))
        exact = connected_components(found.filter("other is not null"), "node", "other")
        # a row's node by its vector: copies share it
        plain = nodes.select("node", "mult").join(counts, "node", "left").join(exact, "node", "left")
        of = keep(save(plain.select("node", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")), "classes"))
        ids = keep(save(rows.filter("sound").groupBy("e").agg(F.min("id").alias("node"), F.count("*").alias("n")), "ids"))
    sound = named(rows.filter("sound"), ids, "e").select("id", "node").join(of, "node").select("id", "n_links", "component")
    lone = rows.filter("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return sound.unionByName(lone).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))
