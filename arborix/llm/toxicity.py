"""Toxicity by a convolutional text classifier in numpy.

A word's embedding is the sum of two rows of one table, picked by two hashes,
so that words which share one row still differ.  Filters over one, two and
three words are followed by max pooling over the whole text and one logistic
unit.  The table starts from smoothed log-odds of the training texts, the rest
from small random numbers; all is then fitted by gradient descent.  Scores are
scaled on texts that were not fitted, where thresholds are set by language too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .language_model import fold
from .simhash import words_of
from .sorted_runs import WordHashes, portions
from .storage import drop, release, save

#: Rows and columns of the table, filters of each width, widths.
ROWS, DIM, FILTERS, WIDTHS = 1 << 19, 8, 8, (1, 2, 3)
#: Labelled texts that :func:`train` takes at most, and their words in all; :func:`train_whole` takes all.
SAMPLE, SAMPLE_WORDS = 8000, 30_000_000
#: Rows of the table that fewer training texts use stay zero.
SEEN = 2
EDGE = b".,;:!?\"'()[]{}*#$%&|<>-_/\\~`+="


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased, without punctuation at their ends."""
    return [w.strip(EDGE) for w in words_of(text)]


def rows_of(h: np.ndarray) -> np.ndarray:
    """The two rows of the table for each word hash."""
    return np.stack([(h % np.uint64(ROWS)), ((h >> np.uint64(32)) % np.uint64(ROWS))], 1).astype(np.int64)


@dataclass
class Network:
    table: np.ndarray
    filters: list[np.ndarray]  # for each width: (width * DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    shift: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, h: np.ndarray, lens: np.ndarray):
        """(pooled, where): the largest response of each filter in each text, and the window that gave it (-1: none above 0)."""
        x = self.table[rows_of(h)].sum(1)
        ends = np.cumsum(lens)
        values, places = [], []
        for width, w, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            n = len(x) - width + 1
            value = np.zeros((len(lens), FILTERS), np.float32)
            place = np.full((len(lens), FILTERS), -1)
            if n > 0:
                z = sum(x[k : k + n] @ w[k * DIM : (k + 1) * DIM] for k in range(width)) + b
                for t, (a, e) in enumerate(zip(ends - lens, ends, strict=True)):
                    if e - a >= width:
                        part = z[a : e - width + 1]
                        at = part.argmax(0)
                        top = part[at, np.arange(FILTERS)]
                        value[t] = np.maximum(top, 0)
                        place[t] = np.where(top > 0, at + a, -1)
            values.append(value)
            places.append(place)
        return np.concatenate(values, 1), np.concatenate(places, 1), x

    def logits(self, h: np.ndarray, lens: np.ndarray) -> np.ndarray:
        return self.pooled(h, lens)[0] @ self.out + self.shift

    def scores(self, h: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Probabilities, as scaled on held-out training texts."""
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logits(h, lens) + b, -30, 30).astype(np.float64)))


def _join(hs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.empty(0, np.uint64), *hs]), np.array([len(h) for h in hs], np.int64)


def _counts(hs: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many texts, and how many toxic ones, use each row of the table."""
    toxic, all_ = np.zeros(ROWS), np.zeros(ROWS)
    for h, label in zip(hs, y, strict=True):
        own = np.unique(rows_of(np.unique(h)))
        all_[own] += 1
        toxic[own] += label
    return all_, toxic


def _started(all_: np.ndarray, toxic: np.ndarray, n: int, n_toxic: float, rng) -> tuple[Network, np.ndarray]:
    """The network before fitting, and which rows of the table may change, from the counts of n texts."""
    prior = (n_toxic + 1) / (n + 2)
    share = (toxic + 4 * prior) / (all_ + 4)
    odds = np.log(share / (1 - share)) - np.log(prior / (1 - prior))
    free = all_ >= SEEN
    table = (rng.standard_normal((ROWS, DIM), dtype=np.float32) * 0.02) * free[:, None]
    table[:, 0] = np.where(free, 0.5 * odds, 0)
    filters = [rng.standard_normal((w * DIM, FILTERS)).astype(np.float32) * 0.1 for w in WIDTHS]
    for f in filters:
        f[0, ::2] += 1
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    out = np.full(len(WIDTHS) * FILTERS, 0.05, np.float32)
    out[: FILTERS : 2] = 0.4
    return Network(table, filters, bias, out, float(np.log(prior / (1 - prior))) - 1.0), free


def _loss(p: np.ndarray, y: np.ndarray) -> float:
    return float(-np.mean(np.log(np.clip(np.where(y > 0, p, 1 - p), 1e-6, 1))))


@dataclass
class Squares:
    """Sums of squared gradients, which slow the steps down: of the weights, the table's rows and the shift."""

    weights: list[np.ndarray]
    table: np.ndarray
    shift: float = 1e-3

    @classmethod
    def of(cls, net: Network) -> Squares:
        return cls([np.full_like(w, 1e-3) for w in (*net.filters, *net.bias, net.out)], np.full(ROWS, 1e-3, np.float32))


def _logits(net: Network, hs: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.empty(0, np.float32), *(net.logits(*_join(hs[k : k + 64])) for k in range(0, len(hs), 64))])


def _descend(net: Network, free: np.ndarray, squares: Squares, hs: list[np.ndarray], y: np.ndarray, order: np.ndarray, rate: float) -> None:
    """One pass of gradient descent, in place, over the texts in the order given."""
    for k in range(0, len(order), 32):
        at = order[k : k + 32]
        h, lens = _join([hs[i] for i in at])
        pooled, place, x = net.pooled(h, lens)
        p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.shift, -30, 30)))
        d = (p - y[at]) / len(at)
        grads: list[np.ndarray] = []
        rows = rows_of(h)
        touched, slopes = [], []
        d_pool = d[:, None] * net.out[None, :]
        for j, width in enumerate(WIDTHS):
            own = place[:, j * FILTERS : (j + 1) * FILTERS]
            t, f = np.nonzero(own >= 0)
            start, slope = own[t, f], d_pool[t, j * FILTERS + f]
            g = np.zeros_like(net.filters[j])
            for o in range(width):
                part = np.zeros((FILTERS, DIM), np.float32)
                np.add.at(part, f, slope[:, None] * x[start + o])
                g[o * DIM : (o + 1) * DIM] = part.T
                touched.append(rows[start + o].reshape(-1))
                slopes.append(np.repeat(slope[:, None] * net.filters[j][o * DIM : (o + 1) * DIM, f].T, 2, 0))
            grads.append(g)
        for j in range(len(WIDTHS)):
            own = place[:, j * FILTERS : (j + 1) * FILTERS] >= 0
            grads.append((d_pool[:, j * FILTERS : (j + 1) * FILTERS] * own).sum(0).astype(np.float32))
        grads.append((pooled.T @ d + 1e-4 * net.out).astype(np.float32))
        for w, g, s in zip([*net.filters, *net.bias, net.out], grads, squares.weights, strict=True):
            s += g * g
            w -= rate * g / np.sqrt(s)
        r, s = np.concatenate(touched), np.concatenate(slopes)
        ok = free[r]
        rows_here, back = np.unique(r[ok], return_inverse=True)
        g = np.zeros((len(rows_here), DIM), np.float32)
        np.add.at(g, back, s[ok])
        squares.table[rows_here] += (g * g).mean(1)
        net.table[rows_here] -= rate * g / np.sqrt(squares.table[rows_here])[:, None]
        squares.shift += float(d.sum()) ** 2
        net.shift -= rate * float(d.sum()) / squares.shift**0.5


def fit(hs: list[np.ndarray], y: np.ndarray, langs: list[str], epochs: int = 8, rate: float = 0.03, seed: int = 3) -> Network:
    """Fit on texts given as word hashes; every fifth text sets the scale, the thresholds and when to stop.

    Without texts, or with one class only, the network is left as it starts.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(y, np.float32)
    dev = np.arange(len(y)) % 5 == 4
    fit_at = np.flatnonzero(~dev)
    net, free = _started(*_counts([hs[i] for i in fit_at], y[fit_at]), len(fit_at), float(y[fit_at].sum()), rng)
    if len(set(y.tolist())) < 2:
        return net
    best, best_loss = None, np.inf
    squares = Squares.of(net)
    dev_at = np.flatnonzero(dev)

    def of(at):
        return _logits(net, [hs[i] for i in at])

    for epoch in range(epochs + 1):
        loss = _loss(1 / (1 + np.exp(-of(dev_at))), y[dev_at]) if len(dev_at) else -epoch
        if loss < best_loss:
            best_loss, best = loss, (net.table.copy(), [f.copy() for f in net.filters], [b.copy() for b in net.bias], net.out.copy(), net.shift)
        if epoch == epochs:
            break
        order = rng.permutation(fit_at)
        _descend(net, free, squares, hs, y, order, rate)
    net = Network(*best)
    if len(dev_at) and len(set(y[dev_at].tolist())) > 1:
        z = of(dev_at).astype(np.float64)
        net.scale = _platt(z, y[dev_at])
        p = 1 / (1 + np.exp(-np.clip(net.scale[0] * z + net.scale[1], -30, 30)))
        lang = np.array([langs[i] for i in dev_at])
        for v in np.unique(lang):
            net.thresholds[str(v)] = _threshold(p[lang == v], y[dev_at][lang == v])
    return net


def _platt(z: np.ndarray, y: np.ndarray, n: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Slope and shift of a logistic function of the logits, each counted n times, drawn a little towards (1, 0)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = n * np.maximum(p * (1 - p), 1e-6)
        g = np.array([np.sum(n * (p - y) * z) + 1e-2 * (a - 1), np.sum(n * (p - y)) + 1e-2 * b])
        hess = np.array([[np.sum(w * z * z) + 1e-2, np.sum(w * z)], [np.sum(w * z), np.sum(w) + 1e-2]])
        step = np.linalg.solve(hess, g)
        a, b = float(np.clip(a - step[0], 0.1, 10)), float(np.clip(b - step[1], -10, 10))
    return a, b


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best F1, drawn to one half where there are few toxic texts."""
    n = int(y.sum())
    if not n:
        return 0.5
    cuts = np.unique(np.clip(p, 0.05, 0.95))
    f1 = [2 * np.sum(y[p >= c]) / max(1, np.sum(p >= c) + n) for c in cuts]
    return float((5 * 0.5 + n * cuts[int(np.argmax(f1))]) / (5 + n))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, sample_words: int = SAMPLE_WORDS) -> Network:
    """Fit on a stated sample of the labelled texts, those with the least hashes of their id; :func:`train_whole` fits on all.

    There are at most ``sample`` of them, and the sample ends before the text
    that would take it over ``sample_words`` words in all, whatever the length of
    each.  Labels that are null, or whose id is, or that have no text don't
    count; of several labels of an id the largest holds, of several texts the
    least.
    """
    some = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("_toxic"))
    order = [F.xxhash64("_id"), F.col("_id")]
    some = some.join(docs.select(F.col(id_col).alias("_id")), "_id", "left_semi").orderBy(*order).limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.struct(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).alias("_text"))
    rows = texts.join(F.broadcast(some), "_id").groupBy("_id").agg(F.min("_text").alias("x"), F.max("_toxic").alias("y")).orderBy(*order)
    hashes, found, n = WordHashes(), [], 0
    for r in rows.toLocalIterator():
        h = hashes.of(tokens(r.x.t))
        n += len(h)
        if n > sample_words:
            break
        found.append((r[0], h, r.y, r.x.l or ""))
    found.sort(key=lambda r: (int(r[0]) * 2654435761 % (1 << 32), r[0]))  # an order that does not follow the ids
    return fit([r[1] for r in found], np.array([r[2] > 0 for r in found], np.float32), [r[3] for r in found])


#: Texts of a block that is fitted by itself in each round, and its words.
BLOCK, BLOCK_WORDS = 8192, 4_000_000
#: Sums over blocks are of whole numbers, so that their order doesn't matter: so many to one.
UNIT = 1 << 20
_SUMS = "row int, n long, square long, " + ", ".join(f"d{k} long" for k in range(DIM))


def _stored_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(block, dev, y, lang, h): every text with a label as word hashes, in the shared folder.

    Texts are dealt to parts and blocks by a hash of their id, whatever the cluster.
    """
    some = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("_toxic"))
    parts = max(1, -(-some.count() // BLOCK))
    texts = docs.select(F.col(id_col).alias("_id"), F.struct(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).alias("_text"))
    both = texts.repartition(parts, "_id").join(some.repartition(parts, "_id").hint("shuffle_hash"), "_id")
    rows = both.groupBy("_id").agg(F.min("_text").alias("x"), F.max("_toxic").alias("y"))
    rows = rows.withColumn("_o", F.xxhash64("_id")).sortWithinPartitions("_o", "_id")
    rows = rows.select(F.spark_partition_id().cast("long").alias("part"), F.col("x.t").alias("t"), (F.pmod("_o", F.lit(5)) == 4).alias("dev"), (F.col("y") > 0).cast("int").alias("y"), F.coalesce("x.l", F.lit("")).alias("lang"))

    def run(arrow: Iterator) -> Iterator:
        import pyarrow as pa

        hashes, block, texts, words = WordHashes(), 0, 0, 0
        for part, ws in portions(arrow, tokens):
            hs, at = [hashes.of(w) for w in ws], []
            for h in hs:
                if texts == BLOCK or texts and words + len(h) > BLOCK_WORDS:
                    block, texts, words = block + 1, 0, 0
                texts, words = texts + 1, words + len(h)
                at.append(block)
            flat, lens = _join(hs)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), pa.array(flat.view(np.int64)))
            blocks = (part.column(0).to_numpy() << 32) + np.array(at, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(blocks), part.column(2), part.column(3), part.column(4), lists], names=["block", "dev", "y", "lang", "h"])

    return save(rows.mapInArrow(run, "block long, dev boolean, y int, lang string, h array<long>"), "toxicity")


def _blocks(arrow: Iterator) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """(block, word hashes, labels, which texts aren't fitted) of each block of stored texts."""
    now, hs, y, dev = None, [], [], []
    for batch in arrow:
        flat, ends = batch.column(3).flatten().to_numpy().view(np.uint64), np.cumsum(np.diff(batch.column(3).offsets.to_numpy()))
        for b, d, label, a, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            if b != now:
                if hs:
                    yield now, hs, np.array(y, np.float32), np.array(dev)
                now, hs, y, dev = b, [], [], []
            hs.append(flat[a:e])
            y.append(label)
            dev.append(d)
    if hs:
        yield now, hs, np.array(y, np.float32), np.array(dev)


def _flat(net: Network, squares: Squares) -> np.ndarray:
    """All numbers but the table's, in one vector."""
    v = np.concatenate([*(w.reshape(-1) for w in (*net.filters, *net.bias, net.out)), [net.shift], *(w.reshape(-1) for w in squares.weights), [squares.shift]]).astype(np.float64)
    return np.concatenate([v, np.zeros(-len(v) % DIM)])


def _unflat(net: Network, squares: Squares, v: np.ndarray) -> None:
    at = 0
    for w in (*net.filters, *net.bias, net.out):
        w[...] = v[at : at + w.size].reshape(w.shape)
        at += w.size
    net.shift, at = float(v[at]), at + 1
    for w in squares.weights:
        w[...] = v[at : at + w.size].reshape(w.shape)
        at += w.size
    squares.shift = float(v[at])


def _copy(net: Network, squares: Squares) -> tuple[Network, Squares]:
    own = Network(net.table.copy(), [f.copy() for f in net.filters], [b.copy() for b in net.bias], net.out.copy(), net.shift)
    return own, Squares([w.copy() for w in squares.weights], squares.table.copy(), squares.shift)


def _summed(row: np.ndarray, n: np.ndarray, square: np.ndarray, d: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(n), pa.array(square), *(pa.array(np.ascontiguousarray(d[:, k])) for k in range(DIM))], names=["row", "n", "square", *(f"d{k}" for k in range(DIM))])


def train_whole(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rounds: int = 8, rate: float = 0.03, seed: int = 3) -> Network:
    """Fit on all texts that have a label, whatever their number.

    In each round every block of texts goes on from the common network by
    gradient descent, and the next network is the mean of theirs, by texts; of a
    row of the table, the mean of the blocks that changed it.  A fifth of the
    texts isn't fitted: all of it says which round is best, and sets the scale
    and the thresholds by language.  What the driver gets of a round is one row
    for each changed row of the table.  Labels count as in :func:`train`.
    """
    spark = docs.sparkSession
    rows = _stored_texts(docs, labels, id_col, text_col, lang_col)
    texts = rows.select("block", "dev", "y", "h")
    made = texts.select("block", "dev", "y").groupBy("dev").agg(F.count("*").alias("n"), F.sum("y").alias("up"), F.count_distinct("block").alias("blocks")).collect()
    n = {r.dev: r.n for r in made}
    up = {r.dev: r.up for r in made}
    # tasks add up their blocks' sums, so fewer of them have less to send
    texts = texts.coalesce(max(64, max([0, *(r.blocks for r in made)]) // 32))
    rng = np.random.default_rng(seed)

    def counted(arrow: Iterator) -> Iterator:
        all_, toxic = np.zeros(ROWS), np.zeros(ROWS)
        for _, hs, y, dev in _blocks(arrow):
            one = _counts([h for h, d in zip(hs, dev, strict=True) if not d], y[~dev])
            all_, toxic = all_ + one[0], toxic + one[1]
        at = np.flatnonzero(all_)
        yield _summed(at, all_[at].astype(np.int64), toxic[at].astype(np.int64), np.zeros((len(at), DIM), np.int64))

    def added(run: Callable):
        return texts.mapInArrow(run, _SUMS).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n", "square", *(f"d{k}" for k in range(DIM)))))

    counts = added(counted).select("row", "n", "square").toArrow()
    all_, toxic = np.zeros(ROWS), np.zeros(ROWS)
    at = counts.column("row").to_numpy()
    all_[at], toxic[at] = counts.column("n").to_numpy(), counts.column("square").to_numpy()
    net, free = _started(all_, toxic, n.get(False, 0), float(up.get(False, 0)), rng)
    if not 0 < sum(up.values()) < sum(n.values()):
        drop(rows)
        return net
    squares, best, best_loss = Squares.of(net), None, np.inf

    for k in range(rounds + 1):
        shared = spark.sparkContext.broadcast((net, squares, free))  # of fixed size

        def step(arrow: Iterator, k=k, shared=shared) -> Iterator:
            begun, begun_squares, free = shared.value
            table, weight, square = np.zeros((ROWS, DIM), np.int64), np.zeros(ROWS, np.int64), np.zeros(ROWS, np.int64)
            small, m, loss, n_dev = 0, 0, 0, 0
            start = _flat(begun, begun_squares)
            for block, hs, y, dev in _blocks(arrow):
                held = np.flatnonzero(dev)
                if len(held):
                    p = 1 / (1 + np.exp(-np.clip(_logits(begun, [hs[i] for i in held]), -30, 30)))
                    loss, n_dev = loss + int(round(_loss(p, y[held]) * len(held) * UNIT)), n_dev + len(held)
                fit_at = np.flatnonzero(~dev)
                if k == rounds or not len(fit_at):
                    continue
                own, own_squares = _copy(begun, begun_squares)
                _descend(own, free, own_squares, hs, y, np.random.default_rng([seed, k, block >> 32, block & 0xFFFFFFFF]).permutation(fit_at), rate)
                at, w = np.flatnonzero(own_squares.table != begun_squares.table), len(fit_at)
                table[at] += w * np.rint((own.table[at] - begun.table[at]).astype(np.float64) * UNIT).astype(np.int64)
                square[at] += w * np.rint((own_squares.table[at] - begun_squares.table[at]).astype(np.float64) * UNIT).astype(np.int64)
                weight[at] += w
                small = small + w * np.rint((_flat(own, own_squares) - start) * UNIT).astype(np.int64)
                m += w
            yield _summed(np.array([-1]), np.array([n_dev]), np.array([loss]), np.zeros((1, DIM), np.int64))
            if m:
                at = np.flatnonzero(weight)
                yield _summed(at, weight[at], square[at], table[at])
                v = small.reshape(-1, DIM)
                yield _summed(ROWS + np.arange(len(v)), np.full(len(v), m), np.zeros(len(v), np.int64), v)

        mean = lambda c: (F.col(c) / F.col("n") / UNIT).cast("float").alias(c)
        got = added(step).filter("n > 0").select("row", "n", mean("square"), *(mean(f"d{i}") for i in range(DIM))).toArrow()
        shared.destroy()
        release(spark)
        row = got.column("row").to_numpy()
        d = np.stack([got.column(f"d{i}").to_numpy() for i in range(DIM)], 1)
        square = got.column("square").to_numpy()
        loss = float(square[row == -1][0]) if (row == -1).any() else -k
        if loss < best_loss:
            best_loss, best = loss, _copy(net, squares)[0]
        own = (row >= 0) & (row < ROWS)
        net.table[row[own]] += d[own]
        squares.table[row[own]] += square[own]
        small = row >= ROWS
        if small.any():
            v = _flat(net, squares)
            _unflat(net, squares, v + d[small][np.argsort(row[small])].reshape(-1))
    net = best
    if 0 < up.get(True, 0) < n[True]:
        _scale(rows.filter("dev"), net)
    drop(rows)
    return net


def _scale(rows: DataFrame, net: Network) -> None:
    """Set the scale, and the thresholds of languages, by all texts that weren't fitted.

    Logits count in steps of 1/256, thresholds in steps of 1/1000.
    """
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(arrow: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in arrow:
            flat, ends = batch.column(2).flatten().to_numpy().view(np.uint64), np.cumsum(np.diff(batch.column(2).offsets.to_numpy()))
            z = _logits(shared.value, np.split(flat, ends[:-1])).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.rint(np.clip(z, -40, 40) * 256).astype(np.int32))], names=["lang", "y", "z"])

    held = save(rows.select("lang", "y", "h").mapInArrow(run, "lang string, y int, z int").groupBy("lang", "y", "z").agg(F.count("*").alias("n")), "toxicity_held")
    bins = held.groupBy("z", "y").agg(F.sum("n").alias("n")).orderBy("z", "y").toArrow()  # 2 * 20481 at most
    z, y, n = (bins.column(c).to_numpy().astype(np.float64) for c in ("z", "y", "n"))
    net.scale = a, b = _platt(z / 256, y, n)
    p = 1 / (1 + F.exp(-(F.lit(a) * F.col("z") / 256 + F.lit(b))))
    cut = F.when(p >= 0.05, F.least(F.floor(p * 1000) / 1000, F.lit(0.95)))
    by = held.groupBy("lang", cut.alias("cut")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("up"))
    above = Window.partitionBy("lang").orderBy(F.col("cut").desc_nulls_last())
    all_up = F.sum("up").over(Window.partitionBy("lang"))
    f1 = F.when(F.col("cut").isNotNull(), 2 * F.sum("up").over(above) / (F.sum("n").over(above) + all_up))
    best = by.select("lang", "cut", all_up.alias("up"), f1.alias("f1")).groupBy("lang").agg(F.max("up").alias("up"), F.max_by("cut", F.struct("f1", -F.col("cut"))).alias("cut"))
    for r in best.collect():  # one for each language
        net.thresholds[r.lang] = (5 * 0.5 + r.up * (0.05 if r.cut is None else r.cut)) / (5 + r.up)
    drop(held)


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (id, score, predicted, flagged): one for each row of docs.

    score depends on the text alone; predicted is whether it is at least one
    half, flagged whether it is at least the threshold of the row's language.
    A null text counts as empty.
    """
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(arrow: Iterator) -> Iterator:
        net, hashes = shared.value, WordHashes()
        for part, words in portions(arrow, tokens):
            p = net.scores(*_join([hashes.of(w) for w in words]))
            limit = np.array([net.thresholds.get(x or "", 0.5) for x in part.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(p >= limit)], names=["id", "score", "predicted", "flagged"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang"))
    return rows.mapInArrow(run, "id long, score double, predicted int, flagged boolean")


def held_out(id_col, folds: int = 5):
    return fold(id_col, folds) == 0
