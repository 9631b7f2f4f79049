"""Scores of chunks for queries: BM25, dense cosine, their mixtures and fusions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
DIM = 512


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text", tokenize: Callable = tx.alnum_tokens, within: list[str] | None = None) -> DataFrame:
    """(within..., term, key, tf, dl): one row for each term of a chunk."""
    within = within or []
    words = chunks.select(*within, key, F.explode(tokenize(F.col(text))).alias("term"))
    tf = words.groupBy(*within, key, "term").agg(F.count("*").alias("tf"))
    # the length is the sum of a chunk's own counts, over rows that are already together
    return tf.withColumn("dl", F.sum("tf").over(Window.partitionBy(*within, key)))


def bm25(queries: DataFrame, chunks: DataFrame, query_id: str = "query_id", question: str = "question", key: str = "chunk_id", text: str = "text", tokenize: Callable = tx.alnum_tokens, within: list[str] | None = None) -> DataFrame:
    """(query_id, key, score) of pairs that share a term; all other pairs score 0.

    ``within`` names columns of both sides that part the corpus: each part has
    its own document frequencies.  The idf of very frequent terms is floored at
    a quarter of the mean, as in the published Okapi variant.
    """
    within = within or []
    tf = postings(chunks, key, text, tokenize, within)
    size = chunks.groupBy(*within).agg(F.count("*").alias("n")) if within else chunks.agg(F.count("*").alias("n"))
    total = tf.groupBy(*within).agg(F.sum("tf").alias("length")) if within else tf.agg(F.sum("tf").alias("length"))
    stats = (size.join(total, within) if within else size.crossJoin(total)).withColumn("avgdl", F.col("length") / F.col("n"))
    df = tf.groupBy(*within, "term").agg(F.count("*").alias("df"))
    raw = df.join(stats, within) if within else df.crossJoin(F.broadcast(stats))  # one row
    raw = raw.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy(*within).agg(F.avg("idf").alias("mean")) if within else raw.agg(F.avg("idf").alias("mean"))
    idf = raw.join(mean, within) if within else raw.crossJoin(F.broadcast(mean))  # one row
    idf = idf.select(*within, "term", "avgdl", F.when(F.col("idf") < 0, EPSILON * F.col("mean")).otherwise(F.col("idf")).alias("idf"))
    asked = queries.select(*within, query_id, F.explode(tokenize(F.col(question))).alias("term")).groupBy(*within, query_id, "term").agg(F.count("*").alias("qn"))
    # only terms that are asked for go on to the postings
    weight = asked.join(idf, [*within, "term"])
    part = F.col("qn") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return weight.join(tf, [*within, "term"]).groupBy(*within, query_id, key).agg(F.sum(part).alias("score"))


#: Weights of asked terms, terms by queries, that a pass over the chunks holds at once; chunks of a block.
WEIGHTS, ROWS = 1 << 22, 512


def bm25_topk(queries: DataFrame, chunks: DataFrame, k: int, query_id: str = "query_id", question: str = "question", key: str = "chunk_id", text: str = "text", tokenize: Callable = tx.alnum_tokens) -> DataFrame:
    """(query_id, key, score, rank): the k best chunks of each query by :func:`bm25`, whole texts against a stated set of queries.

    Texts don't travel: each block of chunks meets the queries' weights in one
    matrix product where it is read, and only the k best of a block leave it.
    Queries go in passes that bound the table of weights which is broadcast.
    """
    words = chunks.select(F.col(key).alias("key"), tokenize(F.col(text)).alias("words"))
    # one pass counts documents of each term and, under the null term, all documents and their lengths
    each = F.explode(F.concat(F.array_distinct(F.coalesce("words", F.array().cast("array<string>"))), F.array(F.lit(None).cast("string"))))
    seen = words.select(F.size("words").alias("dl"), each.alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("length"))
    total = seen.filter("term is null").select(F.col("df").alias("n"), (F.col("length") / F.col("df")).alias("avgdl"))
    idf = seen.filter("term is not null").crossJoin(F.broadcast(total))  # one row
    idf = idf.select("term", "avgdl", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    asked = queries.select(F.col(query_id).alias("query"), F.explode(tokenize(F.col(question))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qn"))
    mean = idf.agg(F.avg("idf").alias("mean"))
    weight = asked.join(idf, "term").crossJoin(F.broadcast(mean))  # one row
    weight = weight.select("query", "term", "avgdl", (F.col("qn") * F.when(F.col("idf") < 0, EPSILON * F.col("mean")).otherwise(F.col("idf"))).alias("w"))
    bound = asked.agg(F.count_distinct("query").alias("q"), F.count_distinct("term").alias("t")).first()
    passes = max(1, -(-bound.q * bound.t // WEIGHTS))
    weight = weight.withColumn("pass", F.pmod(F.xxhash64("query"), F.lit(passes)))
    kind, qkind = chunks.schema[key].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    out = None
    for p in range(passes):
        rows = weight.filter(F.col("pass") == p).drop("pass").toArrow()  # WEIGHTS at most, about
        part = words.mapInArrow(_scorer(rows, k), f"{query_id} {qkind}, {key} {kind}, score double")
        out = part if out is None else out.unionByName(part)
    return top_k(out, k, [query_id], key)


def _best(score, k: int, keys) -> tuple:
    """(columns, rows) of the k largest scores of each row of a matrix, as :func:`top_k` orders them: rounded, then by key."""
    import numpy as np
    import pyarrow.compute as pc

    rows, n = score.shape
    if not rows or not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place = np.empty(n, np.int64)
    place[pc.sort_indices(keys).to_numpy()] = np.arange(n)
    order = np.rint(np.where(np.isfinite(score), score, -1e9) * 1e6).astype(np.int64) * n + (n - 1 - place)
    at = np.argpartition(-order, min(k, n) - 1, axis=1)[:, :k]
    return at.reshape(-1), np.repeat(np.arange(rows), at.shape[1])


def _scorer(rows, k: int) -> Callable:
    """The function over Arrow batches (key, words) that scores them for the queries of one pass."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    ids, terms = pc.unique(rows.column("query")), pc.unique(rows.column("term"))
    avgdl = rows.column("avgdl")[0].as_py() if rows.num_rows else 0.0
    weights = np.zeros((len(terms), len(ids)))
    weights[pc.index_in(rows.column("term"), terms).to_numpy(), pc.index_in(rows.column("query"), ids).to_numpy()] = rows.column("w").to_numpy()
    there = (weights != 0).astype(np.float32)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                length = np.nan_to_num(pc.list_value_length(part.column(1)).cast(pa.float64()).to_numpy(zero_copy_only=False))
                found = pc.index_in(part.column(1).flatten(), terms.cast(part.column(1).type.value_type)).fill_null(-1).to_numpy()
                row = np.repeat(np.arange(part.num_rows), length.astype(np.int64))
                tf = np.zeros((part.num_rows, len(terms)))
                np.add.at(tf, (row[found >= 0], found[found >= 0]), 1)
                tf = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * length / max(avgdl, 1e-300)))[:, None])
                score = np.where((tf > 0).astype(np.float32) @ there > 0, tf @ weights, -np.inf)
                c, q = _best(score.T, k, part.column(0))
                ok = np.isfinite(score[c, q])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[ok])), part.column(0).take(pa.array(c[ok])), pa.array(score[c[ok], q[ok]])], names=["q", "c", "score"])

    return run


def bucket(token: Column, dim: int = DIM) -> Column:
    """The first four bytes of a token's md5, little-endian, modulo the dimension."""
    h = F.md5(token.cast("binary"))
    turned = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    return (F.conv(turned, 16, 10).cast("long") % dim).cast("int")


def hashed(rows: DataFrame, key: str, text: str, dim: int = DIM, within: list[str] | None = None) -> DataFrame:
    """Hashing encoder: (within..., key, b, w), the buckets of each text with log1p of their counts, of length 1."""
    own = [*(within or []), key]
    counts = rows.select(*own, F.explode(tx.encoder_tokens(text)).alias("t")).groupBy(*own, bucket(F.col("t"), dim).alias("b")).agg(F.log1p(F.count("*").cast("double")).alias("w"))
    return counts.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*own))))


def hashed_cosine(queries: DataFrame, chunks: DataFrame, query_id: str = "query_id", question: str = "question", key: str = "chunk_id", text: str = "text", within: list[str] | None = None) -> DataFrame:
    """(query_id, key, score) of the pairs that share a bucket, which are most pairs of a part.

    For small parts of a corpus, or where every score is needed, as in mixtures;
    for the best of a large corpus take :func:`hashed_topk`.
    """
    within = within or []
    q = hashed(queries, query_id, question, within=within).withColumnRenamed("w", "wq")
    c = hashed(chunks, key, text, within=within).withColumnRenamed("w", "wc")
    return q.join(c, ["b", *within]).groupBy(*within, query_id, key).agg(F.sum(F.col("wq") * F.col("wc")).alias("score"))


def hashed_topk(queries: DataFrame, chunks: DataFrame, k: int, query_id: str = "query_id", question: str = "question", key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(query_id, key, score, rank): the k nearest chunks by the hashing encoder, in blocks; pairs that share nothing have no row."""
    pack = lambda rows, i, t: hashed(rows, i, t).groupBy(i).agg(F.collect_list(F.struct("b", "w")).alias("v"))
    near = _block_product(pack(queries, query_id, question), pack(chunks, key, text), k, query_id, key, 0.0)
    return top_k(near, k, [query_id], key)


def unit(v) -> Column:
    """A vector of doubles of length 1; zero stays zero."""
    v = (F.col(v) if isinstance(v, str) else v).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: Queries and chunks that meet in one matrix product.
QUERIES, CHUNKS = 256, 4096


def _block_product(queries: DataFrame, chunks: DataFrame, k: int, query_id: str, key: str, over: float | None = None) -> DataFrame:
    """(query_id, key, score): of each block of chunks the k most similar ones of each query.

    Both have a column v: vectors of doubles, or (b, w) pairs of DIM buckets.
    Blocks of queries are dealt to every block of chunks by its number, an
    equi-join; pairs never become rows.  The copies of the queries are shuffled,
    never broadcast: beside them they look small before they are made.  With
    ``over`` only larger scores count.
    """
    parts, blocks = max(1, -(-chunks.count() // CHUNKS)), max(1, -(-queries.count() // QUERIES))
    pack = lambda rows, i, n, name: rows.groupBy(F.pmod(F.xxhash64(i), F.lit(n)).alias(name)).agg(F.collect_list(F.struct(F.col(i).alias("id"), "v")).alias("x"))
    right = pack(chunks, key, parts, "part").select("part", F.col("x").alias("cs"))
    left = pack(queries, query_id, blocks, "block").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.col("x").alias("qs"))
    kinds = chunks.schema[key].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    return scored_blocks(right.join(left.hint("merge"), "part").select("cs", "qs"), k, query_id, key, kinds, over)


def scored_blocks(work: DataFrame, k: int, query_id: str, key: str, kinds: tuple[str, str], over: float | None = None) -> DataFrame:
    """(query_id, key, score) from rows (cs, qs), arrays of (id, v): of each row the k most similar ids of cs for each of qs; kinds: types of key and query_id."""
    import numpy as np

    def matrix(rows):
        import pyarrow as pa
        import pyarrow.compute as pc

        n, flat = pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64), rows.flatten()
        if not pa.types.is_struct(flat.type):
            return flat.to_numpy(zero_copy_only=False).reshape(len(n), -1)
        out = np.zeros((len(n), DIM))
        out[np.repeat(np.arange(len(n)), n), flat.field("b").to_numpy()] = flat.field("w").to_numpy()
        return out

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                cs, qs = (batch.column(i)[r].values for i in (0, 1))
                s = matrix(qs.field("v")) @ matrix(cs.field("v")).T
                c, q = _best(s, k, cs.field("id"))
                ok = np.ones(len(c), bool) if over is None else s[q, c] > over
                yield pa.RecordBatch.from_arrays([qs.field("id").take(pa.array(q[ok])), cs.field("id").take(pa.array(c[ok])), pa.array(s[q, c][ok])], names=["q", "c", "score"])

    return work.mapInArrow(run, f"{query_id} {kinds[1]}, {key} {kinds[0]}, score double")


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int, query_id: str = "query_id", key: str = "chunk_id", query_vector: str = "qv", vector: str = "v") -> DataFrame:
    """(query_id, key, score, rank): the k most similar vectors of each query, exactly, in blocks of a stated set of queries."""
    near = _block_product(queries.select(query_id, unit(query_vector).alias("v")), chunks.select(key, unit(vector).alias("v")), k, query_id, key)
    return top_k(near, k, [query_id], key)


#: An encoder of texts: its name, which is recorded with what it makes, and a function (rows, key, text) -> (key, v: array<double>).
Encoder = tuple[str, Callable[[DataFrame, str, str], DataFrame]]


def hashing_encoder() -> Encoder:
    def encode(rows: DataFrame, key: str, text: str) -> DataFrame:
        pairs = hashed(rows, key, text).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("b", "w"))).alias("m"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(0.0)))
        return rows.select(key).distinct().join(pairs, key, "left").select(key, F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), DIM)).otherwise(dense).alias("v"))

    return f"hashing-{DIM}", encode


def chosen_encoder(model: Encoder | None = None, allow_fallback: bool = False) -> Encoder:
    """The model's encoder; without one the hashing encoder, but only if that is allowed."""
    if model is not None:
        return model
    if not allow_fallback:
        raise ValueError("no sentence encoder is given, and falling back to the hashing encoder is not allowed")
    return hashing_encoder()


def encoded_topk(queries: DataFrame, chunks: DataFrame, k: int, encoder: Encoder, query_id: str = "query_id", question: str = "question", key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(query_id, key, score, rank, encoder): nearest chunks by a pluggable encoder, whose name is kept."""
    name, encode = encoder
    near = dense_topk(encode(queries, query_id, question).withColumnRenamed("v", "qv"), encode(chunks, key, text), k, query_id, key)
    return near.withColumn("encoder", F.lit(name))


def ranked(scores: DataFrame, by: list[str], tie: str, score: str = "score", base: int = 1, places: int = 6) -> DataFrame:
    """Scores with their rank: rounded score, then the tie column."""
    w = Window.partitionBy(*by).orderBy(F.round(score, places).desc(), F.col(tie))
    return scores.withColumn("rank", F.row_number().over(w) + F.lit(base - 1))


def top_k(scores: DataFrame, k: int, by: list[str], tie: str, score: str = "score") -> DataFrame:
    """The k best of each group; the window is limited before it is shuffled."""
    return ranked(scores, by, tie, score).filter(F.col("rank") <= k)


def minmax(scores: DataFrame, by: list[str], n_all: Column | None = None, score: str = "score") -> DataFrame:
    """Scores scaled to 0..1 in each group; constant scores become 0.

    Pairs without a row score 0: where ``n_all`` says that there are more pairs
    than rows, 0 is among the values.
    """
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    if n_all is not None:
        absent = F.count("*").over(w) < n_all
        low, high = F.when(absent, F.least(low, F.lit(0.0))).otherwise(low), F.when(absent, F.greatest(high, F.lit(0.0))).otherwise(high)
    return scores.withColumn(score, F.when(high - low < 1e-12, 0.0).otherwise((F.col(score) - low) / (high - low)))


def hybrid_minmax(dense: DataFrame, lexical: DataFrame, query_id: str = "query_id", key: str = "chunk_id", alpha: float = 0.5, n_all: Column | None = None) -> DataFrame:
    """alpha of the scaled dense and 1 - alpha of the scaled lexical score."""
    d = minmax(dense, [query_id], n_all).select(query_id, key, F.col("score").alias("dense"))
    b = minmax(lexical, [query_id], n_all).select(query_id, key, F.col("score").alias("bm25"))
    both = d.join(b, [query_id, key], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return both.select(query_id, key, (alpha * zero("dense") + (1 - alpha) * zero("bm25")).alias("score"), zero("dense").alias("dense"), zero("bm25").alias("bm25"))


def rrf(rankings: list[DataFrame], query_id: str = "query_id", key: str = "chunk_id", k: int = RRF_K, base: int = 1) -> DataFrame:
    """Reciprocal rank fusion of rankings with (query_id, key, score): sum of 1 / (k + rank)."""
    parts = [ranked(r, [query_id], key, base=base).select(query_id, key, "rank") for r in rankings]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(query_id, key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def max_pooled(scores: DataFrame, query_id: str = "query_id", group: str = "table_id") -> DataFrame:
    """A table's score: the best of its chunks."""
    return scores.groupBy(query_id, group).agg(F.max("score").alias("score"))


def best_per_table(hits: DataFrame, vectors: int = 20, tables: int = 5, query_id: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """The best tables among the best chunks, each with its best chunk."""
    near = top_k(hits, vectors, [query_id], key)
    first = near.groupBy(query_id, "table_id").agg(F.max_by(key, F.struct(F.round("score", 6), F.expr(f"-rank"))).alias(key), F.max("score").alias("score"))
    return top_k(first, tables, [query_id], "table_id")


def cascade(table_scores: DataFrame, cell_scores: DataFrame, tables: int, cells: int, query_id: str = "query_id") -> DataFrame:
    """Cells ranked inside the best tables only."""
    kept = top_k(table_scores, tables, [query_id], "table_id").select(query_id, "table_id")
    return top_k(cell_scores.join(kept, [query_id, "table_id"], "left_semi"), cells, [query_id], "chunk_id")


def reranked(hits: DataFrame, scorer: Column, pool: int = 50, query_id: str = "query_id") -> DataFrame:
    """Hits of the pool by a second score; the rest behind them in their order."""
    s = hits.withColumn("second", F.when(F.col("rank") <= pool, scorer))
    w = Window.partitionBy(query_id).orderBy(F.col("second").desc_nulls_last(), "rank")
    return s.withColumn("new_rank", F.row_number().over(w))


def lexical_headers(headers: DataFrame, k: int) -> DataFrame:
    """(query_id, question, i, header) by shared tokens, then fewer tokens, then the later header."""
    q, h = F.array_distinct(tx.alnum_tokens("question")), F.array_distinct(tx.alnum_tokens("header"))
    s = headers.select("query_id", "i", "header", F.size(F.array_intersect(q, h)).alias("overlap"), F.size(h).alias("n"))
    w = Window.partitionBy("query_id").orderBy(F.col("overlap").desc(), F.col("n"), F.col("i").desc())
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def composed(row_scores: DataFrame, col_scores: DataFrame, query_id: str = "query_id") -> DataFrame:
    """A cell's score as the sum of its row path's and its column path's."""
    return row_scores.withColumnRenamed("score", "sr").join(col_scores.withColumnRenamed("score", "sc"), query_id).withColumn("score", F.col("sr") + F.col("sc"))


def merged_best(parts: list[DataFrame], query_id: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """Union of hits, each chunk at its best score."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(query_id, key).agg(F.max("score").alias("score"))


def merged_first(hits: DataFrame, query_id: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """Hits of several sub-queries (op, rank) without repeats, in the order first seen."""
    first = hits.groupBy(query_id, key).agg(F.min(F.struct("op", "rank")).alias("at"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy(query_id).orderBy("at", key))).select(query_id, key, "position")


def collisions(cells: DataFrame, least: int = 5) -> DataFrame:
    """Row leaf labels with the number of tables that use them, and whether that is many."""
    label = tx.normal_label(tx.leaf("row_path"))
    return cells.groupBy(label.alias("label")).agg(F.count_distinct("table_id").alias("tables")).withColumn("colliding", F.col("tables") >= least)
