"""A BM25 index on disk: blocks of postings by range of chunks and term, with the largest impact of each.

Building reads the texts once and moves chunks, never postings: a task has all
chunks of a segment and packs them.  Asking reads no text: first only the
blocks' bounds, then the postings of the ranges that can still reach the k best.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators.scoring import EPSILON, K1, QUERIES, B, _best, top_k
from .shared import folder, remove

#: Chunks of a range, on average; bits of a sketch, at most.
RANGE, BITS = 128, 16
#: Chunks of a segment, about: at most, and how many segments there are below that.
SEGMENT, SEGMENTS = 2048, 32
#: Chunks whose words are counted at once.
ROWS = 2048
#: Asked terms up to which the reader is told them, in groups that Parquet's filters take.
TOLD, GROUP = 256, 10
#: No two rows have the same postings: they aren't looked up in a dictionary when they are written.
PLAIN = {f"parquet.enable.dictionary#{c}": "false" for c in ("places", "impacts")}


def _alnum(texts):
    """(how many words each lower-case text has, the words): runs of a-z and 0-9, those of :func:`~arborix.functions.text.alnum_tokens`."""
    import numpy as np
    import pyarrow as pa

    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    wanted = np.zeros(256, bool)
    wanted[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
    inside = wanted[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.append(False, inside)[:-1], np.append(inside, False)[1:]
    starts, last = np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:]))
    ends = np.append(0, np.cumsum(last - starts + 1)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data[inside]))
    return np.diff(np.searchsorted(starts, offsets)), words


def _bytes(values, ends):
    """A column of byte strings: the elements of an array of numbers up to each end."""
    import numpy as np
    import pyarrow as pa

    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(column, kind):
    """All numbers of a column of byte strings, as one array."""
    import numpy as np

    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind)


def _spread(starts, n):
    """(i, starts[i] + 0, 1, ... n[i] - 1) for each i."""
    import numpy as np

    i = np.repeat(np.arange(len(n)), n)
    return i, (starts - (np.cumsum(n) - n))[i] + np.arange(len(i))


def _flat(table, name: str):
    import pyarrow as pa

    column = table[name].combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _counted(batches):
    """(key, words) -> (key, terms, sizes, tf, dl, sketch) of chunks with words, which are lists, or lower-case texts.

    Terms are joined, sizes and tf are int32; a chunk moves as a few byte
    strings.  A sketch is BITS signs of the sums of the words' hash bits, alike
    for chunks of like words.
    """
    import zlib

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for keys, words in (b.slice(at, ROWS).columns for b in batches for at in range(0, b.num_rows, ROWS)):
        if pa.types.is_list(words.type):
            length, words = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64), words.flatten()
        else:
            length, words = _alnum(words.cast(pa.string()))
        coded = words.dictionary_encode()
        n = len(coded.dictionary)
        if not n:
            continue
        at, tf = np.unique(np.repeat(np.arange(len(length)), length) * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        row, code = at // n, at % n
        some = np.flatnonzero(length)
        starts = np.searchsorted(row, some)
        ends = np.append(starts, len(row))
        bits = np.array([zlib.crc32(w.encode()) for w in coded.dictionary.to_pylist()], np.int64)
        signs = (2 * (bits[:, None] >> np.arange(BITS) & 1) - 1).astype(np.float32)
        # half of the bits of a frequent word would decide all: each counts by the root of its number
        sums = np.add.reduceat(signs[code] * np.sqrt(tf).astype(np.float32)[:, None], starts)
        sketch = ((sums > 0) << np.arange(BITS)).sum(1)
        terms = coded.dictionary.take(pa.array(code)).cast(pa.binary())
        size = pc.binary_length(terms).to_numpy()
        joined = _bytes(_numbers(terms, np.uint8), np.append(0, np.cumsum(size))[ends])
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(some)), joined, _bytes(size.astype(np.int32), ends), _bytes(tf.astype(np.int32), ends), pa.array(length[some]), pa.array(sketch)], names=["key", "terms", "sizes", "tf", "dl", "sketch"])


def _packed(avgdl: float) -> Callable:
    """The function over the Arrow batches (segment, range, key, terms, sizes, tf, dl) of one segment that gives its blocks, a row for each term."""
    import numpy as np

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        chunks = pa.Table.from_batches(rows)
        ranges, home = np.unique(_flat(chunks, "range").to_numpy(), return_inverse=True)
        sizes, joined = _flat(chunks, "sizes"), _flat(chunks, "terms")
        row = np.repeat(np.arange(chunks.num_rows), pc.binary_length(sizes).to_numpy() // 4)
        ends = np.append(0, np.cumsum(_numbers(sizes, np.int32))).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(row), pa.py_buffer(ends), pa.py_buffer(_numbers(joined, np.uint8))).dictionary_encode()
        by_name = pc.sort_indices(coded.dictionary)
        name = np.empty(len(by_name), np.int64)
        name[by_name.to_numpy()] = np.arange(len(by_name))
        block = name[coded.indices.to_numpy()] * len(ranges) + home[row]
        order = np.argsort(block, kind="stable")
        block, row = block[order], row[order]
        tf, dl = _numbers(_flat(chunks, "tf"), np.int32)[order].astype(np.float64), _flat(chunks, "dl").to_numpy()[row]
        impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
        place = np.empty(chunks.num_rows, np.int32)  # the order of a Spark sort
        place[pc.sort_indices(_flat(chunks, "key"), null_placement="at_start").to_numpy()] = np.arange(chunks.num_rows)
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        which, home = block[starts] // len(ranges), ranges[block[starts] % len(ranges)]
        first = np.flatnonzero(np.append(True, which[1:] != which[:-1]))  # block of each term
        of_term, of_block = np.append(first, len(starts)), np.append(starts, len(block))
        lists = [pa.ListArray.from_arrays(pa.array(of_term.astype(np.int32)), pa.array(x)) for x in (home, np.diff(of_block), np.maximum.reduceat(impact, starts))]
        ends = of_block[of_term]
        segment = pa.array(np.full(len(first), chunks["segment"][0].as_py(), np.int32))
        out = pa.RecordBatch.from_arrays([segment, coded.dictionary.take(by_name).take(pa.array(which[first])), pa.array(np.diff(ends)), *lists, _bytes(place[row], ends), _bytes(impact, ends)], names=["segment", "term", "df", "ranges", "sizes", "tops", "places", "impacts"])
        for at in range(0, out.num_rows, 1 << 15):
            yield out.slice(at, 1 << 15)

    return run


def _scorer(k: int) -> Callable:
    """The function over the rows (segment, ranges, sizes, places, impacts, asked) of a segment and its pairs (query, range) to score that gives each query's k best there."""
    import numpy as np

    def run(blocks, pairs):
        import pyarrow as pa
        import pyarrow.compute as pc

        queries, ranges = _flat(pairs, "query").dictionary_encode(null_encoding="encode"), pc.unique(_flat(pairs, "range"))
        names, ids = ["query", "segment", "place", "score"], queries.dictionary
        if not pairs.num_rows or not blocks.num_rows:
            return pa.Table.from_arrays([ids.slice(0, 0), *(pa.array([], t) for t in (pa.int32(), pa.int32(), pa.float64()))], names=names)
        wanted = np.zeros((len(ids), len(ranges)), bool)
        wanted[queries.indices.to_numpy(), pc.index_in(_flat(pairs, "range"), ranges).to_numpy()] = True
        # (block, query) for all that ask for a block, of which the pairs to score stay
        asked, homes = _flat(blocks, "asked"), _flat(blocks, "ranges")
        row = np.repeat(np.arange(blocks.num_rows), pc.list_value_length(homes).to_numpy())
        n = pc.list_value_length(asked).to_numpy().astype(np.int64)
        block, each = _spread((np.cumsum(n) - n)[row], n[row])
        who, home = asked.flatten(), pc.fill_null(pc.index_in(homes.flatten(), ranges), -1).to_numpy()[block]
        at = pc.fill_null(pc.index_in(who.field("query"), ids), -1).to_numpy()[each]
        stay = np.flatnonzero((at >= 0) & (home >= 0) & wanted[at, home])
        block, at, w = block[stay], at[stay], who.field("w").to_numpy()[each[stay]]
        size = _flat(blocks, "sizes").flatten().to_numpy()
        places, place = np.unique(_numbers(_flat(blocks, "places"), np.int32), return_inverse=True)
        # the postings of each (block, query)
        pair, post = _spread((np.cumsum(size) - size)[block], size[block])
        cell = at[pair] * len(places) + place[post]
        score = np.bincount(cell, w[pair] * _numbers(_flat(blocks, "impacts"), np.float64)[post], len(ids) * len(places))
        met = np.zeros(len(score), bool)
        met[cell] = True
        score = np.where(met, score, -np.inf).reshape(len(ids), len(places))
        c, q = _best(score, k, pa.array(places))
        ok = np.isfinite(score[q, c])
        c, q = c[ok], q[ok]
        segment = np.full(len(c), blocks["segment"][0].as_py(), np.int32)
        return pa.Table.from_arrays([ids.take(pa.array(q)), pa.array(segment), pa.array(places[c]), pa.array(score[q, c])], names=names)

    return run


class LexicalIndex:
    """Of chunks (key, text), in a folder: ``blocks`` (segment, term, df, ranges, sizes, tops, places, impacts), ``chunks`` (segment, place, key) and ``terms`` (term, df, idf).

    A segment is a set of ranges, written by one task in order of terms, so that
    few pages of its file hold a term.  A block has the postings of one term in
    one range of chunks; a row has the blocks of one term in one segment.
    Places are int32 numbers of the segment's chunks in order of their keys,
    impacts doubles, both joined to byte strings, block after block.  Chunks of
    one sketch form a range, or several by a hash of the key where they are more
    than RANGE, so no term makes a large row, and chunks of like words (one
    language, one kind) share ranges, whose bounds then differ.  An impact is
    what a posting adds for an idf of one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.blocks, self.chunks, self.terms = (spark.read.parquet(f"{self.path}/{t}") for t in ("blocks", "chunks", "terms"))

    @classmethod
    def build(cls, chunks: DataFrame, path: str, key: str = "chunk_id", text: str = "text", tokenize: Callable = tx.alnum_tokens, range_size: int = RANGE) -> LexicalIndex:
        """Null texts have no words but count as chunks; keys must be distinct.  An empty corpus gives an index that finds nothing."""
        spark = chunks.sparkSession
        n = chunks.count()  # of a Parquet table, from its footers
        kind = chunks.schema[key].dataType.simpleString()
        words = (F.lower if tokenize is tx.alnum_tokens else tokenize)(F.coalesce(F.col(text), F.lit("")))  # words of the default are cut in the task
        counted = chunks.select(F.col(key).alias("key"), words.alias("words")).mapInArrow(_counted, f"key {kind}, terms binary, sizes binary, tf binary, dl long, sketch long")
        counted.write.parquet(f"{path}/raw")
        raw = spark.read.parquet(f"{path}/raw")
        avgdl = (raw.agg(F.sum("dl")).first()[0] or 0) / max(1, n)
        own = F.col("sketch").bitwiseAND((1 << min(BITS, max(0, (n // range_size).bit_length() - 1))) - 1)
        sizes = raw.groupBy(own.alias("own")).agg(F.ceil(F.count("*") / range_size).alias("split"))  # 2 ** BITS rows at most
        home = F.col("own") + F.pmod(F.xxhash64("key"), F.col("split")) * (1 << BITS)
        segments = max(1, -(-n // max(range_size, min(SEGMENT, n // SEGMENTS))))
        placed = raw.withColumn("own", own).join(F.broadcast(sizes), "own").withColumn("range", home).withColumn("segment", F.pmod(F.xxhash64("range"), F.lit(segments)).cast("int"))
        place = (F.row_number().over(Window.partitionBy("segment").orderBy("key")) - 1).alias("place")
        placed.select("segment", place, "key").write.parquet(f"{path}/chunks")
        dealt = placed.select("segment", "range", "key", "terms", "sizes", "tf", "dl").repartitionById(segments, "segment")
        dealt.mapInArrow(_packed(avgdl), "segment int, term string, df long, ranges array<long>, sizes array<long>, tops array<double>, places binary, impacts binary").write.options(**PLAIN).parquet(f"{path}/blocks")
        df = spark.read.parquet(f"{path}/blocks").groupBy("term").agg(F.sum("df").alias("df"))
        df = df.withColumn("idf", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        df.write.parquet(f"{path}/df")
        df = spark.read.parquet(f"{path}/df")
        mean = df.agg(F.avg("idf")).first()[0] or 0.0
        df.withColumn("idf", F.when(F.col("idf") < 0, EPSILON * mean).otherwise(F.col("idf"))).write.parquet(f"{path}/terms")
        for t in ("raw", "df"):
            remove(spark, f"{path}/{t}")
        return cls(spark, path)

    def _kept(self, df: DataFrame, label: str) -> DataFrame:
        """df, stored once: what a search reads twice is not worked out twice."""
        path = folder(self.spark, label)
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def _asked(self, queries: DataFrame, query_id: str, question: str, tokenize: Callable) -> DataFrame:
        """(slot, term, asked): the queries of a slot, QUERIES or so, that have the term, each with w: the idf times how often it has it."""
        slots = max(1, -(-queries.count() // QUERIES))
        words = queries.select(F.col(query_id).alias("query"), F.explode(tokenize(F.col(question))).alias("term"))
        w = words.groupBy("query", "term").agg(F.count("*").alias("qn")).join(self.terms, "term").select("query", "term", (F.col("qn") * F.col("idf")).alias("w"))
        slot = F.pmod(F.xxhash64("query"), F.lit(slots)).cast("int")
        return w.groupBy(slot.alias("slot"), "term").agg(F.collect_list(F.struct("query", "w")).alias("asked"))

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", question: str = "question", tokenize: Callable = tx.alnum_tokens, key: str = "chunk_id") -> DataFrame:
        """(query_id, key, score, rank): the k best chunks of each query, the rows of :func:`~arborix.operators.scoring.bm25_topk`."""
        return self._found(queries, k, query_id, question, tokenize, key)[0]

    def audit(self, queries: DataFrame, k: int, query_id: str = "query_id", question: str = "question", tokenize: Callable = tx.alnum_tokens) -> DataFrame:
        """(query_id, blocks, blocks_read): how many blocks hold a term of the query, and of how many the postings are read."""
        return self._found(queries, k, query_id, question, tokenize, "chunk_id")[1]

    def _found(self, queries, k, query_id, question, tokenize, key):
        asked = self._kept(self._asked(queries, query_id, question, tokenize), "asked")
        told = sorted(r.term for r in asked.select("term").distinct().limit(TOLD + 1).collect())
        blocks = self.blocks
        if 0 < len(told) <= TOLD:  # pages of other terms are passed over
            some = None
            for at in range(0, len(told), GROUP):
                one = F.col("term").isin(told[at : at + GROUP])
                some = one if some is None else some | one
            blocks = blocks.filter(some)
        hit = blocks.join(asked, "term")
        each = hit.select("segment", "slot", "asked", F.explode(F.arrays_zip("ranges", "tops")).alias("b")).select("segment", "slot", "b", F.explode("asked").alias("a"))
        each = each.select("segment", "slot", F.col("b.ranges").alias("range"), F.col("a.query").alias("query"), F.greatest(F.col("a.w") * F.col("b.tops"), F.lit(0.0)).alias("most"))
        bound = each.groupBy("segment", "slot", "range", "query").agg(F.sum("most").alias("most"), F.count("*").alias("blocks"))
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("most").desc(), "range"))
        bound = self._kept(bound.withColumn("place", place), "bounds")
        seeds = max(2, k // 4)
        schema = f"query {bound.schema['query'].dataType.simpleString()}, segment int, place int, score double"

        def scored(pairs: DataFrame) -> DataFrame:
            some = pairs.groupBy("segment", "slot").agg(F.collect_set("range").alias("some"))
            rows = hit.join(some, ["segment", "slot"]).filter(F.arrays_overlap("ranges", "some")).select("segment", "slot", "ranges", "sizes", "places", "impacts", "asked")
            parts = [t.groupBy("segment", "slot") for t in (rows, pairs.select("segment", "slot", "range", "query"))]
            return parts[0].cogroup(parts[1]).applyInArrow(_scorer(k), schema).join(self.chunks, ["segment", "place"]).select("query", "key", "score")

        first = self._kept(top_k(scored(bound.filter(F.col("place") <= seeds)), k, ["query"], "key").drop("rank"), "seeds")
        # what the k-th best of the seeds has reached; null where they give fewer
        best = first.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score") - 2e-6).alias("reached"))
        rest = bound.filter(F.col("place") > seeds).join(best, "query", "left").filter("reached is null or most >= reached")
        hits = top_k(first.unionByName(scored(rest)), k, ["query"], "key")
        read = bound.filter(F.col("place") <= seeds).select("query", "blocks").unionByName(rest.select("query", "blocks")).groupBy("query").agg(F.sum("blocks").alias("blocks_read"))
        audit = bound.groupBy("query").agg(F.sum("blocks").alias("blocks")).join(read, "query")
        return hits.withColumnsRenamed({"query": query_id, "key": key}), audit.withColumnRenamed("query", query_id)
