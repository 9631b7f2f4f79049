"""A store of vectors laid out by coarse cells, searched exactly without reading cells that can't matter.

The cells are those of centroids that are fitted once, on a bounded sample of
the first vectors.  All vectors count as of length 1; of each cell the largest
distance of a member from its centroid is kept, so by the triangle inequality
no member is nearer to a query than the query's distance from the centroid less
that radius.  A search reads the cells nearest to each query, and then only
those whose bound is within the distance of the worst hit so far.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.scoring import CHUNKS, QUERIES, best_per_table, scored_blocks, top_k, unit
from .shared import exists, remove

#: Vectors that the centroids are fitted on, and centroids, at most; rounds of fitting; cells that a search reads first.
SAMPLE, CELLS, ROUNDS, SEEDS = 20_000, 1024, 8, 2
#: The cell of vectors that have no direction.
NOWHERE = -1


def _centroids(sample, n: int):
    """Unit centroids of unit vectors, by Lloyd's rounds from spread-out rows."""
    import numpy as np

    c = sample[np.linspace(0, len(sample) - 1, n).astype(int)].copy()
    for _ in range(ROUNDS):
        own = np.argmax(sample @ c.T, 1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-300), c)
    return c


def _matrix(column, dim: int):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) if len(column) else np.empty((0, dim))


class VectorStore:
    """Named collections of vectors (table_id, chunk_id, text, v), all of one length in a collection.

    Every add is a version: cells as folders, and the radius of each.  A chunk
    that a later version has again is replaced; chunk ids are distinct within
    one add.  :meth:`compact` makes one version of all.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{re.sub(r'[^A-Za-z0-9_-]', '_', name)[:63]}"

    def versions(self, name: str) -> list[int]:
        """Numbers of the versions that are whole: their bounds are written last."""
        out, k = [], 1
        while exists(self.spark, f"{self.path(name)}/v-{k}"):
            if exists(self.spark, f"{self.path(name)}/v-{k}/bounds/_SUCCESS"):
                out.append(k)
            k += 1
        return out

    def add(self, name: str, rows: DataFrame) -> None:
        import numpy as np

        at = self.path(name)
        k = 1
        while exists(self.spark, f"{at}/v-{k}"):
            k += 1
        rows = rows.withColumn("_u", unit("v"))
        if not exists(self.spark, f"{at}/centroids/_SUCCESS"):
            # the sample bounds what the driver sees; it decides how well a search is pruned, not what it finds
            sample = rows.select("_u").filter(F.exists("_u", lambda x: x != 0)).orderBy(F.xxhash64("chunk_id")).limit(SAMPLE).toArrow().column(0).combine_chunks()
            m = _matrix(sample, len(sample[0])) if len(sample) else np.empty((0, 0))
            made = _centroids(m, min(CELLS, max(1, int(len(m) ** 0.5)))) if len(m) else m
            self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(made)], "cell int, c array<double>").coalesce(1).write.mode("overwrite").parquet(f"{at}/centroids")
        cells = self._cells(name)
        if not exists(self.spark, f"{at}/columns/_SUCCESS"):  # the columns, for versions without a row
            rows.drop("_u").limit(0).select("*", F.lit(0.0).alias("far"), F.lit(0).alias("cell")).coalesce(1).write.mode("overwrite").parquet(f"{at}/columns")

        def near(batches):
            import pyarrow as pa

            for b in batches:
                u = _matrix(b.column(1), cells.shape[1]) if cells.size else np.zeros((b.num_rows, 1))
                near_to = u @ cells.T if cells.size else np.zeros((b.num_rows, 1))
                own = np.argmax(near_to, 1)
                far = np.sqrt(np.maximum(0, 2 - 2 * near_to[np.arange(len(own)), own]))
                none = ~u.any(1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.where(none, NOWHERE, own).astype(np.int32)), pa.array(np.where(none, 0.0, far))], names=["row", "cell", "far"])

        kind = rows.select(F.struct(*[c for c in rows.columns if c != "_u"]).alias("row")).schema["row"].dataType.simpleString()
        placed = rows.select(F.struct(*[c for c in rows.columns if c != "_u"]).alias("row"), "_u").mapInArrow(near, f"row {kind}, cell int, far double")
        placed.select("row.*", "far", "cell").repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{at}/v-{k}/cells")
        self._version(name, k).groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).coalesce(1).write.mode("overwrite").parquet(f"{at}/v-{k}/bounds")

    def _cells(self, name: str):
        import numpy as np

        rows = sorted(self.spark.read.parquet(f"{self.path(name)}/centroids").collect())  # CELLS at most
        return np.array([r.c for r in rows])

    def read(self, name: str, cells: list[int] | None = None) -> DataFrame:
        """The rows of a collection, or of some cells, each chunk in its last version."""
        out, later = None, None
        for k in reversed(self.versions(name)):
            rows = self._version(name, k)
            ids = rows.select("chunk_id")
            rows = rows if cells is None else rows.filter(F.col("cell").isin(cells))
            rows = rows if later is None else rows.join(later, "chunk_id", "left_anti")
            out = rows if out is None else out.unionByName(rows)
            later = ids if later is None else later.unionByName(ids)
        if out is None:
            raise ValueError(f"there is no collection {name}")
        return out

    def _version(self, name: str, k: int) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path(name)}/columns").schema).parquet(f"{self.path(name)}/v-{k}/cells")

    def compact(self, name: str) -> None:
        """Write all chunks as one version and delete those before it."""
        old = self.versions(name)
        self.add(name, self.read(name).drop("cell", "far"))
        for k in old:  # a search that has begun must have ended
            remove(self.spark, f"{self.path(name)}/v-{k}/bounds")
            remove(self.spark, f"{self.path(name)}/v-{k}/cells")

    def bounds(self, name: str) -> DataFrame:
        """(cell, n, radius) over all versions; n counts replaced chunks, too."""
        parts = [self.spark.read.parquet(f"{self.path(name)}/v-{k}/bounds") for k in self.versions(name)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))

    def nearest(self, name: str, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(hits, audit): (query_id, chunk_id, score, rank), the k most similar vectors of each query (query_id, qv), the hits of a full scan; and (query_id, cells, cells_read)."""
        import numpy as np

        cells = self._cells(name)
        known = self.bounds(name).collect()  # CELLS and one at most
        number = np.array([r.cell for r in known], np.int32)
        radius = np.array([r.radius for r in known])
        sizes = self.spark.createDataFrame([(r.cell, -(-r.n // CHUNKS)) for r in known], "cell int, parts long")
        own = queries.schema["query_id"].dataType.simpleString()

        def bounded(batches):
            import pyarrow as pa

            for b in batches:
                q = _matrix(b.column(1), cells.shape[1]) if cells.size else np.zeros((b.num_rows, 1))
                placed = number != NOWHERE
                low = np.zeros((b.num_rows, len(number)))
                if cells.size:
                    far = np.sqrt(np.maximum(0, 2 - 2 * q @ cells[number[placed]].T))
                    low[:, placed] = np.maximum(0, far - radius[placed])
                low[~q.any(1)] = 0
                rows = np.repeat(np.arange(b.num_rows), len(number))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(np.tile(number, b.num_rows)), pa.array(low.ravel())], names=["query_id", "cell", "low"])

        asked = queries.select("query_id", unit("qv").alias("v"))
        order = Window.partitionBy("query_id").orderBy("low", "cell")
        bound = asked.mapInArrow(bounded, f"query_id {own}, cell int, low double").withColumn("place", F.row_number().over(order))

        def scored(pairs: DataFrame) -> DataFrame:
            wanted = [r.cell for r in pairs.select("cell").distinct().collect()]
            rows = self.read(name, wanted)
            blocks = max(1, -(-queries.count() // QUERIES))
            qs = pairs.select("query_id", "cell").join(asked, "query_id").groupBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct(F.col("query_id").alias("id"), "v")).alias("qs"))
            part = F.pmod(F.xxhash64("chunk_id"), F.col("parts")).alias("part")
            cs = rows.join(F.broadcast(sizes), "cell").groupBy("cell", part).agg(F.collect_list(F.struct(F.col("chunk_id").alias("id"), unit("v").alias("v"))).alias("cs"))
            kinds = rows.schema["chunk_id"].dataType.simpleString(), own
            return scored_blocks(cs.join(qs, "cell").select("cs", "qs"), k, "query_id", "chunk_id", kinds)

        first = scored(bound.filter(F.col("place") <= SEEDS))
        worst = top_k(first, k, ["query_id"], "chunk_id").groupBy("query_id").agg(F.when(F.count("*") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * (F.min("score") - 2e-6)))).alias("worst"))
        rest = bound.filter(F.col("place") > SEEDS).join(worst, "query_id", "left").filter("worst is null or low <= worst + 1e-9")
        hits = top_k(first.unionByName(scored(rest)), k, ["query_id"], "chunk_id")
        read = bound.filter(F.col("place") <= SEEDS).select("query_id").unionByName(rest.select("query_id")).groupBy("query_id").agg(F.count("*").alias("cells_read"))
        return hits, bound.groupBy("query_id").agg(F.count("*").alias("cells")).join(read, "query_id")

    def search(self, name: str, queries: DataFrame, vectors: int = 20, tables: int = 5) -> DataFrame:
        """The best tables among the nearest vectors: (query_id, table_id, score, chunk_id, text of 400 characters at most)."""
        store = self.read(name)
        near = self.nearest(name, queries, vectors)[0].drop("rank").join(store.select("chunk_id", "table_id"), "chunk_id")
        best = best_per_table(near, vectors, tables)
        return best.join(store.select("chunk_id", F.substring("text", 1, 400).alias("text")), "chunk_id")
