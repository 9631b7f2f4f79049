"""Work that is done once for each key, whatever runs die or run twice, and vectors that are encoded once for each text."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import Encoder
from .shared import _path, exists, remove

#: Batches that one generation of work is cut into.
SLICES = 16


def _commit(spark: SparkSession, marker: str, content: str) -> bool:
    """Create a small file unless it is there; whether this call made it."""
    system, p = _path(spark, marker)
    try:
        out = system.create(p, False)
    except Exception:  # it is there, or has just been made by another run
        if not system.exists(p):
            raise
        return False
    out.writeBytes(content) if hasattr(out, "writeBytes") else out.write(bytearray(content.encode()))
    out.close()
    return True


def _content(spark: SparkSession, marker: str) -> str:
    return spark.read.text(marker, wholetext=True).first()[0]


class CommitLog:
    """Results of keyed work below a path, read through its commits only.

    A generation is the keys that were to do when it began, stored, and cut into
    slices by a hash.  A slice is written to a folder of its own and then
    committed by a marker that only one run can create, so a key's result stands
    once, whichever of several runs is first; what a dead run left uncommitted
    is never read, and :meth:`vacuum` deletes it.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "query_id", slices: int = SLICES):
        self.spark, self.path, self.key, self.slices = spark, path.rstrip("/"), key, slices

    def _committed(self, g: int) -> dict[int, str]:
        markers = {s: f"{self.path}/gen-{g}/slice-{s}.commit" for s in range(self.slices)}
        return {s: _content(self.spark, m) for s, m in markers.items() if exists(self.spark, m)}

    def _generations(self) -> int:
        g = 0
        while exists(self.spark, f"{self.path}/gen-{g}/todo.commit"):
            g += 1
        return g

    def read(self) -> DataFrame | None:
        """All committed rows; None before the first commit."""
        parts = [p for g in range(self._generations()) for p in self._committed(g).values()]
        return self.spark.read.parquet(*parts) if parts else None

    def run(self, todo: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
        """Do what is left of todo (key, ...) and give all results; work keeps the key and may be called again for a slice whose run died."""
        last = self._generations() - 1
        if last >= 0:
            self._finish(last, work)
        done = self.read()
        # keys without a result in a finished generation are done as well
        for g in range(last + 1):
            todo = todo.join(self._todo(g).select(self.key), self.key, "left_anti")
        if not todo.isEmpty():
            at = f"{self.path}/gen-{last + 1}/todo-{uuid.uuid4().hex}"
            todo.dropDuplicates([self.key]).write.parquet(at)
            if not _commit(self.spark, f"{self.path}/gen-{last + 1}/todo.commit", at):
                remove(self.spark, at)
            self._finish(last + 1, work)
            done = self.read()
        return done

    def _todo(self, g: int) -> DataFrame:
        return self.spark.read.parquet(_content(self.spark, f"{self.path}/gen-{g}/todo.commit"))

    def _finish(self, g: int, work: Callable[[DataFrame], DataFrame]) -> None:
        there, todo = self._committed(g), self._todo(g)
        for s in range(self.slices):
            if s in there:
                continue
            at = f"{self.path}/gen-{g}/slice-{s}-{uuid.uuid4().hex}"
            work(todo.filter(F.pmod(F.xxhash64(self.key), F.lit(self.slices)) == s)).write.parquet(at)
            if not _commit(self.spark, f"{self.path}/gen-{g}/slice-{s}.commit", at):
                remove(self.spark, at)

    def vacuum(self) -> int:
        """Delete what is not committed; no run may be at work."""
        live = {p.rsplit("/", 1)[1] for g in range(self._generations()) for p in [*self._committed(g).values(), _content(self.spark, f"{self.path}/gen-{g}/todo.commit")]}
        n = 0
        for g in range(self._generations() + 1):
            system, p = _path(self.spark, f"{self.path}/gen-{g}")
            for status in system.listStatus(p) if system.exists(p) else []:
                name = status.getPath().getName()
                if status.isDirectory() and name not in live:
                    remove(self.spark, f"{self.path}/gen-{g}/{name}")
                    n += 1
        return n


def cached_vectors(corpus: DataFrame, path: str, encoder: Encoder, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, v) of each row, encoding only texts that the folder does not hold for this encoder.

    Texts are known by their SHA-256, equal ones are encoded once, and a null
    text is the empty one.  Each call adds one batch, if anything is new; a
    batch that a dead run left unfinished is not read.
    """
    spark, (name, encode) = corpus.sparkSession, encoder
    at = f"{path.rstrip('/')}/{re.sub(r'[^A-Za-z0-9_.-]', '_', name)}"
    rows = corpus.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_h", F.sha2(F.col("_text").cast("binary"), 256))
    new = rows.select("_h", "_text").dropDuplicates(["_h"])
    there = _batches(spark, at)
    if there:
        new = new.join(spark.read.parquet(*there).select("_h"), "_h", "left_anti")
    if not there or not new.isEmpty():
        encode(new, "_h", "_text").select("_h", "v").write.parquet(f"{at}/{uuid.uuid4().hex}")
        there = _batches(spark, at)
    return rows.join(spark.read.parquet(*there).dropDuplicates(["_h"]), "_h").select(key, "v")


def _batches(spark: SparkSession, at: str) -> list[str]:
    system, p = _path(spark, at)
    names = [s.getPath().getName() for s in system.listStatus(p)] if system.exists(p) else []
    return [f"{at}/{n}" for n in sorted(names) if exists(spark, f"{at}/{n}/_SUCCESS")]
