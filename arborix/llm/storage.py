"""Shared storage for the corpus operators.

Everything that one stage leaves for another goes to the folder that the
cluster names in ``spark.checkpoint.dir``: tables as Parquet, and sorted arrays
as raw files that the workers map into memory.  Nothing that another machine
reads is written elsewhere.  Two uses of a local folder remain: where no shared
folder is set and Spark runs on one machine, and the copy of an array that a
worker maps from a store which can't be mapped, unlinked as soon as it is open.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_made: list[str] = []
_paths: dict[int, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where the setting is absent (tests on one machine) a temporary folder is
    used; on a cluster an absent setting is an error, since a local folder
    would not be visible to the other machines.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="arborix-")
    return _own[app]


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever they are called: names may hold dots."""
    return [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in df.columns]


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    _made.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def clear(spark: SparkSession) -> None:
    """Delete all that this process has left in the shared folder; results must have been written elsewhere.

    A result is read from there when it is asked for, so only the caller knows
    when it has been written.
    """
    while _made:
        remove(spark, _made.pop())


def save(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out, lambda _, k=id(out): _paths.pop(k, None)), path)
    return out


@contextmanager
def scratch(spark: SparkSession):
    """Delete at the end what was left in the shared folder inside, but for the tables that are handed to ``keep``."""
    begun, held = len(_made), []
    try:
        yield lambda df: held.append(_paths[id(df)][1]) or df
    finally:
        new, _made[begun:] = _made[begun:], []
        for path in new:
            if path in held:
                _made.append(path)
            else:
                remove(spark, path)
        release(spark)


@contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Hand Python workers at most n rows at once, for actions run inside: rows may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Keys of more rows than this, and than this part of all, are joined without a shuffle.
MANY, PART = 256, 10_000


def named(rows: DataFrame, keys: DataFrame, on: str, total: int | None = None) -> DataFrame:
    """rows joined to what keys (on, n: number of rows, ...) say of them, each row by its one key.

    total: the number of rows, or more, if it is known.

    Rows of frequent keys, such as copies of one text, stay where they are: no
    more than PART keys can have more than one in PART of all rows, so the
    table of these is small whatever the input.  The others are shuffled.
    """
    total = (keys.agg(F.sum("n")).first()[0] or 0) if total is None else total
    most = max(MANY, total // PART)
    more = [c for c in keys.columns if c not in (on, "n")]
    hot = keys.filter(F.col("n") > most).select(on, F.struct(*more).alias("_of"))
    some = rows.join(F.broadcast(hot), on, "left")
    rest = some.filter("_of is null").drop("_of").join(keys.filter(F.col("n") <= most).drop("n"), on)
    return some.filter("_of is not null").select(*rows.columns, "_of.*").unionByName(rest.select(*rows.columns, *more))


def release(spark: SparkSession) -> None:
    """Let the engine delete the shuffle files of what is done: it does so when the driver collects its garbage."""
    spark.sparkContext._jvm.System.gc()


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`save` that is no longer read."""
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, f)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path, by Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def make_dir(spark: SparkSession, path: str) -> str:
    """Create a folder in the shared storage."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
    return path


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_array(uri: str, values: np.ndarray) -> None:
    """Write a raw array; a repeated task replaces the file in one step."""
    system, path = _filesystem(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(values).tobytes() if values.nbytes < 1 << 20 else memoryview(np.ascontiguousarray(values)).cast("B"))
    system.move(part, path)


def map_array(uri: str, dtype) -> np.ndarray:
    """Map a raw array into memory.

    A folder mounted on the machine is mapped in place.  From any other store
    the file is copied first, mapped and unlinked at once, so that nothing
    stays in the worker's folder.
    """
    system, path = _filesystem(uri)
    if system.get_file_info(path).size == 0:
        return np.empty(0, dtype)
    if system.type_name == "local":
        return np.memmap(path, dtype=dtype, mode="r")
    import shutil

    with tempfile.NamedTemporaryFile(delete=False) as local, system.open_input_stream(path) as source:
        shutil.copyfileobj(source, local, 1 << 22)
    try:
        return np.memmap(local.name, dtype=dtype, mode="r")
    finally:
        os.unlink(local.name)


def delete_file(uri: str) -> bool:
    """Delete a file of the shared folder, from a task; whether it was there (a repeated task finds it gone)."""
    if not exists(uri):
        return False
    system, path = _filesystem(uri)
    system.delete_file(path)
    return True


def write_text(uri: str, text: str) -> None:
    """Write a small file in one step."""
    write_array(uri, np.frombuffer(text.encode(), "u1"))


def read_text(uri: str) -> str:
    system, path = _filesystem(uri)
    with system.open_input_stream(path) as f:
        return f.read().decode()


def exists(uri: str) -> bool:
    from pyarrow import fs

    system, path = _filesystem(uri)
    return system.get_file_info(path).type == fs.FileType.File
