"""The shared folder: where what one job leaves is found by the next, on any machine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``; below a temporary folder if Spark runs on one machine and none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="arborix-"))
    return f"{at.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    system, p = _path(spark, path)
    return system.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    system, p = _path(spark, path)
    system.delete(p, True)
