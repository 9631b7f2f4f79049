"""Benchmark files as Spark data sources: partitions by ranges of files, filters on split and ids pushed to the reader.

    formats.register(spark)
    spark.read.format("table_samples").load(folder).filter("split = 'dev'")
    spark.read.format("table_documents").load(folder).filter("table_id in ('7', '12')")

Filters on the split and on a document's table_id choose files by their names,
before any is opened; those on the ids of samples are applied line by line.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .benchmarks import SAMPLE

#: A range of a file that one task reads; documents are grouped up to it.
RANGE_BYTES = 32 << 20
_SPLIT = re.compile(r"(?:^|/)([A-Za-z0-9]+)_samples(?:\.jsonl|/[^_./][^/]*)$")
_TABLE = re.compile(r"(?:^|/)([^/]+)\.json$")


def _files(path: str):
    """(file system, [(name below the folder, path, bytes)]) of a folder, in order."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    return system, sorted((f.path[len(root) :].lstrip("/"), f.path, f.size) for f in found if f.is_file)


class _Range(InputPartition):
    """A part of a file, or several whole files."""

    def __init__(self, paths: list[str], start: int = 0, end: int = 0, split: str = ""):
        self.paths, self.start, self.end, self.split = paths, start, end, split


class _Reader(DataSourceReader):
    """Keeps equalities on the columns that it can apply itself; a subclass says which and reads."""

    columns: tuple[str, ...] = ()

    def __init__(self, options: dict):
        self.path, self.wanted = options["path"], {}
        self.bytes = int(options.get("rangeBytes", RANGE_BYTES))
        if self.bytes < 1:
            raise ValueError("rangeBytes must be positive")
        self.also = options.get("otherwise")

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name in self.columns:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def read(self, part: _Range | None) -> Iterator[tuple]:
        """Rows of a part; there is none, and Spark gives None, where no file is left."""
        return iter(()) if part is None else self.rows(part)

    def rows(self, part: _Range) -> Iterator[tuple]:
        raise NotImplementedError

    def _wants(self, name: str, value) -> bool:
        return name not in self.wanted or (value is not None and value in self.wanted[name])


def _lines(stream, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin in a range of bytes: each line of a file is in one range only."""
    if start:
        stream.seek(start - 1)
        stream.readline()
    while stream.tell() < end and (line := stream.readline()):
        yield line


def _texts(x) -> list[str] | None:
    as_text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    return None if x is None else [as_text(v) for v in (x if isinstance(x, list) else [x])]


_ARRAYS = ("answer", "aggregation", "answer_formulas")
_FIELDS = tuple(f.split()[0] for f in SAMPLE.split(", "))


def _sample(line: bytes) -> dict:
    """Fields of a line; one that is no JSON object has none."""
    try:
        doc = json.loads(line)
    except ValueError:
        doc = {}
    doc = doc if isinstance(doc, dict) else {}
    return {k: _texts(doc.get(k)) if k in _ARRAYS else (_texts(doc.get(k)) or [None])[0] for k in _FIELDS}


class SamplesReader(_Reader):
    columns = ("split", "id", "table_id")

    def partitions(self) -> list[_Range]:
        out = []
        for name, path, size in _files(self.path)[1]:
            split = _SPLIT.search(name)
            if split and self._wants("split", split[1]):
                out += [_Range([path], a, min(a + self.bytes, size), split[1]) for a in range(0, size, self.bytes)]
        return out

    def rows(self, part: _Range) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        with io.BufferedReader(system.open_input_file(part.paths[0]), 1 << 20) as stream:
            for line in _lines(stream, part.start, part.end):
                if line.strip():
                    x = _sample(line)
                    if self._wants("id", x["id"]) and self._wants("table_id", x["table_id"]):
                        yield (*[x[k] for k in _FIELDS], part.split)


class SamplesSource(DataSource):
    """Question samples in files ``<split>_samples.jsonl`` (or folders ``<split>_samples``) below a folder.

    Blank lines are no samples; a line that is no JSON object has null fields.
    """

    @classmethod
    def name(cls) -> str:
        return "table_samples"

    def schema(self) -> str:
        return f"{SAMPLE}, split string"

    def reader(self, schema) -> SamplesReader:
        return SamplesReader(self.options)


class DocumentsReader(_Reader):
    columns = ("table_id",)

    def partitions(self) -> list[_Range]:
        chosen: dict[str, tuple[str, int]] = {}
        for folder in filter(None, (self.path, self.also)):
            for name, path, size in _files(folder)[1]:
                table = _TABLE.search(name)
                if table and self._wants("table_id", table[1]):
                    chosen.setdefault(table[1], (path, size))
        out, used = [], self.bytes
        for path, size in chosen.values():
            if used + size > self.bytes:
                out.append(_Range([]))
                used = 0
            out[-1].paths.append(path)
            used += size + 1
        return out

    def rows(self, part: _Range) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        for path in part.paths:
            with system.open_input_stream(path) as stream:
                yield _TABLE.search(path)[1], stream.read().decode("utf-8", "replace")


class DocumentsSource(DataSource):
    """(table_id, raw) of files ``<table_id>.json`` below a folder; the option ``otherwise`` names a second folder, for tables that the first lacks."""

    @classmethod
    def name(cls) -> str:
        return "table_documents"

    def schema(self) -> str:
        return "table_id string, raw string"

    def reader(self, schema) -> DocumentsReader:
        return DocumentsReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session and lets filters be pushed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (SamplesSource, DocumentsSource):
        spark.dataSource.register(source)
