"""Models as encoders: loaded once by each Python worker, asked in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scoring import Encoder

#: What this worker has loaded, by the encoder's name; workers outlive their tasks.
_loaded: dict[str, Callable] = {}


def _model(name: str, load: Callable[[], Callable]) -> Callable:
    """The worker's model; a function of the module, so that tasks share what it keeps and don't bring their own."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def _vectors(model: Callable, texts: list[str], batch: int) -> np.ndarray:
    """One row for each text; texts of like length are asked together, so little is padded."""
    order = np.argsort([len(t) for t in texts], kind="stable")
    parts = []
    for a in range(0, len(order), batch):
        asked = [texts[i] for i in order[a : a + batch]]
        v = np.asarray(model(asked), dtype=np.float64)
        if v.ndim != 2 or len(v) != len(asked):
            raise ValueError(f"a model gave an array of shape {v.shape} for {len(asked)} texts")
        if not np.isfinite(v).all():
            raise ValueError("a model gave numbers that are not finite")
        parts.append(v)
    return np.concatenate(parts)[np.argsort(order, kind="stable")]


def model_encoder(name: str, load: Callable[[], Callable], batch: int = 64) -> Encoder:
    """The encoder of a model: ``load()`` gives a function from a list of texts to an array with a row for each.

    ``load`` runs once in each Python worker, not once for each task or batch,
    so ``name`` must stand for the model and its version.  Null texts are encoded
    as empty ones.  An array of another shape, or with numbers that are not
    finite, is an error.  Memory is that of the model and one Arrow batch.
    """
    if batch < 1:
        raise ValueError("batch must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(name, load)
        for b in batches:
            if b.num_rows:
                v = _vectors(model, b.column(1).to_pylist(), batch)
                offsets = np.arange(0, v.size + 1, v.shape[1] or 1, dtype=np.int32)[: len(v) + 1]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, v.ravel())], names=[b.schema.names[0], "v"])

    def encode(rows: DataFrame, key: str, text: str) -> DataFrame:
        asked = rows.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
        return asked.mapInArrow(run, T.StructType([asked.schema[0], T.StructField("v", T.ArrayType(T.DoubleType()))]))

    return name, encode
