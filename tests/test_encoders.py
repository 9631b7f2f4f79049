"""Models behind the encoder interface: loaded once for each worker, equal to the model asked directly."""

import os
import uuid

import numpy as np
import pytest

from arborix.operators import encoders, scoring
from arborix.sources import commits


def _loader(folder):
    def load():
        with open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w"):
            pass
        return lambda texts: np.array([[len(t), t.count("a"), 1.0] for t in texts])

    return load


def test_loaded_once_and_equal(spark, tmp_path):
    texts = ["", "a", "banana", None, "é" * 30, *[f"row {i} " + "a" * (i % 7) for i in range(300)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").repartition(16)
    encoder = encoders.model_encoder(f"count-{tmp_path}", _loader(tmp_path), batch=7)
    for _ in range(2):
        got = {r.chunk_id: list(r.v) for r in encoder[1](rows, "chunk_id", "text").collect()}
        assert got == {i: [len(t or ""), (t or "").count("a"), 1.0] for i, t in enumerate(texts)}
    loads = [f.split("-")[0] for f in os.listdir(tmp_path)]
    assert 1 <= len(loads) == len(set(loads)) < 16
    assert encoder[1](rows.limit(0), "chunk_id", "text").count() == 0
    assert commits.cached_vectors(rows, f"file://{tmp_path}/kept", encoder).count() == len(texts)
    asked = spark.createDataFrame([("q", "aaaa")], "query_id string, question string")
    near = scoring.encoded_topk(asked, rows.filter("chunk_id in (1, 2, 4)"), 1, encoder).first()
    # (4, 4, 1) against (1, 1, 1), (6, 3, 1) and (30, 0, 1): 0.905, 0.950, 0.701
    assert near.chunk_id == 2 and near.score == pytest.approx(37 / np.sqrt(33 * 46)) and near.encoder == encoder[0]


def test_wrong_models_are_errors():
    assert encoders._vectors(lambda t: [[1.0]] * len(t), ["b", "a"], 1).tolist() == [[1.0], [1.0]]
    with pytest.raises(ValueError, match="shape"):
        encoders._vectors(lambda t: np.zeros((1, 2)), ["a", "b"], 2)
    with pytest.raises(ValueError, match="finite"):
        encoders._vectors(lambda t: np.full((len(t), 2), np.nan), ["a", "b"], 2)
    with pytest.raises(ValueError, match="positive"):
        encoders.model_encoder("x", lambda: None, 0)
