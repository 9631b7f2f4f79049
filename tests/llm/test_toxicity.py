"""Operator 7: accuracy on held-out texts, and edges."""

import numpy as np
import pytest

from arborix.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, score string"


def texts(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = [f"w{x}" for x in rng.zipf(1.3, int(rng.integers(5, 300))) % 100_000]
        bad = rng.random() < 0.2
        if bad:
            words.insert(int(rng.integers(len(words) + 1)), ("Nasty,", "vile", "FOUL!")[int(rng.integers(3))])
        out.append((i, " ".join(words), ("en", "de", None)[i % 3], "clash", int(bad)))
    return out


@pytest.fixture(scope="module")
def trained(spark):
    rows = texts(1500, 1)
    docs = spark.createDataFrame([r[:4] for r in rows], SCHEMA)
    labels = spark.createDataFrame([(r[0], 1, r[4]) for r in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    return toxicity.train(docs, labels)


def test_held_out_accuracy(spark, trained):
    rows = texts(600, 2)
    got = {r.id: r for r in toxicity.score(spark.createDataFrame([r[:4] for r in rows], SCHEMA), trained).collect()}
    right = np.mean([got[r[0]].predicted == r[4] for r in rows])
    assert right > 0.97
    assert np.mean([got[r[0]].flagged == bool(r[4]) for r in rows]) > 0.97
    assert set(trained.thresholds) == {"en", "de", ""}


def test_scores_depend_on_the_text_alone(spark, trained):
    rows = [(None, None, None, ""), (1, "", "en", ""), (2, "vile w1 w2", "en", ""), (3, "vile w1 w2", "de", ""), (3, "vile w1 w2", "de", ""), (4, "w1 " * 60_000 + "vile", "en", ""), (5, "...", "xx", "")]
    got = toxicity.score(spark.createDataFrame(rows, SCHEMA), trained).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert got[0].score == got[1].score and got[2].score == got[3].score == got[4].score
    assert got[5].predicted == 1
    assert toxicity.score(spark.createDataFrame([], SCHEMA), trained).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "")], SCHEMA)
    net = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert 0 <= toxicity.score(docs, net).first().score <= 1


def test_the_sample_is_bounded_by_texts_and_words_and_repeats(spark, monkeypatch):
    rows = texts(60, 3) + [(7, "second text of seven", "en", "clash", 1), (8, None, None, "clash", 0)]
    docs = spark.createDataFrame([r[:4] for r in rows], SCHEMA)
    labels = spark.createDataFrame([(r[0], 1, r[4]) for r in rows[:60]] + [(10_000 + i, 1, 1) for i in range(40)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda hs, y, langs: seen.append([h.tolist() for h in hs]))
    toxicity.train(docs, labels)
    toxicity.train(docs.repartition(5), labels)
    toxicity.train(docs, labels, sample=50)
    toxicity.train(docs, labels, sample_words=1000)
    assert len(seen[0]) == 60 and seen[0] == seen[1]  # labels without a text take no place
    assert len(seen[2]) == 50 and all(h in seen[0] for h in seen[2])
    assert 0 < sum(map(len, seen[3])) <= 1000 and all(h in seen[0] for h in seen[3])


def test_forward_pass_is_the_brute_force():
    rng = np.random.default_rng(1)
    pick = lambda *n: rng.standard_normal(n).astype(np.float32)
    net = toxicity.Network(pick(toxicity.ROWS, toxicity.DIM), [pick(w * toxicity.DIM, toxicity.FILTERS) for w in toxicity.WIDTHS], [pick(toxicity.FILTERS) for _ in toxicity.WIDTHS], pick(len(toxicity.WIDTHS) * toxicity.FILTERS), 0.3, (1.5, -0.2))
    hs = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (0, 1, 2, 3, 7, 40)]
    for h, got in zip(hs, net.scores(*toxicity._join(hs)), strict=True):
        x = [net.table[int(v) % toxicity.ROWS] + net.table[(int(v) >> 32) % toxicity.ROWS] for v in h]
        z = 0.3
        for j, (width, w, b) in enumerate(zip(toxicity.WIDTHS, net.filters, net.bias, strict=True)):
            for f in range(toxicity.FILTERS):
                top = max([float(np.concatenate(x[i : i + width]) @ w[:, f] + b[f]) for i in range(len(x) - width + 1)], default=0)
                z += max(0, top) * net.out[j * toxicity.FILTERS + f]
        assert got == pytest.approx(1 / (1 + np.exp(-(1.5 * z - 0.2))), abs=1e-4)


def test_gradients_lower_the_loss():
    rng = np.random.default_rng(0)
    hs = [rng.integers(0, 1 << 62, 20).astype(np.uint64) for _ in range(60)]
    y = np.arange(60) % 2
    shared = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    hs = [np.concatenate([h, rng.choice(shared[:200] if k else shared[200:], 10)]) for h, k in zip(hs, y, strict=True)]
    net = toxicity.fit(hs, y, ["en"] * 60)
    p = np.array([net.scores(*toxicity._join([h]))[0] for h in hs])
    assert np.mean((p >= 0.5) == y) > 0.9


def test_all_labelled_texts_are_fitted(spark, monkeypatch):
    rows = texts(1500, 1) + [(7, "second text of seven", "en", "clash", 1), (8, None, None, "clash", 0)]
    docs = spark.createDataFrame([r[:4] for r in rows], SCHEMA)
    labels = spark.createDataFrame([(r[0], 1, r[4]) for r in rows[:1500]] + [(None, 1, 1), (3, 1, None), (10_000, 1, 1)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE", 50)
    monkeypatch.setattr(toxicity, "BLOCK", 400)
    kept = toxicity._stored_texts(docs, labels, "doc_id", "text", "lang").collect()
    assert len(kept) == 1500 and len({r.block for r in kept}) >= 4  # one of two texts of an id, labels without a text none
    net = toxicity.train_whole(docs, labels)
    assert set(net.thresholds) == {"en", "de", ""} and net.scale != (1.0, 0.0)
    held = texts(600, 2)
    got = {r.id: r for r in toxicity.score(spark.createDataFrame([r[:4] for r in held], SCHEMA), net).collect()}
    assert np.mean([got[r[0]].predicted == r[4] for r in held]) > 0.97
    assert np.mean([got[r[0]].flagged == bool(r[4]) for r in held]) > 0.97
    again = toxicity.train_whole(docs.repartition(5), labels.repartition(3))
    assert np.array_equal(net.table, again.table) and net.scale == again.scale and net.thresholds == again.thresholds


def test_whole_fit_without_labels_or_with_one_class(spark):
    docs = spark.createDataFrame([(1, "a b", "en", ""), (2, "", "en", "")], SCHEMA)
    for labels in ([], [(1, 1, 0), (2, 1, 0)]):
        net = toxicity.train_whole(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert all(0 <= r.score <= 1 for r in toxicity.score(docs, net).collect())
