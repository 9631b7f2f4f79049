"""Operators 12 and 13 against brute force."""

import hashlib
import math
import re
import zlib
from itertools import permutations

import numpy as np
import pandas as pd
import pytest

from arborix.llm import audit, importance

SCHEMA = "doc_id long, text string, source string, score string, rank string, mask string, n string, good string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, *["clash"] * 5) for i, t, s in rows], SCHEMA)


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def corpus(seed=3):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("Ba", "ne", "ÉI", "漢", "x9") for b in ("ta", "ro", "Ü", "", "z" * 70, "q" * 63, "p" * 62)]
    texts = [None, "", " ?! ", "one", "one two", "A-b_c", "w " * 25, "9" * 500]
    texts += [" ".join(rng.choice(words, int(rng.integers(1, 80)))).replace(" ", (" ", "\n", "--", "\x00")[k % 4]) for k in range(80)]
    texts += [texts[20]] * 3 + [texts[30]] * 2
    return [(int(i) if k % 17 else None, t, ("hot" if k % 3 else None) if k % 5 else "s1") for k, (i, t) in enumerate(zip(rng.permutation(len(texts)), texts, strict=True))]


def test_features_are_crcs_of_runs():
    texts = [t for _, t, _ in corpus()]
    words = [importance.words_of(t) for t in texts]
    buckets, of = importance.Features().of(words)
    for k, t in enumerate(texts):
        w, f = features(t)
        assert [x.decode() for x in words[k]] == w
        assert sorted(buckets[of == k].tolist()) == sorted(zlib.crc32(x.encode()) % 10000 for x in f)


def test_resampling_is_the_brute_force(spark):
    rows, target = corpus(), ["Bata nero one two three", "baro 漢ta x9ro Bata", None]
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, item_id long")
    got = [tuple(r) for r in importance.resample(frame(spark, rows), bench, percent=30).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    s, t = np.zeros(10000), np.zeros(10000)
    for counts, texts in ((s, [x for _, x, _ in rows]), (t, target)):
        for x in texts:
            for f in features(x)[1]:
                counts[zlib.crc32(f.encode()) % 10000] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10000) / ((a + 1) * (t.sum() + 10000)))) for a, b in zip(s, t, strict=True)]
    want, fit = [], []
    for i, x, _ in rows:
        w, f = features(x)
        weight = sum(gain[zlib.crc32(g.encode()) % 10000] for g in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(w) >= 20:
            fit.append(want[-1])
    fit.sort(key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1]))
    for k in range(30 * len(fit) // 100):
        fit[k][4] = k + 1
    assert sorted(got, key=repr) == sorted(map(tuple, want), key=repr)
    assert sum(r[4] is not None for r in got) > 10


def test_ranks_of_ties(spark):
    """Many equal scores: all ranks once, smaller ids first."""
    rows = spark.createDataFrame([(i, 25, 1, 0, 7 if i % 2 else 9) for i in range(400)], importance.SCORED)
    got = {r.doc_id: r["rank"] for r in importance.ranked(rows.repartition(6), 250).collect()}
    order = sorted(got, key=lambda i: (i % 2, i))
    assert [got[i] for i in order] == [*range(1, 251), *[None] * 150]


def test_resampling_without_rows(spark):
    none = frame(spark, [])
    assert importance.resample(none, none).count() == 0
    alone = importance.resample(frame(spark, [(1, None, None), (2, "a b", "s")]), none).collect()
    assert sorted((r.doc_id, r.n_features, r["rank"]) for r in alone) == [(1, 0, None), (2, 3, None)]


def brute_audit(rows, labels):
    low = lambda i: math.inf if i is None else i
    first = {}
    for i, t, _ in rows:
        first[t or ""] = min(first.get(t or "", math.inf), low(i))
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), low(i) > first[t]), strict=True) if bad}
        mine = [x for x in labels if x[0] == i and i is not None]
        docs.append((s or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), k] = [len(left), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone), f]
        for (p, _, _), row in out.items():
            if p == part:
                row[6] = shapley[row[6]]
    return out


def audited_corpus():
    rng = np.random.default_rng(5)
    word = lambda n: " ".join(f"{'W' if rng.random() < 0.1 else 'w'}{x}" for x in rng.integers(0, 60, n))
    texts = [None, "", " ", *[word(int(rng.integers(10, 120))) + ("", " #", " 5%")[k % 3] for k in range(60)], "UPPER CASE " * 40]
    texts += [texts[10]] * 6 + [texts[11]] * 4 + [None, ""]
    rows = [(int(i), t, ("hot", "s1", None, "")[k % 4] if k % 3 else "hot") for k, (i, t) in enumerate(zip(rng.permutation(len(texts)), texts, strict=True))]
    return [*rows, (None, texts[10], "hot"), (None, "nowhere else", "s1"), (None, "nowhere else", "s2"), (rows[20][0], rows[20][1], "other"), (rows[20][0], rows[20][1], rows[20][2])]


@pytest.mark.parametrize("parts", [1, 9])
def test_audit_is_the_brute_force(spark, parts):
    rows = audited_corpus()
    labels = [(i, k % 2, int(k % 7 == 0)) for k, (i, _, _) in enumerate(rows[:70]) if i is not None] + [(rows[0][0], None, 1), (None, 1, 1)]
    given = spark.createDataFrame(pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype("Int64").astype(object).where(lambda d: d.notna(), None), "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in audit.audit(frame(spark, rows).repartition(parts), given).collect()}
    want = brute_audit(rows, labels)
    assert got == want and len(got) == 600 * len({s or "" for _, _, s in rows})
    assert any(v[4] for v in got.values()) and any(v[5] for v in got.values())


def test_copies_of_colliding_fingerprints():
    """Texts with one fingerprint stay apart, by the full text."""
    met = [(7, (b"a", 3, "p", 0, 1)), (7, (b"b", 2, "p", 0, 1)), (7, (b"a", 1, "p", 0, 2)), (7, (None, 9, "p", 16, 1))]
    assert sorted(audit._chained(iter(met))) == [(1, "p", 0, 2), (2, "p", 0, 1), (3, "p", 16, 1), (9, "p", 16, 1)]


def test_audit_of_no_rows(spark):
    none = frame(spark, [])
    assert audit.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
