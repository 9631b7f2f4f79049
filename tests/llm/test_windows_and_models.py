"""Operators 6 and 9 against brute force."""

import hashlib
import json
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from arborix.llm import language_model as lm
from arborix.llm import substring

SCHEMA = "doc_id long, text string, score string, kept string"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)


def brute_repeats(texts):
    words = [(t or "").encode().split() for t in texts]
    n = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - 34) if n[tuple(w[i : i + 35])] > 1 for k in range(35)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 500, n)]
    passages = [word(n) for n in (34, 35, 36, 60, 200)]
    texts = [None, "", " \n", "one two", " ".join(["same"] * 36), " ".join(["a", "b"] * 40), "x" * 9000, " ".join(["é", "ß"] * 17 + ["z"])]
    for k in range(60):
        t = word(int(rng.integers(1, 120)))
        for _ in range(int(rng.integers(0, 3))):
            t += passages[int(rng.integers(5))] + word(int(rng.integers(0, 40)))
        texts.append((" ", "\n", "\t ")[k % 3].join(t))
    texts += [texts[20], texts[20], texts[30].upper()]
    return texts


def test_repeated_windows_are_the_brute_force(spark, monkeypatch):
    monkeypatch.setattr("arborix.llm.sorted_runs.TOKENS", 700)
    texts = corpus()
    got = {r.id: r for r in substring.remove_repeats(frame(spark, texts)).collect()}
    want = brute_repeats(texts)
    assert [(got[i].n_words, got[i].n_removed, got[i].kept_sha256) for i in range(len(texts))] == want
    assert sum(w[1] > 0 for w in want) > 30
    assert hashlib.sha256(got[9].kept.encode()).hexdigest() == got[9].kept_sha256


def test_repeats_edges(spark):
    assert substring.remove_repeats(frame(spark, [])).count() == 0
    long = " ".join(f"k{i}" for i in range(40))
    got = substring.remove_repeats(spark.createDataFrame([(None, long, "", ""), (None, long, "", ""), (1, None, "", "")], SCHEMA)).collect()
    assert sorted((r.n_words, r.n_removed) for r in got) == [(0, 0), (40, 40), (40, 40)]


@pytest.mark.parametrize("postings", [False, True])
def test_increments_find_what_all_at_once_finds(spark, postings):
    texts = corpus(1)
    half = len(texts) // 2
    old, new = frame(spark, texts[:half]), frame(spark, texts[half:], range(half, len(texts)))
    index = substring.FingerprintIndex(spark, postings=postings)
    index.append(old)
    got = {r.id: r.n_removed for r in substring.remove_repeats(new, index=index, history=old).collect()}
    assert got == {i: w[1] for i, w in enumerate(brute_repeats(texts)) if i >= half}
    assert index.version == 2
    if postings:  # documents of the history that share no window, nor a part of one, are not read
        sharing = {r.id for r in index.holders().collect()}
        assert sharing and sharing < set(range(half))
        assert {i for i in range(half) if len((texts[i] or "").split()) < 35}.isdisjoint(sharing)


def test_increments_write_their_own_runs_only(spark):
    import os

    index = substring.FingerprintIndex(spark, shards=4)
    folder = index.uri.removeprefix("file://")
    seen = {}
    for k in range(9):
        long = [" ".join(f"{k}w{x}" for x in np.random.default_rng((k, j)).integers(0, 999, 80)) for j in range(20)]
        assert index.append(frame(spark, long), batches=1) == 0
        now = {f: os.stat(f"{folder}/{f}").st_mtime_ns for f in os.listdir(folder)}
        assert all(now[f] == at for f, at in seen.items() if f in now)  # nothing is written again
        named = {n for v in range(max(1, k), k + 2) for n, _ in json.loads(open(f"{folder}/manifest-{v}.json").read())["runs"]}
        assert {f.rsplit("-", 1)[0] for f in now if f.startswith("run")} == named  # what was merged away two versions ago is gone
        grown = {f for f in now.keys() - seen.keys() if f.startswith("run")}
        assert len(grown) == 4  # one run, or the one that it completes
        seen = now
    assert sorted(level for _, level in index.runs) == [0, 1, 1]
    again = substring.FingerprintIndex(spark, index.uri)
    assert (again.version, again.shards, again.runs) == (9, 4, [tuple(r) for r in index.runs])
    with pytest.raises(ValueError):
        substring.FingerprintIndex(spark, index.uri, shards=6)
    assert again.append(frame(spark, [long[3]]), batches=1) > 0


def test_shards_of_minima_are_even(spark):
    index = substring.FingerprintIndex(spark, shards=16)
    texts = [" ".join(f"w{x}" for x in np.random.default_rng(j).integers(0, 99999, 400)) for j in range(60)]
    index.append(frame(spark, texts), batches=1)
    from arborix.llm.storage import map_array

    sizes = [len(map_array(f"{index.uri}/{index.runs[0][0]}-{s}.keys", "<u8")) for s in range(16)]
    assert sum(sizes) > 1500 and max(sizes) < 2 * sum(sizes) / 16


def test_portions_do_not_visit_empty_shards(tmp_path):
    """What a portion costs follows its keys, not the number of shards; each key lies in the range of its shard."""
    import time

    from arborix.llm import sorted_runs

    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, dtype=np.uint64))
    for shards in (1, 3, 10, 10**4, 10**6, 10**9):
        of = sorted_runs.shard_of(keys, shards)
        assert of.tolist() == [int(k) * shards >> 64 for k in keys]
        rows = sorted_runs.packed(keys, np.ones(len(keys), np.int64), shards)
        assert b"".join(r[2] for r in rows) == keys.tobytes() and [r[0] for r in rows] == sorted(set(of.tolist()))
        began = time.process_time()
        found = sorted_runs.Sorted(str(tmp_path), "none", shards, keys="<u8").has(keys[:200])
        assert not found.any() and time.process_time() - began < 1


def test_totals_beyond_32_bits():
    first, second = np.array([0, 0, 1]), np.array([1, 2, 2])
    counts = np.array([(1 << 33) + 1, 3, 1])
    ids, stats = lm.stats_of(first, second, counts)
    row = (ids.astype("<u4").tobytes(), b"".join(v.astype(k).tobytes() for v, k in zip(stats, lm.STATS.values(), strict=True)))
    sums = lm.summed_stats([row, row], 0, 3)
    assert sums["total"].tolist() == [2 * ((1 << 33) + 4), 2, 0]
    assert [sums[k].tolist() for k in ("n1", "n3", "before")] == [[0, 2, 0], [4, 0, 0], [0, 2, 4]]


def brute_model(train, texts):
    tok = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    pairs = Counter(p for t in train for p in zip([None, *tok(t)], tok(t)))
    uni = Counter(w for t in train for w in tok(t))
    before = Counter(b for _, b in pairs)
    count_of = lambda c: tuple(sum(v == k for v in c.values()) for k in (1, 2, 3, 4))
    high, low = lm.Discounts.of(count_of(pairs)), lm.Discounts.of(count_of(before))
    d = lambda x, c: (0, x.one, x.two, x.more)[min(c, 3)]
    spread = sum(d(low, c) for c in before.values()) / len(pairs)
    after = {}
    for (a, _), c in pairs.items():
        after.setdefault(a, []).append(c)

    def p_low(w):
        return (before[w] - d(low, before[w])) / len(pairs) + spread / (len(uni) + 1)

    def p(a, w):
        if a not in after:
            return p_low(w)
        c, total = pairs[a, w], sum(after[a])
        return (c - d(high, c)) / total + sum(d(high, x) for x in after[a]) / total * p_low(w)

    n, v = sum(uni.values()), len(uni)
    assert abs(sum(p(None, w) for w in uni) + p(None, b"never") - 1) < 1e-9
    return [(len(tok(t)), sum(uni[w] > 0 for w in tok(t)), sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in tok(t)), sum(math.log10(p(a, w)) for a, w in zip([None, *tok(t)], tok(t)))) for t in texts], n


def test_language_model_is_the_brute_force(spark, monkeypatch):
    monkeypatch.setattr("arborix.llm.sorted_runs.TOKENS", 900)
    texts = corpus(2) + ["a b " * 300]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    docs = frame(spark, texts)
    model = lm.train(docs.filter(lm.fold(docs["doc_id"], 7) != 2))
    got = {r.id: r for r in lm.score(docs, model).collect()}
    want, n = brute_model([t for t, h in zip(texts, held, strict=True) if not h], texts)
    assert model.tokens == n
    for i, w in enumerate(want):
        assert (got[i].n_tokens, got[i].n_known) == w[:2]
        assert got[i].base_score == pytest.approx(w[2], rel=1e-9)
        assert got[i].score == pytest.approx(w[3], rel=1e-9)


def test_language_model_edges(spark):
    none = lm.train(frame(spark, []))
    got = lm.score(frame(spark, [None, "", "a b"]), none).collect()
    assert [(r.n_tokens, r.n_known, r.base_score, r.score) for r in got] == [(1, 0, 0.0, 0.0), (1, 0, 0.0, 0.0), (3, 0, 0.0, 0.0)]
    assert lm.score(frame(spark, []), none).count() == 0
    assert lm.score(frame(spark, ["x"]), lm.train(frame(spark, [None, None]))).first().score < 0
