"""Operator 11 against brute force."""

import hashlib

import numpy as np
import pytest

from arborix.llm import suffixes

SCHEMA = "doc_id long, text string, score string, dk string, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], SCHEMA)


def brute(rows):
    """One result for each row: bytes, removed, spans, digest; ids that are null come last."""
    low = lambda i: float("inf") if i is None else i
    first, out = {}, []
    raw = [(low(i), (t or "").encode()) for i, t in rows]
    for i, t in raw:
        for p in range(len(t) - 49):
            s = t[p : p + 50]
            first[s] = min(first.get(s, i), i)
    for i, t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(x for x, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 300, n))
    passages = [word(n) for n in (8, 14, 15, 30, 90)] + ["é漢" * 30, "z" * 49, "q" * 50]
    texts = [None, "", " ", "x" * 49, "x" * 50, "x" * 51, "x" * 700, "ab" * 400, "漢字" * 60, "b" + "ab" * 60]
    for _ in range(60):
        parts = [word(int(rng.integers(0, 30)))]
        for _ in range(int(rng.integers(0, 3))):
            parts += [passages[int(rng.integers(len(passages)))], word(int(rng.integers(0, 12)))]
        texts.append("".join(parts))
    texts += [texts[20], texts[20], texts[30].upper(), texts[30][7:], texts[31][:-3] + "!", texts[32] + texts[33]]
    ids = rng.permutation(len(texts)).tolist()
    rows = list(zip(ids, texts, strict=True))
    return [*rows, (None, texts[21]), (None, texts[21]), (None, texts[22] + word(30)), (None, "only here " + word(40)), (None, "only here " + rows[3][1] * 2), rows[40], (ids[41], texts[42])]


@pytest.mark.parametrize("hot_rows", [2, 5, suffixes.HOT])
def test_repeated_bytes_are_the_brute_force(spark, hot_rows):
    rows = corpus()
    got = suffixes.remove_repeated(frame(spark, rows).repartition(7), hot_rows=hot_rows).collect()
    want = brute(rows)
    key = lambda i: -1 if i is None else i
    assert sorted((key(r.id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((key(i), *w) for (i, _), w in zip(rows, want, strict=True))
    assert sum(w[1] > 0 for w in want) > 30 and max(w[2] for w in want) > 1
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_no_rows(spark):
    assert suffixes.remove_repeated(frame(spark, [])).count() == 0
    assert [tuple(r)[1:4] for r in suffixes.remove_repeated(frame(spark, [(1, None)])).collect()] == [(0, 0, 0)]


@pytest.mark.parametrize("letters", [1, 2, 4, 26])
def test_anchors_are_leftmost_least_grams(letters):
    rng = np.random.default_rng(letters)
    texts = [bytes(rng.integers(97, 97 + letters, n).astype(np.uint8)) for n in (0, 10, 49, 50, 51, 400, 3000, 20, 49, 70)] + [b"x" * 300, b"ab" * 200, b"", b"abc"]
    begin, *runs = suffixes.anchors(texts)
    h = suffixes.grams(np.frombuffer(b"".join(texts), np.uint8))
    want = []
    for k, t in enumerate(texts):
        for p in range(begin[k], begin[k] + len(t) - 49):
            j = p + int(np.argmin(h[p : p + 50 - suffixes.GRAM + 1]))
            want.append((k, p, j, int(h[j])))
    assert sorted((k, p, a, int(g)) for k, f, e, a, g in zip(*(r.tolist() for r in runs), strict=True) for p in range(f, e + 1)) == want


def test_multikey_order_sorts_rows():
    rng = np.random.default_rng(1)
    digits = rng.integers(0, 3, (500, 5)).astype(np.uint64)
    order, new = suffixes.multikey_order(digits)
    rows = [tuple(digits[i]) for i in order]
    assert rows == sorted(map(tuple, digits)) and new.tolist() == [True, *(a != b for a, b in zip(rows, rows[1:], strict=False))]
