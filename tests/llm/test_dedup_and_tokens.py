"""Operators 1, 3, 4, 5, 8 and the mixing of sources against brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborix.llm import bpe, lines, mixing, quality, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, component string"
PROSE = " ".join(f"w{i} the of" for i in range(60))
TEXTS = [
    None, "", "   \n\t ", "one", "One", "two words", "a b c", "A B C", "a b c d e f g", PROSE, PROSE, PROSE + " x",
    "x" * 5000, "ab " * 3000, "line one here\nline two here\nline three\nline four\nlast",
    "intro\nline one here\nline two here\nline three\nline four\nend", "\n\n\n", "é ß İ \x1c z", "<|endoftext|> a <|endoftext|>", "!!" * 900,
]


def rows(texts=TEXTS, ids=None):
    ids = ids if ids is not None else [10 * i + 3 for i in range(len(texts))]
    return [(i, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, len(t or ""), "clash", "clash") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(ids=[None, None, *[10 * i for i in range(2, len(TEXTS))]]), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_fingerprint(text, k=3):
    w = [x for x in (text or "").encode().lower().split()]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, links):
    part = {i: i for i in ids}
    while True:
        new = dict(part)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == part:
            return part
        part = new


def test_simhash_is_the_brute_force(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(40)]
    texts = list(TEXTS)
    for g in range(12):
        base = list(rng.choice(words, 200))
        for _ in range(12):
            t = list(base)
            t[rng.integers(200)] = "new"
            texts.append(" ".join(t))
    got = {r.id: r for r in simhash.near_duplicates(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    fp = {i: brute_fingerprint(t) for i, t, *_ in rows(texts)}
    assert {i: r.fp[0] % (1 << 64) for i, r in got.items()} == fp
    links = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2]
    assert {i: r.component for i, r in got.items()} == brute_components(fp, links)
    assert len(links) > 50


def test_simhash_large_group_of_near_copies(spark, monkeypatch):
    """More distinct fingerprints below one segment value than a block holds."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = np.random.default_rng(2)
    base = int(rng.integers(1 << 62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (150, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 50)})
    nodes = spark.createDataFrame([(f, [f]) for f in fps], "node long, fp array<long>")
    edges = {(r.a, r.b) for r in simhash._links(nodes, 1, 2).collect()}
    links = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2]
    assert edges <= {*links, *((b, a) for a, b in links)}
    assert brute_components(fps, edges) == brute_components(fps, links)


def test_simhash_edges(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    assert {r.component for r in got if r.fp == [0]} == {20}  # null, empty and blank texts are one class
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs.unionByName(docs), shingle=5, n_words=2, distance=19)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert len(texts) == len(set(texts)) and sum(t == PROSE for t in texts) == 1
    assert sum(not (t or "").split() for t in texts) == 1


def test_near_dedup_of_the_pipeline_finds_pairs_at_0_8(spark):
    """Recall by brute force over the exact Jaccard of five-word shingles; no link below 0.8."""
    import corpus_pipeline

    rng = np.random.default_rng(6)
    texts = []
    for g in range(60):
        base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        texts.append(" ".join(base))
        for changes in (1, 3, 5, 6, 7, 12):
            t = list(base)
            for at in rng.integers(0, 300, changes):
                t[at] = f"x{rng.integers(1 << 30)}"
            texts.append(" ".join(t))
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    near = [(a, b) for a in range(len(texts)) for b in range(a) if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    df = spark.createDataFrame(rows(texts, range(len(texts))), SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, df, "").collect()}
    want = brute_components(range(len(texts)), near)
    assert {i for i in want if want[i] == i} <= kept  # nothing goes without a pair of 0.8
    assert sum(a in kept and b in kept for a, b in near) <= 0.03 * len(near)
    assert sum(0.8 <= len(grams[a] & grams[b]) / len(grams[a] | grams[b]) < 0.85 for a, b in near) > 50


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.data())
def test_forest_connects_the_same(n, m, data):
    linked = np.array(data.draw(st.lists(st.booleans(), min_size=n * m, max_size=n * m))).reshape(n, m)
    a, b = simhash.forest(linked)
    assert all(linked[x, y] for x, y in zip(a, b, strict=True))
    full = [(int(x), 100 + int(y)) for x, y in zip(*np.nonzero(linked), strict=True)]
    ends = [*range(n), *range(100, 100 + m)]
    assert brute_components(ends, full) == brute_components(ends, [(int(x), 100 + int(y)) for x, y in zip(a, b, strict=True)])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 1 << 30))
def test_joined_blocks_connect_as_all_links(n, m, seed):
    rng = np.random.default_rng(seed)
    f = rng.integers(0, 64, (n + m, 1)).astype(np.uint64)
    f1, f2 = f[:n], f[n:]
    inside = [simhash.parts_of(simhash.bits_apart(x, x) <= 1) for x in (f1, f2)]
    off = simhash.bits_apart(f1, f2)
    own = [(i, j) for i in range(n) for j in range(i) if inside[0][i] == inside[0][j]] + [(n + i, n + j) for i in range(m) for j in range(i) if inside[1][i] == inside[1][j]]
    for tier, (x, y) in zip((1, 2), simhash.joined(off, *inside, [1, 2]), strict=True):
        assert all(off[a, b] <= tier for a, b in zip(x, y, strict=True))
        every = own + [(a, n + b) for a in range(n) for b in range(m) if off[a, b] <= tier]
        few = own + [(int(a), n + int(b)) for a, b in zip(x, y, strict=True)]
        assert brute_components(range(n + m), every) == brute_components(range(n + m), few)


def test_shards(docs, empty, spark, tmp_path):
    many = spark.createDataFrame(rows([PROSE[: 10 + i % 400] for i in range(3000)]), SCHEMA)
    placed, path = sharding.shard(many, 24)
    versions = [sharding.SlotMap.load(spark, path, v) for v in (1, 2)]
    got = placed.collect()
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert max(load.values()) < 1.01 * min(load.values())
    for k in range(24):
        own = sorted(r.slot for r in got if r.shard == k)
        assert own == list(range(len(own)))
    moved = [s for s in range(sharding.SLOTS) if versions[0].of[s] != versions[1].of[s]]
    assert set(moved) <= {e[0] for e in versions[1].edits}
    sizes = Counter()
    for r in got:
        sizes[r.virtual_slot] += r.size
    more = versions[1].grown(dict(sizes))
    assert all(b in (a, 24) for a, b in zip(versions[1].of, more.of, strict=True)) and 24 in more.of
    empty_shard = sharding.SlotMap(25, list(more.of), 4, [(1, 2, 3)])
    for m in (*versions, more, more, empty_shard):
        m.save(spark, f"{tmp_path}/map")
    for m in (*versions, more, empty_shard):
        assert sharding.SlotMap.load(spark, f"{tmp_path}/map", m.version) == m
    assert sharding.SlotMap.load(spark, f"{tmp_path}/map") == empty_shard
    none = sharding.SlotMap.initial(24).grown({})
    none.save(spark, f"{tmp_path}/none")
    assert sharding.SlotMap.load(spark, f"{tmp_path}/none").shards == 25
    with pytest.raises(ValueError):
        sharding.SlotMap.load(spark, f"{tmp_path}/map", 9)
    again, _ = sharding.shard(many, path=path)  # goes on from version 2, which is even: nothing moves
    assert sharding.SlotMap.load(spark, path).version == 3 and {(r.id, r.shard) for r in again.collect()} == {(r.id, r.shard) for r in got}
    lost = spark.createDataFrame([(None, "same", "en", "s", n, "", "") for n in range(3000)], SCHEMA)
    assert sharding.with_slots(lost).select("virtual_slot").distinct().count() > 1000
    sharding.write_shards(docs, more, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(TEXTS)
    got = {r.id: r for r in sharding.shard(docs)[0].collect()}
    for i, t, *_ in rows(ids=[None, None, *[10 * i for i in range(2, len(TEXTS))]]):
        if i is not None:
            assert (got[i].size, got[i].text_crc32) == (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert sharding.shard(empty)[0].count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def test_bpe_is_the_library(docs, empty, library):
    got = {(r.id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, bpe.default_vocabulary()).collect()}
    want = set()
    for i, t, *_ in rows(ids=[None, None, *[10 * i for i in range(2, len(TEXTS))]]):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    assert bpe.round_trip(empty, bpe.default_vocabulary()).count() == 0
    back = bpe.decode(bpe.encode(docs, bpe.default_vocabulary()).withColumnRenamed("text", "was"), bpe.default_vocabulary()).collect()
    assert all(r.text == (r.was or "") for r in back)
    both = bpe.encode(docs.withColumnRenamed("text", "was"), bpe.default_vocabulary(), text_col="was", decoded_col="text").collect()
    assert all(r.text == (r.was or "") for r in both) and len(both) == len(back)


@pytest.mark.parametrize("space", ["\n\n", "\n\t", "   \n", " \n \n", "\t", "  "])
@pytest.mark.parametrize("run", ["x" * 3000, "漢" * 1500, "=" * 3000, "7" * 2500])
def test_bpe_of_space_before_long_runs(library, space, run):
    coder = bpe.load(bpe.default_vocabulary())
    for text in ("foo." + space + run, "foo." + space + run + space + "bar" + space + run + space):
        assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_leaves_are_encoded_by_several_threads(library):
    import threading

    coder, seen = bpe.ByteBPE(bpe.default_vocabulary(), 3), set()
    leaf, gate = coder.leaf, threading.Barrier(3, timeout=60)

    def watched(x):
        if threading.get_ident() not in seen:
            seen.add(threading.get_ident())
            gate.wait()  # goes on when three threads are at work
        return leaf(x)

    coder.leaf = watched
    text = "intro " + "".join(np.random.default_rng(8).choice(list("abcdefgh"), 40000)) + " end"
    assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert len(seen) == 3


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=300), st.text("ab", min_size=1, max_size=60).map(lambda x: x * 50), st.text(" \n\t x", max_size=900), st.text("'sre <|endoftext|>", max_size=400), st.text("aé漢🙂", min_size=1, max_size=9).map(lambda x: x * 90)))
def test_bpe_of_any_text(text):
    from tokenizers import Tokenizer

    global _library
    if "_library" not in globals():
        _library = Tokenizer.from_file(bpe.default_vocabulary())
    old, bpe.LONG = bpe.LONG, 64
    try:
        coder = bpe.load(bpe.default_vocabulary(), 2)
        ids = coder.encode(text)
    finally:
        bpe.LONG = old
    assert ids == _library.encode(text, add_special_tokens=False).ids
    assert coder.decode(ids) == _library.decode(ids, skip_special_tokens=False)


def brute_measures(text):
    w = [x.decode() for x in (text or "").encode().split()]
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(wins)
    covered = {i + k for i, x in enumerate(wins) if n[x] > 1 for k in range(3)}
    worded = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(worded) - len(set(worded)), len(covered))


def test_quality_measures_are_the_brute_force(spark, empty):
    rng = np.random.default_rng(3)
    texts = [*TEXTS, *("".join(rng.choice(list("ab \n#|"), 60)) for _ in range(300))]
    for r in quality.quality(spark.createDataFrame(rows(texts), SCHEMA)).collect():
        t = texts[(r.id - 3) // 10]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.quality(empty).count() == 0


def test_quality_rejects_junk_and_keeps_prose(spark):
    rng = np.random.default_rng(4)
    vocab = [f"{a}{b}{c}" for a in "prst" for b in ("an", "el", "io", "ur") for c in ("da", "mis", "ton", "e", "ri")]
    prose = [" ".join(rng.choice([*vocab, "the", "of", "and"], 150)) for _ in range(300)]
    junk = ["### ".join(rng.choice(vocab, 150)) for _ in range(20)] + ["!! ".join(rng.choice(vocab, 150)).upper() for _ in range(20)]
    got = {r.text: r for r in quality.keep_good(spark.createDataFrame(rows(prose + junk), SCHEMA)).collect()}
    assert set(got) == set(prose)
    assert set(got[prose[0]].asDict()) == {x.split()[0] for x in SCHEMA.split(", ")}


def test_quality_posteriors_are_the_brute_force_em(spark):
    """EM over the documents themselves, in probabilities and not in logarithms."""
    rng = np.random.default_rng(11)
    kinds = [["the", "of", "and"], [f"word{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(26)], ["LONGERWORD", "NO"], ["#", "*"], ["1234", "77"]]
    word = lambda p: str(rng.choice(kinds[rng.choice(5, p=p)]))
    texts = [" ".join(word(p) for _ in range(int(rng.integers(5, 300)))) for p in rng.dirichlet([4, 20, 0.6, 0.2, 0.2], 250)] + [None, ""]
    got = quality.quality(spark.createDataFrame(rows(texts), SCHEMA)).collect()
    votes = np.array([[r[f"vote_{k}"] for k in quality.RULES] for r in got])
    assert set(votes.reshape(-1).tolist()) == {-1, 0, 1}
    good, bad_of_good, good_of_bad = 0.85, np.full(9, 0.02), np.full(9, 0.6)

    def posterior():
        a = good * np.where(votes < 0, bad_of_good, np.where(votes > 0, 1 - bad_of_good, 1)).prod(1)
        b = (1 - good) * np.where(votes < 0, 1 - good_of_bad, np.where(votes > 0, good_of_bad, 1)).prod(1)
        return a / (a + b)

    for _ in range(60):
        p = posterior()[:, None]
        good = (p.sum() + 20 * 0.85) / (len(votes) + 20)
        bad_of_good = np.clip(((p * (votes < 0)).sum(0) + 20 * 0.02) / ((p * (votes != 0)).sum(0) + 20), 1e-4, 0.5)
        good_of_bad = np.clip((((1 - p) * (votes > 0)).sum(0) + 20 * 0.6) / (((1 - p) * (votes != 0)).sum(0) + 20), 1e-3, 0.98)
    for r, p in zip(got, posterior(), strict=True):
        assert r.p_good == pytest.approx(p, abs=1e-9)
        assert r.kept == (not r.base_failed and r.p_good >= 0.5)
    assert 20 < sum(r.kept for r in got) < 240


DOTTED = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `_row` string"


def test_columns_of_any_name_are_kept(spark):
    """Names with dots and names that the operators use themselves; repeated rows, null ids, an empty table."""
    data = [(None if k % 7 == 0 else k // 2, PROSE if k % 3 else f"{PROSE} {k}", "en", "s", k, f"x{k}", "clash") for k in range(20)]
    data += [data[3], data[3]]
    df = spark.createDataFrame(data, DOTTED)
    keep = {
        "quality": quality.keep_good(df), "lines": lines.dedup_lines(df), "simhash": simhash.keep_one(df, shingle=5, n_words=8, distance=96, jaccard=0.8),
        "mixing": mixing.sample(df, share=1.0), "bpe": bpe.encode(df.withColumn("ids", F.lit("old")), bpe.default_vocabulary()),
    }
    for name, out in keep.items():
        assert out.columns[:7] == df.columns, name
        found = out.collect()
        assert {r["a.b"] for r in found} <= {d[5] for d in data} and {r["_row"] for r in found} == {"clash"}, name
        assert len(found) == (len(data) if name != "simhash" else len({r["text"] for r in found})), name
    assert dict(keep["bpe"].dtypes)["ids"] == "array<int>"
    none = df.limit(0)
    assert [f(none).count() for f in (quality.keep_good, lines.dedup_lines, simhash.keep_one, mixing.sample)] == [0, 0, 0, 0]


def brute_line_dedup(items, sixteenths=lines.SIXTEENTHS):
    """The definition, text by text: units, their first places, the agreeing lines around them."""
    blank = " \t\n\x0b\f\r"
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    order = sorted({(i is None, i or 0, md5(t or ""), t or "") for i, t in items})
    first, found, words = {}, [], []
    for k, (*_, t) in enumerate(order):
        w = [x for x in t.split("\n") if x.strip(blank)]
        words.append(w)
        h = [md5(x) for x in w]
        end = [i for i in range(len(w)) if i == len(w) - 1 or int(md5((h[i - 1] if i else "") + h[i])[0], 16) < sixteenths]
        start = [0, *(e + 1 for e in end)]
        for c, e in enumerate(end):
            d = c if e > start[c] else c + 1
            if d < len(end):
                body = tuple(w[start[c] : end[d] + 1])
                size = [e - s + 1 for s, e in zip(start, end)]
                p = c - 1 - (c > 1 and size[c - 1] == 1)
                q = d + 1 + (d + 2 < len(end) and size[d + 1] == 1)
                at = (k, start[c], end[d], w[start[p] : start[c]] if c else [], w[end[d] + 1 : end[q] + 1] if q < len(end) else [])
                if len(body) > 1:
                    found.append((body, at))
                    first.setdefault(body, at)
    gone = [set() for _ in order]
    same = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for body, (k, a, b, before, after) in found:
        k0, a0, _, before0, after0 = first[body]
        if (k, a) != (k0, a0):
            gone[k] |= set(range(a - same(before[::-1], before0[::-1]), b + same(after, after0) + 1))
    out = {}
    for (no, i, _, t), g in zip(order, gone, strict=True):
        keep, n, drop = [], -1, False
        for x in t.split("\n"):
            if x.strip(blank):
                n += 1
                drop = n in g
            if not drop:
                keep.append(x)
        out[None if no else i, t] = "\n".join(keep)
    return [(i, t if t is None else out[i, t]) for i, t in items]


def test_line_dedup_is_the_brute_force(spark, empty):
    rng = np.random.default_rng(5)
    passage = [f"shared line {k} of a passage" for k in range(12)]
    texts = [*TEXTS, *TEXTS[-6:]]
    for k in range(40):
        own = [f"own {k} {j} {rng.integers(5)}" for j in range(int(rng.integers(1, 9)))]
        at = int(rng.integers(0, len(own) + 1))
        texts.append("\n".join(own[:at] + passage * int(rng.integers(0, 3)) + own[at:]))
    ids = [None, None, *range(5, len(texts) + 3)]
    got = lines.dedup_lines(spark.createDataFrame(rows(texts, ids), SCHEMA)).select("doc_id", "text").collect()
    want = brute_line_dedup(list(zip(ids, texts, strict=True)))
    assert Counter(map(tuple, got)) == Counter(want)
    assert sum(t.count(x) for x in passage for _, t in want if t) <= 1.1 * len(passage)
    assert lines.dedup_lines(empty).count() == 0
    frequent = spark.createDataFrame(rows([f"own {k}\n\nfirst line\n\nsecond line\n \nthird\nfourth\n\n\nend {k}" for k in range(600)]), SCHEMA)
    texts = [r.text for r in lines.dedup_lines(frequent).collect()]
    assert sum("second line" in t for t in texts) == 1 and sum("first" in t or "third" in t or "fourth" in t for t in texts) == 1
    assert "own 7\n\nend 7" in texts
    twice = spark.createDataFrame(rows(["a b\nc d\ne f\ng h"] * 2, [1, 1]), SCHEMA)
    assert len({r.text for r in lines.dedup_lines(twice).collect()}) == 1


@pytest.mark.parametrize("length, share, sixteenths", [(2, 0.75, 15), (3, 0.95, 15), (4, 0.99, 15), (8, 0.99, 15), (2, 1.0, 16)])
def test_line_dedup_finds_passages_in_other_surroundings(spark, length, share, sixteenths):
    text = lambda g, j: "\n".join([f"a {g} {j} {k}" for k in range(3)] + [f"passage {g} {k}" for k in range(length)] + [f"b {g} {j} {k}" for k in range(3)])
    got = lines.dedup_lines(spark.createDataFrame(rows([text(g, j) for j in range(2) for g in range(200)]), SCHEMA), keep_columns=False, sixteenths=sixteenths).collect()
    assert sum(r.n_removed for r in got) >= share * 200 * length
    assert all(r.text.count("\na ") + r.text.startswith("a ") == 3 and r.text.count("\nb ") == 3 for r in got)


def test_raking_meets_its_targets(spark):
    cells = [(f"s{a}", f"l{b}", f"t{c}", (a + 1) * (b + 2) * (3 * c + 1) + a * c) for a in range(3) for b in range(2) for c in range(2)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    targets = {"source": {"s0": 2.0, "s1": 1.0, "s2": 1.0}, "lang": 0.5, "topic": 0.0}
    got = mixing.rake(df, targets).collect()
    total = sum(r.tokens for r in got)
    share = lambda d, v: sum(r.tokens * r.weight for r in got if r[d] == v) / total
    assert share("source", "s0") == pytest.approx(0.5, abs=1e-6)
    assert share("topic", "t0") == pytest.approx(0.5, abs=1e-6)
    by_spark = {tuple(r[:3]): r.weight for r in mixing.rake(df, targets, rounds=3, driver_cells=0).select("source", "lang", "topic", "weight").collect()}
    for r in mixing.rake(df, targets, rounds=3).collect():
        assert by_spark[tuple(r[:3])] == pytest.approx(r.weight)
    p = mixing.probabilities(mixing.rake(df, targets), 0.4).collect()
    assert sum(r.tokens * r.p for r in p) == pytest.approx(0.4 * total, rel=1e-6)


def test_mixing_keeps_null_topics(spark):
    """A topic that is null is a value of its own: no row is lost, and its cells are raked like others."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, "a b c", None if i % 3 else "s", None) for i in range(40)], "doc_id long, text string, source string, lang string")
    rows, cells = mixing.mix(df, topic=F.when(F.col("doc_id") % 2 == 0, F.lit("even")))
    got = rows.collect()
    assert sorted(r._row.doc_id for r in got) == list(range(40)) and {r.topic for r in got} == {"even", ""}
    assert sorted((r.source, r.topic) for r in cells.collect()) == [("", ""), ("", "even"), ("s", ""), ("s", "even")]


def test_mixing_edges(docs, empty):
    rows_, _ = mixing.mix(docs)
    assert rows_.count() == len(TEXTS)
    assert mixing.sample(empty).count() == 0
    out = mixing.sample(docs, share=1.0)
    assert out.columns == docs.columns and out.count() == len(TEXTS)


def test_mixing_is_the_brute_force(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(["w"] * int(rng.integers(1, 60))) + rng.choice(["", " | a", "?", " 7"]) for _ in range(400)]
    data = [(int(i), t, str(rng.choice(["en", "de"], p=[0.8, 0.2])), str(rng.choice(["a", "b", "c"], p=[0.7, 0.2, 0.1])), len(t), "", "") for i, t in enumerate(texts)]
    got = {r[0].doc_id: r for r in mixing.mix(spark.createDataFrame(data, SCHEMA))[0].collect()}
    topic = lambda t: "table" if " | " in t else "question" if "?" in t else "figures" if any(c.isdigit() for c in t) else "prose"
    cells = Counter()
    for _, t, lang, source, *_ in data:
        cells[source, lang, topic(t)] += len(t.split())
    total, weight = sum(cells.values()), dict.fromkeys(cells, 1.0)
    share = lambda k, w: {v: sum(n * w[c] for c, n in cells.items() if c[k] == v) for v in {c[k] for c in cells}}
    want = [{v: (n / total) ** 0.7 for v, n in share(k, dict.fromkeys(cells, 1.0)).items()} for k in range(3)]
    want = [{v: x / sum(w.values()) for v, x in w.items()} for w in want]
    for _ in range(mixing.ROUNDS):
        for k in range(3):
            now = share(k, weight)
            weight = {c: w * want[k][c[k]] * total / now[c[k]] for c, w in weight.items()}
    low, high = 0.0, 1 / min(weight.values())
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if sum(n * min(1, weight[c] * mid) for c, n in cells.items()) >= 0.75 * total else (mid, high)
    for i, t, lang, source, *_ in data:
        p = min(1, weight[source, lang, topic(t)] * high)
        u = int(hashlib.md5(f"{i}:17".encode()).hexdigest()[:8], 16) / 2**32
        assert (got[i].n_tokens, got[i].topic) == (len(t.split()), topic(t))
        assert got[i].p == pytest.approx(p, rel=1e-6) and got[i].kept == (u < p)
