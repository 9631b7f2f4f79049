"""The registered queries and the pipeline over small folders of tables, against their SQL, libraries and brute force."""

import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from test_dedup_and_tokens import brute_components, brute_fingerprint, brute_line_dedup

import corpus_pipeline
from arborix.llm import bpe, oracles, queries

WORDS = [f"{a}{b}{c}" for a in "prst" for b in ("an", "el", "io", "ur") for c in ("da", "mis", "ton", "e", "ri", "lo")]


def documents():
    """Prose with copies, near copies, shared passages, junk, null and empty and long texts, ties and rows that repeat a text."""
    rng = np.random.default_rng(7)
    line = lambda n: " ".join(rng.choice([*WORDS, "the", "of", "and"], n))
    prose = lambda k: "\n".join(line(int(rng.integers(10, 30))) for _ in range(k))
    passage = prose(5)
    texts = [prose(int(rng.integers(4, 9))) for _ in range(60)]
    texts += [f"{prose(3)}\n{passage}\n{prose(2)}" for _ in range(8)]
    for k in range(12):  # near copies: one word in ninety is another
        w = texts[k].split(" ")
        for at in rng.integers(0, len(w), max(1, len(w) // 90)):
            w[at] = "altered"
        texts.append(" ".join(w))
    texts += texts[20:26] + [None, "", " \n\t ", "one", "ONE", "### " * 80, "# *\n" * 60, "x" * 30_000, "foo.\n\n" + "漢" * 3000, " ".join(["again and again"] * 60)]
    texts.append(" ".join(rng.choice(WORDS, 20_000)))
    n = len(texts)
    return pd.DataFrame(
        {
            "doc_id": np.arange(n) * 3 + 1, "text": texts, "lang": [("en", "de", None)[i % 3] for i in range(n)], "source": ["hot" if i % 3 else (f"s{i % 4}" if i % 5 else None) for i in range(n)],
            "n_chars": pd.array([None if i % 4 == 0 else len(t or "") for i, t in enumerate(texts)], "Int64"), "a.b": "dotted", "kept": "clash", "_row": "clash", "component_id": "clash",
        }
    )


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs = documents()
    docs.to_parquet(path / "documents.parquet", index=False)
    rng = np.random.default_rng(9)
    base = rng.standard_normal((40, 8)).astype(np.float32)
    vectors = [*base, *(base[:12] + rng.standard_normal((12, 8)).astype(np.float32) * 0.02), *base[:3]]
    vectors = [v.tolist() for v in vectors] + [None, [0.0] * 8, [float("nan")] * 8]
    pd.DataFrame({"vec_id": np.arange(len(vectors)) * 2, "embedding": vectors, "label": 1, "component": "clash"}).to_parquet(path / "embeddings.parquet", index=False)
    pd.DataFrame({"doc_id": docs.doc_id, "quality": 1, "toxic": [int("altered" in (t or "")) for t in docs.text], "score": "clash"}).to_parquet(path / "labels.parquet", index=False)
    pd.DataFrame({"item_id": range(12), "text": [*docs.text[:11], None]}).to_parquet(path / "benchmark.parquet", index=False)
    return str(path)


TABLES = ("documents", "embeddings", "labels", "benchmark")


@pytest.fixture(scope="module")
def no_rows(tmp_path_factory, folder):
    path = tmp_path_factory.mktemp("none")
    for name in TABLES:
        import pyarrow.parquet as pq

        pq.write_table(pq.read_table(f"{folder}/{name}.parquet").slice(0, 0), path / f"{name}.parquet")
    return str(path)


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t)
    return con.sql(sql).df()


def rows_of(df):
    plain = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else bool(v) if isinstance(v, np.bool_) else v
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_queries_are_their_sql(spark, folder, name):
    import pyarrow.parquet as pq

    got = queries.QUERIES[name](spark, folder).toPandas()
    want = by_sql(oracles.ORACLES[name], **{t: pq.read_table(f"{folder}/{t}.parquet") for t in TABLES})
    assert rows_of(got) == rows_of(want) and len(got) > 50


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_of_empty_tables(spark, no_rows, name):
    got = queries.QUERIES[name](spark, no_rows)
    assert got.count() == 0 and got.columns[0] in ("doc_id", "vec_id", "part")


def test_simhash_query(spark, folder):
    docs = documents()
    got = queries.op1_simhash(spark, folder).toPandas().set_index("doc_id")
    fp = {int(i): brute_fingerprint(t) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    part = brute_components(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    assert {i: (r.fingerprint, r.component_id) for i, r in got.iterrows()} == {i: (f"{fp[i]:016x}", part[i]) for i in fp}


def test_sharding_query(spark, folder):
    docs = documents()
    got = queries.op3_sharding(spark, folder).toPandas()
    assert got.law.unique().tolist() == ["bytes"] and got.grown_shard.isna().all() and got["shard"].between(0, 23).all()
    raw = {i: (t or "").encode() for i, t in zip(docs.doc_id, docs.text, strict=True)}
    assert all((s, c) == (len(raw[i]) + 8, zlib.crc32(raw[i])) for i, s, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True))
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert sorted(got.doc_id) == sorted(raw)


def test_bpe_query(spark, folder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    docs = documents()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op4_bpe(spark, folder).collect()}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_toxicity_query(spark, folder):
    docs = documents()
    got = queries.op7_toxicity(spark, folder).toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(docs.doc_id)
    for i, r in got.iterrows():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    same = got.loc[docs.doc_id[docs.text.isna() | (docs.text == "")]].score
    assert same.nunique() == 1


def brute_pipeline(docs):
    """Stage by stage: SQL of the verdicts and of the mixture, lists of lines, all pairs of shingles, the tokenizers library."""
    from tokenizers import Tokenizer

    good = by_sql(oracles.ORACLES["op8_quality"], documents=docs)
    docs = docs[docs.doc_id.isin(good[good.kept].doc_id)].copy()
    docs["text"] = [t for _, t in brute_line_dedup(list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)))]
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for i, t in zip(docs.doc_id, docs.text, strict=True)}
    like = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
    part = brute_components(grams, [(a, b) for a in grams for b in grams if a < b and like(grams[a], grams[b]) >= 0.8])
    docs = docs[[part[i] == i for i in docs.doc_id]]
    mixed = by_sql(oracles.ORACLES["op2_mixing"], documents=docs)
    docs = docs[docs.doc_id.isin(mixed[mixed.kept].doc_id)]
    library = Tokenizer.from_file(bpe.default_vocabulary())
    return {i: (library.encode(t, add_special_tokens=False).ids, t) for i, t in zip(docs.doc_id, docs.text, strict=True)}, part


def test_pipeline_is_the_brute_force(spark, folder):
    want, part = brute_pipeline(documents())
    got = {r.doc_id: (list(r.ids), r.text) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want
    assert 30 < len(want) < 75 and sum(a != b for a, b in part.items()) >= 5


def test_pipeline_keeps_columns_and_takes_nulls(spark, folder):
    """All but the last stage return the columns of documents; rows without an id, source or text do no harm."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lost = docs.limit(5).selectExpr("cast(null as long) doc_id", "text", "cast(null as string) lang", "cast(null as string) source", "n_chars", "`a.b`", "kept", "_row", "component_id")
    rows = docs.unionByName(lost).unionByName(docs.limit(3))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, folder)
        assert rows.columns == docs.columns, name
        assert rows.count() > 20, name
    assert {name for name, _ in corpus_pipeline.STAGES} == {"quality rules", "line dedup", "simhash near-dedup", "mixing", "bpe"}
