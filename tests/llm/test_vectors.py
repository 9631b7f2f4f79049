"""Operator 10 against brute force."""

import numpy as np
import pytest
from test_dedup_and_tokens import brute_components

from arborix.llm import nn_descent

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def brute(rows, threshold=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {}
    for a, x in ok:
        for b, y in ok:
            if a != b and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                links.setdefault(a, set()).add(b)
    part = brute_components([i for i, _ in rows if i is not None], [(a, b) for a in links for b in links[a]])
    return {i: (len(links.get(i, ())), part[i], part[i] == i) for i, _ in rows if i is not None}


def test_vectors_are_the_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "LEAF", 60)
    monkeypatch.setattr(nn_descent, "BLOCK", 20)
    rng = np.random.default_rng(8)
    vs = [rng.standard_normal(16) for _ in range(400)]
    for g in range(6):  # groups of near copies, larger than a list
        base = rng.standard_normal(16)
        vs += [base + rng.standard_normal(16) * 0.02 * (g + 1) for _ in range(10 + 12 * g)]
    vs += [vs[0]] * 50 + [vs[0] * 2, vs[401] * 1e-20, np.zeros(16), np.zeros(16)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vs)]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [None] * 16), (n + 3, [float("nan")] * 16), (n + 4, [float("inf")] + [0.0] * 15), (n + 5, [1.0, 0.0]), (n + 6, [2.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows] + [(None, rows[0][1], 1, "clash")], SCHEMA)
    got = nn_descent.near_duplicates(df).collect()
    assert len(got) == len(rows) + 1
    assert [(r.n_links, r.component, r.kept) for r in got if r.id is None] == [(0, None, False)]
    want = brute(rows)
    have = {r.id: (r.n_links, r.component, r.kept) for r in got if r.id is not None}
    found = sum(min(have[i][0], want[i][0]) for i in want) / sum(w[0] for w in want.values())
    assert found > 0.9
    assert all(have[i][0] <= want[i][0] for i in want)
    assert have == want


def test_groups_larger_than_a_list_that_link(spark):
    """Each list fills with its own group, at 0.999; the groups link at about 0.97."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(3):
        a, x = rng.standard_normal((2, 16))
        a /= np.linalg.norm(a)
        x -= (x @ a) * a
        b = 0.97 * a + np.sqrt(1 - 0.97**2) * x / np.linalg.norm(x)
        rows += [c + rng.standard_normal(16) * 0.003 for c in (a, b) for _ in range(25)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    got = nn_descent.near_duplicates(spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA)).collect()
    assert {r.id: (r.n_links, r.component, r.kept) for r in got} == brute(rows)


def test_lone_pairs_in_deep_trees(spark, monkeypatch):
    """Pairs just above the threshold that deep trees part; the audit has links to count."""
    monkeypatch.setattr(nn_descent, "LEAF", 4)
    rng = np.random.default_rng(4)
    base, x = rng.standard_normal((2, 1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    x -= (x * base).sum(1, keepdims=True) * base
    other = 0.952 * base + np.sqrt(1 - 0.952**2) * x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, other[:300]]).astype(np.float32))]
    got = {r.id: r.component for r in nn_descent.near_duplicates(spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA)).collect()}
    assert [i for i in range(300) if got[1500 + i] != i] == []
    assert len(set(got.values())) == 1500


def test_an_audit_tells_of_lost_links(spark, monkeypatch):
    """A graph that loses its links, all or those of every other node, is found out."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 16))
    rows = [(i, v.astype(np.float32).tolist(), 1, "clash") for i, v in enumerate(np.concatenate([base, base + rng.standard_normal((60, 16)) * 0.01]))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert nn_descent.near_duplicates(df).filter("not kept").count() == 60
    monkeypatch.setattr(nn_descent, "ROUNDS", 1)
    links = nn_descent._links_of
    for lost in ("true", "a % 2 = 0"):
        monkeypatch.setattr(nn_descent, "_links_of", lambda graph, t, lost=lost: links(graph, t).filter(f"not ({lost})"))
        with pytest.raises(RuntimeError, match="audited"):
            nn_descent.near_duplicates(df)


def test_no_vectors(spark):
    assert nn_descent.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("per_pass", [16, 1 << 13])
def test_an_audit_counts_all_links_in_passes(spark, monkeypatch, per_pass):
    """Planted pairs, half of them under one tag; without links an audit says so."""
    monkeypatch.setattr(nn_descent, "AUDIT_PASS", per_pass)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((100, 16))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [(2 * i + j, 2 * i if i % 2 else 2 * i + j, base[i].tolist()) for i in range(100) for j in range(2)]
    nodes = spark.createDataFrame(rows, "node long, tag long, v array<double>")
    share = nn_descent.audit(nodes, 200)  # all nodes in one pass, or enough of them in several
    assert share == 0.5 if per_pass > 200 else 0.4 < share < 0.6
    assert nn_descent.audit(nodes.filter("node % 2 = 0"), 100) is None
