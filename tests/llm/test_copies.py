"""Exact copies, SimHash, embeddings, components."""

import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import components, exact, multiindex, simhash

from . import brute


def rows(df):
    return [tuple(r) for r in df.collect()]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


# -- exact ------------------------------------------------------------------

@pytest.mark.parametrize("table_bytes", [exact.TABLE_BYTES, 2_000])
def test_exact_against_plain(spark, given, table_bytes):
    docs = spark.createDataFrame([*given, *[(i + 1000, t) for i, t in given[:50]]], "doc_id long, text string").repartition(5)
    want = {}
    for i, t in docs.collect():
        want.setdefault(norm(t), []).append(i)
    got = {r[0]: r[1:] for r in rows(exact.exact_dedup(docs, table_bytes=table_bytes))}
    for t, ids in want.items():
        for i in ids:
            assert got[i] == (min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest())


def test_exact_odd(odd, repeated, empty):
    got = {r[0]: r for r in rows(exact.exact_dedup(odd))}
    assert got[5][1] == 1 and got[3][1] == 2 and got[12][1] == 11
    assert got[4][4] == hashlib.sha256(b" ").hexdigest()
    r = rows(exact.exact_dedup(repeated))
    assert len(r) == 14
    assert [x for x in r if x[0] is None and x[2] == 2] == [(None, None, 2, True, hashlib.sha256(b"no id at all here, sorry").hexdigest())] * 2
    assert sum(x[0] == 1 and x[3] for x in r) == 3  # the repeated row is decided alike; the other text is its own group
    assert rows(exact.exact_dedup(empty)) == []


def test_grace_recursion_and_collision():
    data = [(hashlib.sha256(str(k % 500).encode()).digest(), str(k % 500).encode() * 50, 1, k) for k in range(3000)]
    for size in (1 << 30, 5_000, 400):
        got = sorted((c, n, i) for _, c, n, i in exact.grace(data, size))
        assert got == sorted((str(k).encode() * 50, 6, k) for k in range(500))
    with pytest.raises(ValueError):
        list(exact.grace([(b"0" * 32, b"a", 1, 1), (b"0" * 32, b"b", 1, 2)]))


# -- components -------------------------------------------------------------

def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 80)] + [(5000, 5000), (7, 7)]
    links += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    shuffled = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in links]
    got = {r[0]: r[1] for r in rows(components.components(spark.createDataFrame(shuffled, "u long, v long")))}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    want = brute.closure(nodes, [x for x in links if x[0] != x[1]])
    assert got == want
    assert rows(components.components(spark.createDataFrame([], "u long, v long"))) == []


# -- simhash ----------------------------------------------------------------

@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_simhash_against_plain(spark, given, hot):
    near = [(i + 500, (t or "") + " tail") for i, t in given[:60]]
    docs = spark.createDataFrame([*given, *near], "doc_id long, text string")
    prints, comp = brute.simhash_components([*given, *near])
    got = rows(simhash.simhash_groups(docs, hot=hot))
    assert {r[0]: r[1] for r in got} == prints
    assert {r[0]: r[2] for r in got} == comp


def test_simhash_odd(odd, odd_rows, repeated, empty):
    prints, comp = brute.simhash_components(odd_rows)
    got = rows(simhash.simhash_groups(odd))
    assert {r[0]: (r[1], r[2]) for r in got} == {i: (prints[i], comp[i]) for i, _ in odd_rows}
    r = rows(simhash.simhash_groups(repeated))
    assert len(r) == 14 and all(x[2] == 2 for x in r if x[1] == "0" * 16)
    assert rows(simhash.simhash_groups(empty)) == []


@pytest.mark.parametrize("most", [1, 3, 5])
def test_pigeonhole_is_complete(most):
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for n in (100, 10**6, 10**11):
        plan = simhash.allocation(sample, n, most)
        assert sum(t + 1 for _, t in plan) == most + 1
        used = [b for g, _ in plan for b in g]
        assert len(used) == len(set(used))
        a = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
        flips = [rng.choice(64, most, replace=False) for _ in a]
        b = np.array([x ^ np.uint64(sum(1 << int(k) for k in f)) for x, f in zip(a, flips)])
        if n > 100:
            continue
        with np.errstate(over="ignore"):
            probes = [k for k, _ in simhash._keys(a, plan)]
            files = [k for k, p in simhash._keys(b, plan) if not p]
        assert all(any(x[i] == y[i] for x in probes for y in files) for i in range(len(a)))


# -- embeddings -------------------------------------------------------------

def clusters(n, dim=16, seed=2, noise=0.05):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 6, dim))
    v = centre[rng.integers(0, len(centre), n)] + noise * rng.normal(size=(n, dim))
    return [(i, [float(x) for x in row]) for i, row in enumerate(v)]


@pytest.mark.parametrize("cell_rows", [multiindex.CELL_ROWS, 4])
def test_embeddings_recall(spark, cell_rows):
    data = clusters(600)
    links, comp = brute.cosine_links(data)
    got = {r[0]: r[1:] for r in rows(multiindex.embedding_groups(
        spark.createDataFrame(data, "vec_id long, embedding array<double>"), cell_rows=cell_rows))}
    total = sum(links.values())
    assert total > 2000
    assert all(got[i][0] <= links[i] for i in links)  # none below the bound, none twice
    assert sum(r[0] for r in got.values()) >= 0.95 * total
    assert np.mean([got[i][1] == comp[i] for i in comp]) >= 0.95
    assert all(r[2] == (i == r[1]) for i, r in got.items())


@pytest.mark.parametrize("n,pairs", [(4000, 20), (4000, 100)])
def test_embeddings_recall_of_sparse_pairs(spark, n, pairs):
    """Near copies so rare that the queries meet next to none of them."""
    rng = np.random.default_rng(n + pairs)
    v = rng.normal(size=(n, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    _, v[-pairs:] = multiindex.at_bound(v[:pairs], rng.normal(size=(pairs, 64)), 0.952)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = rows(multiindex.embedding_groups(df).where("n_links > 0"))
    found = sum(n - pairs <= r[0] and r[2] == r[0] - n + pairs for r in got)
    assert found >= 0.95 * pairs and len(got) == 2 * found


def test_visits_from_the_bound():
    """A vector held out of the codebooks finds its partner at the bound."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32)) @ rng.normal(size=(32, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = multiindex.Index(multiindex.codebook(x[:2000, :16], 20), multiindex.codebook(x[:2000, 16:], 20))
    index.visits = multiindex.bound_visits(index, x[2000:2500], 0.95, 0.99)
    for toward in (rng.normal(size=(500, 32)), x[:500]):
        a, b = multiindex.at_bound(x[2500:], toward, 0.95)
        assert np.allclose((a * b).sum(axis=1), 0.95)
        met = (index.traversal(a) == index.cells(b)[:, None]).any(axis=1) | (index.traversal(b) == index.cells(a)[:, None]).any(axis=1)
        assert met.mean() >= 0.96
    assert multiindex.bound_visits(index, x[:1], 0.95, 0.99) >= 1


def test_embeddings_odd(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0, 0.0]), (3, [1.0, -0.0, 0.0, 0.0]), (4, None), (5, []),
            (6, [0.0] * 4), (7, [nan, 1.0, 0.0, 0.0]), (8, [inf, 1.0, 0.0, 0.0]), (9, [1.0, None, 0.0, 0.0]),
            (10, [1.0, 0.0]), (11, [1.0, 0.01]), (12, [1e-300, 0.0, 0.0, 0.0]), (13, [3.0]), (14, [5.0]), (15, [-5.0]),
            (None, [1.0, 0.0, 0.0, 0.0]), (20, [0.0, 1.0, 0.0, 0.0])]
    got = {r[0]: r[1:] for r in rows(multiindex.embedding_groups(
        spark.createDataFrame([(*r, "x") for r in data], "vec_id long, embedding array<double>, n_links string")))}
    assert got[1] == (4, 1, True) and got[2] == (4, 1, False) and got[12] == (4, 1, False) and got[None] == (4, 1, False)
    for i in (4, 5, 6, 7, 8, 9, 15, 20):
        assert got[i] == (0, i, True)
    assert got[10] == (1, 10, True) and got[11] == (1, 10, False) and got[13] == (1, 13, True) and got[14] == (1, 13, False)
    assert rows(multiindex.embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>"))) == []


def test_traversal_order():
    rng = np.random.default_rng(0)
    index = multiindex.Index(rng.normal(size=(7, 4)), rng.normal(size=(7, 4)), visits=20)
    v = rng.normal(size=(30, 8))
    a, b = index._halves(v)
    want = (a[:, :, None] + b[:, None, :]).reshape(30, -1).argsort(axis=1)[:, :20]
    assert (index.traversal(v) == want).all()
    x = rng.normal(size=(30, 8))
    rank = index.rank(v, x)
    full = multiindex.Index(index.first, index.second, visits=49).traversal(v)
    assert (full[np.arange(30), rank] == index.cells(x)).all()
