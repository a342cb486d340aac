"""Decontamination, fill-in-the-middle, ranked lexical search."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate as dec
from tessera.llm import fim, lexical

from . import brute

ITEMS = "item_id long, text string, doc_id string, n_chars int, _i int"


def passages():
    rng = random.Random(3)
    words = [f"k{n}" for n in range(300)] + ["É", "straße", "x1"]
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (25, 14, 10, 12, 3, 1, 40)]
    docs = []
    for i in range(120):
        w = [rng.choice(words) for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(3)):
            part = rng.choice(items).split()
            a = rng.randrange(len(part))
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() if rng.random() < .2 and x.isascii() else x for x in part[a:a + rng.randrange(4, 20)]]
        docs.append((i, rng.choice([" ", ", ", " -- "]).join(w)))
    docs += [(200, None), (201, ""), (202, " .\n"), (203, items[0] + " " + items[0]), (204, " ".join(items * 3000)), (205, "k1" * 90_000),
             (None, items[1]), (None, items[1]), (None, None), (3, items[2]), (203, items[0] + " " + items[0])]
    named = [(10 * k, t) for k, t in enumerate(items)] + [(5, None), (6, " ;"), (70, items[1]), (0, "k1 k2 k3"), (None, items[3])]
    return docs, named


def of(spark, rows, schema="doc_id long, text string"):
    wide = schema + ", spans int, _k string, n_hit int, _row string" if schema.startswith("doc") else schema
    more = len(wide.split(",")) - 2
    return spark.createDataFrame([(*r, *[None] * more) for r in rows], wide)


def test_contamination(spark):
    docs, items = passages()
    got = dec.contamination(of(spark, docs), of(spark, items, ITEMS)).collect()
    want = brute.contamination(docs, items)
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_words, r.n_hit, [tuple(s) for s in r.spans], list(r.items)))
                                            for r in got)
    assert all(r.contaminated == (r.n_hit > 0) for r in got)
    few = dec.contamination(of(spark, docs).repartition(7), of(spark, items, ITEMS), block_bytes=9000).collect()  # in blocks
    assert sorted(map(str, few)) == sorted(map(str, got))


def test_removal(spark):
    docs, items = passages()
    d, b = of(spark, docs), of(spark, items, ITEMS)
    want = {(w[0], w[1], w[2]): w for w in brute.contamination(docs, items)}
    cut = dec.remove_spans(d, b)
    assert cut.columns == d.columns and cut.count() == len(docs)
    by_id = {r.doc_id: r.text for r in cut.where("doc_id < 200 and doc_id <> 3").collect()}
    texts = dict(x for x in docs if x[0] is not None and x[0] < 200 and x[0] != 3)
    for w in want.values():
        if w[0] not in by_id:
            continue
        kept = brute.NOISE.sub(" ", "".join(c.lower() if c.isascii() else c for c in by_id[w[0]] or "")).split()
        all_ = brute.NOISE.sub(" ", "".join(c.lower() if c.isascii() else c for c in texts[w[0]] or "")).split()
        gone = {k for a, z in w[3] for k in range(a, z)}
        assert kept == [x for k, x in enumerate(all_) if k not in gone]
        if not gone:
            assert by_id[w[0]] == texts[w[0]]
    got = dec.remove_documents(d, b)
    clean = sorted(str(w[0]) for w in brute.contamination(docs, items) if not w[2])
    assert got.columns == d.columns and sorted(str(r.doc_id) for r in got.collect()) == clean
    assert dec.remove_documents(d, b, most=1.0).count() == len(docs)


def test_cut_text(spark):
    df = spark.createDataFrame([("Ab, c--D e. ",)], "t string")
    for gone, want in (([(0, 1)], ", c--D e. "), ([(1, 3)], "Ab e. "), ([(0, 4)], ". "), ([(0, 1), (3, 4)], ", c--D. ")):
        spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(z).alias("stop")) for a, z in gone])
        assert df.select(dec._without(F.col("t"), spans)).first()[0] == want


def test_contamination_empty(spark, empty, odd):
    none = spark.createDataFrame([], ITEMS)
    assert dec.contamination(odd, none).where("contaminated").isEmpty() and dec.contamination(odd, none).count() == 15
    assert dec.contamination(empty, spark.createDataFrame([(1, "a", None, None, 0)], ITEMS)).isEmpty()
    assert dec.remove_spans(empty, none).columns == empty.columns
    assert dec.remove_documents(odd, none).count() == 15


def test_contamination_hot_window(spark):
    """One passage in most documents and in many items."""
    hot = " ".join(f"h{k}" for k in range(10))
    items = [(k, f"{hot} tail{k}") for k in range(300)]
    docs = [(k, f"x{k} {hot} y{k}") for k in range(3000)]
    got = dec.contamination(of(spark, docs).repartition(9), of(spark, [(*i, "a", 1, 2)[:2] for i in items], ITEMS))
    rows = got.select("n_hit", F.size("items").alias("n")).distinct().collect()
    assert [tuple(r) for r in rows] == [(10, 300)]


# -- fill in the middle ------------------------------------------------------

def plain_fim(i, text):
    """The contract, with Python's own regular expressions."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (i, n, "plain", None, None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return (i, n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}")
    return (i, n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


def check_fim(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    out = fim.fill_in_middle(df)
    again = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(str(plain_fim(*r)) for r in rows) == sorted(str(tuple(r)[:-1]) for r in again)
    assert sorted(r.back for r in again) == sorted(t or "" for _, t in rows)
    return {r.form for r in again}


def test_fill_in_middle(spark, odd, repeated, empty, given):
    assert check_fim(spark.createDataFrame(given, "doc_id long, text string")) == {"plain", "psm", "spm"}
    check_fim(odd)
    check_fim(repeated)
    assert fim.fill_in_middle(empty).isEmpty()
    rng = random.Random(1)
    chars = "ab<>PSM\\$1 \n\r é\U0001f600\x00"
    rows = [(k, "".join(rng.choice(chars) for _ in range(rng.randrange(30)))) for k in range(600)]
    rows += [(k, t) for k, t in zip(range(1000, 1040), ["<", ">P", "S><", "a<P", "<S>", "<M", "<<P>>", "P>" * 9] * 5)]
    rows += [(2000 + k, "a" * 2_000_000 if k % 2 else "é1 " * 200_000) for k in range(6)]
    check_fim(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


# -- ranked search -----------------------------------------------------------

def plain_search(docs, items, k=20):
    kinds = [(i, Counter(lexical.terms(t))) for i, t in docs]
    kinds = [(i, c, sum(c.values())) for i, c in kinds if c]
    n_docs, total = len(kinds), sum(n for _, _, n in kinds)
    df = Counter(t for _, c, _ in kinds for t in c)
    out = []
    for q, text in items:
        best = []
        for i, c, n in kinds:
            m = 75 + 25 * n * n_docs // total
            s = sum(q_tf * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                    for t, q_tf in Counter(lexical.terms(text)).items() if t in c)
            if s:
                best.append((-s, math.inf if i is None else i))
        out += [(q, r, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(best)[:k], 1)]
    return out


def check_search(spark, docs, items, k=20, parts=3, query_bytes=1 << 20, **kw):
    df = of(spark, docs).repartition(parts)
    got = lexical.search(lexical.build_index(df, **kw), of(spark, items, ITEMS), k, query_bytes=query_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(str, plain_search(docs, items, k))) == sorted(str(tuple(r)) for r in got.collect())


def test_search(spark, given, odd_rows):
    items = [(k, t) for k, (_, t) in enumerate(given[:8])] + [(100, None), (101, " - "), (102, "zzzzz"), (3, given[0][1]), (None, given[1][1])]
    check_search(spark, given, items, chunk_docs=37)
    check_search(spark, given, items, k=1, chunk_points=500, query_bytes=3000)
    odd = odd_rows + odd_rows[:6] + [(None, "alpha one"), (None, "alpha one"), (None, None), (-5, "ALPHA")]
    check_search(spark, odd, [(1, "alpha Beta alpha one É caf́e x y w1 w2"), (2, odd_rows[5][1]), (2, odd_rows[5][1])], k=5, chunk_docs=4)


def test_search_ties_and_copies(spark):
    """A third of all rows are one text, and every document holds one term."""
    docs = [(k, "same words here") for k in range(400)] + [(400 + k, f"every doc{k % 7} here") for k in range(800)]
    check_search(spark, docs, [(1, "same here"), (2, "here"), (3, "doc3 words")], chunk_docs=100)


def test_search_empty(spark, empty):
    none = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b", None, None, 0)], ITEMS)
    assert lexical.search(lexical.build_index(empty), some).isEmpty()
    assert lexical.search(lexical.build_index(spark.createDataFrame([(1, "a")], "doc_id long, text string")), none).isEmpty()


@pytest.mark.parametrize("seed", range(6))
def test_treap(seed):
    rng = np.random.default_rng(seed)
    for _ in range(40):
        rows, cols = int(rng.integers(1, 50)), int(rng.integers(1, 40))
        grid = (rng.random((rows, cols)) < rng.random()) * rng.integers(1, 200_000 if seed % 2 else 4, (rows, cols))
        r, c = np.nonzero(grid)
        if not len(r):
            continue
        bits = max(1, (rows - 1).bit_length(), (cols - 1).bit_length())
        tree = lexical.Treap(lexical.build(r, c, grid[r, c], bits) | {"bits": bits, "docs": np.arange(cols, dtype="<i8").tobytes()})
        assert sum(len(v) - 1 for v in tree.value) == len(r)  # a node for each point
        pick = rng.choice(rows, size=min(rows, int(rng.integers(1, 8))), replace=False)
        w, best = rng.integers(1, 9, len(pick)), lexical.Best(int(rng.integers(1, 6)))
        tree.search(pick, w, best)
        score = w @ grid[pick]
        want = sorted(((-int(s), d) for d, s in enumerate(score) if s))[:best.k]
        assert [(-s, d) for s, d in want] == list(zip(best.score.tolist(), best.doc.tolist()))


# -- odd inputs of earlier operators ------------------------------------------

def test_licences_odd_rows(spark):
    """Clashing column names, ids that repeat, null and very long texts."""
    from tessera.llm import licences

    notice = next(line for line in licences.TEMPLATES["MIT"] if len(licences.terms(line)) >= 5)
    rows = [(1, "a/x", notice), (1, "a/x", notice), (1, "b/y", "nothing"), (None, None, None), (2, "c/z", ""),
            (3, "c/long", "word " * 150_000 + "\n" + notice + "\n" + "more " * 50_000), (4, "d/LICENSE", notice), (5, "d/e/f", None)]
    df = spark.createDataFrame([(*r, "own", 0.5, "dir") for r in rows], "doc_id long, path string, text string, own string, cosine double, _path string")
    got = licences.scan_licences(df, "doc_id", "path", "text")
    assert got.columns == ["doc_id", "path", "own", "cosine", "licence_file", "licence", "licence_from"]
    found = sorted((str(r.doc_id), str(r.path), str(r.own), str(r.licence), str(r.licence_from)) for r in got.collect())
    assert found == sorted([("1", "a/x", "MIT", "MIT", "None")] * 2 + [
        ("1", "b/y", "None", "None", "None"), ("None",) * 5, ("2", "c/z", "None", "None", "None"), ("3", "c/long", "MIT", "MIT", "None"),
        ("4", "d/LICENSE", "MIT", "MIT", "None"), ("5", "d/e/f", "None", "MIT", "d")])
    assert licences.scan_licences(df.limit(0), "doc_id", "path", "text").isEmpty()


def test_embeddings_of_repeated_ids(spark):
    from tessera.llm import multiindex

    data = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.001]), (3, [0.001, 1.0]), (4, [-1.0, 0.2]), (4, [-1.0, 0.2]), (5, None), (5, None)]
    df = spark.createDataFrame([(*r, True) for r in data], "vec_id long, embedding array<double>, kept boolean")
    got = {r.vec_id: (r.component_id, r.kept) for r in multiindex.embedding_groups(df).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (1, False), 4: (4, True), 5: (5, True)}
    assert multiindex.embedding_groups(df).count() == len(data)
