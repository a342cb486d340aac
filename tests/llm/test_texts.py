"""Lines, licences, repeated passages."""

import hashlib
import os
import random
import tempfile

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import licences, lines, suffix

from . import brute


def rows(df):
    return [tuple(r) for r in df.collect()]


# -- lines ------------------------------------------------------------------

def edited(seed=4, n=150):
    """Documents whose lines are copies of others with words changed."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    pool, docs = [], []
    for i in range(n):
        out = []
        for _ in range(rng.randrange(0, 6)):
            if pool and rng.random() < 0.6:
                w = list(rng.choice(pool))
                for _ in range(rng.randrange(0, 3)):
                    k = rng.randrange(len(w) + 1)
                    w[k:k + rng.randrange(0, 2)] = [rng.choice(words)] * rng.randrange(0, 2)
            else:
                w = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 6, 9, 20, 57]))]
            pool.append(w)
            out.append(rng.choice([" ", "  "]).join(w if rng.random() < 0.8 else [x.upper() for x in w]))
        docs.append((i, "\n".join(out)))
    return docs


def test_lines_against_plain(spark, given):
    for docs in (edited(), given):
        got = {r._id: r for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        want = brute.line_dedup(docs)
        assert {i: r.text for i, r in got.items()} == want
        for i, t in docs:
            left = want[i].count("\n") + 1 if got[i].n_lines > got[i].n_exact + got[i].n_near else 0
            assert got[i].n_lines == t.count("\n") + 1 == got[i].n_exact + got[i].n_near + left


def test_lines_hot_template(spark):
    """Very many near variants of one line, and of one short line exact copies."""
    n = 30_000
    df = spark.range(n).selectExpr("id AS doc_id", "concat('one two three four five six ', id, '\\n', 'ok', '\\n \\n', 'x', id) AS text")
    got = lines.dedup_lines(df.repartition(6)).groupBy("n_exact", "n_near").count().collect()
    assert {tuple(r) for r in got} == {(0, 0, 1), (1, 1, n - 1)}


def test_lines_odd(odd, odd_rows, repeated, empty):
    assert {r._id: r.text for r in lines.dedup_lines(odd).collect()} == brute.line_dedup(odd_rows)
    got = lines.dedup_lines(repeated, carry=True).collect()
    assert len(got) == 14
    texts = [r.text for r in got if r._row.doc_id == 8]
    assert texts[0] == texts[1] != ""  # a repeated row is one document with a row each
    assert all(r.text == "no id at all here, sorry" for r in got if r._row.doc_id is None and r.n_lines and r.text)
    assert rows(lines.dedup_lines(empty)) == []


def test_one_edit_only():
    assert brute.one_edit("a b c".split(), "a c".split()) and brute.one_edit([], ["x"])
    assert not brute.one_edit("a b c".split(), "a c b".split())


# -- licences ---------------------------------------------------------------

def test_licences(spark, empty):
    mit, gpl = licences.TEMPLATES["MIT"][0], licences.TEMPLATES["GPL-3.0"][0]
    filler = "some words of ordinary prose without any legal meaning that go on for a while\n" * 3
    files = [(1, "a/LICENSE", mit), (2, "a/b/c.txt", filler), (3, "a/b/d/e.txt", filler + gpl), (4, "x/y.txt", filler),
             (5, "a/d/LICENSE", gpl + "\n"), (6, "a/d/f/g.txt", filler), (7, "ab/c.txt", filler), (8, None, filler),
             (9, "a/n.txt", None), (10, "a/d/z", ""), (11, "top.txt", filler), (12, "a/d/COPYING", "Licensed under CC BY 4.0."),
             (13, "q/r.txt", filler + "see the License of version things"), (14, "a/b/c.txt", filler)]
    got = {r.doc_id: r for r in licences.scan_licences(
        spark.createDataFrame(files, "doc_id long, path string, text string"), "doc_id", "path", "text").collect()}
    said = {i: (r.own, r.licence, r.licence_from) for i, r in got.items()}
    assert said[1] == ("MIT", "MIT", None) and said[2] == (None, "MIT", "a") and said[3] == ("GPL-3.0", "GPL-3.0", None)
    assert said[6][1:] == ("GPL-3.0", "a/d") or said[6][1:] == ("CC-BY-4.0", "a/d")
    for i in (4, 7, 8, 11, 13):
        assert said[i] == (None, None, None)
    assert said[9] == (None, "MIT", "a") and said[10][2] == "a/d" and said[14] == said[2]
    assert [i for i, r in got.items() if r.licence_file] == sorted([1, 5, 12], key=list(got).index)
    none = empty.selectExpr("doc_id", "lang as path", "text")
    assert rows(licences.scan_licences(none, "doc_id", "path", "text")) == []


def test_licence_shortcut_loses_nothing():
    s = licences.Scanner({"the": 900, "license": 5, "version": 40}, 1000, licences.TEMPLATES, 0.6)
    rng = random.Random(1)
    vocabulary = sorted(s.idf) + ["foo", "bar"]
    for _ in range(3000):
        line = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 9)))
        v = {t: line.split().count(t) * s.idf.get(t, s.other) for t in set(licences.terms(line))}
        norm = np.sqrt(sum(x * x for x in v.values()))
        top = max(sum(x * u.get(t, 0) for t, x in v.items()) / norm for _, u in s.vectors)
        if top >= 0.6 + 1e-9 and set(licences.terms(line)) == set(line.split()):
            assert s.best(line) is not None


def scanner():
    return licences.Scanner({"all": 900, "the": 9000, "of": 9000, "version": 400, "license": 300, "2": 500, "3": 500, "and": 9000},
                            100_000, licences.TEMPLATES, 0.6)


def test_licence_notices_and_versions():
    s = scanner()
    for text, want in [
            ("All rights reserved.", "Proprietary"), ("Copyright 2020 A. B. All rights reserved.", "Proprietary"),
            ("GNU General Public License, version 2.", "GPL-2.0"), ("GNU General Public License, version 3.", "GPL-3.0"),
            ("GNU Affero General Public License, version 3", "AGPL-3.0"), ("GNU Lesser General Public License, version 3", "LGPL-3.0"),
            ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
            ("All rights reserved.\nLicensed under the Apache License, Version 2.0.", "Apache-2.0"),
            *[(f"// SPDX-License-Identifier: {x}", x) for x in ("Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "CC0-1.0", "Unlicense")]]:
        assert s.scan(text)[0] == want, text
    assert s.scan("SPDX-License-Identifier: Foo-1.0")[0] is None and s.scan("see the License of version things")[0] is None
    assert s.scan("Mit.\nISC\nmit und mit")[0] is None


def test_licence_windows():
    """Notices within a long line, and over several lines."""
    s = scanner()
    prose = "some words of ordinary prose that go on and on without any meaning for a long while " * 3
    for name, lines in licences.TEMPLATES.items():
        for line in lines:
            if len(licences.terms(line)) >= 3:
                assert s.scan(prose + line + " " + prose)[0] == name, line
                assert s.scan(prose + "\n# " + line.replace(" ", "\n# ") + "\n" + prose)[0] == name, line
    assert s.scan(prose * 20) == (None, 0.0, 0.0)


def test_licence_files(spark):
    """Full texts, each under its own copyright line, speak for their folders,
    whatever the file is called; so does a file named LICENSE with a notice."""
    texts = licences.full_texts()
    assert len(texts) >= 13
    filler = "some words of ordinary prose without any legal meaning that go on for a while\n" * 5
    files = [(100, "n/LICENSE.md", filler + "Licensed under CC BY-SA 4.0.\n"), (101, "n/a.py", filler),
             (102, "m/license.py", filler + "Licensed under CC BY-SA 4.0.\n"), (103, "m/a.py", filler)]
    for k, (name, (text,)) in enumerate(texts.items()):
        files += [(2 * k, f"p{k}/{['LICENSE', 'about'][k % 2]}", f"Copyright (c) 2021 Jo Doe <jo@doe.net>\nAll rights reserved.\n\n{text}"),
                  (2 * k + 1, f"p{k}/src/main.c", filler)]
    got = {r.doc_id: r for r in licences.scan_licences(
        spark.createDataFrame(files, "doc_id long, path string, text string"), "doc_id", "path", "text").collect()}
    for k, name in enumerate(texts):
        assert (got[2 * k].own, got[2 * k].licence_file) == (name, True)
        assert (got[2 * k + 1].licence, got[2 * k + 1].licence_from) == (name, f"p{k}")
    assert got[100].licence_file and got[101].licence == "CC-BY-SA-4.0"
    assert not got[102].licence_file and got[103].licence is None


# -- repeated passages ------------------------------------------------------

def passages(seed=6):
    rng = random.Random(seed)
    letters = "abcdefgh é"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [make(n) for n in (99, 100, 101, 140, 260, 700)]
    docs = [(i, "".join(make(rng.randrange(0, 90)) + rng.choice(shared)[rng.randrange(0, 3):] for _ in range(rng.randrange(0, 5))))
            for i in range(40)]
    return [*docs, (50, "x" * 1000), (51, "xy" * 400), (52, "x" * 150 + "y" + "x" * 150), (53, None), (54, ""),
            (55, docs[7][1]), (56, docs[7][1]), (57, "z" * 99), (58, "z" * 100), (59, "z" * 100)]


def digest(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()}


@pytest.mark.parametrize("hot", [suffix.HOT, 2])
def test_repeats_against_plain(spark, given, hot):
    for docs in (passages(), [(i + 100, t) for i, t in given[:60]] + [(i, t) for i, t in given[:60]]):
        got = digest(suffix.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), hot=hot))
        assert got == brute.repeats(docs)


@pytest.mark.parametrize("least", [2, 7, 32, 33, 130])
def test_repeats_other_lengths(spark, least):
    docs = passages(9)[:25]
    got = digest(suffix.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), least=least))
    assert got == brute.repeats(docs, least)


def test_repeats_odd(odd, odd_rows, repeated, empty):
    assert digest(suffix.remove_repeats(odd)) == brute.repeats(odd_rows)
    got = suffix.remove_repeats(repeated).collect()
    assert len(got) == 14
    assert [r.n_removed for r in got if r.doc_id == 8] == [0, 0]  # one document, with a row each
    assert rows(suffix.remove_repeats(empty)) == []


def stretch_rows(docs):
    """(key, document, place, bytes) of the stretches of the texts, sorted."""
    cut, out = suffix.Stretches(100), []
    with np.errstate(over="ignore"):
        for i, t in docs:
            start, count, h, _ = cut.of(np.frombuffer(t, dtype=np.uint8))
            out += [(int(k), i, int(a), t[a:a + n + 99]) for k, a, n in zip((h >> np.uint64(16)).view(np.int64), start, count)]
    return sorted(out)


def transformed(data, most=10_000):
    t = pa.table([pa.array(c, k) for c, k in zip(zip(*data), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                 names=["_k", "_id", "_at", "_s"])
    return [tuple(r.values()) for b in suffix._transformed(iter(t.to_batches(max_chunksize=most)), 100) for r in b.to_pylist()]


def test_a_partition_is_transformed_in_parts(monkeypatch):
    """whole minimizers, so many bytes at a time; what repeats under a key is not held."""
    rng = random.Random(3)
    piece = lambda n: bytes(rng.choice(b"abcdef") for _ in range(n))
    passages = [piece(120) for _ in range(30)]
    docs = [(i, b"".join(rng.choice(passages) + piece(rng.randrange(40)) for _ in range(12))) for i in range(20)]
    data, sizes, seen = stretch_rows(docs), [], {}
    want = [(i, p) for i, t in docs for p in range(len(t) - 99) if seen.setdefault(t[p:p + 100], (i, p)) != (i, p)]
    assert len(want) > 1000
    starts = lambda marks: [(i, p) for i, at, n in marks for p in range(at, at + n)]
    assert sorted(starts(transformed(data))) == want
    made = suffix.Transform
    monkeypatch.setattr(suffix, "Transform", lambda strings, folder: sizes.append(sum(map(len, strings))) or made(strings, folder))
    monkeypatch.setattr(suffix, "CUT_BYTES", 2_000, raising=False)
    monkeypatch.setattr(suffix, "TRANSFORM_BYTES", 5_000, raising=False)
    for most in (7, 10_000):
        sizes.clear()
        assert sorted(starts(transformed(data, most))) == want
        assert len(sizes) > 4 and max(sizes) <= 5_000 + 2_000 + 240 * 168
    sizes.clear()
    assert starts(transformed([(5, i, 0, b"x" * 100) for i in range(30_000)])) == [(i, 0) for i in range(1, 30_000)]
    assert sizes in ([], [100])


def test_hot_strings_are_cut_out_in_parts():
    """each string of a hot minimizer counts, not each stretch; one document, 3,000 stretches."""
    text = "".join(random.Random(1).choices("abcdefgh", k=69 * 3_000 + 99))
    spans = [{"_c": 69, "_at": 69 * k, "_hot": True} for k in range(3_000)]
    kind = pa.list_(pa.struct([("_c", pa.int64()), ("_at", pa.int64()), ("_hot", pa.bool_())]))
    b = pa.record_batch([pa.array([7]), pa.array([0]), pa.array([text]), pa.array([spans], kind)], ["_id", "_ord", "_text", "_p"])
    got = list(suffix._cut_out(iter([b]), 100))
    assert max(sum(map(len, x.column("_s").to_pylist())) for x in got) < 4 << 20
    assert [(r["_id"], r["_at"], r["_s"]) for x in got for r in x.to_pylist()] == [
        (7, k, text[k:k + 100].encode()) for k in range(69 * 3_000)]


@pytest.mark.parametrize("block", [5, 64, 1 << 20])
def test_transform_is_the_sorted_suffixes(block):
    rng = random.Random(8)
    strings = [bytes(rng.choice(b"\x00ab\xff") for _ in range(rng.randrange(1, 30))) for _ in range(25)] + [b"aaaa"] * 3
    with tempfile.TemporaryDirectory() as folder:
        t = suffix.Transform(strings, folder, block)
        symbol, prefix, whose = (np.concatenate(c) for c in zip(*t.blocks()))
        assert len(os.listdir(folder)) == 3
    # the ends differ, in the order of the strings
    want = sorted(([b + 1 for b in s[len(s) - j:]] + [0, i], i, j) for i, s in enumerate(strings) for j in range(len(s) + 1))
    assert [divmod(int(w), 1 << t.bits) for w in whose] == [(i, j) for _, i, j in want]
    for k, (s, i, j) in enumerate(want):
        assert symbol[k] == (strings[i][len(strings[i]) - j - 1] + 1 if j < len(strings[i]) else 0)
        if k:
            a, b = s[:-2], want[k - 1][0][:-2]
            assert prefix[k] == next((x for x, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
