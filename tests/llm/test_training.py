"""Toxicity, packing, mixing, WARC, pipeline."""

import gzip
import hashlib
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import mixing, packing, toxicity, warc
from tessera.llm.common import saved

from . import brute

PATH = public_tokenizers.path("word_bpe_49k.json")


def rows(df):
    return [tuple(r) for r in df.collect()]


# -- toxicity ---------------------------------------------------------------

def quadratic_segments(score):
    """The maximal-scoring segments by their definition: the best segment,
    then the same left and right of it. Of equals the shortest, then first."""
    best = None
    for a in range(len(score)):
        total = 0
        for z in range(a + 1, len(score) + 1):
            total += score[z - 1]
            if total > 0 and (best is None or (total, a - z, -a) > best[0]):
                best = ((total, a - z, -a), a, z, total)
    if best is None:
        return []
    _, a, z, total = best
    left, right = quadratic_segments(score[:a]), quadratic_segments(score[z:])
    return left + [(a, z, total)] + [(p + z, q + z, s) for p, q, s in right]


def test_segments():
    rng = np.random.default_rng(0)
    for _ in range(300):
        score = rng.integers(-4, 4, rng.integers(0, 25)) + rng.random() * 0.001
        got = [(a, z, round(s, 6)) for a, z, s in toxicity.segments(score.astype(float))]
        assert got == [(a, z, round(s, 6)) for a, z, s in quadratic_segments(score.tolist())]


def test_tokens():
    bucket, start, stop, raw = toxicity.tokens("Ab, äÖ x1-ab " + "z" * 500)
    assert [raw[a:z].decode() for a, z in zip(start, stop)] == ["ab", "äö", "x1", "ab", "z" * 500]
    assert bucket[0, 0] == bucket[3, 0] and (bucket[0, 1:] == -1).all() and (bucket[4] >= 0).all()
    assert len(toxicity.tokens(None)[0]) == len(toxicity.tokens(" .\n")[0]) == 0


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(800)]
    bad = ["vilest", "wretch", "curses", "loath"]
    docs, labels = [], []
    for i in range(700):
        t = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        y = i % 6 == 0
        if y:
            at = rng.randrange(len(t))
            t[at:at] = [rng.choice(bad + [rng.choice(words)]) for _ in range(8)]
        docs.append((i, " ".join(t)))
        labels.append((i, int(y)))
    docs += [(1000, None), (1001, ""), (1002, "vilest wretch curses loath vilest " * 4), (1003, "x" * 300_000), (None, "wretch")]
    d = spark.createDataFrame([(*r, 0.5) for r in docs], "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    model = toxicity.fit(d, lab)
    got = {r._d: r for r in toxicity.score_documents(d, model).collect()}
    assert len(got) == 705 and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i].score >= 0.3) == (i % 6 == 0) for i in held)
    assert right >= 0.97 * len(held)
    assert got[1000].score == got[1001].score < 0.3 < got[1002].score and got[1000].passages == []
    assert "vilest wretch" in got[1002].passages[0].text
    left = toxicity.clean_documents(d, model)
    assert left.columns == d.columns and 1002 not in {r[0] for r in rows(left)}


def test_toxicity_without_labels(spark, odd, empty):
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    for docs, n in ((odd, 15), (empty, 0)):
        got = toxicity.score_documents(docs, toxicity.fit(docs, lab)).collect()
        assert len(got) == n and len({r.score for r in got}) == min(n, 1)


# -- packing ----------------------------------------------------------------

def check_packed(docs, out, window=4096):
    tok = Tokenizer.from_file(PATH)
    want = sorted(tok.encode(t or "", add_special_tokens=False).ids + [2] for _, t in docs)
    whole, seqs = {}, {}
    for r in out:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length > 0
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        whole.setdefault(r.doc_id, []).append((r.start, r.doc_tokens, ids))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= window and (at == window or at & (at - 1) == 0)
    return want, whole


def test_packing(spark, given):
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    out = packing.pack_documents(df, PATH, shard_tokens=20_000).collect()
    want, whole = check_packed(given, out)
    got = []
    for pieces in whole.values():
        ids = []
        for start, n, part in sorted(pieces):
            assert start == len(ids)
            ids += part
        assert len(ids) == n
        got.append(ids)
    assert sorted(got) == want
    again = packing.pack_documents(df.repartition(5), PATH, shard_tokens=20_000).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_packing_odd(spark, odd, odd_rows, repeated, empty):
    want, whole = check_packed(odd_rows, packing.pack_documents(odd, PATH).collect())
    assert sorted(sum((p[2] for p in sorted(x)), []) for x in whole.values()) == want
    out = packing.pack_documents(repeated, PATH, shard_tokens=50).collect()
    assert sum(r.length for r in out) == sum(len(x) for x in check_packed([tuple(r)[:2] for r in repeated.collect()], out)[0])
    assert rows(packing.pack_documents(empty, PATH)) == []


def test_tokens_as_the_tokenizer():
    tok = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    odd = ["don't", "'s", "x's.", "É", "é", "é", "́", "a b", "\x1c", " ", "..", "a.,", "Ab!?", "Δς.", "İ.",
           "1.5,", "ǅ.", "<|endoftext|>", "你好。", "x\x00", "a‍.", "ﬁ.", "ª.", "ſ.", "-", "_a_", "'", "'ll.", "I'M."]
    odd += ["<|startoftext|>", "<|ENDOFTEXT|>", "a<|endoftext|>b", "<|endoftext", "Žlutý", "ŒŸ", "µ"]
    texts = ["".join(rng.choice(odd) + rng.choice(["", " ", "\n", "\t", "\x0b", "　"]) for _ in range(12)) for _ in range(400)]
    texts += ["", " ", "plain", "hello <|endoftext|> world"]
    got = packing.Tokens.at(PATH).encode(pa.array(texts))
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_tokens_with_a_full_table(given):
    tok, own = Tokenizer.from_file(PATH), packing.Tokens(PATH)
    own.most_words = 300
    for _ in range(2):
        for at in range(0, 60, 20):
            texts = [t for _, t in given[at:at + 20]]
            for text, ids in zip(texts, own.encode(pa.array(texts)), strict=True):
                assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids
    assert len(own.where) == len(own.start) == len(own.size) and own.size.sum() == len(own.flat)


def test_tokens_of_a_cased_tokenizer(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not packing.Tokens.at(path).by_word and packing.Tokens.at(PATH).by_word
    out = packing.pack_documents(spark.createDataFrame([(1, "Hello World. Ok")], "doc_id long, text string"), path, end_id=50256)
    ids = [i for r in sorted(out.collect(), key=lambda r: r.start) for i in np.frombuffer(bytes(r.ids), "<u4").tolist()]
    assert ids == Tokenizer.from_file(path).encode("Hello World. Ok", add_special_tokens=False).ids + [50256]


def corpus_weights(docs):
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]).astype(int))
    idf = np.array([max(0.0, np.log((len(docs) - c + 0.5) / (c + 0.5))) for c in df])
    return idf, sum(map(len, docs)) / len(docs)


def plain_pack(docs, idf, mean, window, k1=1.2, b=0.75):
    """The windows, by going through every unused document for each seed."""
    def score(seed, d):
        total = 0.0
        for t in sorted(set(docs[seed].tolist())):
            tf = float((docs[d] == t).sum())
            if tf and idf[t] > 0:
                total += idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(docs[d]) / max(1.0, mean)))
        return total

    free, out, seq, room, seed, rest = list(range(len(docs))), [], [], window, None, None
    while free or rest:
        if rest is None:
            if not seq:
                d = seed = free[0]
            else:
                d = max(free, key=lambda x: (score(seed, x), -x))
            free.remove(d)
            rest = (d, 0)
        d, at = rest
        n = min(room, len(docs[d]) - at)
        seq.append((d, at, n))
        room -= n
        rest = (d, at + n) if at + n < len(docs[d]) else None
        if not room:
            out.append(seq)
            seq, room, seed = [], window, d
    return out, seq


def test_bm25_and_pack_near():
    rng = np.random.default_rng(1)
    docs = [np.r_[rng.integers(0, 50, 30) + 100 * (k % 4), 2].astype(np.uint16) for k in range(40)]
    idf, mean = corpus_weights(docs)
    scores = packing.Bm25(docs, idf, mean).scores(5)
    assert set(np.argsort(-scores)[:10]) == set(range(1, 40, 4))
    seqs = list(packing.pack(docs, idf, mean, 256))
    assert sum(n for s in seqs for _, _, n in s) == sum(map(len, docs))
    first = {d % 4 for d, _, _ in seqs[0]}
    assert len(first) == 1


@pytest.mark.parametrize("seed", range(4))
def test_pack_as_plain(seed):
    rng = np.random.default_rng(seed)
    docs = [np.r_[rng.integers(3, 90, rng.integers(0, 60)), 2].astype(np.uint16) for _ in range(60)]
    idf, mean = corpus_weights(docs)
    full, last = plain_pack(docs, idf, mean, 64)
    got = list(packing.pack(docs, idf, mean, 64))
    assert got[:len(full)] == full and sum(n for s in got[len(full):] for _, _, n in s) == sum(n for _, _, n in last)


def test_twins_meet(spark):
    """Documents alike, though in different hash shards, come together."""
    rng = random.Random(9)
    docs = []
    for k in range(150):
        w = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(120)]
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:-4] + ["other", "end"]))]
    out = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), PATH, shard_tokens=9000).collect()
    where = {}
    for r in out:
        where.setdefault(r.doc_id, set()).add(r.sequence_id)
    assert len({r.sequence_id >> 32 for r in out}) > 5
    assert sum(bool(where[2 * k] & where[2 * k + 1]) for k in range(150)) >= 120


def test_packing_copies(spark):
    """Copies of a text under many ids, and rows that repeat in whole, are cut into shards."""
    text = " ".join(f"word{k}" for k in range(200))
    df = spark.range(400).selectExpr("if(id % 2 = 0, id, NULL) AS doc_id", f"'{text}' AS text")
    out = packing.pack_documents(df, PATH, shard_tokens=20_000).collect()
    n = len(next(packing.Tokens.at(PATH).encode(pa.array([text])))) + 1
    assert sum(r.length for r in out) == 400 * n and len({r.sequence_id >> 32 for r in out}) > 3
    check_packed([], out)


# -- mixing -----------------------------------------------------------------

def test_water_fill():
    assert mixing.water_fill([10, 10], [1, 1], 1.5, 2) == [15, 15]
    assert mixing.water_fill([10, 100], [3, 1], 1.5, 2) == [20, 145]
    assert mixing.water_fill([0, 5], [3, 1], 1.5, 2) == [0, 7.5]
    assert mixing.water_fill([], [], 1.5, 2) == []
    got = mixing.water_fill([1, 10, 100, 1000], [3, 1, 2, 3], 1.5, 2)
    assert sum(got) == pytest.approx(1.5 * 1111) and got[:3] == [2, 20, 200]


    rng = random.Random(4)
    for _ in range(200):
        sizes = [rng.choice([0, 1, rng.randrange(10**3), rng.randrange(10**9)]) for _ in range(rng.randrange(1, 12))]
        weights = [(3, 1, 2)[k % 3] for k in range(len(sizes))]
        assert mixing.water_fill(sizes, weights, 1.5, 2) == pytest.approx(brute.targets(sizes, weights, 1.5, 2), rel=1e-6, abs=1e-3)


def test_shard_counts_at_any_size():
    for totals, shard in (([5000, 0, 1, 70_000], 4096), ([3 * 10**9, 10**9, 7], 4 * 10**6), ([10**12, 10**10], 10**9), ([], 5), ([0], 5)):
        got = list(mixing.shard_counts(totals, shard, 3))
        assert sum(got, np.zeros(len(totals), dtype=np.int64)).tolist() == totals
        assert all(0 < g.sum() <= shard and (g >= 0).all() for g in got)
        if sum(totals) > 10 * shard:  # the first shards follow the totals
            share = sum(got[:8])[0] / sum(g.sum() for g in got[:8])
            assert share == pytest.approx(totals[0] / sum(totals), abs=0.05)


def test_permutation():
    for n in (1, 2, 3, 63, 64, 65, 1000):
        k = np.arange(n)
        for key in (1, 99):
            assert sorted(mixing.permuted(k, np.full(n, n), np.full(n, key))) == list(range(n))
    assert (mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 1)) != np.arange(1000)).mean() > 0.9


def test_mixing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: (r.source, len(brute.WORD.findall(r.text or ""))) for r in docs.collect()}
    got = {r.doc_id: r for r in mixing.taken(mixing.mix(docs)).collect()}
    sums = {}
    for i, r in got.items():
        assert r.size == text[i][1] and r.taken <= 2 * r.size
        s = sums.setdefault(text[i][0], [0, 0, r.target, r.source_size])
        s[0], s[1] = s[0] + r.size, s[1] + r.taken
    names = sorted(sums)
    want = mixing.water_fill([sums[s][0] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5, 2)
    for s, t in zip(names, want):
        assert sums[s][2] == t and sums[s][3] == sums[s][0] and abs(sums[s][1] - t) <= 64
    assert sorted(rows(mixing.taken(mixing.mix(docs.repartition(7))))) == sorted(map(tuple, got.values()))


def test_mixed_documents(spark, odd, odd_rows, repeated, empty):
    m = mixing.mix(odd, block=4)
    taken = {r.doc_id: r.taken for r in mixing.taken(m).collect()}
    out = mixing.mixed_documents(odd, m)
    assert out.columns == odd.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(brute.WORD.findall(r.text))
    assert words == {i: n for i, n in taken.items() if n}
    got = mixing.taken(mixing.mix(repeated)).collect()
    assert len(got) == 14 and all(r.taken <= 2 * r.size for r in got)
    assert rows(mixing.taken(mixing.mix(empty))) == [] and rows(mixing.mixed_documents(empty, mixing.mix(empty))) == []


def joins_of_slots(df):
    """The kinds of join by source and block number in the plan that ran."""
    return set(re.findall(r"(\w+) \[_s#\d+L, _b#\d+L\], \[_s", df._jdf.queryExecution().executedPlan().toString()))


def test_slots_are_not_sent_to_the_driver(spark):
    """A few rows of draws are expanded to very many slots: F3."""
    docs = spark.createDataFrame([(i, f"w{i} " * 300, f"s{i % 2}") for i in range(60)], "doc_id long, text string, source string")
    got = mixing.mix(docs).pieces
    assert got.count() > 0 and got.collect() and joins_of_slots(got) == {"SortMergeJoin"}


def test_draws_are_made_on_an_executor():
    """As shard_counts has them, a batch for each shard, each source's slots numbered on."""
    slots, blocks = np.array([500, 0, 7, 90_000]), np.array([300, 0, 7, 60_000])
    want, first = list(mixing.shard_counts(slots.tolist(), 4096, 3)), np.zeros(4, dtype=np.int64)
    got = list(mixing._drawn(iter([]), blocks, slots, 4096, 3))
    assert len(got) == len(want) > 20
    for k, (b, n) in enumerate(zip(got, want, strict=True)):
        at = np.flatnonzero(n)
        assert b.to_pydict() == {"_s": at.tolist(), "blocks": blocks[at].tolist(), "shard": [k] * len(at),
                                 "first": first[at].tolist(), "slots": n[at].tolist()}
        first += n
    assert list(mixing._drawn(iter([]), blocks, np.zeros(4, dtype=np.int64), 4096, 3)) == []


# -- archives ---------------------------------------------------------------

def test_warc(spark):
    big = "<p>é" * 400
    pages = [(1, "http://a/1", big), (2, "http://a/ 2\r\nX: y", big), (3, None, None), (4, "u", "small"), (5, "u", "small"),
             (6, "u", big), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 200), (None, "n", big), (8, "l", "long" * 500_000), (6, "u", big),
             (9, "u", "")]
    df = spark.createDataFrame([(*p, "resp", 3) for p in pages], "page_id long, url string, html string, record_type string, _id int")
    manifest = warc.write_archives(df.repartition(3))
    got = warc.read_archives(manifest).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == sorted(
        [(1, "revisit", 6), (2, "revisit", 6), (3, "response", None), (4, "response", None), (5, "response", None),
         (6, "response", None), (6, "response", None), (7, "response", None), (0, "revisit", 6), (8, "response", None),
         (9, "response", None)])
    html = {p: (h or "").encode() for p, _, h in pages}
    for r in got:
        assert r.payload_bytes == len(html[r.page_id]) and r.payload_digest == hashlib.sha1(html[r.page_id]).hexdigest()
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None:
            assert bytes(r.payload) == html[r.page_id]
    assert {r.url for r in got if r.page_id == 2} == {"http://a/%202%0D%0AX:%20y"}
    # any gzip reader sees one text of records
    files, at = warc.open_fs(manifest.first().path)
    assert gzip.decompress(files.open_input_stream(at, compression=None).read()).startswith(b"WARC/1.1\r\n")
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert rows(warc.read_archives(warc.write_archives(none))) == []


def test_warc_damage():
    a = warc.record(1, "u", b"x" * 5000, None, False)
    b = warc.record(2, "u", b"y" * 200_000, None, False)
    assert [r["page_id"] for r in warc.read_records(io.BytesIO(a + b))] == [1, 2]
    for broken in (a[:-9], a[:40], a + b"junk", gzip.compress(gzip.decompress(a)[:-4]),
                   gzip.compress(gzip.decompress(a).replace(b"xxxx", b"xxxz", 1)), gzip.compress(gzip.decompress(a) + b"!"),
                   gzip.compress(gzip.decompress(a).replace(b"Length: 5", b"Length: 6"))):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.read_records(io.BytesIO(broken)))


# -- pipeline ---------------------------------------------------------------

def test_pipeline(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line dedup", "simhash", "mixing", "packing"]
    for name, stage in cp.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = saved(stage(spark, docs, sf), "t")
        seen.append(docs.count())
        if name == "line dedup":
            assert {r.doc_id: r.text for r in docs.collect()} == brute.line_dedup(before)
        if name == "simhash":
            _, comp = brute.simhash_components(before)
            assert {r.doc_id for r in docs.collect()} == set(comp.values())
        if name == "mixing":
            size = {i: len(brute.WORD.findall(t or "")) for i, t in before}
            got = {}
            for r in docs.collect():
                got[r.doc_id] = got.get(r.doc_id, 0) + len(brute.WORD.findall(r.text))
                assert r.n_chars == len(r.text)
            assert all(n <= 2 * size[i] for i, n in got.items())
            assert sum(got.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.05)
        if name == "packing":
            want, whole = check_packed(before, docs.collect())
            assert sum(len(p[2]) for x in whole.values() for p in x) == sum(map(len, want))
        else:
            assert docs.columns == columns
    assert seen[1] <= seen[0] and seen[2] == seen[1] and seen[3] <= seen[2]


def test_pipeline_mixing_sends_no_slots_to_the_driver(spark):
    """the fourth stage, texts cut in parts."""
    import corpus_pipeline as cp

    docs = spark.createDataFrame([(i, f"w{i} " * 300, f"s{i % 2}", 9) for i in range(60)],
                                 "doc_id long, text string, source string, n_chars long")
    out = dict(cp.STAGES)["mixing"](spark, docs, "")
    assert out.collect() and joins_of_slots(out) == {"SortMergeJoin"}


def test_pipeline_odd(spark, odd, repeated, empty):
    import corpus_pipeline as cp

    for docs in (odd, repeated, empty):
        n = docs.count()
        for name, stage in cp.STAGES:
            out = saved(stage(spark, docs, "/root/testdata/sf0.001"), "t")
            if name != "packing":
                assert out.columns == docs.columns
            if name in ("toxicity", "line dedup"):
                assert out.count() <= n
            docs = out


def test_pipeline_near_copies_keep_a_row_each(spark):
    """Rows under one id or none are not copies of one another; and a copy goes
    even if its id is the root of another component."""
    import corpus_pipeline as cp

    rng = random.Random(7)
    text = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(40)]
    data = [(None, text[k], None) for k in range(10)] + [(1, text[k], None) for k in range(10, 20)]
    data += [(k, text[k], "x") for k in range(20, 30)] + [(k + 100, text[k], "x") for k in range(20, 30)]
    data += [(None, text[3], None), (1, text[12], "y"), (1, text[12], "y"), (50, text[30], None), (60, text[31], None),
             (60, text[30], None), (None, text[30], None), (70, None, None), (71, "", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(5)
    fp = {t: brute.simhash(t) for _, t, _ in data}
    comp = brute.closure(range(len(data)), [(a, b) for a in range(len(data)) for b in range(a)
                                            if (fp[data[a][1]] ^ fp[data[b][1]]).bit_count() <= 3])
    least = {}
    for k, (i, _, _) in enumerate(data):
        least[comp[k]] = min(least.get(comp[k], (True, 0)), (i is None, i or 0))
    got = cp.drop_near_copies(spark, docs, "").collect()
    assert len(got) == len(least) == 33
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(least.values())
    by_text = {fp[r.text]: r.doc_id for r in got}
    assert len(by_text) == 33 and by_text[fp[text[30]]] == 50 and by_text[fp[text[31]]] == 60
