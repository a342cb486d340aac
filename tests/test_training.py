"""The trained recogniser and the joint descent against plain versions."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import entities, joint, tagger
from tessera.plans import fixtures as fx

SMOKE = "/root/testdata/sf0.001"


# -- recogniser --------------------------------------------------------------

def plain_best(model, tokens):
    """The best tags of one line by going through all of its sequences' prefixes."""
    def seen(t):
        return t if t in model.obs else tagger._shape(t)

    def emitted(k):
        kind = seen(tokens[k])
        if kind in tagger.OPENING and (k == 0 or tokens[k - 1] in tagger.ENDS):
            kind = tagger.OPENING[kind]
        return model.obs.get(kind, len(model.obs))

    paths = {t: (int(model.move[model.obs["\n"], 0, t] + model.emit[emitted(0), t]), [t]) for t in range(len(model.tags))}
    for k in range(1, len(tokens)):
        cue = model.obs.get(seen(tokens[k - 1]), len(model.obs))
        step = {}
        for t in range(len(model.tags)):
            s, p = max(((paths[u][0] + int(model.move[cue, u, t]), u) for u in paths), key=lambda x: (x[0], -x[1]))
            step[t] = (s + int(model.emit[emitted(k), t]), paths[p][1] + [t])
        paths = step
    return max(paths.values(), key=lambda x: (x[0], [-t for t in reversed(x[1])]))


def plain_score(model, tokens, tags):
    """The score of one sequence."""
    s, cue, before = 0, model.obs["\n"], 0
    for k, (token, t) in enumerate(zip(tokens, tags)):
        kind = token if token in model.obs else tagger._shape(token)
        own = model.obs.get(kind, len(model.obs))
        if kind in tagger.OPENING and (k == 0 or tokens[k - 1] in tagger.ENDS):
            kind = tagger.OPENING[kind]
        s += int(model.move[cue, before, t] + model.emit[model.obs.get(kind, len(model.obs)), t])
        cue, before = own, t
    return s


@pytest.fixture(scope="module")
def named(spark):
    return fx.fx_named(spark, SMOKE).checkpoint()


@pytest.fixture(scope="module")
def model(named):
    return tagger.fit_tagger(named, "text", "gold")


def test_best_tags_as_plain(model, named):
    lines = [line for r in named.limit(12).collect() for line in r.text.split("\n")][:60]
    lines += ["", "Ask Qwerty Group", "We met Zzz in Xyz last week.", "A. B. C.", "x " * 400, "Please call Ab Cd at Ef Group before noon."]
    tokens = [tagger._TOKEN.findall(x) for x in lines]
    first = np.concatenate([[True] + [False] * (len(t) - 1) if t else [] for t in tokens]).astype(bool)
    flat = [x for t in tokens for x in t]
    got = model.best(*model.observe(flat, first), np.array([len(t) for t in tokens]))
    at = 0
    for t in tokens:
        mine = got[at:at + len(t)].tolist()
        at += len(t)
        if t:
            want = plain_best(model, t)
            assert plain_score(model, t, mine) == want[0] and mine == want[1]


def test_recogniser_finds_new_names(model):
    text = "Nothing here. We met Zebulon in Xanadu last week.\nPlease call Qwert Yuiop at Hjklm Group before noon."
    got = [(s["text"], s["label"]) for s in model.spans([text])[0]]
    assert got == [("Zebulon", "PERSON"), ("Xanadu", "GPE"), ("Qwert Yuiop", "PERSON"), ("Hjklm Group", "ORG")]
    assert [text[s["start"]:s["end"]] for s in model.spans([text])[0]] == [x for x, _ in got]


def test_entities_with_model(spark, model):
    rows = [(1, "We met Qwert in Amyville last week."), (2, None), (3, ""), (4, "mail a@b.org Daniel, call 555-0100"),
            (5, "é" * 50 + "\nWe met Ünal in Yxcv last week."), (6, "word " * 200_000 + "\nRegards, Poiu Lkjh")]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, model string, _tz int")
    got = {r.doc_id: [(s.text, s.label) for s in r.spans] for r in entities.detect_entities(d, model=model).collect()}
    assert got[1] == [("Qwert", "PERSON"), ("Amyville", "GPE")] and got[2] == got[3] == []
    assert {("a@b.org", "EMAIL"), ("Daniel", "PERSON"), ("555-0100", "PHONE")} <= set(got[4])
    assert ("Yxcv", "GPE") in got[5] and got[6][-1] == ("Poiu Lkjh", "PERSON")
    for r in entities.detect_entities(d, model=model).collect():
        assert all(r.text[s.start:s.end] == s.text for s in r.spans or [])


def test_flows_with_a_model(spark, model):
    from tessera import fixed_values as fv
    from tessera.plans import workflows as wf

    rows = [(k, "We met Qwertz in Asdfgh last week." if k % 2 else "Nothing.", None, *[str(k % 2)] * 9) for k in range(12)]
    d = spark.createDataFrame(rows, ", ".join(["row_id long, text string, rtnl string", *[f"{t} string" for t in fv.ALL_TAGS]]))
    out = wf.training_set(d, n_calibrate=2, model=model).where("row_id % 2 = 1").collect()
    texts = [r.text for r in out if r.text is not None]
    assert any("met" in t for t in texts) and not any("Qwertz" in t or "Asdfgh" in t for t in texts)
    packet, _ = wf.annotation_packets(d.select("row_id", "text"), 6, 1, 5, model=model)
    assert not packet.where("text like '%Qwertz%'").count()


def test_tagged_spans(spark):
    text = "Ab cd, ef-Gh é 12"
    rows = [(text, [(0, 2, "X", "Ab"), (7, 12, "Y", "ef-Gh")]), (text, [(7, 12, "Y", ""), (0, 5, "X", ""), (3, 8, "Z", ""), (1, 1, "Q", "")]),
            (text, []), (text, None), ("", []), (text, [(k, k + 1, "L", "") for k in range(17)])]
    d = spark.createDataFrame(rows, "t string, s array<struct<start:int,end:int,label:string,text:string>>")
    got = [list(zip(r.x.tokens, r.x.tags)) for r in d.select(tagger.tagged(F.col("t"), F.col("s")).alias("x")).collect()]
    o = [(t, "O") for t in ["Ab", "cd", ",", "ef", "-", "Gh", "é", "12"]]
    assert got[0] == [("Ab", "B-X"), *o[1:3], ("ef", "B-Y"), ("-", "I-Y"), ("Gh", "I-Y"), *o[6:]]
    assert got[1] == [("Ab", "B-X"), ("cd", "I-X"), (",", "O"), ("ef", "B-Y"), ("-", "I-Y"), ("Gh", "I-Y"), *o[6:]]
    assert got[2] == got[3] == o and got[4] == []
    assert got[5] == [(c, "B-L") for c in text if c != " "]


def test_span_report(spark):
    schema = "gold array<struct<start:int,end:int,label:string,text:string>>, spans array<struct<start:int,end:int,label:string,text:string>>"
    a, b, c = (0, 1, "P", "a"), (2, 3, "P", "b"), (2, 3, "Q", "b")
    d = spark.createDataFrame([([a, b], [a, c]), ([b], [b]), ([], [a]), (None, None)], schema)
    seen = spark.createDataFrame([("a",)], "text string")
    got = {r.label: r for r in tagger.span_report(d, seen=seen).collect()}
    assert (got["P"].n_gold, got["P"].n_found, got["P"].n_right, got["P"].n_new, got["P"].recall_new) == (3, 3, 2, 2, 0.5)
    assert (got["Q"].n_gold, got["Q"].n_found, got["Q"].recall) == (0, 1, None)


def test_fit_without_annotations(spark):
    d = spark.createDataFrame([("Some text.", None), (None, None)], "text string, spans array<struct<start:int,end:int,label:string,text:string>>")
    m = tagger.fit_tagger(d)
    assert m.tags == ["O"] and m.spans(["Any Name", None, ""]) == [[], [], []]


# -- joint descent -----------------------------------------------------------

def sample(n=240, seed=4):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randrange(0, 25))]
        rows.append((i, " ".join(t), int("w1" in t or "w2" in t), int(rng.random() < 0.2), rng.randrange(4)))
    return [*rows, (n, None, 0, 1, 0), (n + 1, " \n", 1, 0, 1)]


def plain_fit(rows, target, config, fold, dim):
    """One fit by itself, a row at a time."""
    own = [r for r in rows if r[4] != fold]
    bags = {}
    for r in rows:
        n = {}
        for t in re.findall("[^\t\n\x0b\f\r ]+", r[1] or ""):
            j = int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim
            n[j] = n.get(j, 0) + 1
        bags[r[0]] = {j: 1 + math.log(c) for j, c in n.items()}
    idf = [math.log((len(own) + 1) / (sum(j in bags[r[0]] for r in own) + 1)) for j in range(dim)]
    pos = sum(r[2 + target] for r in own)
    pw = (len(own) - pos) / pos if pos else 1.0

    def scaled(r):
        x = np.zeros(dim + 1)
        for j, v in bags[r[0]].items():
            x[j] = v * idf[j]
        norm = math.sqrt(float(x @ x))
        x = x / norm if norm else x
        x[dim] = 1
        return x

    w, m, s = np.zeros(dim + 1), np.zeros(dim + 1), np.zeros(dim + 1)
    steps = config["epochs"] * config["batches"]
    for step in range(steps):
        g, n = np.zeros(dim + 1), 0
        for r in own:
            if int(hashlib.md5(f"batch:{r[0]}".encode()).hexdigest()[:8], 16) % config["batches"] == step % config["batches"]:
                x = scaled(r)
                p = 1 / (1 + math.exp(-float(x @ w)))
                g += ((1 - r[2 + target]) * p - pw * r[2 + target] * (1 - p)) * x
                n += 1
        g /= n
        lr = joint.rate(config, step)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w = w * (1 - lr * config["weight_decay"]) - lr * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(s / (1 - 0.999 ** (step + 1))) + 1e-8)
    return w, pw, scaled


def test_joint_as_separate_fits(spark):
    rows, dim = sample(), 32
    feats = joint.hashed_features(spark.createDataFrame(rows, "id long, text string, a int, b int, fold int"), dim=dim)
    grid = joint.configurations({"learning_rate": [0.1, 0.3], "batches": [1, 3]}, {"epochs": 2})
    fits = joint.fit_joint(feats, "id", ["a", "b"], grid, "fold", dim)
    assert fits.weights.shape == (dim + 1, 4 * 4 * 2)
    for f in range(0, fits.weights.shape[1], 3):
        w, pw, _ = plain_fit(rows, int(fits.target[f]), grid[fits.config[f]], int(fits.fold[f]), dim)
        assert np.allclose(fits.weights[:, f], w, atol=1e-6) and math.isclose(fits.pos_weight[f], pw)
    scores = joint.score_joint(fits, feats, "id", "fold").collect()
    assert len(scores) == len(rows) * 4 * 2
    f = next(k for k in range(32) if fits.config[k] == 2 and fits.fold[k] == 1 and fits.target[k] == 0)
    _, _, scaled = plain_fit(rows, 0, grid[2], 1, dim)
    by_id = {r[0]: r for r in rows}
    mine = [r for r in scores if r.config_id == 2 and r.fold == 1 and r.target == "a"]
    assert {r.id for r in mine} == {r[0] for r in rows if r[4] == 1}
    for r in mine:
        assert abs(r.logit - float(scaled(by_id[r.id]) @ fits.weights[:, f])) < 1e-5 and r.y_true == by_id[r.id][2]


def test_joint_on_all_rows(spark):
    rows, dim = sample(), 64
    feats = joint.hashed_features(spark.createDataFrame(rows, "id long, text string, a int, b int, fold int"), dim=dim)
    fits = joint.fit_joint(feats, "id", ["a", "b"], [{"epochs": 30, "learning_rate": 0.5}], dim=dim)
    w, _, _ = plain_fit([(*r[:4], 0) for r in rows], 1, fits.configs[0], -1, dim)
    assert np.allclose(fits.weights[:, 1], w, atol=1e-6)
    loss = {(r.target, r.epoch): r.loss for r in joint.epoch_losses(fits, spark).collect()}
    assert len(loss) == 60 and loss["a", 30] < loss["a", 1]
    got = {(r.target, r.metric): r.value for r in joint.evaluate_joint(fits, feats, "id").collect()}
    assert got["a", "f1_macro"] > 0.85 and ("aggregate", "f1_macro") in got
    coefs = joint.coefficients(fits, spark).where("target = 'a'").collect()
    assert len(coefs) == dim + 1 and all(r.fold is None for r in coefs)


def test_joint_sums_on_executors(spark, monkeypatch):
    rows = sample(90)
    feats = joint.hashed_features(spark.createDataFrame(rows, "id long, text string, a int, b int, fold int"), dim=100)
    a = joint.fit_joint(feats, "id", ["a", "b"], [{"epochs": 1}], "fold", 100)
    monkeypatch.setattr(joint, "DIRECT_BYTES", 0)
    b = joint.fit_joint(feats, "id", ["a", "b"], [{"epochs": 1}], "fold", 100)
    assert np.allclose(a.weights, b.weights, atol=1e-9) and np.allclose([x[2] for x in a.losses], [x[2] for x in b.losses])


def test_joint_odd_rows(spark):
    feats = joint.hashed_features(spark.createDataFrame([(k, "x" if k % 2 else None, 0) for k in range(20)], "id long, text string, a int"))
    fits = joint.fit_joint(feats, "id", ["a"])
    assert np.isfinite(fits.weights).all() and fits.pos_weight.tolist() == [1.0]
    bad = joint.hashed_features(spark.createDataFrame([(1, "x", None), (2, "y", 1)], "id long, text string, a int"))
    with pytest.raises(Exception, match="missing label"):
        joint.fit_joint(bad, "id", ["a"])
    with pytest.raises(ValueError, match="unknown"):
        joint.configurations({"depth": [1]})


def test_rate():
    c = {"learning_rate": 2.0, "epochs": 10, "batches": 2, "warmup_ratio": 0.1}
    assert [joint.rate(c, k) for k in (0, 1, 2, 11, 19)] == [0.0, 1.0, 2.0, 1.0, pytest.approx(2 / 18)]


# -- subwords ----------------------------------------------------------------

def test_subwords(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessera.operators.encode import encode_subwords

    rows = [(1, "Hello wörld, it's 2024!"), (2, None), (3, ""), (4, "long words " * 900), (5, "<|endoftext|> é😀"), (1, "again")]
    df = spark.createDataFrame([(i, t, i % 2) for i, t in rows], "id long, text string, y int").repartition(3)
    for name, first, last in (("word_bpe_49k.json", 49406, 49407), ("byte_bpe_50k.json", None, 50256)):
        tok = Tokenizer.from_file(public_tokenizers.path(name))
        got = {}
        for r in encode_subwords(df, "id", public_tokenizers.path(name), max_len=64, labels=["y"], first=first, last=last).collect():
            n = sum(r.attention_mask)
            assert len(r.input_ids) == len(r.attention_mask) == 64 and r.attention_mask == [1] * n + [0] * (64 - n) and r.y == r.id % 2
            assert set(r.input_ids[n:]) <= {0} and r.input_ids[n - 1] == last and (first is None or r.input_ids[0] == first)
            got.setdefault((r.id, r.n_tokens), {})[r.chunk] = r.input_ids[first is not None:n - 1]
        want = [(i, tok.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
        assert sorted((i, [x for k in sorted(c) for x in c[k]]) for (i, _), c in got.items()) == sorted(want)
        cut = encode_subwords(df, "id", public_tokenizers.path(name), max_len=64, overflow=False).collect()
        assert len(cut) == len(rows) and all("chunk" not in r for r in cut)
    with pytest.raises(ValueError):
        encode_subwords(df, "id", "none", max_len=2, first=1, last=2)


# -- large term lists --------------------------------------------------------

def test_term_list_as_sequential():
    from tessera.operators.termlist import TermList

    rng = random.Random(6)
    for trial in range(3000):
        chars = rng.choice(["ab", "ab _", "abc_"])
        terms = ["".join(rng.choice(chars) for _ in range(rng.randrange(0, 5))) for _ in range(rng.randrange(0, 9))]
        token = rng.choice(["_", " ", "", "a", "ba", "_a"])
        text = "".join(rng.choice(chars) for _ in range(rng.randrange(0, 40)))
        want = text
        for t in terms:
            want = want.replace(t, token) if t else want
        assert TermList(terms, token).replace(text) == want, (terms, token, text)


def test_redact_term_list(spark):
    from tessera.operators import termlist
    from tessera.operators import text as txt

    rng = random.Random(1)
    terms = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7))) for _ in range(600)] + ["a\U0001f600", "b c"]
    rows = [(k, "".join(rng.choice("abcdé \U0001f600") for _ in range(rng.randrange(200)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "abcdé" * 40_000)]
    df = spark.createDataFrame([(*r, r[1], "x") for r in rows], "id long, text string, rtnl string, terms string")
    want = {}
    for k, t in rows:
        for x in terms:
            t = t.replace(x, " ") if t is not None else t
        want[k] = t
    for out in (txt.redact_terms(df, terms=terms), termlist.redact_term_list(df, ["text", "rtnl"], terms, most=500)):
        assert out.columns == df.columns
        got = out.collect()
        assert {r.id: r.text for r in got} == want and all(r.text == r.rtnl for r in got)
    assert [len(b) for b in termlist.blocks(["aa", "b", "cccc", "d"], 3)] == [2, 1, 1] and termlist.blocks([]) == []
    fold = df.where("id < 60").select("id", txt.redact_terms_expr("text", terms).alias("t")).collect()
    assert {r.id: r.t for r in fold} == {k: want[k] for k in range(60)}


# -- folds balanced in several labels ----------------------------------------

def test_multilabel_folds(spark):
    from tessera.operators.sampling import deal_label_sets, multilabel_folds

    rng = random.Random(3)
    rows = [(k, int(rng.random() < 0.05), int(rng.random() < 0.4), int(rng.random() < 0.2)) for k in range(401)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "row_id long, a int, b int, c int, fold2 string")
    got = {r.row_id: r.fold for r in multilabel_folds(df, ["a", "b", "c"], 5).collect()}
    assert got == {r.row_id: r.fold for r in multilabel_folds(df.repartition(7), ["a", "b", "c"], 5).collect()}
    assert set(got) == set(range(401)) and set(got.values()) == set(range(5))
    for pick in ([r for r in rows if r[1]], [r for r in rows if r[2]], [r for r in rows if r[3]], rows):
        per = [sum(got[r[0]] == f for r in pick) for f in range(5)]
        assert max(per) - min(per) <= 2
    assert multilabel_folds(df.limit(0), ["a"], 5).isEmpty()
    with pytest.raises(Exception, match="neither 0 nor 1"):
        multilabel_folds(df.withColumn("a", F.lit(None).cast("int")), ["a", "b"]).collect()
    with pytest.raises(ValueError):
        multilabel_folds(df, [])
    for _ in range(300):
        k, sets = rng.choice([2, 3, 5]), {}
        for _ in range(rng.randrange(1, 200)):
            s = "".join(rng.choice("001") for _ in range(3))
            sets[s] = sets.get(s, 0) + 1
        dealt = deal_label_sets(sets, k)
        assert {s: b * k + len(m) for s, (b, m) in dealt.items()} == sets
        assert all(len(set(m)) == len(m) < k and set(m) <= set(range(k)) for _, m in dealt.values())
        for i in range(4):
            per = [sum(b + (f in m) for s, (b, m) in dealt.items() if i == 3 or s[i] == "1") for f in range(k)]
            assert max(per) - min(per) <= 3


# -- what a worker holds -----------------------------------------------------

def test_text_parts():
    import pyarrow as pa

    from tessera.functions.batches import text_parts

    texts = ["a" * 10, None, "", "é" * 6, "b" * 100, "c", None]
    for most in (0, 1, 12, 25, 1000):
        for given in (pa.array(texts, pa.string()), pa.array(["x", *texts], pa.large_string()).slice(1)):
            parts = list(text_parts(given, most))
            assert [t for p in parts for t in p] == texts
            assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= most for p in parts)
    assert list(text_parts(pa.array([], pa.string()))) == []


def test_large_batches_go_in_parts(spark, monkeypatch):
    """A worker makes features and ids of a bounded part of a batch at a time."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tessera.operators import encode

    path = public_tokenizers.path("word_bpe_49k.json")
    assert not hasattr(encode, "TEXTS_AT_ONCE")
    texts = ["word%d " % k * 20_000 for k in range(40)] + [None, ""]
    sizes = []
    given = pa.array(texts)
    real = Tokenizer.from_file(path)

    class Seen:
        def encode_batch_fast(self, some, add_special_tokens):
            sizes.append(sum(map(len, some)))
            return real.encode_batch_fast(some, add_special_tokens=add_special_tokens)

    monkeypatch.setitem(encode._OPEN, path, Seen())
    monkeypatch.setattr(encode.F, "arrow_udf", lambda kind: lambda f: lambda col: f)  # joint's too: one module
    out = [x for a in encode.subword_ids("text", path)(iter([given])) for x in a.to_pylist()]
    assert out == [real.encode(t or "", add_special_tokens=False).ids for t in texts] and len(sizes) > 3 and max(sizes) <= 1 << 20
    seen = []
    hashed = joint._hashed
    monkeypatch.setattr(joint, "_hashed", lambda some, *a: seen.append(sum(len(t or "") for t in some)) or hashed(some, *a))
    monkeypatch.setattr(joint, "ensure_checkpoint_dir", lambda s: None)

    class Frame:
        sparkSession = None

        def __getattr__(self, name):
            return lambda *a, **k: self

        def withColumn(self, name, run):
            self.run = run
            return self

    held = Frame()
    monkeypatch.setattr(joint.F, "col", lambda c: c)
    joint.hashed_features(held)
    got = [x for a in held.run(iter([given])) for x in a.to_pylist()]
    want = hashed(texts, joint.DIM, {}).to_pylist()
    assert got == want and len(seen) > 3 and max(seen) <= 1 << 20
    assert want[0] == {"idx": want[0]["idx"], "val": [1 + math.log(20_000)]} and want[-1] == want[-2] == {"idx": [], "val": []}


def test_tagger_codes_each_token_once(spark, model, monkeypatch):
    """Shapes are found once for each distinct token, whatever the texts repeat."""
    import pickle

    calls = []
    shape = tagger._shape
    monkeypatch.setattr(tagger, "_shape", lambda t: calls.append(t) or shape(t))
    fresh = pickle.loads(pickle.dumps(model))
    texts = ["Zzyzx met Qwertyu. Vvv at 12345\nAsk Zzyzx", None, ""] * 50
    assert fresh.spans(texts) == model.spans(texts) and "_kept" not in pickle.loads(pickle.dumps(fresh)).__dict__
    fresh._kept.clear()
    calls.clear()
    fresh.spans(texts)
    assert calls and len(calls) == len(set(calls))
