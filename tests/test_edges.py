"""Edge cases and traps (small literal frames), checked against brute-force
Python definitions where a metric is involved."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera import fixed_values as fv
from tessera.operators import agreement as agr
from tessera.operators import columns as cols
from tessera.operators import entities as ent
from tessera.operators import labels as lab
from tessera.operators import coding
from tessera.operators import metrics as met
from tessera.operators import ranks
from tessera.operators import rows as rws
from tessera.operators import sampling as smp
from tessera.operators import text as txt


# --------------------------------------------------------------------- tags
def test_tag_coerce_grammar(spark):
    vals = ["1", "0", " ", "", None, "1.0", "x", "1d", "1_000", "inf", " 2 ", "1.7", "-1.5", ".5", "1e1"]
    df = spark.createDataFrame([(v,) for v in vals], "c string")
    got = [r.c for r in lab.normalize_tags(df, ["c"], "coerce").collect()]
    assert got == [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 2, 1, -1, 0, 10]


def test_tag_strict_blank_and_error(spark):
    ok = spark.createDataFrame([("1",), (" ",), (None,), ("0",)], "c string")
    assert [r.c for r in lab.normalize_tags(ok, ["c"], "strict").collect()] == [1, 0, 0, 0]
    bad = spark.createDataFrame([("x",)], "c string")
    with pytest.raises(Exception):
        lab.normalize_tags(bad, ["c"], "strict").collect()


# ---------------------------------------------------------------- columns
def test_drop_sentinel_keeps_nulls(spark):
    df = spark.createDataFrame([("a",), ("___",), (None,)], "`Unique ID` string")
    assert sorted(str(r[0]) for r in cols.drop_sentinel(df).collect()) == ["None", "a"]


def test_normalize_ids_half_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (None,), (float("nan"),), (-0.5,)], "x double")
    assert [r.x for r in cols.normalize_ids(df, ["x"]).collect()] == [2, 4, 0, 0, 0]


def test_triangulate_needs_both(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (0, 1.0), (None, 1.0)], "afrm int, afrm_gpt double")
    got = [r.afrm_triangulate for r in cols.triangulate(df, ["afrm"]).collect()]
    assert got == [1, 0, 0, 0]


def test_composite_indicator_truthiness(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (None, 0), (-1, 0)], "a int, b int")
    assert [r.trgt for r in cols.composite_indicator(df, ["a", "b"]).collect()] == [0, 1, 1, 1]


def test_fill_placeholders(spark):
    df = spark.createDataFrame([(" ",), (None,), ("  ",), ("x",)], "n string")
    assert [r.n for r in cols.fill_placeholders(df, ["n"]).collect()] == [".", ".", "  ", "x"]


# ------------------------------------------------------------------- text
def test_redact_terms_order_quirk(spark):
    df = spark.createDataFrame([("Daniela met Amyloid Scottish",)], "text string")
    faithful = txt.redact_terms(df, ["text"]).first().text
    assert faithful == " a met  loid  ish"
    longest = txt.redact_terms(df, ["text"], longest_first=True).first().text
    assert longest == "  met  loid  ish"
    words = txt.redact_terms(df, ["text"], word_boundary=True).first().text
    assert words == "  met Amyloid Scottish"


def test_redact_terms_special_characters(spark):
    terms = ["[x]", "a|b", "c\\d", "$5", "\\E"]
    df = spark.createDataFrame([("p [x] a|b c\\d $5 \\E q",), ("none here",)], "text string")
    got = [r.text for r in txt.redact_terms(df, ["text"], terms, token="_").collect()]
    assert got == ["p _ _ _ _ _ q", "none here"]
    fold = df.select(txt.replace_terms_fold(F.col("text"), terms, "_").alias("t")).collect()
    assert [r.t for r in fold] == got


def test_redaction_idempotent(spark):
    df = spark.createDataFrame([("Daniel <PII> x",)], "text string")
    once = txt.redact_terms(df, ["text"])
    assert once.first().text == txt.redact_terms(once, ["text"]).first().text


def test_strip_numerals_unicode(spark):
    df = spark.createDataFrame([("a1\r\n2b ٣ c",)], "text string")
    assert txt.strip_numerals(df).first().text == "a b   c"


def test_strip_tokens(spark):
    df = spark.createDataFrame([("x<|AFRM|><|REFL|>y",)], "text string")
    assert txt.strip_tokens(df).first().text == "x  y"


SPAN = "array<struct<start:int,end:int,label:string,text:string>>"


def test_redact_spans_overlap_and_order(spark):
    spans = [(0, 3, "PERSON", "abc"), (2, 5, "ORG", "cde"), (7, 8, "CARDINAL", "h"), (9, 10, "GPE", "j")]
    df = spark.createDataFrame([("abcdefghij", spans)], f"text string, spans {SPAN}")
    assert txt.redact_spans(df).first().text == " fghi "


def test_redact_entities_everywhere(spark):
    df = spark.createDataFrame([("Dan and Daniel", [(0, 3, "PERSON", "Dan")])], f"text string, spans {SPAN}")
    assert txt.redact_entities(df).first().text == "<|PII|> and <|PII|>iel"


def test_null_text_modes(spark):
    df = spark.createDataFrame([(None, [])], f"text string, spans {SPAN}")
    assert txt.redact_spans(df).first().text is None
    assert txt.redact_spans(df, null_text="nan").first().text == "nan"


def test_detect_entities_builtin(spark):
    text = "Daniela wrote to Daniel at x.y@mail.org or 555-0100; Amyloid and Danielx no."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = ent.detect_entities(df).first().spans
    got = [(s.start, s.end, s.label, s.text) for s in spans]
    assert got == [(0, 7, "PERSON", "Daniela"), (17, 23, "PERSON", "Daniel"),
                   (27, 39, "EMAIL", "x.y@mail.org"), (43, 51, "PHONE", "555-0100")]
    for s in got:
        assert text[s[0]:s[1]] == s[3]


def test_detect_entities_user_fn(spark):
    import re

    def fn(s):
        return [(m.start(), m.end(), "ORG") for m in re.finditer(r"ACME", s)]

    df = spark.createDataFrame([(1, "ACME x ACME"), (2, None)], "doc_id long, text string")
    out = ent.detect_entities(df, fn=fn).orderBy("doc_id").collect()
    assert [(s.start, s.end) for s in out[0].spans] == [(0, 4), (7, 11)]
    assert out[1].spans == []
    red = txt.redact_spans(ent.detect_entities(df, fn=fn), labels=["ORG"]).orderBy("doc_id").first()
    assert red.text == "  x  "


# -------------------------------------------------------------------- LLM
def test_parse_reply_quirks(spark):
    rows = [
        ("afrm", " afrm_1\n\nafrm_rationale: because X<|SPL|>Y\n\nafrm_explanation: Two. Lines. "),
        ("afrm", " 0\nafrm_explanation: Does not merit afrm_1."),
        ("afrm", " afrm_1"),
        ("afrm", "error"),
        ("afrm", None),
        ("afrm", "afrm_1 afrm_rationale: a afrm_rationale: b"),
    ]
    df = spark.createDataFrame(rows, "alias string, reply string")
    got = [(r.decision, r.rationale, r.explanation) for r in coding.parse_responses(df).collect()]
    assert got == [
        (1, "because X<|SPL|>Y", "Two. Lines."),
        (1, None, "Does not merit afrm_1."),  # substring quirk: decision from the explanation
        (1, None, None),
        (None, None, None),
        (None, None, None),
        (1, "a", None),
    ]


def test_parse_rerun_keeps_previous(spark):
    df = spark.createDataFrame([("afrm", "error", 1, "old", "old e")],
                               "alias string, reply string, decision int, rationale string, explanation string")
    r = coding.parse_responses(df).first()
    assert (r.decision, r.rationale, r.explanation) == (1, "old", "old e")


def test_prompt_matches_template(spark):
    from tessera.sources.codebook import codebook
    p = {r.alias: r.prompt for r in coding.build_prompts(codebook(spark)).collect()}
    a, name, definition, clar, ex = fv.CODEBOOK[0]
    expected = (fv.CODEBOOK_ROLE + fv.DEFINITION_TEMPLATE.format(name=name, definition=definition)
                + fv.INSTRUCTION_TEMPLATE.format(name=name, alias=a) + clar + ex)
    assert p[a] == expected


# -------------------------------------------------------------- agreement
def _kappa(a, b):
    n = len(a)
    classes = sorted(set(a) | set(b))
    po = sum(x == y for x, y in zip(a, b)) / n
    pe = sum((a.count(c) / n) * (b.count(c) / n) for c in classes)
    return None if pe == 1 else (po - pe) / (1 - pe)


def test_kappa_brute_force_and_symmetry(spark):
    rnd = random.Random(3)
    a = [rnd.choice([0, 1, 2]) for _ in range(300)]
    b = [x if rnd.random() < 0.6 else rnd.choice([0, 1, 2]) for x in a]
    df = spark.createDataFrame(list(zip(a, b)), "t_x int, t_y int")
    k = agr.cohen_kappa(df, ["t"], "x", "y").first().kappa
    assert k == pytest.approx(_kappa(a, b), abs=1e-6)
    df2 = spark.createDataFrame(list(zip(b, a)), "t_x int, t_y int")
    assert agr.cohen_kappa(df2, ["t"], "x", "y").first().kappa == k


def test_kappa_degenerate(spark):
    same = spark.createDataFrame([(1, 1)] * 5, "t_x int, t_y int")
    assert agr.cohen_kappa(same, ["t"], "x", "y").first().kappa is None
    one = spark.createDataFrame([(0, 0), (0, 1), (0, 0)], "t_x int, t_y int")
    assert agr.cohen_kappa(one, ["t"], "x", "y").first().kappa == 0.0


def test_value_counts_absent_is_null(spark):
    df = spark.createDataFrame([(0, 1), (0, 1)], "a int, b int")
    got = {r.value: (r.a, r.b) for r in agr.value_counts(df, ["a", "b"]).collect()}
    assert got == {0: (2, None), 1: (None, 2)}


# ----------------------------------------------------------------- ranks
def test_exact_rank_equals_global_window(spark):
    rnd = random.Random(5)
    data = [(i, rnd.choice(["a", "b", "c"])) for i in range(2000)]
    df = spark.createDataFrame(data, "k long, s string").repartition(7)
    ours = ranks.seeded_rank(df, "k", 11, by=["s"]).select("k", "rank")
    w = Window.partitionBy("s").orderBy(ranks.seeded_hash("k", 11), "k")
    ref = df.select("k", F.row_number().over(w).alias("rank"))
    assert ours.exceptAll(ref).count() == 0 and ref.exceptAll(ours).count() == 0


def test_rank_invariant_under_repartition(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a = smp.shuffle(df, 1, "k").collect()
    b = smp.shuffle(df.repartition(13), 1, "k").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_ordered_index_and_previous(spark):
    ids = sorted(random.Random(2).sample(range(10**9), 500))
    df = spark.createDataFrame([(i, str(i)) for i in ids], "k long, v string").repartition(5)
    idx = {r.k: r["index"] for r in smp.reindex(df, ["k"]).collect()}
    assert idx == {k: i for i, k in enumerate(ids)}
    prev = {r.k: r.p for r in ranks.previous_value(df, ["k"], "v", "p").collect()}
    assert prev == {k: (str(ids[i - 1]) if i else None) for i, k in enumerate(ids)}


def test_running_sums(spark):
    rnd = random.Random(9)
    data = [(rnd.random(), rnd.randint(0, 3)) for _ in range(400)]
    df = spark.createDataFrame(data, "x double, v int")
    got = {r.x: r.cs for r in ranks.running_sums(df, [F.col("x")], F.floor(F.col("x") * 16), {"cs": F.col("v")})
           .collect()}
    acc, exp = 0, {}
    for x, v in sorted(data):
        acc += v
        exp[x] = acc
    assert got == exp


# -------------------------------------------------------------- sampling
def test_sample_n_errors_and_plan(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    with pytest.raises(ValueError):
        smp.sample_n(df, 11, 1, "k")
    plan = smp.sample_n(df, 5, 1, "k", position=None)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_holdout_skips_small(spark):
    df = spark.range(10).withColumnRenamed("id", "row_id")
    assert {r.split for r in smp.holdout(df, 10).collect()} == {"train"}
    got = [r.split for r in smp.holdout(df, 3).collect()]
    assert got.count("calibrate") == 3


def test_split_quotas_and_folds(spark):
    data = [(i, 1 if i % 5 == 0 else 0) for i in range(103)]
    df = spark.createDataFrame(data, "row_id long, trgt int")
    sp = smp.stratified_split(df, 0.2).collect()
    assert len(sp) == 103 and sum(r.split == "test" for r in sp) == math.ceil(0.2 * 103)
    folds = smp.stratified_folds(df, 5).collect()
    for c in (0, 1):
        sizes = [sum(1 for r in folds if r.trgt == c and r.fold == f) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
    tiny = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "row_id long, trgt int")
    with pytest.raises(Exception):
        smp.stratified_split(tiny, 0.2).collect()


def test_augment_lineage_and_leak_free_split(spark):
    data = [(i, f"t{i}", f"r{i}" if i % 3 else None, 1 if i % 2 else 0) for i in range(60)]
    df = spark.createDataFrame(data, "row_id long, text string, rtnl string, trgt int")
    aug = rws.augment(df)
    rows = aug.collect()
    assert len(rows) == 60 + 30
    copies = [r for r in rows if r.agmt == 1]
    assert all(r.parent_id == r.row_id and r.rtnl == " " and r.seq == 1 for r in copies)
    split = rws.assemble_train(aug).collect()
    test_keys = {r.row_id for r in split if r.split == "test"}
    assert all(r.split == "train" and r.parent_id not in test_keys for r in split if r.seq == 1)


def test_flag_augmented_null_quirk_and_parent_of(spark):
    # copy of row 2 has a NULL rationale: the faithful flag misses it
    data = [(1, "a", "ra", 1), (2, "b", None, 1), (3, "ra", "x", 0)]
    df = spark.createDataFrame(data, "row_id long, text string, rtnl string, trgt int")
    aug = rws.augment(df, clear_rtnl=False).drop("agmt")
    flagged = rws.flag_augmented(aug, ["row_id", "seq"])
    got = {(r.row_id, r.seq): r.agmt for r in flagged.collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (2, 0): 0, (2, 1): 0, (3, 0): 0}
    par = {(r.row_id, r.seq): r.parent_key for r in rws.parent_of(flagged, ["row_id", "seq"]).collect()}
    assert par[(1, 1)] == 1 and par[(2, 1)] is None


# ---------------------------------------------------------------- metrics
def _ap(y, p):
    pts = sorted(set(p), reverse=True)
    total = sum(y)
    if total == 0:
        return None
    ap, prev_r = 0.0, 0.0
    for t in pts:
        tp = sum(1 for a, b in zip(y, p) if b >= t and a == 1)
        n = sum(1 for b in p if b >= t)
        r = tp / total
        ap += (r - prev_r) * (tp / n)
        prev_r = r
    return ap


def _f1_macro(y, q):
    out = []
    for c in sorted(set(y) | set(q)):
        tp = sum(1 for a, b in zip(y, q) if a == c and b == c)
        fp = sum(1 for a, b in zip(y, q) if a != c and b == c)
        fn = sum(1 for a, b in zip(y, q) if a == c and b != c)
        out.append(2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0)
    return sum(out) / len(out)


def _mcc(y, q):
    tp = sum(1 for a, b in zip(y, q) if a == 1 and b == 1)
    tn = sum(1 for a, b in zip(y, q) if a == 0 and b == 0)
    fp = sum(1 for a, b in zip(y, q) if a == 0 and b == 1)
    fn = sum(1 for a, b in zip(y, q) if a == 1 and b == 0)
    den = math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return 0.0 if den == 0 else (tp * tn - fp * fn) / den


def test_metrics_brute_force(spark):
    rnd = random.Random(4)
    y = [rnd.randint(0, 1) for _ in range(500)]
    p = [round(rnd.random(), 2) for _ in range(500)]  # many ties
    q = [int(v > 0.5) for v in p]
    df = spark.createDataFrame([("t", a, b, c) for a, b, c in zip(y, q, p)],
                               "target string, y_true int, y_pred int, y_prob double")
    m = {r.metric: r.value for r in met.evaluate_long(df).where("target = 't'").collect()}
    assert m["auprc"] == pytest.approx(_ap(y, p), abs=1e-6)
    assert m["f1_macro"] == pytest.approx(_f1_macro(y, q), abs=1e-6)
    assert m["mcc"] == pytest.approx(_mcc(y, q), abs=1e-6)


def test_metrics_single_class_and_all_ties(spark):
    df = spark.createDataFrame([("t", 0, 0, 0.3)] * 4, "target string, y_true int, y_pred int, y_prob double")
    m = {r.metric: r.value for r in met.evaluate_long(df).collect() if r.target == "t"}
    assert m == {"f1_macro": 1.0, "mcc": 0.0, "auprc": None}
    pooled = met.pooled_metrics(df).collect()
    assert [r.metric for r in pooled] == ["f1_macro"]  # AUPRC left out without positives
    ties = spark.createDataFrame([("t", 1, 1, 0.5), ("t", 0, 1, 0.5)], "target string, y_true int, y_pred int, "
                                 "y_prob double")
    assert met.average_precision(ties).first().value == 0.5


def test_cv_summary_population_std_and_nan(spark):
    df = spark.createDataFrame([(0, "t", "m", 1.0), (1, "t", "m", 3.0), (2, "t", "m", float("nan")),
                                (0, "t", "z", None)], "fold int, target string, metric string, value double")
    got = {(r.metric): (r.mean, r.std, r.n_folds) for r in met.cv_summary(df).collect()}
    assert got == {"m": (2.0, 1.0, 2)}


def test_pos_weights(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (0, 0)], "a int, b int")
    got = {r.target: r.pos_weight for r in met.pos_weights(df, ["a", "b"]).collect()}
    assert got == {"a": 2.0, "b": 1.0}


def test_weighted_bce_matches_formula(spark):
    rows = [("t", 1, 0.3), ("t", 0, -1.2), ("t", 1, 2.0)]
    df = spark.createDataFrame(rows, "target string, y_true int, logit double")
    got = met.weighted_bce(df, {"t": 2.0}).first().bce

    def sp(z):
        return math.log1p(math.exp(z))
    exp = sum(2.0 * y * sp(-z) + (1 - y) * sp(z) for _, y, z in rows) / 3
    assert got == pytest.approx(exp, abs=1e-6)


def test_encode_batch_pad_truncate(spark):
    from tessera.operators.encode import encode_batch
    df = spark.createDataFrame([(1, "a b a"), (2, "c " * 10), (3, "   ")], "k long, text string")
    out = {r.k: r for r in encode_batch(df, "k", max_len=4, overflow=False).collect()}
    assert all(len(r.input_ids) == 4 and len(r.attention_mask) == 4 for r in out.values())
    assert out[1].attention_mask == [1, 1, 1, 0] and out[1].input_ids[3] == 0
    assert out[2].attention_mask == [1, 1, 1, 1] and out[2].n_tokens == 10
    assert out[3].input_ids == [0, 0, 0, 0] and out[3].n_tokens == 0
    assert out[1].input_ids[0] == out[1].input_ids[2]


# ----------------------------------------------------------------- plans
def test_no_python_in_text_plans(spark):
    df = spark.createDataFrame([(1, "Daniel x")], "doc_id long, text string")
    plan = txt.redact_spans(ent.detect_entities(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_pushdown_reaches_scan(spark):
    from tessera.sources.io import load
    d = load(spark, "/root/testdata/sf0.001", "documents").where("lang = 'en'").select("doc_id")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def _single_partition_inputs(plan: str) -> list[str]:
    """For every ``Exchange SinglePartition``, the first operator below it
    that aggregates, windows, shuffles or scans."""
    lines = plan.splitlines()
    found = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" not in line:
            continue
        depth = len(line) - len(line.lstrip(" :+-"))
        for nxt in lines[i + 1:]:
            if len(nxt) - len(nxt.lstrip(" :+-")) <= depth:
                break
            for op in ("HashAggregate", "SortAggregate", "TakeOrderedAndProject", "Window", "Exchange hashpartitioning",
                       "FileScan", "Scan "):
                if op in nxt:
                    found.append(op)
                    break
            else:
                continue
            break
    return found


@pytest.mark.parametrize("name", ["shuffle", "seeded_rank", "stratified_split", "stratified_folds", "reindex",
                                  "average_precision", "holdout", "sample_strata", "augment", "flag_augmented",
                                  "parent_of", "training_set"])
def test_no_single_partition_over_rows(spark, name):
    import __spark_entry__ as E
    plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    below = _single_partition_inputs(plan)
    # a single-partition exchange only ever sits on an aggregated summary
    assert all(op in ("HashAggregate", "SortAggregate") for op in below), below


def test_sample_n_is_the_top_of_the_hash_order(spark):
    import hashlib
    df = spark.range(300).withColumnRenamed("id", "k").repartition(3)
    want = sorted(range(300), key=lambda k: hashlib.md5(f"5:{k}".encode()).hexdigest())
    for n in (1, 40, 299, 300):
        got = {(r.k, r.position) for r in smp.sample_n(df, n, 5, "k").collect()}
        assert got == {(k, i) for i, k in enumerate(want[:n])}
    assert smp.sample_n(df, 0, 5, "k").count() == 0
    # a hold-out labels by the same cut-off and ranks nothing
    h = smp.holdout(df, 40, 5, "k")
    assert {r.k for r in h.where("split = 'calibrate'").collect()} == set(want[:40])
    plan = h._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan


def test_by_family_keeps_copies_with_parent(spark):
    data = [(i, f"t{i}", f"r{i}", i % 2) for i in range(40)]
    aug = rws.augment(spark.createDataFrame(data, "row_id long, text string, rtnl string, trgt int"))
    aug = aug.withColumn("family", F.coalesce("parent_id", "row_id"))
    out = smp.by_family(smp.stratified_folds, aug, "family", F.col("agmt") == 0, 4, key="row_id").collect()
    fold_of = {r.row_id: r.fold for r in out if r.seq == 0}
    assert len(out) == 60
    assert all(r.fold == fold_of[r.parent_id] for r in out if r.seq == 1)


def test_code_requests_with_fake_client(spark):
    from tessera.sources.codebook import codebook

    def client(system, user):
        if "boom" in user:
            raise RuntimeError("down")
        alias = "afrm" if '"Affirm,"' in system else "agnt"
        return f"{alias}_1\n\n{alias}_rationale: {user}\n\n{alias}_explanation: ok."

    docs = spark.createDataFrame([(1, "glad you asked"), (2, "boom")], "doc_id long, text string")
    req = coding.request_table(docs, codebook(spark, aliases=["afrm", "agnt"]), "doc_id")
    replies = coding.code_requests(req, client, "doc_id")
    got = {(r.doc_id, r.alias): (r.decision, r.rationale) for r in coding.parse_responses(replies).collect()}
    assert got[(1, "afrm")] == (1, "glad you asked") and got[(1, "agnt")] == (1, "glad you asked")
    assert got[(2, "afrm")] == (None, None)


def test_tag_strict_unicode_blank(spark):
    df = spark.createDataFrame([("\u00a0",), ("\u2003 \x1c",)], "c string")
    assert [r.c for r in lab.normalize_tags(df, ["c"], "strict").collect()] == [0, 0]


def test_encode_null_text(spark):
    from tessera.operators.encode import encode_batch
    df = spark.createDataFrame([(1, None), (2, "a")], "k long, text string")
    out = {r.k: r for r in encode_batch(df, "k", max_len=3).collect()}
    assert out[1].n_tokens == 0 and out[1].input_ids == [0, 0, 0]


def test_rank_keeps_null_stratum(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "k long, s string")
    got = sorted((r.k, r["rank"]) for r in ranks.seeded_rank(df, "k", 1, by=["s"]).collect())
    assert [k for k, _ in got] == [1, 2, 3]
    assert sorted(r for k, r in got if k != 3) == [1, 2]


def test_head_by_any_type_in_order(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k")).repartition(4)
    assert [r.k for r in cols.head_by(df, 30, ["k"]).collect()] == list(range(30))
    words = df.withColumn("w", F.concat(F.lit("w"), F.col("k")))
    assert [r.w for r in cols.head_by(words, 3, ["w"]).collect()] == ["w0", "w1", "w10"]


def test_encode_chunks_cover_whole_text(spark):
    from tessera.operators.encode import encode_batch
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(10))), (2, "")], "k long, text string")
    out = sorted(encode_batch(df, "k", max_len=4, overflow=True).collect(), key=lambda r: (r.k, r.chunk))
    assert [(r.k, r.chunk) for r in out] == [(1, 0), (1, 1), (1, 2), (2, 0)]
    assert sum(sum(r.attention_mask) for r in out if r.k == 1) == 10
    assert out[2].attention_mask == [1, 1, 0, 0]


def test_holdout_auto_keeps_families(spark):
    data = [(i, f"t{i}", f"r{i}", 1) for i in range(50)]
    aug = rws.augment(spark.createDataFrame(data, "row_id long, text string, rtnl string, trgt int"))
    out = smp.holdout(aug, 21).collect()
    split_of = {(r.row_id, r.seq): r.split for r in out}
    assert all(split_of[(i, 0)] == split_of[(i, 1)] for i in range(50))
    assert sum(1 for v in split_of.values() if v == "calibrate") <= 21
    rows = smp.holdout(aug, 21, group=None).collect()
    assert sum(1 for r in rows if r.split == "calibrate") == 21


def test_stale_bounds_stay_exact(spark):
    ids = list(range(-50, 300, 7))
    df = spark.createDataFrame([(i, str(i)) for i in ids], "k long, v string")
    prev = {r.k: r.p for r in ranks.previous_value(df, ["k"], "v", "p", n_buckets=8, bounds=(0.0, 10.0)).collect()}
    assert prev == {k: (str(ids[i - 1]) if i else None) for i, k in enumerate(ids)}


def test_guards_refuse_unbounded_driver_tables(spark):
    from tessera.sources.codebook import codebook
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ValueError):
        coding.request_table(docs, codebook(spark), "doc_id", max_codes=2)
    assert coding.request_table(docs, codebook(spark), "doc_id").count() == len(fv.CODEBOOK)


def test_replicate_counts(spark):
    df = spark.range(7)
    assert rws.replicate(df, 20).count() == 21
    assert rws.replicate(df, 3).count() == 7


def test_concat_rows_fills_missing(spark):
    a = spark.createDataFrame([(1, "x")], "id long, a string")
    b = spark.createDataFrame([(2, 3.0)], "id long, b double")
    got = sorted(tuple(r) for r in rws.concat_rows(a, b).collect())
    assert got == [(1, "x", None), (2, None, 3.0)]


def test_triangulate_refuses_string_tags(spark):
    df = spark.createDataFrame([("1", 1.0)], "afrm string, afrm_gpt double")
    with pytest.raises(TypeError):
        cols.triangulate(df, ["afrm"])


# ----------------------------------------------------- lineage, counts, edges
def augmented_rows(spark, n=60):
    data = [(i, f"t{i}", f"r{i}", i % 2) for i in range(n)]
    return rws.augment(spark.createDataFrame(data, "row_id long, text string, rtnl string, trgt int"))


def test_augmented_rows_have_their_own_id_and_family(spark):
    from tessera.operators import ml
    aug = augmented_rows(spark).repartition(5)
    rows = aug.collect()
    assert len({r.aug_id for r in rows}) == len(rows) == 90
    out = ml.assign_folds(aug, "row_id", 4, "trgt", 56).collect()
    assert len(out) == 90
    folds = {}
    for r in out:
        folds.setdefault(r.row_id, set()).add(r.fold)
    assert all(len(f) == 1 for f in folds.values()) and {f for s in folds.values() for f in s} == {0, 1, 2, 3}
    drawn = lambda d: {r.aug_id for r in smp.holdout(d, 20, 3, group=None).where("split = 'calibrate'").collect()}
    assert drawn(aug) == drawn(aug.repartition(2)) and len(drawn(aug)) == 20
    orphans = aug.where("not (seq = 0 and row_id = 1)")
    with pytest.raises(Exception, match="no original"):
        ml.assign_folds(orphans, "row_id", 4, "trgt", 56).collect()


def test_split_and_augment_is_assemble_train(spark):
    data = [(i, f"t{i}", f"r{i}", i % 2) for i in range(60)]
    df = spark.createDataFrame(data, "row_id long, text string, rtnl string, trgt int")
    a = {(r.row_id, r.seq, r.split) for r in rws.split_and_augment(df).collect()}
    assert a == {(r.row_id, r.seq, r.split) for r in rws.assemble_train(rws.augment(df)).collect()}


def test_replicate_new_id(spark):
    out = rws.replicate(spark.range(7).withColumnRenamed("id", "k"), 20, key="k").collect()
    assert len({r.rep_id for r in out}) == 21


def test_encode_keeps_rare_tokens_labels_and_repeated_keys(spark):
    from tessera.operators.encode import encode_batch
    df = spark.createDataFrame([(1, "a b a", 5), (1, "x y z", 6)], "k long, text string, y int")
    out = sorted(encode_batch(df, "k", max_len=4, labels=["y"]).collect(), key=lambda r: r.y)
    assert [r.n_tokens for r in out] == [3, 3] and [r.y for r in out] == [5, 6]
    ids = {i for r in out for i in r.input_ids}
    assert len(ids) == 6 and 1 not in ids


def test_kappa_large_counts_and_many_classes(spark):
    big = 10**11
    cells = spark.createDataFrame([("t", 0, 0, 6 * big), ("t", 1, 1, 3 * big), ("t", 0, 1, big), ("t", 1, 0, big)],
                                  "tag string, a int, b int, cnt long")
    n, agree, pe = 11 * big, 9 * big, (7 * 7 + 4 * 4) * big * big
    assert agr.kappa_from_cells(cells).first().kappa == pytest.approx((n * agree - pe) / (n * n - pe), abs=1e-6)
    many = spark.range(5000).select(F.lit("t").alias("tag"), F.col("id").alias("a"), F.col("id").alias("b"),
                                    F.lit(2).cast("long").alias("cnt"))
    assert agr.kappa_from_cells(many).first().kappa == 1.0


def test_missing_values_are_errors(spark):
    pairs = spark.createDataFrame([(1, 1), (None, 0)], "t_x int, t_y int")
    with pytest.raises(Exception, match="missing value"):
        agr.cohen_kappa(pairs, ["t"], "x", "y").collect()
    assert agr.cohen_kappa(pairs, ["t"], "x", "y", missing="drop").first().n == 1
    for row in ((None, 1, 0.5), (1, None, 0.5), (1, 1, None), (1, 1, float("nan"))):
        long = spark.createDataFrame([("t", 0, 0, 0.1), ("t", *row)], "target string, y_true int, y_pred int, y_prob double")
        with pytest.raises(Exception, match="missing value"):
            met.evaluate_long(long).collect()


def test_average_precision_skewed_scores(spark):
    import random
    rng = random.Random(1)
    rows = [("t", int(rng.random() < 0.1), rng.random() * (1e-4 if rng.random() < 0.95 else 1.0)) for _ in range(2000)]
    got = met.average_precision(spark.createDataFrame(rows, "target string, y_true int, y_prob double")).first().value
    order = sorted(rows, key=lambda r: -r[2])
    tp, acc = 0, 0.0
    for i, r in enumerate(order, 1):
        tp += r[1]
        acc += r[1] * tp / i
    assert got == pytest.approx(acc / tp, abs=1e-6)


def test_range_buckets_balance_and_outliers(spark):
    ids = [*range(20_000), 10**15]
    df = spark.createDataFrame([(i,) for i in ids], "k long").repartition(3)
    b = ranks._with_range_bucket(df, "k", 64)
    sizes = [r["count"] for r in b.groupBy(ranks.BUCKET).count().collect()]
    assert len(sizes) >= 60 and max(sizes) < 2 * len(ids) / len(sizes)
    got = {r.k: r["index"] for r in ranks.ordered_index(df, ["k"], n_buckets=64).collect()}
    assert got == {k: i for i, k in enumerate(sorted(ids))}


def test_strict_tags_numbers_and_large_values(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (2.7,)], "c double")
    assert [r.c for r in lab.normalize_tags(df, ["c"], "strict").collect()] == [1, 0, 0, 2]
    df = spark.createDataFrame([("3000000000",)], "c string")
    assert lab.normalize_tags(df, ["c"], "coerce").first().c == 3_000_000_000


def test_rerun_replaces_old_rationale(spark):
    df = spark.createDataFrame([("afrm", " 0", 1, "old", "old"), ("afrm", "error", 1, "old", "old"), ("afrm", None, 1, "old", "old")],
                               "alias string, reply string, decision int, rationale string, explanation string")
    got = [(r.decision, r.rationale, r.explanation) for r in coding.parse_responses(df).collect()]
    assert got == [(0, None, None), (1, "old", "old"), (1, "old", "old")]


def test_short_stratum_is_an_error(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(20)], "k long, s int")
    assert smp.sample_strata(df, "s", {0: 3, 1: 10}, 1, "k").count() == 13
    with pytest.raises(ValueError, match="stratum"):
        smp.sample_strata(df, "s", {0: 11}, 1, "k")


def test_recogniser_addresses_that_begin_with_names(spark):
    texts = ["Danielle@x.org", "Amy123@x.org wrote", "see bob@x.org.", "Amys Amy", "555-01001 555-0100", "Daniela, Daniel"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in ent.spans_long(ent.detect_entities(df)).collect():
        got.setdefault(r.doc_id, []).append((r.label, r.span_text, r.start))
    assert got == {0: [("EMAIL", "Danielle@x.org", 0)], 1: [("EMAIL", "Amy123@x.org", 0)], 2: [("EMAIL", "bob@x.org", 4)],
                   3: [("PERSON", "Amy", 5)], 4: [("PHONE", "555-0100", 10)],
                   5: [("PERSON", "Daniela", 0), ("PERSON", "Daniel", 9)]}
    red = txt.redact_spans(ent.detect_entities(df)).orderBy("doc_id").collect()
    assert red[0].text == " " and red[4].text == "555-01001  "


def test_redact_terms_nested_and_folded_agree(spark, monkeypatch):
    df = spark.createDataFrame([("abc abd ab a",), (None,)], "text string")
    terms = ["ab", "abc", "a", " "]
    a = [r.text for r in txt.redact_terms(df, ["text"], terms, token="_").collect()]
    monkeypatch.setattr(txt, "NESTED_LIMIT", 1)
    assert a == [r.text for r in txt.redact_terms(df, ["text"], terms, token="_").collect()]


def test_class_lookup_join_path(spark, monkeypatch):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else i % 3) for i in range(100)], "row_id long, trgt int")
    a = {(r.row_id, r.fold) for r in smp.stratified_folds(df, 5).collect()}
    monkeypatch.setattr(smp, "LITERAL_CLASSES", 1)
    assert a == {(r.row_id, r.fold) for r in smp.stratified_folds(df, 5).collect()}


def test_checkpoint_folder_only_falls_back_on_a_local_master():
    from types import SimpleNamespace

    from tessera.session import ensure_checkpoint_dir
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077",
                         getConf=lambda: SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: d)))
