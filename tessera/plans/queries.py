"""The query registry: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the survey's inventory, each over the whole given tables (or
fixture views Spark derives from them). Computed columns carry the same
names as in :mod:`tessera.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import agreement as agr
from ..operators import coding
from ..operators import columns as cols
from ..operators import encode as enc
from ..operators import entities as ent
from ..operators import grid as grd
from ..operators import labels as lab
from ..operators import metrics as met
from ..operators import rows as rws
from ..operators import sampling as smp
from ..operators import tagger as tag
from ..operators import text as txt
from ..sources import io as sio
from ..sources.codebook import codebook
from ..sources.io import load
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def q(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


TAG_CELLS = [f"{t}_{s}" for t in fv.ALL_TAGS for s in ("r1", "r2")]


def coerced_annot(spark, base) -> DataFrame:
    a = fx.fx_annot(spark, base)
    return lab.normalize_tags(a, TAG_CELLS, "coerce")


def cycle_of(id_col) -> F.Column:
    return (F.conv(F.substring(F.md5(F.concat(F.lit("cycle:"), id_col)), 1, 1), 16, 10).cast("int") % 4)


def rater_sheet(spark, base, who: str) -> DataFrame:
    a = fx.fx_annot(spark, base)
    return a.select("doc_id", *[F.col(f"{t}_{who}").alias(t) for t in fv.ALL_TAGS], "rtnl")


# --------------------------------------------------------------------------
# agreement
# --------------------------------------------------------------------------

@q("cohen_kappa")
def q_cohen_kappa(spark, base):
    """Flagship: two raters' sheets -> lenient tags -> pair on the row key ->
    kappa for nine tags."""
    r1 = lab.normalize_tags(rater_sheet(spark, base, "r1"), fv.ALL_TAGS, "coerce")
    r2 = lab.normalize_tags(rater_sheet(spark, base, "r2"), fv.ALL_TAGS, "coerce")
    paired = agr.pair_annotators(r1, r2, "doc_id", "r1", "r2")
    return agr.cohen_kappa(paired, fv.ALL_TAGS, "r1", "r2")


@q("kappa_multiclass")
def q_kappa_multiclass(spark, base):
    ev = load(spark, base, "events")
    flip = F.substring(F.md5(F.concat(F.lit("kmc:"), F.col("event_id").cast("string"))), 1, 1) < "c"
    d = ev.select(F.col("event_type").alias("event_type_a"),
                  F.when(flip, F.col("event_type")).otherwise(F.lit("view")).alias("event_type_b"))
    return agr.cohen_kappa(d, ["event_type"], "a", "b")


@q("kappa_corrections")
def q_kappa_corrections(spark, base):
    """Tags as a stream: first answers, a quarter of the second rater's wrong, then corrections, then old events again."""
    from ..streaming import corrected_kappa, kappa_corrections
    path, sink = scratch_path(spark, "events"), scratch_path(spark, "kappa")
    wide = coerced_annot(spark, base)
    answers = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(who).alias("rater"), F.col(f"{t}_{s}").cast("int").alias("value"))
                        for t in fv.ALL_TAGS for s, who in (("r1", "a"), ("r2", "b"))])
    right = wide.select(F.col("doc_id").alias("key"), F.inline(answers))
    wrong = (F.col("rater") == "b") & (F.substring(F.md5(F.concat("tag", F.col("key").cast("string"))), 1, 1) < "4")
    first = right.withColumn("value", F.when(wrong, 1 - F.col("value")).otherwise(F.col("value"))).withColumn("seq", F.lit(1).cast("long"))
    files = max(4, spark.sparkContext.defaultParallelism)  # of each part: every core reads one
    for part in (first, right.where(wrong).withColumn("seq", F.lit(2).cast("long")), first.where(wrong)):
        part.repartition(files).write.mode("append").parquet(path)
    events = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", files).parquet(path)
    query = kappa_corrections(events, sink, scratch_path(spark, "state"))
    query.awaitTermination()
    return corrected_kappa(spark, sink)


@q("pair_annotators")
def q_pair_annotators(spark, base):
    return agr.pair_annotators(rater_sheet(spark, base, "r1"), rater_sheet(spark, base, "r2"), "doc_id", "r1", "r2")


@q("tags_coerce")
def q_tags_coerce(spark, base):
    return coerced_annot(spark, base).select("doc_id", *TAG_CELLS)


@q("tags_strict")
def q_tags_strict(spark, base):
    a = fx.fx_annot(spark, base)
    # strict mode accepts only integer literals and blanks: map the lenient-only
    # cells first, as the fixture definition asks
    fixed = a.withColumns({c: F.when(F.col(c) == "1.0", "1").when(F.col(c) == "x", "0").otherwise(F.col(c))
                           for c in TAG_CELLS})
    return lab.normalize_tags(fixed, TAG_CELLS, "strict").select("doc_id", *TAG_CELLS)


@q("disagreements")
def q_disagreements(spark, base):
    d = cols.disagreements(coerced_annot(spark, base), fv.ALL_TAGS, "r1", "r2")
    return d.select("doc_id", *[f"{t}_dis" for t in fv.ALL_TAGS])


@q("value_counts")
def q_value_counts(spark, base):
    return agr.value_counts(coerced_annot(spark, base), TAG_CELLS)


@q("reliability_trend")
def q_reliability_trend(spark, base):
    d = coerced_annot(spark, base).withColumn("cycle", cycle_of(F.col("id")))
    return agr.reliability_trend(d, fv.ALL_TAGS, "r1", "r2", "cycle")


# --------------------------------------------------------------------------
# sources, projections, filters
# --------------------------------------------------------------------------


@q("read_responses")
def q_read_responses(spark, base):
    return sio.read_table(spark, sio.table_path(base, "documents"), row_id="doc_id").select(
        "row_id", "text", "lang", "source", "n_chars")


@q("profile")
def q_profile(spark, base):
    return sio.profile(load(spark, base, "documents"))


@q("drop_columns")
def q_drop_columns(spark, base):
    return cols.drop_columns(fx.fx_sheet(spark, base), fv.RAW_SHEET_DROP + ["not_there"])


@q("suffix_columns")
def q_suffix_columns(spark, base):
    return cols.suffix_columns(rater_sheet(spark, base, "r2"), "_r2", keep=["doc_id"])


@q("blank_tags")
def q_blank_tags(spark, base):
    d = fx.fx_annot(spark, base).select("doc_id", "text")
    return cols.assign_blank(d, fv.CYCLE_TAG_COLUMNS, " ")


@q("drop_sentinel")
def q_drop_sentinel(spark, base):
    return cols.drop_sentinel(fx.fx_sheet(spark, base), "Unique ID").select("row_id", "`Unique ID`")


@q("normalize_ids")
def q_normalize_ids(spark, base):
    return cols.normalize_ids(fx.fx_sheet(spark, base), ["EmailPairID", "WithinPatientID", "MHP ID"]).select(
        "row_id", "EmailPairID", "WithinPatientID", "`MHP ID`")


@q("condense_responses")
def q_condense_responses(spark, base):
    return cols.condense_responses(fx.fx_sheet(spark, base), pilot=1)


@q("theme_subset")
def q_theme_subset(spark, base):
    return cols.any_positive(fx.fx_train(spark, base), fv.THEMES).select("doc_id", *fv.THEMES)


@q("head_by")
def q_head_by(spark, base):
    return cols.head_by(fx.fx_train(spark, base).select("doc_id", "afrm", "trgt"), 899, ["doc_id"])


@q("composite_indicator")
def q_composite_indicator(spark, base):
    return fx.fx_train(spark, base).select("doc_id", *fv.TARGETS, "trgt")


def triangulated(spark, base) -> DataFrame:
    human = fx.fx_train(spark, base).select("doc_id", "text", "rtnl", *fv.ALL_TAGS)
    parsed = coding.parse_responses(fx.fx_reply(spark, base))
    wide = coding.replies_wide(parsed, "doc_id", fv.LLM_CODES)
    return cols.triangulate(human.join(wide, "doc_id", "left"), fv.LLM_CODES)


@q("triangulate")
def q_triangulate(spark, base):
    return triangulated(spark, base).select(
        "doc_id", *[x for c in fv.LLM_CODES for x in (c, f"{c}_gpt", f"{c}_triangulate")])


def _three_raters(spark, base):
    """Two people and the model, on the codes that the model was asked for."""
    a = coerced_annot(spark, base).select("doc_id", *[f"{c}_{s}" for c in fv.LLM_CODES for s in ("r1", "r2")])
    m = triangulated(spark, base).select("doc_id", *[F.col(f"{c}_gpt").cast("int").alias(f"{c}_gpt") for c in fv.LLM_CODES])
    return a.join(m, "doc_id")


@q("rater_errors")
def q_rater_errors(spark, base):
    from ..operators import rater_error
    return rater_error.rater_errors(_three_raters(spark, base), fv.LLM_CODES, ["r1", "r2", "gpt"], iterations=20)[0]


@q("triangulate_by_error")
def q_triangulate_by_error(spark, base):
    from ..operators import rater_error
    d = rater_error.triangulate_by_error(_three_raters(spark, base), fv.LLM_CODES, ["r1", "r2", "gpt"], iterations=20)
    return d.select("doc_id", *[x for c in fv.LLM_CODES for x in (f"{c}_p_yes", f"{c}_triangulate")])


@q("kappa_intervals")
def q_kappa_intervals(spark, base):
    return agr.kappa_intervals(coerced_annot(spark, base), fv.ALL_TAGS, "r1", "r2", "doc_id", reps=100)


@q("finalize_triangulated")
def q_finalize_triangulated(spark, base):
    return cols.finalize_triangulated(triangulated(spark, base)).drop("text", "rtnl")


@q("fill_placeholders")
def q_fill_placeholders(spark, base):
    d = fx.fx_annot(spark, base).select("doc_id", F.col("afrm_r1").alias("note"), "rtnl")
    return cols.fill_placeholders(d, ["note", "rtnl"])


# --------------------------------------------------------------------------
# text
# --------------------------------------------------------------------------

def text_and_rationale(spark, base) -> DataFrame:
    return fx.fx_text_rtnl(spark, base)


@q("redact_terms")
def q_redact_terms(spark, base):
    return txt.redact_terms(text_and_rationale(spark, base), ["text", "rtnl"])


@q("redact_terms_large")
def q_redact_terms_large(spark, base):
    """A list taken from the data: the words of eight letters and more in ``benchmark``, in an order that lets them overlap."""
    w = load(spark, base, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{8,}"), F.lit(0))).alias("t")).distinct()
    terms = [r.t for r in w.orderBy(F.md5("t"), "t").collect()]  # a term list lives on the driver (S2)
    return txt.redact_terms(load(spark, base, "documents").select("doc_id", "text"), ["text"], terms, token="_")


@q("strip_numerals")
def q_strip_numerals(spark, base):
    return txt.strip_numerals(load(spark, base, "documents").select("doc_id", "text"), "text")


@q("strip_tokens")
def q_strip_tokens(spark, base):
    return txt.strip_tokens(fx.fx_text(spark, base), "text")


@q("detect_entities")
def q_detect_entities(spark, base):
    return ent.spans_long(ent.detect_entities(fx.fx_text(spark, base)), "doc_id")


@q("tagger_counts")
def q_tagger_counts(spark, base):
    """What the recogniser learns from all annotated texts."""
    emission, transition = tag.tag_counts(fx.fx_named(spark, base), "text", "gold")
    none = F.lit(None).cast("string")
    return emission.select(F.lit("emission").alias("kind"), none.alias("prev"), "tag", F.col("obs").alias("seen"), "n").unionByName(
        transition.select(F.lit("transition").alias("kind"), "prev", "tag", F.col("cue").alias("seen"), "n"))


def _tagger_rows(spark, base):
    d = fx.fx_named(spark, base)
    return d, F.substring(F.md5(F.concat(F.lit("tagger:"), F.col("doc_id").cast("string"))), 1, 1) < "8"


@q("tagger_entities")
def q_tagger_entities(spark, base):
    """Spans that a recogniser trained on half of the documents finds in all."""
    d, train = _tagger_rows(spark, base)
    found = ent.detect_entities(d, model=tag.fit_tagger(d.where(train), "text", "gold"))
    return ent.spans_long(found, "doc_id")


@q("tagger_report")
def q_tagger_report(spark, base):
    """Precision, recall and F1 on the half that was not trained on."""
    d, train = _tagger_rows(spark, base)
    learn = d.where(train)
    found = tag.tag_entities(d.where(~train), tag.fit_tagger(learn, "text", "gold"))
    return tag.span_report(found, seen=learn.select(F.explode("gold.text").alias("text")))


@q("redact_spans")
def q_redact_spans(spark, base):
    d = ent.detect_entities(fx.fx_text(spark, base))
    return txt.redact_spans(d, "text", "spans").select("doc_id", "text")


@q("redact_entities")
def q_redact_entities(spark, base):
    d = ent.detect_entities(fx.fx_text(spark, base))
    return txt.redact_entities(d, "text", "spans").select("doc_id", "text")


# --------------------------------------------------------------------------
# LLM request / reply tables
# --------------------------------------------------------------------------

@q("request_table")
def q_request_table(spark, base):
    return coding.request_table(load(spark, base, "benchmark"), codebook(spark), "item_id")


@q("build_prompts")
def q_build_prompts(spark, base):
    # prompts as used: the distinct system prompts of the request table
    req = coding.request_table(load(spark, base, "benchmark"), codebook(spark, aliases=fv.LLM_CODES), "item_id")
    return req.groupBy("alias", "system_prompt").agg(F.count(F.lit(1)).alias("n_requests"),
                                                     F.sum(F.length("user_text")).alias("n_user_chars"))


@q("codebook")
def q_codebook(spark, base):
    # codebook rows joined to the replies seen per code and how many of them say yes
    replies = coding.parse_responses(fx.fx_reply(spark, base)).groupBy("alias").agg(
        F.count(F.lit(1)).alias("n_replies"), F.sum("decision").alias("n_positive"))
    return codebook(spark).join(replies, "alias", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_replies", "n_positive")})


@q("parse_responses")
def q_parse_responses(spark, base):
    return coding.parse_responses(fx.fx_reply(spark, base)).select("doc_id", "alias", "decision", "rationale",
                                                               "explanation")


# --------------------------------------------------------------------------
# sampling, splits, augmentation
# --------------------------------------------------------------------------


def train_frame(spark, base) -> DataFrame:
    return fx.fx_train(spark, base)


@q("sample_n")
def q_sample_n(spark, base):
    return smp.sample_n(train_frame(spark, base), 50, 56, "doc_id").select("doc_id", "position", "trgt")


@q("shuffle")
def q_shuffle(spark, base):
    return smp.shuffle(load(spark, base, "documents").select("doc_id"), 56, "doc_id")


@q("reindex")
def q_reindex(spark, base):
    return smp.reindex(cols.condense_responses(fx.fx_sheet(spark, base)).select("row_id"), ["row_id"])


@q("seeded_rank")
def q_seeded_rank(spark, base):
    from ..operators.ranks import seeded_rank
    return seeded_rank(train_frame(spark, base).select("doc_id", "trgt"), "doc_id", 7, by=["trgt"])


@q("sample_strata")
def q_sample_strata(spark, base):
    d = train_frame(spark, base).select("doc_id", "agnt")
    return smp.sample_strata(d, "agnt", {1: 5, 0: 95}, 42, "doc_id")


@q("holdout")
def q_holdout(spark, base):
    return smp.holdout(train_frame(spark, base).select("doc_id"), 200, 56, "doc_id")


@q("holdout_rest")
def q_holdout_rest(spark, base):
    h = smp.holdout(train_frame(spark, base).select("doc_id"), 200, 56, "doc_id")
    return h.where(F.col("split") == "train").select("doc_id")


@q("stratified_split")
def q_stratified_split(spark, base):
    return smp.stratified_split(train_frame(spark, base).select("doc_id", "trgt"), 0.2, "trgt", 56, "doc_id")


@q("stratified_folds")
def q_stratified_folds(spark, base):
    return smp.stratified_folds(train_frame(spark, base).select("doc_id", "trgt"), 5, "trgt", 56, "doc_id")


def augmented(spark, base, clear_rtnl=True) -> DataFrame:
    d = train_frame(spark, base).select("doc_id", "text", "rtnl", "trgt")
    return rws.augment(d, "doc_id", clear_rtnl=clear_rtnl)


@q("augment")
def q_augment(spark, base):
    a = augmented(spark, base)
    return smp.reindex(a, ["doc_id", "seq"], "position").select(
        "doc_id", "seq", "parent_id", "agmt", "text", "rtnl", "position")


@q("flag_augmented")
def q_flag_augmented(spark, base):
    a = augmented(spark, base, clear_rtnl=False).drop("agmt")
    return rws.flag_augmented(a, ["doc_id", "seq"], out="agmt_flag").select("doc_id", "seq", "agmt_flag")


@q("parent_of")
def q_parent_of(spark, base):
    # W1 then J5 fused: one pass windows the rows once for both steps
    a = augmented(spark, base, clear_rtnl=False).drop("agmt")
    out = rws.flag_and_parent(a, ["doc_id", "seq"], key="doc_id", flag="agmt_flag", out="parent_key")
    return out.select("doc_id", "seq", "agmt_flag", "parent_key")


@q("semi_augmented")
def q_semi_augmented(spark, base):
    a = augmented(spark, base)
    split = smp.stratified_split(a.where(F.col("agmt") == 0), 0.2, "trgt", 56, "doc_id")
    train = split.where(F.col("split") == "train")
    return rws.semi(a.where(F.col("agmt") == 1), train, "parent_id", "doc_id").select("doc_id", "seq", "parent_id")


@q("assemble_train")
def q_assemble_train(spark, base):
    d = train_frame(spark, base).select("doc_id", "text", "rtnl", "trgt")
    return rws.split_and_augment(d, 0.2, "trgt", 56, "doc_id").select("doc_id", "seq", "split")


@q("split_report")
def q_split_report(spark, base):
    return rws.split_report(rws.assemble_train(augmented(spark, base), 0.2, "trgt", 56, "doc_id"))


@q("concat_rows")
def q_concat_rows(spark, base):
    # both have `text`, at different places
    return rws.concat_rows(load(spark, base, "documents").select("doc_id", "text", "lang", "source"),
                           load(spark, base, "conversations").select("conv_id", "turn", "role", "text"))


@q("replicate")
def q_replicate(spark, base):
    return rws.replicate(load(spark, base, "labels").select("doc_id", "quality", "toxic"), 1600, key="doc_id")


@q("sample_by_cycle")
def q_sample_by_cycle(spark, base):
    d = cols.condense_responses(fx.fx_sheet(spark, base), pilot=1)
    return smp.sample_by_cycle(d, 80, 1, 56, "row_id")


@q("masked_copy")
def q_masked_copy(spark, base):
    packet = smp.sample_n(train_frame(spark, base).select("doc_id", "text", *fv.ALL_TAGS, "rtnl"), 100, 42,
                          "doc_id", position=None)
    return smp.masked_copy(packet, fv.CYCLE_TAG_COLUMNS)


# --------------------------------------------------------------------------
# metrics, weights, grids, encoding
# --------------------------------------------------------------------------

LABEL_TARGETS = ["quality", "toxic"]
GRID = {"learning_rate": [1e-5, 2e-5, 5e-5], "batch_size": [16, 32]}
THRESHOLDS = {"threshold": [0.3, 0.4, 0.5, 0.6, 0.7]}


def label_folds(spark, base) -> DataFrame:
    lab_ = load(spark, base, "labels").select("doc_id", "quality")
    return smp.stratified_folds(lab_, 5, "quality", 56, "doc_id").select("doc_id", "fold")


def scores_with_folds(spark, base) -> DataFrame:
    return fx.fx_scores(spark, base).join(label_folds(spark, base), "doc_id")


@q("decide")
def q_decide(spark, base):
    d = met.decide(fx.fx_scores(spark, base).select("doc_id", "target", "logit"), "logit", 0.5, "p", "decision")
    return d.select("doc_id", "target", F.round("p", 6).alias("p"), "decision")


@q("prevalence")
def q_prevalence(spark, base):
    return met.prevalence(fx.fx_train(spark, base), fv.TARGETS + fv.THEMES)


@q("pos_weights")
def q_pos_weights(spark, base):
    return met.pos_weights(fx.fx_train(spark, base), fv.TARGETS)


@q("pos_weights_by_fold")
def q_pos_weights_by_fold(spark, base):
    d = smp.stratified_folds(fx.fx_train(spark, base), 5, "trgt", 56, "doc_id")
    return met.pos_weights_by_fold(d, fv.TARGETS, "fold")


@q("f1_macro")
def q_f1_macro(spark, base):
    return met.f1_macro(fx.fx_scores(spark, base))


@q("mcc")
def q_mcc(spark, base):
    return met.mcc(fx.fx_scores(spark, base))


@q("average_precision")
def q_average_precision(spark, base):
    return met.average_precision(fx.fx_scores(spark, base))


@q("pooled_metrics")
def q_pooled_metrics(spark, base):
    return met.pooled_metrics(fx.fx_scores(spark, base))


@q("fold_metrics")
def q_fold_metrics(spark, base):
    return met.evaluate_long(scores_with_folds(spark, base), by=["fold"])


@q("cv_summary")
def q_cv_summary(spark, base):
    return met.cv_summary(met.evaluate_long(scores_with_folds(spark, base), by=["fold"]))


@q("weighted_bce")
def q_weighted_bce(spark, base):
    w = met.pos_weights(load(spark, base, "labels"), LABEL_TARGETS)
    return met.weighted_bce(fx.fx_scores(spark, base), w)


@q("param_grid")
def q_param_grid(spark, base):
    folds = smp.stratified_folds(fx.fx_train(spark, base).select("doc_id", "trgt"), 5, "trgt", 56, "doc_id")
    return grd.with_folds(GRID, folds)


@q("threshold_search")
def q_threshold_search(spark, base):
    return grd.threshold_search(scores_with_folds(spark, base), THRESHOLDS["threshold"])


@q("best_config")
def q_best_config(spark, base):
    res = grd.threshold_search(scores_with_folds(spark, base), THRESHOLDS["threshold"])
    return grd.best_config(res, "mean_f1", ["threshold"])


@q("encode_batch")
def q_encode_batch(spark, base):
    # the reference's truncation, asked for; encode_chunks encodes whole texts
    e = enc.encode_batch(load(spark, base, "documents").select("doc_id", "text"), "doc_id", max_len=512, overflow=False)
    return e.select("doc_id", "n_tokens", F.array_join("input_ids", ",").alias("input_ids"),
                    F.array_join("attention_mask", ",").alias("attention_mask"))


@q("encode_subwords")
def q_encode_subwords(spark, base):
    """Whole texts in windows of 512 subwords of a public vocabulary, as digests."""
    import public_tokenizers

    e = enc.encode_subwords(load(spark, base, "documents").select("doc_id", "text"), "doc_id",
                            public_tokenizers.path("word_bpe_49k.json"), first=49406, last=49407)
    return e.select("doc_id", "chunk", "n_tokens", F.crc32(F.array_join("input_ids", ",")).alias("ids_crc32"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_mask"))


# --------------------------------------------------------------------------
# Models (one joint descent)
# --------------------------------------------------------------------------
ML_GRID = {"maxIter": [5, 10, 20], "regParam": [0.0, 0.01]}


def labelled_features(spark, base):
    from ..operators import ml
    docs = load(spark, base, "documents").select("doc_id", "text")
    d = load(spark, base, "labels").join(docs, "doc_id")
    d = cols.composite_indicator(d, LABEL_TARGETS, "trgt")
    return ml.featurize(d, "text")[1]


def _train_test(spark, base):
    feats = labelled_features(spark, base)
    split = smp.stratified_split(feats, 0.2, "trgt", 56, "doc_id").checkpoint(eager=True)
    return split.where(F.col("split") == "train"), split.where(F.col("split") == "test")


JOINT_GRID = {"learning_rate": [0.05, 0.1, 0.2], "batches": [1, 2]}


def _joint_split(spark, base):
    lab_ = cols.composite_indicator(load(spark, base, "labels"), LABEL_TARGETS, "trgt")
    return smp.stratified_split(lab_, 0.2, "trgt", 56, "doc_id")


def _joint_features(spark, base, rows):
    from ..operators import joint
    docs = load(spark, base, "documents").select("doc_id", "text")
    return joint.hashed_features(sio.spread(rows.join(docs, "doc_id")))


def _joint_rows(spark, base):
    """Labelled rows with features: training part, test part."""
    feats = _joint_features(spark, base, _joint_split(spark, base))
    return feats.where("split = 'train'"), feats.where("split = 'test'")


def _joint_folds(spark, base):
    train = _joint_split(spark, base).where("split = 'train'")
    return _joint_features(spark, base, smp.stratified_folds(train, 5, "trgt", 56, "doc_id"))


@q("fit_multilabel")
def q_fit_multilabel(spark, base):
    from ..operators import joint
    train, _ = _joint_rows(spark, base)
    fits = joint.fit_joint(train, "doc_id", LABEL_TARGETS)
    return joint.coefficients(fits, spark).drop("config_id", "fold")


@q("training_loss")
def q_training_loss(spark, base):
    from ..operators import joint
    fits = joint.fit_joint(_joint_folds(spark, base), "doc_id", LABEL_TARGETS, fold="fold")
    return joint.epoch_losses(fits, spark).drop("config_id")


@q("evaluate")
def q_evaluate(spark, base):
    from ..operators import joint
    train, test = _joint_rows(spark, base)
    return joint.evaluate_joint(joint.fit_joint(train, "doc_id", LABEL_TARGETS), test, "doc_id")


@q("cross_validate")
def q_cross_validate(spark, base):
    from ..operators import joint
    return joint.cross_validate_joint(_joint_folds(spark, base), "doc_id", LABEL_TARGETS)[1]


@q("grid_search")
def q_grid_search(spark, base):
    from ..operators import joint
    return joint.grid_search_joint(_joint_folds(spark, base), "doc_id", LABEL_TARGETS, JOINT_GRID)


# --------------------------------------------------------------------------
# end-to-end flow
# --------------------------------------------------------------------------

@q("training_set")
def q_training_set(spark, base):
    from .workflows import training_set
    d = fx.fx_train(spark, base).select("doc_id", "text", "rtnl", *fv.ALL_TAGS)
    return training_set(d, "doc_id").select("doc_id", "seq", "split", "text")


@q("redact_terms_longest")
def q_redact_terms_longest(spark, base):
    # corrected mode: longer terms first, so no name is cut by its prefix
    return txt.redact_terms(text_and_rationale(spark, base), ["text", "rtnl"], longest_first=True)


@q("encode_chunks")
def q_encode_chunks(spark, base):
    # the whole text in consecutive 512-token windows: every token, rare ones too
    e = enc.encode_batch(load(spark, base, "documents").select("doc_id", "text"), "doc_id", max_len=512)
    return e.select("doc_id", "chunk", "n_tokens", F.array_join("input_ids", ",").alias("input_ids"),
                    F.array_join("attention_mask", ",").alias("attention_mask"))


# --------------------------------------------------------------------------
# keys and lineage of augmented rows; edges of tags, replies and counts
# --------------------------------------------------------------------------

@q("head_by_text")
def q_head_by_text(spark, base):
    return cols.head_by(load(spark, base, "documents").select("doc_id", "source", "lang"), 50, ["source", "lang", "doc_id"])


@q("profile_first")
def q_profile_first(spark, base):
    return sio.profile(load(spark, base, "documents"), order=["doc_id"], head=3)


@q("folds_augmented")
def q_folds_augmented(spark, base):
    from ..operators import ml
    return ml.assign_folds(augmented(spark, base), "doc_id", 5, "trgt", 56).select("doc_id", "seq", "fold")


@q("holdout_rows")
def q_holdout_rows(spark, base):
    return smp.holdout(augmented(spark, base), 200, 56, "doc_id", group=None).select("doc_id", "seq", "split")


@q("encode_augmented")
def q_encode_augmented(spark, base):
    e = enc.encode_batch(augmented(spark, base), "aug_id", max_len=512, labels=["trgt"])
    return e.select("aug_id", "chunk", "n_tokens", F.array_join("input_ids", ",").alias("input_ids"),
                    F.array_join("attention_mask", ",").alias("attention_mask"), "trgt")


@q("tags_strict_numeric")
def q_tags_strict_numeric(spark, base):
    return lab.normalize_tags(fx.fx_sheet(spark, base).select("row_id", "EmailPairID"), ["EmailPairID"], "strict")


@q("parse_rerun")
def q_parse_rerun(spark, base):
    # a second run: a third of the replies fail, a third now say no
    first = coding.parse_responses(fx.fx_reply(spark, base))
    third = F.pmod("doc_id", F.lit(3))
    again = first.withColumn("reply", F.when(third == 0, "error").when(third == 1, " 0").otherwise(F.col("reply")))
    return coding.parse_responses(again).select("doc_id", "alias", "decision", "rationale", "explanation")


@q("value_counts_missing")
def q_value_counts_missing(spark, base):
    return agr.value_counts(fx.fx_annot(spark, base), TAG_CELLS)


@q("split_sizes")
def q_split_sizes(spark, base):
    d = smp.stratified_split(train_frame(spark, base).select("doc_id", "trgt"), 0.2, "trgt", 56, "doc_id")
    return d.groupBy("trgt", "split").agg(F.count(F.lit(1)).alias("n_rows"))


@q("multilabel_folds")
def q_multilabel_folds(spark, base):
    return smp.multilabel_folds(fx.fx_train(spark, base).select("doc_id", *fv.TARGETS), fv.TARGETS, 5, 56, "doc_id")


@q("cv_plan")
def q_cv_plan(spark, base):
    # what each fit of the grid search gets: fold sizes and class weights, per configuration and target
    d = smp.stratified_folds(fx.fx_train(spark, base), 5, "trgt", 56, "doc_id")
    return grd.with_folds(ML_GRID, d.select("doc_id", "fold")).join(met.pos_weights_by_fold(d, fv.TARGETS, "fold"), "fold")


# --------------------------------------------------------------------------
# sources, sinks and flows
# --------------------------------------------------------------------------

def scratch_path(spark, name: str) -> str:
    import uuid

    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@q("read_terms")
def q_read_terms(spark, base):
    path = scratch_path(spark, "terms")
    load(spark, base, "benchmark").select(F.explode(F.split("text", "\n")).alias("value")).write.text(path)
    return sio.read_terms(spark, path).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@q("write_read_table")
def q_write_read_table(spark, base):
    path = scratch_path(spark, "stage")
    sio.write_table(load(spark, base, "documents"), path, partition_by=["lang"])
    return spark.read.parquet(path).select("doc_id", "text", "lang", "source", "n_chars")


@q("write_cycles")
def q_write_cycles(spark, base):
    """Cycles written one by one, one of them again with other rows: each is there once."""
    path, d = scratch_path(spark, "cycles"), load(spark, base, "documents")
    d = d.select("doc_id", "lang", "n_chars", cycle_of(F.col("doc_id").cast("string")).alias("cycle"))
    for cycle in (0, 1, 2, 3, 1):
        sio.write_partitions(d.where(F.col("cycle") == cycle), path, ["cycle"])
    sio.write_partitions(d.where("cycle = 2").withColumn("lang", F.upper("lang")), path, ["cycle"])
    return sio.read_partitions(spark, path, d.schema, ["cycle"])


@q("write_read_csv")
def q_write_read_csv(spark, base):
    path = scratch_path(spark, "csv")
    d = load(spark, base, "labels")
    sio.write_csv(d, path)
    return sio.read_table(spark, path, schema=d.schema, fmt="csv", header=True)


@q("null_text")
def q_null_text(spark, base):
    return fx.fx_annot(spark, base).select("doc_id", txt.text_for_nlp("rtnl", "nan").alias("text"))


@q("pystrip")
def q_pystrip(spark, base):
    from ..functions import pystrip
    return fx.fx_reply(spark, base).select("doc_id", "alias", pystrip("reply").alias("reply"))


@q("theme_output")
def q_theme_output(spark, base):
    from .workflows import theme_output
    return theme_output(fx.fx_train(spark, base), "doc_id")


@q("flow_agreement")
def q_flow_agreement(spark, base):
    from .workflows import agreement_report
    rep = agreement_report(rater_sheet(spark, base, "r1"), rater_sheet(spark, base, "r2"), "doc_id")
    return rep["disagreements"].select("doc_id", *[f"{t}_dis" for t in fv.ALL_TAGS], "rtnl_r1", "rtnl_r2")


@q("flow_triangulation")
def q_flow_triangulation(spark, base):
    from .workflows import triangulated_labels
    raw = fx.fx_annot(spark, base)
    human = raw.select("doc_id", *[F.when(F.col(f"{c}_r1") == "1.0", "1").when(F.col(f"{c}_r1") == "x", "0").otherwise(
        F.col(f"{c}_r1")).alias(c) for c in fv.LLM_CODES])
    return triangulated_labels(human, fx.fx_reply(spark, base).select("doc_id", "alias", "reply"), "doc_id")
