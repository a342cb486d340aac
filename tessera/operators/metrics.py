"""Decisions, prevalence, class weights and multilabel metrics (T11, G3-G9,
G11). Metrics take the long form ``(by..., target, y_true, y_pred, y_prob)``
and return ``(by..., target, metric, value)``; the heavy part is always one
map-side combined aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio, sigmoid, softplus
from .ranks import running_sums

AGGREGATE = "aggregate"
SCORE_BUCKETS = 64


def decide(df: DataFrame, logit: str = "logit", threshold: float = 0.5, prob: str = "y_prob",
           pred: str = "y_pred") -> DataFrame:
    """probability = sigmoid(logit); decision = probability > threshold."""
    return df.withColumn(prob, sigmoid(logit)).withColumn(pred, (F.col(prob) > F.lit(threshold)).cast("int"))


def prevalence(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Positives, total and percent positive per column, in one pass."""
    agg = df.agg(F.count(F.lit(1)).alias("n_total"), *[F.sum(c).cast("long").alias(f"p{i}")
                                                       for i, c in enumerate(cols)])
    stack = F.array(*[F.struct(F.lit(c).alias("tag"), F.col(f"p{i}").alias("n_pos")) for i, c in enumerate(cols)])
    return agg.select("n_total", F.inline(stack)).select(
        "tag", "n_pos", "n_total", F.round(F.lit(100.0) * ratio("n_pos", "n_total"), 6).alias("pct"))


def pos_weights(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``pos_weight = n_neg / n_pos`` per target (1.0 without positives),
    overall or per ``by`` group (e.g. per fold)."""
    by = list(by)
    agg = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).cast("long").alias(f"p{i}")
                                                               for i, c in enumerate(cols)])
    stack = F.array(*[F.struct(F.lit(c).alias("target"), F.col(f"p{i}").alias("n_pos")) for i, c in enumerate(cols)])
    out = agg.select(*by, "_n", F.inline(stack)).withColumn("n_neg", F.col("_n") - F.col("n_pos"))
    w = F.when(F.col("n_pos") > 0, F.col("n_neg").cast("double") / F.col("n_pos")).otherwise(F.lit(1.0))
    return out.select(*by, "target", "n_pos", "n_neg", F.round(w, 6).alias("pos_weight"))


def _given(c: str):
    """The column; a NULL (or NaN) in it raises."""
    missing = F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    return F.when(missing, F.raise_error(F.lit(f"missing value in {c}")).cast("double")).otherwise(F.col(c).cast("double"))


def confusion(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn per (by..., target). A missing label or prediction is an
    error: no row is left out."""
    y, p = _given("y_true") == 1, _given("y_pred") == 1
    return long.groupBy(*by, "target").agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


def _f1_macro_expr():
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    f1_pos = 2 * tp / (2 * tp + fp + fn)
    f1_neg = 2 * tn / (2 * tn + fn + fp)
    has_pos = (F.col("tp") + F.col("fp") + F.col("fn")) > 0
    has_neg = (F.col("tn") + F.col("fp") + F.col("fn")) > 0
    total = F.when(has_pos, f1_pos).otherwise(0.0) + F.when(has_neg, f1_neg).otherwise(0.0)
    classes = has_pos.cast("int") + has_neg.cast("int")
    return F.try_divide(total, classes.cast("double"))


def _mcc_expr():
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(den == 0, F.lit(0.0)).otherwise((tp * tn - fp * fn) / den)


def f1_macro(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro F1 over the classes present in truth or prediction."""
    c = confusion(long, by)
    return c.select(*by, "target", F.lit("f1_macro").alias("metric"), F.round(_f1_macro_expr(), 6).alias("value"))


def mcc(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Matthews correlation (0 when undefined)."""
    c = confusion(long, by)
    return c.select(*by, "target", F.lit("mcc").alias("metric"), F.round(_mcc_expr(), 6).alias("value"))


def score_counts(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Positives and rows per distinct score: the one shuffle AP needs. A
    missing score or label is an error: no row is left out."""
    return long.withColumn("y_prob", _given("y_prob")).groupBy(*by, "target", "y_prob").agg(
        F.sum(_given("y_true")).cast("long").alias("pos"), F.count(F.lit(1)).alias("cnt"))


def ap_from_counts(s: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AP = sum(pos_k * TP_k / N_k) / P over thresholds, running sums down the
    scores computed as a bucketed prefix sum (no single-partition window)."""
    keys = list(keys)
    # equal shares of the distinct scores, wherever they lie: quantiles per group (any monotone cut gives the same sums)
    at = [(k + 1) / SCORE_BUCKETS for k in range(SCORE_BUCKETS - 1)]
    cuts = s.groupBy(*keys).agg(F.percentile_approx("y_prob", at, 1000).alias("_cuts"))
    s = s.join(cuts.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)}),
               [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]).drop(*[f"_k{i}" for i in range(len(keys))])
    bucket = -F.size(F.filter("_cuts", lambda c: c <= F.col("y_prob")))
    s = running_sums(s, [F.col("y_prob").desc()], bucket, {"tp_cum": F.col("pos"), "n_cum": F.col("cnt")}, keys)
    ap = s.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("tp_cum").cast("double") / F.col("n_cum"))).alias("_acc"),
        F.sum("pos").alias("_p"))
    return ap.select(*keys, F.lit("auprc").alias("metric"),
                     F.round(F.when(F.col("_p") > 0, F.col("_acc") / F.col("_p")), 6).alias("value"))


def average_precision(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Step-sum average precision, tied scores form one threshold;
    NULL for a group without positives."""
    return ap_from_counts(score_counts(long, by), [*by, "target"])


def evaluate_long(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per-target f1_macro, mcc and auprc plus pooled ('aggregate') f1_macro
    and auprc (G8: no pooled MCC; pooled AUPRC left out without positives).

    Two aggregations of the rows feed everything: the confusion counts (the
    pooled ones are their sum over targets, as flattening the label matrix
    adds the confusion matrices) and the per-score counts (pooled: summed
    over targets per score)."""
    by = list(by)
    keys = [*by, "target"]
    cells = ("tp", "fp", "fn", "tn")
    # each table gets its pooled rows and goes through once
    conf = _with_pooled(confusion(long, by), by, [], cells)
    per = conf.select(*keys, F.inline(F.array(
        F.struct(F.lit("f1_macro").alias("metric"), F.round(_f1_macro_expr(), 6).alias("value")),
        F.struct(F.lit("mcc").alias("metric"), F.round(_mcc_expr(), 6).alias("value")))))
    per = per.where((F.col("target") != AGGREGATE) | (F.col("metric") != "mcc"))
    ap = ap_from_counts(_with_pooled(score_counts(long, by), by, ["y_prob"], ("pos", "cnt")), keys)
    return per.unionByName(ap.where((F.col("target") != AGGREGATE) | F.col("value").isNotNull()))


def _with_pooled(table: DataFrame, by: Sequence[str], more: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """``table`` and its sums over targets, under the target ``aggregate``: each
    row counts for its own target and for all of them, in one shuffle."""
    names = F.explode(F.array(F.col("target"), F.lit(AGGREGATE)))
    return table.withColumn("target", names).groupBy(*by, "target", *more).agg(*[F.sum(c).alias(c) for c in sums])


def pooled_metrics(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics over all targets flattened together."""
    flat = long.withColumn("target", F.lit(AGGREGATE))
    ap = average_precision(flat, by).where(F.col("value").isNotNull())
    return f1_macro(flat, by).unionByName(ap)


def cv_summary(fold_metrics: DataFrame, by: Sequence[str] = ("target", "metric")) -> DataFrame:
    """Mean and population std over folds; missing/NaN values skipped, a
    metric with no value left out."""
    v = fold_metrics.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return v.groupBy(*by).agg(F.round(F.avg("value"), 6).alias("mean"),
                              F.round(F.stddev_pop("value"), 6).alias("std"),
                              F.count(F.lit(1)).alias("n_folds"))


def weighted_bce(long: DataFrame, weights: DataFrame | Mapping[str, float], by: Sequence[str] = (),
                 logit: str = "logit") -> DataFrame:
    """Mean over all cells of pos_weight*y*softplus(-z) + (1-y)*softplus(z)
    (binary cross-entropy on logits with per-target positive weights).
    ``weights``: a mapping, or a table with one row per target (as
    :func:`pos_weights` returns)."""
    if isinstance(weights, Mapping):
        w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        d = long.withColumn("_w", F.coalesce(F.element_at(w, F.col("target")), F.lit(1.0)))
    else:
        # one row per target: bounded by the number of label columns
        d = long.join(F.broadcast(weights.select("target", F.col("pos_weight").alias("_w"))), "target", "left") \
            .withColumn("_w", F.coalesce("_w", F.lit(1.0)))
    y = F.col("y_true").cast("double")
    cell = F.col("_w") * y * softplus(-F.col(logit)) + (F.lit(1.0) - y) * softplus(F.col(logit))
    return d.groupBy(*by).agg(F.round(F.avg(cell), 6).alias("bce"), F.count(F.lit(1)).alias("n_cells"))


def pos_weights_by_fold(df: DataFrame, cols: Sequence[str], fold: str = "fold") -> DataFrame:
    """G4 per fold: weights of each fold's *training* part (all other folds),
    from per-fold sums (k rows) minus the fold's own, never a k-fold copy."""
    from pyspark.sql import Window
    agg = df.groupBy(fold).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).cast("long").alias(f"p{i}")
                                                               for i, c in enumerate(cols)])
    w = Window.partitionBy()
    agg = agg.withColumns({"_n": F.sum("_n").over(w) - F.col("_n"),
                           **{f"p{i}": F.sum(f"p{i}").over(w) - F.col(f"p{i}") for i in range(len(cols))}})
    stack = F.array(*[F.struct(F.lit(c).alias("target"), F.col(f"p{i}").alias("n_pos")) for i, c in enumerate(cols)])
    out = agg.select(fold, "_n", F.inline(stack)).withColumn("n_neg", F.col("_n") - F.col("n_pos"))
    wt = F.when(F.col("n_pos") > 0, F.col("n_neg").cast("double") / F.col("n_pos")).otherwise(F.lit(1.0))
    return out.select(fold, "target", "n_pos", "n_neg", F.round(wt, 6).alias("pos_weight"))
