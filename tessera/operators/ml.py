"""Multilabel training and evaluation as Spark ML jobs (M1-M4, re-aimed).

The reference fine-tunes a transformer; here each target gets a weighted
logistic regression over hashed TF-IDF features. ``weightCol`` carries the
per-target positive weight n_neg/n_pos, the same weighting as a
positive-weighted BCE loss. Every fit is a distributed L-BFGS job; the
driver only loops over (configuration, fold, target) and holds models.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IDFModel, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.io import write_csv
from .metrics import cv_summary, evaluate_long, pos_weights
from .sampling import by_family, stratified_folds

DEFAULT_PARAMS = {"maxIter": 25, "regParam": 0.01}


def featurize(df: DataFrame, text: str = "text", num_features: int = 1 << 16) -> tuple[PipelineModel, DataFrame]:
    """Tokenise -> hashed term frequencies (``tf``). Row by row: nothing is
    learned here, so nothing of a test row can leak. The frame is checkpointed
    (reliable storage under spark.checkpoint.dir) so the fits that follow
    neither recompute nor depend on a long lineage."""
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"[\s\p{Z}]+", toLowercase=True),
        HashingTF(inputCol="_tokens", outputCol="tf", numFeatures=num_features),
    ])
    ensure_checkpoint_dir(df.sparkSession)
    model = pipe.fit(df)
    return model, model.transform(df).drop("_tokens").checkpoint(eager=True)


def fit_idf(train: DataFrame) -> IDFModel:
    """Inverse document frequencies of the training part alone."""
    return IDF(inputCol="tf", outputCol="features").fit(train)


def _fit_one(train: DataFrame, target: str, weight: float, p: Mapping):
    d = train.withColumn("_w", F.when(F.col(target) == 1, F.lit(float(weight))).otherwise(F.lit(1.0))) \
             .withColumn("_y", F.col(target).cast("double"))
    lr = LogisticRegression(featuresCol="features", labelCol="_y", weightCol="_w",
                            maxIter=int(p["maxIter"]), regParam=float(p["regParam"]))
    return lr.fit(d)


def fit_multilabel(train: DataFrame, targets: Sequence[str], params: Mapping | None = None,
                   parallelism: int = 4) -> dict:
    """M1: one weighted logistic regression per target. Returns
    ``{target: (model, pos_weight, idf)}``; the weights come from one aggregate.
    A frame with ``tf`` gets ``features`` from its own document frequencies.
    Fits are independent Spark jobs, submitted concurrently (as
    ``CrossValidator(parallelism=...)`` does) so small fits overlap."""
    p = {**DEFAULT_PARAMS, **(params or {})}
    idf = None
    if "features" not in train.columns:
        idf = fit_idf(train)
        train = idf.transform(train)
    weights = {r.target: r.pos_weight for r in pos_weights(train, targets).collect()}  # one row per target
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        futs = {t: ex.submit(_fit_one, train, t, weights[t], p) for t in targets}
        return {t: (futs[t].result(), weights[t], idf) for t in targets}


def score_long(models: dict, df: DataFrame, key: str, targets: Sequence[str]) -> DataFrame:
    """Long scores (key, target, y_true, logit, y_prob, y_pred) for all targets."""
    parts = []
    for t in targets:
        m, _, idf = models[t]
        x = df if idf is None else idf.transform(df)
        s = m.transform(x.select(key, "features", t))
        parts.append(s.select(
            key, F.lit(t).alias("target"), F.col(t).cast("int").alias("y_true"),
            vector_to_array("rawPrediction")[1].alias("logit"),
            vector_to_array("probability")[1].alias("y_prob")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.withColumn("y_pred", (F.col("y_prob") > 0.5).cast("int"))


def evaluate(models: dict, df: DataFrame, key: str, targets: Sequence[str]) -> DataFrame:
    """M2: per-target f1_macro / mcc / auprc plus pooled metrics."""
    return evaluate_long(score_long(models, df, key, targets))


def assign_folds(feats: DataFrame, key: str, k: int, strat: str, seed, family: str | None = "auto") -> DataFrame:
    """Stratified folds; with ``family`` (the original's key on every row,
    e.g. ``coalesce(parent_id, row_id)``) only originals are dealt and each
    augmented copy joins its parent's fold, so no copy validates its parent.
    ``"auto"`` (default) does so when a ``parent_id`` column is present;
    ``None`` deals every row (the reference's behaviour)."""
    if family == "auto":
        if "parent_id" in feats.columns:
            fam = feats.withColumn("_tz_family", F.coalesce(F.col("parent_id"), F.col(key)))
            return assign_folds(fam, key, k, strat, seed, "_tz_family").drop("_tz_family")
        family = None
    if family is None:
        return stratified_folds(feats, k, strat, seed, key)
    # a copy shares its parent's key: lineage, not the key, tells originals
    own = F.col("seq") == 0 if "seq" in feats.columns else F.col("parent_id").isNull() \
        if "parent_id" in feats.columns else F.col(family) == F.col(key)
    return by_family(stratified_folds, feats, family, own, k, strat, seed, key=key)


def cross_validate(feats: DataFrame, key: str, targets: Sequence[str], k: int = 5, strat: str = "trgt",
                   seed=56, params: Mapping | None = None, parallelism: int = 8,
                   family: str | None = "auto") -> tuple[DataFrame, DataFrame]:
    """M3: stratified k-fold CV: per fold, weights from the training part, a
    fresh model per target, validation metrics; then mean/std over folds.
    Returns (fold metrics, summary). Folds are fitted concurrently."""
    ensure_checkpoint_dir(feats.sparkSession)
    folded = feats if "fold" in feats.columns else \
        assign_folds(feats, key, k, strat, seed, family).checkpoint(eager=True)

    def one_fold(f: int) -> DataFrame:
        train = folded.where(F.col("fold") != f)
        val = folded.where(F.col("fold") == f)
        models = fit_multilabel(train, targets, params, parallelism=len(targets))
        return score_long(models, val, key, targets).withColumn("fold", F.lit(f))

    with ThreadPoolExecutor(max_workers=max(1, parallelism // max(1, len(targets)))) as ex:
        per_fold = list(ex.map(one_fold, range(k)))
    scores = per_fold[0]
    for x in per_fold[1:]:
        scores = scores.unionByName(x)
    # one metrics job for all folds (grouped by fold), not one per fold
    metrics = evaluate_long(scores, by=["fold"]).checkpoint(eager=True)
    return metrics, cv_summary(metrics)


def grid_search(feats: DataFrame, key: str, targets: Sequence[str], grid: Mapping[str, Sequence],
                k: int = 5, strat: str = "trgt", seed=56, family: str | None = "auto",
                fixed: Mapping | None = None, csv: str | None = None) -> DataFrame:
    """M4: every configuration of ``grid`` x k-fold CV; mean/std of the pooled
    F1 and AUPRC per configuration, best first. ``fixed`` parameters apply to
    all and are columns of the result; ``csv``: also written there."""
    import itertools
    fixed = dict(fixed or {})
    unknown = (set(grid) | set(fixed)) - set(DEFAULT_PARAMS)
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    names = [*grid, *fixed]
    spark = feats.sparkSession
    ensure_checkpoint_dir(spark)
    folded = assign_folds(feats, key, k, strat, seed, family).checkpoint(eager=True)  # shared by all configs

    def one_config(item):
        cid, values = item
        params = dict(zip(names, values))
        metrics, _ = cross_validate(folded, key, targets, k, strat, seed, params, parallelism=4)
        agg = metrics.where(F.col("target") == "aggregate").groupBy("metric").agg(
            F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).collect()  # <= 2 rows
        stats = {r.metric: (r.mean, r.std) for r in agg}
        f1 = stats.get("f1_macro", (None, None))
        ap = stats.get("auprc", (None, None))
        return (cid, *values, f1[0], f1[1], ap[0], ap[1])

    configs = [(i, (*v, *fixed.values())) for i, v in enumerate(itertools.product(*grid.values()))]
    with ThreadPoolExecutor(max_workers=3) as ex:
        rows = list(ex.map(one_config, configs))
    kinds = {n: "bigint" if all(isinstance(v, int) for v in [*grid.get(n, []), *([fixed[n]] if n in fixed else [])])
             else "double" for n in names}
    rows = [tuple(float(v) if 0 < i <= len(names) and kinds[names[i - 1]] == "double" else v for i, v in enumerate(r))
            for r in rows]
    schema = ", ".join(["config_id int"] + [f"{n} {kinds[n]}" for n in names] +
                       ["mean_f1 double", "std_f1 double", "mean_auprc double", "std_auprc double"])
    res = spark.createDataFrame(rows, schema)
    res = res.orderBy(F.desc_nulls_last("mean_f1"), *names)
    if csv:
        write_csv(res.coalesce(1), csv)
    return res
