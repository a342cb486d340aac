"""Multilabel training as one joint descent (M1-M4): every fit, that is every
configuration x fold x target, takes its step from the same pass over the rows.

A fit is a linear head on hashed TF-IDF features (inverse document frequencies
of its own training part, rows of unit length) under positive-weighted binary
cross-entropy, stepped by AdamW with linear warm-up and decay. A row counts for
the fits whose fold it is not in and whose minibatch is its own, so a pass
costs one job however many fits there are: a task sums the gradients of its
rows, blocks of them are added up on the executors (unless all are a few
megabytes), and the driver holds only the weights (features x fits).
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import list_array, text_parts
from ..session import ensure_checkpoint_dir
from .metrics import cv_summary, evaluate_long

DIM = 512
DEFAULTS = {"learning_rate": 0.1, "epochs": 5, "batches": 2, "weight_decay": 0.01, "warmup_ratio": 0.1}
BETAS, EPSILON = (0.9, 0.999), 1e-8
_SPACES = re.compile("[\t\n\x0b\f\r ]+")
KEPT_TOKENS = 100_000  # tokens whose bucket a task keeps
CHUNK = 512  # rows made dense at once
BLOCK = 64  # rows of the gradient table that travel together
ALL = -1  # the fold of a fit on all rows
DIRECT_BYTES = 64 << 20  # partial sums of all tasks up to this go to the driver as they are, else they are added up on the executors


def _hashed(texts: Sequence[str | None], dim: int, at: dict[str, int]) -> pa.StructArray:
    """Buckets and weights of some texts; ``at`` keeps buckets of tokens met before."""
    size, idx, count = [], [], []
    for text in texts:
        n: dict[int, int] = {}
        for t in _SPACES.split(text or ""):
            if t:
                j = at.get(t)
                if j is None:
                    if len(at) >= KEPT_TOKENS:
                        at.clear()
                    j = at[t] = int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim
                n[j] = n.get(j, 0) + 1
        own = sorted(n)
        size.append(len(own))
        idx += own
        count += [n[j] for j in own]
    kinds, which = np.unique(np.array(count, dtype=np.int64), return_inverse=True)
    val = np.array([1 + math.log(c) for c in kinds.tolist()])[which]
    return pa.StructArray.from_arrays([list_array(size, pa.array(idx, pa.int32())), list_array(size, pa.array(val, pa.float64()))], ["idx", "val"])


def hashed_features(df: DataFrame, text: str = "text", dim: int = DIM) -> DataFrame:
    """``df`` without the text, with ``idx`` and ``val``: the hash buckets (32
    bits of md5, modulo ``dim``) of its white-space tokens in order, and 1 + ln
    of how often they occur. Row by row: nothing is learned or shuffled. Texts
    without tokens have empty arrays. Checkpointed."""
    ensure_checkpoint_dir(df.sparkSession)

    @F.arrow_udf("struct<idx:array<int>,val:array<double>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at: dict[str, int] = {}
        for texts in batches:
            for some in text_parts(texts):
                yield _hashed(some, dim, at)

    rows = df.withColumn("_tz_x", run(F.col(text))).drop(text)
    return rows.select("*", "_tz_x.idx", "_tz_x.val").drop("_tz_x").checkpoint(eager=True)


def configurations(grid: Mapping[str, Sequence], fixed: Mapping | None = None) -> list[dict]:
    """The configurations of a grid, in the order of its values."""
    unknown = (set(grid) | set(fixed or {})) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    return [{**DEFAULTS, **(fixed or {}), **dict(zip(grid, v))} for v in itertools.product(*grid.values())]


def steps_of(config: Mapping) -> int:
    return int(config["epochs"]) * int(config["batches"])


def rate(config: Mapping, step: int) -> float:
    """The learning rate at ``step`` (from 0): up to the full rate over the
    warm-up, then down to nothing at the end."""
    total = steps_of(config)
    warm = int(total * config["warmup_ratio"])
    share = step / max(1, warm) if step < warm else max(0.0, (total - step) / max(1, total - warm))
    return float(config["learning_rate"]) * share


@dataclass
class Fits:
    """Fits side by side: column f of ``weights`` (the last row is the bias)
    belongs to configuration, fold and target f. ``losses``: (step, fit, mean
    loss of the minibatch before the step)."""

    configs: list[dict]
    targets: list[str]
    config: np.ndarray
    fold: np.ndarray
    target: np.ndarray
    pos_weight: np.ndarray
    idf: dict[int, np.ndarray]
    weights: np.ndarray
    losses: list[tuple[int, int, float]] = field(default_factory=list)

    def columns(self, fold: int) -> np.ndarray:
        return np.flatnonzero(self.fold == fold)


def _given(batch: pa.RecordBatch, dim: int, targets: Sequence[str]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of a batch in chunks: their place, dense features and labels."""
    for at in range(0, batch.num_rows, CHUNK):
        part = batch.slice(at, CHUNK)
        size = np.array([len(x) for x in part.column("idx")], dtype=np.int64)
        x = np.zeros((part.num_rows, dim))
        x[np.repeat(np.arange(part.num_rows), size), part.column("idx").flatten().to_numpy()] = part.column("val").flatten().to_numpy()
        yield slice(at, at + part.num_rows), x, np.column_stack([part.column(t).to_numpy(zero_copy_only=False) for t in targets])


def _scaled(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = x * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


_PART = pa.schema([("block", pa.int32()), ("sums", pa.binary())])


def _partial(batches: Iterator[pa.RecordBatch], fits: Fits, batch_of: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Gradients, rows and loss of the fits over a task's rows."""
    dim, n = fits.weights.shape[0] - 1, fits.weights.shape[1]
    parts = np.array([fits.configs[c]["batches"] for c in fits.config])
    sums = np.zeros((dim + 3, n))
    for b in batches:
        home, lot = b.column("_fold").to_numpy(), b.column("_lot").to_numpy()
        for at, x, labels in _given(b, dim, fits.targets):
            for f, idf in fits.idf.items():
                cols = fits.columns(f)
                xf, y, w = _scaled(x, idf), labels[:, fits.target[cols]], fits.pos_weight[cols]
                z = xf @ fits.weights[:-1, cols] + fits.weights[-1, cols]
                on = (home[at] != f)[:, None] & (lot[at][:, None] % parts[cols] == batch_of[cols])
                p = 1 / (1 + np.exp(-z))
                r = np.where(on, (1 - y) * p - w * y * (1 - p), 0)
                sums[:dim, cols] += xf.T @ r
                sums[dim:, cols] += np.stack([r.sum(axis=0), on.sum(axis=0),
                                              np.where(on, w * y * _softplus(-z) + (1 - y) * _softplus(z), 0).sum(axis=0)])
    blocks = range(0, len(sums), BLOCK)
    yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([sums[k:k + BLOCK].tobytes() for k in blocks])],
                                     schema=_PART)


def _added(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x.as_py()) for x in table.column("sums")], axis=0)
    return pa.Table.from_arrays([table.column("block").slice(0, 1), pa.array([total.tobytes()])], schema=_PART)


def fit_joint(feats: DataFrame, key: str, targets: Sequence[str], configs: Sequence[Mapping] | None = None,
              fold: str | None = None, dim: int = DIM) -> Fits:
    """M1, and the fits of M3 and M4: all ``configs`` x targets on all rows, or,
    with a ``fold`` column, on each fold's other rows. ``feats`` comes from
    :func:`hashed_features`; a missing label is an error. Jobs: one for
    weights and frequencies, one for each step of the longest configuration."""
    ensure_checkpoint_dir(feats.sparkSession)
    spark, configs, targets = feats.sparkSession, [{**DEFAULTS, **c} for c in configs or [{}]], list(targets)
    missing = F.raise_error(F.lit("missing label")).cast("double")
    lot = F.conv(F.substring(F.md5(F.concat(F.lit("batch:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    rows = feats.select("idx", "val", lot.alias("_lot"), (F.col(fold).cast("int") if fold else F.lit(ALL - 1)).alias("_fold"),
                        *[F.coalesce(F.col(t).cast("double"), missing).alias(t) for t in targets])
    cores = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:  # every pass reads these rows: deal a small table out once
        rows = rows.repartition(cores).checkpoint(eager=True)
    size = rows.groupBy("_fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(t).alias(t) for t in targets])
    freq = rows.select("_fold", F.explode("idx").alias("j")).groupBy("_fold", "j").agg(F.count(F.lit(1)).alias("n"))
    size, freq = size.toPandas(), freq.toPandas()  # a row per fold; at most folds x dim rows
    folds = sorted(size["_fold"].tolist()) if fold else [ALL]
    idf, positive, count = {}, {}, {}
    for f in folds:
        own = size[size["_fold"] != f]
        count[f] = int(own["n"].sum())
        positive[f] = [float(own[t].sum()) for t in targets]
        df = np.bincount(freq[freq["_fold"] != f]["j"], weights=freq[freq["_fold"] != f]["n"], minlength=dim)
        idf[f] = np.log((count[f] + 1) / (df + 1))
    each = list(itertools.product(range(len(configs)), folds, range(len(targets))))
    config, home, target = (np.array(x, dtype=np.int64) for x in zip(*each))
    weight = np.array([(count[f] - positive[f][t]) / positive[f][t] if positive[f][t] else 1.0 for _, f, t in each])
    fits = Fits(configs, targets, config, home, target, weight, idf, np.zeros((dim + 1, len(each))))
    first, second = np.zeros_like(fits.weights), np.zeros_like(fits.weights)
    direct = rows.rdd.getNumPartitions() * fits.weights.nbytes <= DIRECT_BYTES
    for step in range(max(map(steps_of, configs))):
        live = np.array([step < steps_of(configs[c]) for c in config])
        batch_of = np.where(live, [step % int(configs[c]["batches"]) for c in config], -1)
        held = spark.sparkContext.broadcast((fits, batch_of))
        parts = rows.mapInArrow(lambda b, h=held: _partial(b, *h.value), "block int, sums binary")
        if not direct:
            parts = parts.groupBy("block").applyInArrow(_added, "block int, sums binary")
        got: dict[int, np.ndarray] = {}
        for r in parts.collect():  # features x fits, times the tasks where these are few
            got[r.block] = got.get(r.block, 0) + np.frombuffer(r.sums).reshape(-1, len(each))
        held.destroy()
        sums = np.concatenate([got[k] for k in sorted(got)])
        n = np.maximum(sums[-2], 1)
        grad = sums[:-2] / n
        fits.losses += [(step, f, float(sums[-1, f] / n[f])) for f in np.flatnonzero(live).tolist()]
        lr = np.array([rate(configs[c], step) for c in config])
        decay = np.array([configs[c]["weight_decay"] for c in config])
        first = np.where(live, BETAS[0] * first + (1 - BETAS[0]) * grad, first)
        second = np.where(live, BETAS[1] * second + (1 - BETAS[1]) * grad * grad, second)
        move = lr * (first / (1 - BETAS[0] ** (step + 1))) / (np.sqrt(second / (1 - BETAS[1] ** (step + 1))) + EPSILON)
        fits.weights = np.where(live, fits.weights * (1 - lr * decay) - move, fits.weights)
    return fits


def coefficients(fits: Fits, spark) -> DataFrame:
    """(config_id, fold, target, feature, coef, pos_weight), coefficients to six
    decimals; the bias is feature -1. ``fold`` is null for fits on all rows."""
    dim = fits.weights.shape[0] - 1
    pdf = pd.concat([pd.DataFrame({
        "config_id": int(fits.config[f]), "fold": float("nan") if fits.fold[f] == ALL else int(fits.fold[f]),
        "target": fits.targets[fits.target[f]], "feature": [*range(dim), -1], "coef": np.round(fits.weights[:, f], 6) + 0.0,
        "pos_weight": round(float(fits.pos_weight[f]), 6)}) for f in range(fits.weights.shape[1])])
    out = spark.createDataFrame(pdf)
    return out.select(F.col("config_id").cast("int"), F.when(~F.isnan(F.col("fold").cast("double")), F.col("fold").cast("int")).alias("fold"),
                      "target", F.col("feature").cast("int").alias("feature"), "coef", "pos_weight")


def epoch_losses(fits: Fits, spark) -> DataFrame:
    """(config_id, fold, target, epoch, loss): the mean of an epoch's minibatch
    losses, each taken before its step."""
    per: dict[tuple[int, int], list[float]] = {}
    for step, f, loss in fits.losses:
        per.setdefault((f, step // int(fits.configs[fits.config[f]]["batches"])), []).append(loss)
    rows = [(int(fits.config[f]), None if fits.fold[f] == ALL else int(fits.fold[f]), fits.targets[fits.target[f]], e + 1,
             round(float(np.mean(x)), 6)) for (f, e), x in sorted(per.items())]
    return spark.createDataFrame(rows, "config_id int, fold int, target string, epoch int, loss double")


def _scores(batches: Iterator[pa.RecordBatch], fits: Fits, key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    dim = fits.weights.shape[0] - 1
    for b in batches:
        home, keys = b.column("_fold").to_numpy(), b.column("_key")
        for at, x, labels in _given(b, dim, fits.targets):
            for f, idf in fits.idf.items():
                mine = np.flatnonzero((home[at] == f) | (f == ALL))
                cols = fits.columns(f)
                if not len(mine):
                    continue
                z = _scaled(x[mine], idf) @ fits.weights[:-1, cols] + fits.weights[-1, cols]
                n = len(cols)
                yield pa.RecordBatch.from_arrays([
                    keys.take(pa.array(np.repeat(mine + at.start, n))), pa.array(np.tile(fits.config[cols], len(mine)), pa.int32()),
                    pa.array(np.full(z.size, f), pa.int32()),
                    pa.array(np.array(fits.targets, dtype=object)[np.tile(fits.target[cols], len(mine))], pa.string()),
                    pa.array(labels[mine][:, fits.target[cols]].ravel().astype(np.int32)), pa.array(np.round(z.ravel(), 6) + 0.0),
                ], names=["_key", "config_id", "fold", "target", "y_true", "logit"])


def score_joint(fits: Fits, feats: DataFrame, key: str, fold: str | None = None) -> DataFrame:
    """(key, config_id, fold, target, y_true, logit, y_prob, y_pred): fits with a
    fold score that fold's rows, fits on all rows every row. Logits and
    probabilities have six decimals, so that rows alike are ties."""
    kind = feats.schema[key].dataType
    rows = feats.select(F.col(key).alias("_key"), "idx", "val", (F.col(fold).cast("int") if fold else F.lit(ALL)).alias("_fold"),
                        *[F.col(t).cast("double").alias(t) for t in fits.targets])
    held = feats.sparkSession.sparkContext.broadcast(fits)
    out = rows.mapInArrow(lambda b: _scores(b, held.value, None),
                          f"_key {kind.simpleString()}, config_id int, fold int, target string, y_true int, logit double")
    return out.withColumns({"y_prob": F.round(1 / (1 + F.exp(-F.col("logit"))), 6), "y_pred": (F.col("logit") > 0).cast("int")}) \
        .withColumnRenamed("_key", key)


def evaluate_joint(fits: Fits, feats: DataFrame, key: str) -> DataFrame:
    """M2: per-target f1_macro, mcc and auprc and the pooled metrics of fits on
    all rows, on the rows of ``feats``."""
    by = ["config_id"] if len(fits.configs) > 1 else []
    return evaluate_long(score_joint(fits, feats, key), by=by)


def cross_validate_joint(feats: DataFrame, key: str, targets: Sequence[str], config: Mapping | None = None, fold: str = "fold",
                         dim: int = DIM) -> tuple[DataFrame, DataFrame]:
    """M3: (metrics per fold, mean and std over folds), all folds fitted in the
    same passes."""
    fits = fit_joint(feats, key, targets, [config or {}], fold, dim)
    metrics = evaluate_long(score_joint(fits, feats, key, fold), by=["fold"])
    return metrics, cv_summary(metrics)


def grid_search_joint(feats: DataFrame, key: str, targets: Sequence[str], grid: Mapping[str, Sequence], fold: str = "fold",
                      fixed: Mapping | None = None, dim: int = DIM) -> DataFrame:
    """M4: a row per configuration with mean and std over folds of the pooled F1
    and AUPRC, best first. Configurations, folds and targets advance together:
    the number of jobs is that of the longest configuration's steps."""
    configs = configurations(grid, fixed)
    fits = fit_joint(feats, key, targets, configs, fold, dim)
    from .metrics import pooled_metrics
    pooled = pooled_metrics(score_joint(fits, feats, key, fold), by=["config_id", "fold"])
    stats = cv_summary(pooled, by=["config_id", "metric"])

    def of(metric: str, value: str, name: str):
        return F.max(F.when(F.col("metric") == metric, F.col(value))).alias(name)

    stats = stats.groupBy("config_id").agg(of("f1_macro", "mean", "mean_f1"), of("f1_macro", "std", "std_f1"),
                                           of("auprc", "mean", "mean_auprc"), of("auprc", "std", "std_auprc"))
    names = [*grid, *(fixed or {})]
    rows = [(i, *[c[n] for n in names]) for i, c in enumerate(configs)]
    table = feats.sparkSession.createDataFrame(rows, ["config_id", *names]).withColumn("config_id", F.col("config_id").cast("int"))
    return table.join(F.broadcast(stats), "config_id", "left").orderBy(F.desc_nulls_last("mean_f1"), "config_id")
