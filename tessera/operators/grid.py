"""Hyper-parameter grids (J6) and picking the best configuration.

A grid is a parameter (a handful of configurations known on the driver), so
it is expanded with ``itertools.product`` and attached to data rows with a
row-local ``inline`` of literals, never with a join.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .metrics import _f1_macro_expr


def grid_rows(params: Mapping[str, Sequence]) -> list[dict]:
    """Configurations in list order, first parameter slowest; ``config_id`` is
    the position."""
    names = list(params)
    rows = [dict(zip(names, values)) for values in itertools.product(*[params[n] for n in names])]
    return [{"config_id": i, **r} for i, r in enumerate(rows)]


def param_grid(spark: SparkSession, params: Mapping[str, Sequence]) -> DataFrame:
    """The Cartesian product of the parameter lists as a (tiny) table."""
    rows = grid_rows(params)
    cols = ["config_id", *params]
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], cols).withColumn(
        "config_id", F.col("config_id").cast("int"))


def _grid_literal(params: Mapping[str, Sequence]):
    return F.array(*[F.struct(F.lit(r["config_id"]).alias("config_id"),
                              *[F.lit(r[n]).alias(n) for n in params]) for r in grid_rows(params)])


def with_folds(params: Mapping[str, Sequence], folds: DataFrame, fold: str = "fold") -> DataFrame:
    """Grid x folds: one row per (configuration, fold) fit with the train and
    validation sizes of that fold. Only the per-fold counts (k rows) are
    expanded, never the data rows."""
    sizes = folds.groupBy(fold).agg(F.count(F.lit(1)).alias("n_val"))
    sizes = sizes.withColumn("n_train", F.sum("n_val").over(Window.partitionBy()) - F.col("n_val"))  # k rows
    return sizes.select(F.inline(_grid_literal(params)), fold, "n_train", "n_val")


def threshold_search(long: DataFrame, thresholds: Sequence[float], fold: str = "fold",
                     param: str = "threshold") -> DataFrame:
    """Cross-validated search over the decision threshold: per (config, fold)
    the pooled macro F1 of ``y_prob > threshold``, then mean and population
    std over folds. Each row falls between two thresholds; rows are counted
    per (fold, label, interval), one row per interval at most, and the counts
    above each threshold are sums over the intervals beyond it."""
    cuts = sorted({float(t) for t in thresholds})
    above = F.aggregate(F.array(*[F.lit(c) for c in cuts]), F.lit(0),
                        lambda acc, c: acc + (F.col("y_prob") > c).cast("int"))  # thresholds below the score
    counts = long.groupBy(fold, "y_true", above.alias("above")).agg(F.count(F.lit(1)).alias("cnt"))
    grid = F.array(*[F.struct(F.lit(r["config_id"]).alias("config_id"), F.lit(float(r[param])).alias(param),
                              F.lit(cuts.index(float(r[param]))).alias("cut"))
                     for r in grid_rows({param: list(thresholds)})])
    d = counts.select(fold, "y_true", "above", "cnt", F.inline(grid))
    pred = F.col("above") > F.col("cut")
    y = F.col("y_true") == 1
    conf = d.groupBy("config_id", param, fold).agg(
        F.sum(F.when(y & pred, F.col("cnt")).otherwise(0)).alias("tp"),
        F.sum(F.when(~y & pred, F.col("cnt")).otherwise(0)).alias("fp"),
        F.sum(F.when(y & ~pred, F.col("cnt")).otherwise(0)).alias("fn"),
        F.sum(F.when(~y & ~pred, F.col("cnt")).otherwise(0)).alias("tn"))
    per_fold = conf.select("config_id", param, fold, F.round(_f1_macro_expr(), 6).alias("value"))
    return per_fold.groupBy("config_id", param).agg(
        F.round(F.avg("value"), 6).alias("mean_f1"), F.round(F.stddev_pop("value"), 6).alias("std_f1"))


def best_config(results: DataFrame, metric: str = "mean_f1", params: Sequence[str] = ()) -> DataFrame:
    """The configuration with the best metric (NULLs last, ties broken by
    parameter values so the pick is reproducible)."""
    return results.orderBy(F.desc_nulls_last(metric), *[F.asc(p) for p in params]).limit(1)
