"""Inter-rater agreement: pairing (J1), Cohen's kappa (G1), value counts (G2),
kappa trend by cycle (G10).

The expensive part (one pass over the rows) is a map-side combined
``groupBy(tag, a, b).count()``; everything after it works on a table of
``tags x classes^2`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .columns import suffix_columns


def pair_annotators(a: DataFrame, b: DataFrame, on: str, s1: str, s2: str) -> DataFrame:
    """Inner equi-join of two raters' sheets on the row key; every other
    column gets the rater suffix (``_<s1>`` / ``_<s2>``)."""
    return suffix_columns(a, f"_{s1}", keep=[on]).join(suffix_columns(b, f"_{s2}", keep=[on]), on, "inner")


def rater_pairs(df: DataFrame, codes: Sequence[str], s1: str, s2: str, by: Sequence[str] = ()) -> DataFrame:
    """Long form (by..., tag, a, b): one row per (row, tag)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("tag"), F.col(f"{c}_{s1}").alias("a"),
                               F.col(f"{c}_{s2}").alias("b")) for c in codes])
    return df.select(*by, F.inline(pairs))


def confusion_cells(df: DataFrame, codes: Sequence[str], s1: str, s2: str, by: Sequence[str] = (),
                    missing: str = "raise") -> DataFrame:
    """(by..., tag, a, b, cnt): the per-tag rater confusion matrix. A pair with
    a missing value is an error; with ``missing="drop"`` it is left out."""
    long = rater_pairs(df, codes, s1, s2, by)
    whole = F.col("a").isNotNull() & F.col("b").isNotNull()
    if missing == "raise":
        whole = F.when(whole, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("missing value in tag "), F.col("tag"))).cast("boolean"))
    return long.where(whole).groupBy(*by, "tag", "a", "b").agg(F.count(F.lit(1)).alias("cnt"))


def kappa_from_cells(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted Cohen's kappa from confusion cells, exact until the last
    division: (n*sum(n_ii) - sum(n_i. n_.i)) / (n^2 - sum(n_i. n_.i)); NULL when
    the denominator is 0 (both raters constant and equal).

    Each cell gives its count to its row's and its column's class; two grouped
    sums over the cell table follow, for any number of classes. Products are
    DECIMAL(38, 0), so counts up to 10^18 pairs do not overflow."""
    keys = [*by, "tag"]
    zero = F.lit(0).cast("long")
    halves = F.array(F.struct(F.col("a").alias("k"), F.col("cnt").alias("na"), zero.alias("nb"),
                              F.when(F.col("a") == F.col("b"), F.col("cnt")).otherwise(zero).alias("agree")),
                     F.struct(F.col("b").alias("k"), zero.alias("na"), F.col("cnt").alias("nb"), zero.alias("agree")))
    marg = cells.select(*keys, F.inline(halves)).groupBy(*keys, "k").agg(
        F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.sum("agree").alias("agree"))
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("na", "nb", "n", "agree")}
    res = marg.groupBy(*keys).agg(F.sum("na").alias("n"), F.sum("agree").alias("agree"),
                                  F.sum((wide["na"] * wide["nb"]).cast("decimal(38,0)")).alias("pe"))
    num = (wide["n"] * wide["agree"]).cast("decimal(38,0)") - F.col("pe")
    den = (wide["n"] * wide["n"]).cast("decimal(38,0)") - F.col("pe")
    return res.select(*keys, "n", F.round(F.try_divide(num.cast("double"), den.cast("double")), 6).alias("kappa"))


def cohen_kappa(df: DataFrame, codes: Sequence[str], s1: str, s2: str, by: Sequence[str] = (),
                missing: str = "raise") -> DataFrame:
    """G1: kappa per tag (and per ``by`` group), any number of classes."""
    return kappa_from_cells(confusion_cells(df, codes, s1, s2, by, missing), by)


def reliability_trend(df: DataFrame, codes: Sequence[str], s1: str, s2: str, cycle: str = "cycle",
                      benchmark: float = fv.KAPPA_BENCHMARK) -> DataFrame:
    """Kappa by cycle x tag with the pre-registered benchmark flag."""
    k = cohen_kappa(df, codes, s1, s2, by=[cycle])
    return k.withColumn("meets_benchmark", F.coalesce(F.col("kappa") > F.lit(benchmark), F.lit(False)))


def value_counts(df: DataFrame, cols: Sequence[str], value: str = "value") -> DataFrame:
    """Value x column count matrix; a value absent from a column is NULL,
    and missing cells are not counted."""
    long = df.unpivot([], list(cols), "column", value).where(F.col(value).isNotNull())
    return long.groupBy(value).pivot("column", list(cols)).agg(F.count(F.lit(1)))


# -- intervals ---------------------------------------------------------------

# Poisson(1) weights by inversion: u of 16 bits weighs as many as it reaches of these steps (65,536 x the distribution function).
POISSON_STEPS = [math.floor(65536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(8)]


def bootstrap_weights(df: DataFrame, key: str, reps: int, seed=56) -> DataFrame:
    """One row per row of ``df`` and replicate in which it counts: ``rep`` and
    its Poisson(1) weight ``w``, from md5('boot:seed:block:key'), eight
    replicates a digest. Row by row, so a lost executor draws the same again."""
    blocks = -(-reps // 8)
    d = df.withColumn("_tz_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    d = d.withColumn("_tz_h", F.md5(F.concat_ws(":", F.lit("boot"), F.lit(str(seed)), F.col("_tz_block"), F.col(key))))
    draws = []
    for k in range(8):
        u = F.conv(F.substring("_tz_h", 4 * k + 1, 4), 16, 10).cast("int")
        draws.append(F.struct((F.col("_tz_block") * 8 + k).alias("rep"), sum((u >= s).cast("int") for s in POISSON_STEPS).alias("w")))
    return d.select(*df.columns, F.inline(F.array(*draws))).where((F.col("w") > 0) & (F.col("rep") < reps))


def kappa_replicates(df: DataFrame, codes: Sequence[str], s1: str, s2: str, key: str, reps: int = 200, seed=56) -> DataFrame:
    """(rep, tag, n, kappa): kappa of each bootstrap replicate, all in one pass:
    the weights of a cell are added up as its count. A missing value is an error."""
    cells = bootstrap_weights(df.select(key, *[F.col(f"{c}_{s}") for c in codes for s in (s1, s2)]), key, reps, seed)
    bad = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("missing value")).cast("int")).otherwise(F.col("w"))
    cells = rater_pairs(cells, codes, s1, s2, by=["rep", "w"]).withColumn("w", bad)
    return kappa_from_cells(cells.groupBy("rep", "tag", "a", "b").agg(F.sum("w").alias("cnt")), by=["rep"])


def kappa_intervals(df: DataFrame, codes: Sequence[str], s1: str, s2: str, key: str, reps: int = 200, level: float = 0.95,
                    seed=56) -> DataFrame:
    """Kappa per tag with its bootstrap percentile interval (lo, hi), standard
    error and the number of replicates in which it is defined."""
    tail = (1 - level) / 2
    r = kappa_replicates(df, codes, s1, s2, key, reps, seed).groupBy("tag").agg(
        F.round(F.percentile("kappa", F.lit(tail)), 6).alias("lo"), F.round(F.percentile("kappa", F.lit(1 - tail)), 6).alias("hi"),
        F.round(F.stddev_samp("kappa"), 6).alias("se"), F.count("kappa").alias("n_reps"))
    return cohen_kappa(df, codes, s1, s2).join(F.broadcast(r), "tag", "left")  # a row for each tag
