"""Rater and model error (P12, extended): what each rater and the model get
right, and how likely a tag is given all their answers, by expectation
maximisation (Dawid-Skene).

The answers matter only through how often each combination of them occurs, so
the rows are read once, into at most 3^raters counts per code (yes, no,
missing); the iterations run on that table, and one more pass over the rows
looks their combinations up.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITERATIONS = 50
PRIOR = 1.0  # added to the counts of right and wrong answers and of either class, so that nothing is 0 or 1
MOST_RATERS = 8


def _answer(c: Column) -> Column:
    return F.when(c == 1, "1").when(c == 0, "0").when(c.isNull(), "-").otherwise(F.raise_error(F.lit("a tag is neither 0 nor 1")))


def _pattern(code: str, raters: Sequence[str]) -> Column:
    return F.concat(*[_answer(F.col(f"{code}_{r}")) for r in raters])


def answer_patterns(df: DataFrame, codes: Sequence[str], raters: Sequence[str]) -> DataFrame:
    """(code, pattern, n): combinations of answers, a character per rater."""
    if not 1 < len(raters) <= MOST_RATERS:
        raise ValueError(f"from 2 to {MOST_RATERS} raters")
    each = F.array(*[F.struct(F.lit(c).alias("code"), _pattern(c, raters).alias("pattern")) for c in codes])
    return df.select(F.inline(each)).groupBy("code", "pattern").agg(F.count(F.lit(1)).alias("n"))


def fit_errors(counts: list[tuple[str, int]], raters: int, iterations: int = ITERATIONS) -> tuple[float, np.ndarray, dict[str, float]]:
    """(prevalence, right, posterior) of one code: ``right[r]`` is how often
    rater r says yes to a yes and no to a no; ``posterior[pattern]`` the chance
    of a yes. Begins with the share of yes among a pattern's answers."""
    counts = sorted(counts)
    n = np.array([c for _, c in counts], dtype=float)
    yes = np.array([[a == "1" for a in p] for p, _ in counts], dtype=float).reshape(-1, raters)
    no = np.array([[a == "0" for a in p] for p, _ in counts], dtype=float).reshape(-1, raters)
    given = yes.sum(axis=1) + no.sum(axis=1)
    chance = np.where(given > 0, yes.sum(axis=1) / np.maximum(given, 1), 0.5)
    prevalence, right = 0.5, np.full((raters, 2), 0.5)
    for _ in range(iterations):
        pos, neg = n * chance, n * (1 - chance)
        prevalence = (pos.sum() + PRIOR) / (n.sum() + 2 * PRIOR)
        right = np.stack([(pos @ yes + PRIOR) / (pos @ (yes + no) + 2 * PRIOR), (neg @ no + PRIOR) / (neg @ (yes + no) + 2 * PRIOR)], axis=1)
        a = prevalence * np.prod(np.where(yes > 0, right[:, 0], np.where(no > 0, 1 - right[:, 0], 1.0)), axis=1)
        b = (1 - prevalence) * np.prod(np.where(no > 0, right[:, 1], np.where(yes > 0, 1 - right[:, 1], 1.0)), axis=1)
        chance = a / (a + b)
    return float(prevalence), right, {p: float(x) for (p, _), x in zip(counts, chance)}


def rater_errors(df: DataFrame, codes: Sequence[str], raters: Sequence[str], iterations: int = ITERATIONS) -> tuple[DataFrame, DataFrame]:
    """(errors, posteriors): ``(code, rater, prevalence, sensitivity,
    specificity, n)`` and ``(code, pattern, n, p_yes)``. ``df`` holds a 0/1
    column ``{code}_{rater}`` for each; a null is no answer."""
    counts: dict[str, list[tuple[str, int]]] = {c: [] for c in codes}
    for r in answer_patterns(df, codes, raters).collect():  # at most 3^raters rows per code
        counts[r.code].append((r.pattern, r.n))
    errors, posteriors = [], []
    for code in codes:
        prevalence, right, chance = fit_errors(counts[code], len(raters), iterations)
        for k, r in enumerate(raters):
            n = sum(c for p, c in counts[code] if p[k] != "-")
            errors.append((code, r, round(prevalence, 6), round(float(right[k, 0]), 6), round(float(right[k, 1]), 6), n))
        posteriors += [(code, p, c, round(chance[p], 6)) for p, c in sorted(counts[code])]
    spark = df.sparkSession
    return (spark.createDataFrame(errors, "code string, rater string, prevalence double, sensitivity double, specificity double, n long"),
            spark.createDataFrame(posteriors, "code string, pattern string, n long, p_yes double"))


def triangulate_by_error(df: DataFrame, codes: Sequence[str], raters: Sequence[str], threshold: float = 0.5,
                         out_suffix: str = "_triangulate", iterations: int = ITERATIONS) -> DataFrame:
    """P12 by posterior: ``{code}_p_yes`` and ``{code}_triangulate`` (1 where the
    chance of a yes given all answers is above ``threshold``). Each row looks
    its combination up in a literal of at most 3^raters entries."""
    _, post = rater_errors(df, codes, raters, iterations)
    known: dict[str, dict[str, float]] = {c: {} for c in codes}
    for r in post.collect():
        known[r.code][r.pattern] = r.p_yes
    out = df
    for c in codes:
        if not known[c]:
            out = out.withColumn(f"{c}_p_yes", F.lit(None).cast("double"))
        else:
            look = F.create_map(*itertools.chain(*[(F.lit(p), F.lit(x)) for p, x in known[c].items()]))
            out = out.withColumn(f"{c}_p_yes", F.element_at(look, _pattern(c, raters)))
        out = out.withColumn(f"{c}{out_suffix}", (F.col(f"{c}_p_yes") > threshold).cast("int"))
    return out
