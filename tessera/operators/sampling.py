"""Reproducible sampling, shuffles, hold-outs, stratified splits and folds
(O1-O6, O9, O10, W2, W3).

Randomness is a seeded md5 of the row key, so results do not depend on
partitioning, executor count or retries, and every engine can reproduce
them. Ranks come from :mod:`tessera.operators.ranks` (no single-partition
window over row data).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .columns import assign_blank, drop_columns
from .ranks import ordered_index, seeded_hash, seeded_rank

PREFIX = 4  # hex characters: 65,536 shares of the hash order


def _cut_off(df: DataFrame, n: int, seed, key: str) -> tuple[int, str | None, str]:
    """(rows, hash, key) of the n-th row in seeded order, the hash None if
    there are n rows or fewer. Two small jobs: rows per hash prefix (at most
    65,536 counts), then the top of one prefix."""
    h = seeded_hash(key, seed)
    counts = {r[0]: r[1] for r in df.groupBy(F.substring(h, 1, PREFIX).alias("p")).count().collect()}
    total, left = sum(counts.values()), n
    if total <= n or n <= 0:
        return total, None, ""
    for p in sorted(counts, key=lambda p: p or ""):
        if counts[p] >= left:
            break
        left -= counts[p]
    rows = df.select(h.alias("h"), F.col(key).alias("k")).where(F.substring("h", 1, PREFIX) == p)
    last = rows.orderBy("h", "k").limit(left).orderBy(F.desc("h"), F.desc("k")).first()
    return total, last["h"], last["k"]


def _within(seed, key: str, h: str, k) -> F.Column:
    """Rows up to and with the cut-off, row by row: nothing is shuffled."""
    own = seeded_hash(key, seed)
    return (own < F.lit(h)) | ((own == F.lit(h)) & (F.col(key) <= F.lit(k)))


def sample_n(df: DataFrame, n: int, seed, key: str, position: str | None = "position",
             check: bool = True) -> DataFrame:
    """O1: exactly ``n`` rows without replacement (error if n > rows, like the
    reference); ``position`` 0..n-1 is the sample order. ``key`` must be
    unique. The rows are those up to a hash cut-off found beforehand (two
    small jobs); only the n rows taken are ranked."""
    total, h, k = _cut_off(df, n, seed, key)
    if check and n > total:
        raise ValueError(f"cannot take a sample of {n} from {total} rows without replacement")
    taken = df.limit(0) if n <= 0 else df if h is None else df.where(_within(seed, key, h, k))
    if not position:  # the n rows alone, in sample order
        return taken.withColumn("_tz_h", seeded_hash(key, seed)).orderBy("_tz_h", key).limit(n).drop("_tz_h")
    return seeded_rank(taken, key, seed, out=position).withColumn(position, F.col(position) - 1)


def shuffle(df: DataFrame, seed, key: str, position: str = "position") -> DataFrame:
    """O2: seeded full shuffle; emits the new 0-based ``position``."""
    return seeded_rank(df, key, seed, out=position).withColumn(position, F.col(position) - 1)


def reindex(df: DataFrame, order: Sequence[str], out: str = "index") -> DataFrame:
    """Dense 0-based index along a given order (``reset_index(drop=True)``)."""
    return ordered_index(df, order, out)


def sample_strata(df: DataFrame, col: str, quotas: Mapping, seed, key: str,
                  position: str = "position") -> DataFrame:
    """O3: ``quotas[v]`` rows of stratum ``v`` (an error if it has fewer), then
    a seeded shuffle of the kept rows. A cut-off per stratum, as for
    :func:`sample_n`: only the rows taken are ranked."""
    keep = F.lit(False)
    for v, n in quotas.items():
        if int(n) <= 0:
            continue
        own = F.col(col).eqNullSafe(F.lit(v))
        total, h, k = _cut_off(df.where(own), int(n), seed, key)
        if total < int(n):
            raise ValueError(f"cannot take {n} rows of stratum {v!r}: it has {total}")
        keep = keep | (own if h is None else own & _within(seed, key, h, k))
    return shuffle(df.where(keep), seed, key, position)


def holdout(df: DataFrame, n: int = 200, seed=56, key: str = "row_id", out: str = "split",
            group: str | None = "auto") -> DataFrame:
    """Label exactly ``n`` rows 'calibrate' and the rest 'train'; when
    the table has ``n`` rows or fewer nothing is held out (as the reference
    skips with a warning). With ``group`` (e.g. the parent id of augmented
    copies), whole groups are held out in seeded order while the running row
    count stays within ``n``, so no copy is split from its parent. The
    default ``"auto"`` does that whenever the rows carry augmentation lineage
    (a ``parent_id`` column); ``group=None`` is the reference's row-level draw."""
    if group == "auto":
        if "parent_id" in df.columns:
            df = df.withColumn("_tz_family", F.coalesce(F.col("parent_id"), F.col(key)))
            return holdout(df, n, seed, key, out, "_tz_family").drop("_tz_family")
        group = None
    if group is None:
        # augmented copies share their parent's key; their own id draws single rows
        key = "aug_id" if "aug_id" in df.columns else key
        total, h, k = _cut_off(df, n, seed, key)
        cal = F.lit(False) if total <= n or n <= 0 else _within(seed, key, h, k)
        return df.withColumn(out, F.when(cal, "calibrate").otherwise("train"))
    from .ranks import hex_bucket, running_sums
    fam = df.groupBy(group).agg(F.count(F.lit(1)).alias("_tz_size")).withColumn("_tz_h", seeded_hash(group, seed))
    fam = running_sums(fam, [F.col("_tz_h"), F.col(group)], hex_bucket("_tz_h"), {"_tz_cum": F.col("_tz_size")},
                       totals=True)
    fam = fam.select(group, F.when((F.col("_tz_cum_total") > n) & (F.col("_tz_cum") <= n), "calibrate")
                     .otherwise("train").alias(out))
    return df.join(fam, group)


def class_quotas(counts: DataFrame, by: str, test_size: float) -> DataFrame:
    """Per-class test quotas: n_test = ceil(test_size * n); each class gets
    floor(n_test * n_c / n), the remainder goes to the largest fractional
    parts (ties by class value). Works on the small per-class table."""
    w_all = Window.partitionBy()
    t = counts.withColumns({"_n": F.sum("n_c").over(w_all)})
    t = t.withColumn("_n_test", F.ceil(F.lit(float(test_size)) * F.col("_n")).cast("long"))
    t = t.withColumns({"_base": F.floor(F.col("_n_test") * F.col("n_c") / F.col("_n")).cast("long"),
                       "_rem": F.pmod(F.col("_n_test") * F.col("n_c"), F.col("_n"))})
    t = t.withColumn("_left", F.col("_n_test") - F.sum("_base").over(w_all))
    t = t.withColumn("_order", F.row_number().over(Window.orderBy(F.col("_rem").desc(), F.col(by))))
    quota = F.col("_base") + F.when(F.col("_order") <= F.col("_left"), 1).otherwise(0)
    too_small = F.col("n_c") < 2
    return t.select(by, F.when(too_small, F.raise_error(F.lit("a class has fewer than 2 rows")))
                    .otherwise(quota).cast("long").alias("quota"))


LITERAL_CLASSES = 1000


def class_lookup(df: DataFrame, table: DataFrame, by: str, value: str) -> DataFrame:
    """``df`` with the per-class ``value`` (quota, offset) of ``table``: inlined
    as a literal while the classes are few (a hot class costs no shuffle), else
    joined by the class."""
    rows = table.select(by, value).limit(LITERAL_CLASSES + 1).collect()
    if len(rows) > LITERAL_CLASSES:
        right = table.select(F.col(by).alias("_tz_c"), value)
        return df.join(right, F.col(by).eqNullSafe(F.col("_tz_c")), "left").drop("_tz_c")
    known = [(r[0], r[1]) for r in rows if r[0] is not None]
    null_value = next((r[1] for r in rows if r[0] is None), None)
    col = F.col(by)
    if known:
        lookup = F.element_at(F.create_map(*[x for k, v in known for x in (F.lit(k), F.lit(v))]), col)
    else:
        lookup = F.lit(None)
    return df.withColumn(value, F.when(col.isNull(), F.lit(null_value)).otherwise(lookup))


def stratified_split(df: DataFrame, test_size: float = 0.2, by: str = "trgt", seed=56, key: str = "row_id",
                     out: str = "split") -> DataFrame:
    """Seeded stratified train/test split with exact per-class quotas."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n_c"))
    quotas = class_quotas(counts, by, test_size).withColumnRenamed("quota", "_tz_quota")
    ranked = class_lookup(seeded_rank(df, key, seed, by=[by], out="_tz_rank"), quotas, by, "_tz_quota")
    return ranked.withColumn(
        out, F.when(F.col("_tz_rank") <= F.col("_tz_quota"), "test").otherwise("train")).drop("_tz_rank", "_tz_quota")


def stratified_folds(df: DataFrame, k: int = 5, by: str = "trgt", seed=56, key: str = "row_id",
                     out: str = "fold") -> DataFrame:
    """fold = (rows in earlier classes + rank in class - 1) mod k: every
    fold gets floor or ceil of each class's share, classes dealt round-robin."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n_c"))
    offsets = counts.select(by, F.coalesce(F.sum("n_c").over(
        Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_tz_class_off"))
    ranked = class_lookup(seeded_rank(df, key, seed, by=[by], out="_tz_rank"), offsets, by, "_tz_class_off")
    return ranked.withColumn(
        out, F.pmod(F.col("_tz_class_off") + F.col("_tz_rank") - 1, F.lit(k)).cast("int")).drop(
        "_tz_rank", "_tz_class_off")


MOST_LABELS = 16


def deal_label_sets(counts: Mapping[str, int], k: int) -> dict[str, tuple[int, list[int]]]:
    """For each label set (a string of 0 and 1) of ``counts``: how many rows
    every fold gets, and the folds that get one more. Sets are dealt by their
    rarest label, rarest first; a row left over goes to the fold that lacks
    most of that label, then of all its labels, then of rows, then to the first."""
    size = len(next(iter(counts), ""))
    total = [sum(n for s, n in counts.items() if s[i] == "1") for i in range(size)] + [sum(counts.values())]
    has = {s: [i for i in range(size) if s[i] == "1"] for s in counts}
    rarest = {s: min(has[s], key=lambda i: (total[i], i), default=size) for s in counts}
    # k times what a fold lacks of each label, and of rows: whole numbers
    lack = [[t - k * sum(n // k for s, n in counts.items() if i == size or s[i] == "1") for i, t in enumerate(total)] for _ in range(k)]
    out = {}
    for s in sorted(counts, key=lambda s: (not has[s], total[rarest[s]], s)):
        more: list[int] = []
        for _ in range(counts[s] % k):
            free = [f for f in range(k) if f not in more]
            f = max(free, key=lambda f: (lack[f][rarest[s]], sum(lack[f][i] for i in has[s]), lack[f][size], -f))
            more.append(f)
            for i in [*has[s], size]:
                lack[f][i] -= k
        out[s] = (counts[s] // k, more)
    return out


def multilabel_folds(df: DataFrame, labels: Sequence[str], k: int = 5, seed=56, key: str = "row_id", out: str = "fold") -> DataFrame:
    """O6 for several labels at once: folds that are balanced in every label and
    in size, by iterative stratification on the label sets. A job counts the
    sets (at most 2^labels rows come to the driver); rows are then dealt within
    their set in the order of the seeded hash. A label other than 0 or 1 is an error."""
    if not 0 < len(labels) <= MOST_LABELS:
        raise ValueError(f"from 1 to {MOST_LABELS} labels")
    bad = F.raise_error(F.lit("a label is neither 0 nor 1"))
    sets = F.concat(*[F.when(F.col(c) == 1, "1").when(F.col(c) == 0, "0").otherwise(bad) for c in labels])
    rows = df.withColumn("_tz_set", sets)
    dealt = deal_label_sets({r["_tz_set"]: r["n"] for r in rows.groupBy("_tz_set").agg(F.count(F.lit(1)).alias("n")).collect()}, k)
    if not dealt:
        return df.withColumn(out, F.lit(None).cast("int"))
    each = F.create_map(*[x for s, (n, _) in dealt.items() for x in (F.lit(s), F.lit(n * k).cast("long"))])
    more = F.create_map(*[x for s, (_, fs) in dealt.items() for x in (F.lit(s), F.array(*map(F.lit, fs)).cast("array<int>"))])
    at = F.col("_tz_rank") - 1 - F.element_at(each, F.col("_tz_set"))  # from 0 on: of the rows left over
    fold = F.when(at < 0, F.pmod(F.col("_tz_rank") - 1, F.lit(k))).otherwise(F.get(F.element_at(more, F.col("_tz_set")), at.cast("int")))
    ranked = seeded_rank(rows, key, seed, by=["_tz_set"], out="_tz_rank")
    return ranked.withColumn(out, fold.cast("int")).drop("_tz_rank", "_tz_set")


def by_family(assign, df: DataFrame, family: str, is_original, *args, **kw) -> DataFrame:
    """Run a row assignment (split/fold/holdout) on original rows only and give
    every copy its parent's value: ``family`` is the original's key on every
    row (``coalesce(parent_id, row_id)``). Every row is returned; a copy whose
    original is not in ``df`` is an error."""
    orig = df.where(is_original)
    assigned = assign(orig, *args, **kw)
    new_cols = [c for c in assigned.columns if c not in orig.columns]
    got = assigned.select(F.col(kw.get("key", "row_id")).alias("_tz_f"), *new_cols, F.lit(True).alias("_tz_found"))
    orphan = F.raise_error(F.concat(F.lit("no original for the copy of "), F.col(family).cast("string")))
    out = df.join(got, F.col(family) == F.col("_tz_f"), "left")
    for c in new_cols:
        out = out.withColumn(c, F.when(F.col("_tz_found"), F.col(c)).otherwise(orphan.cast(out.schema[c].dataType)))
    return out.drop("_tz_f", "_tz_found")


def sample_by_cycle(df: DataFrame, n: int, cycle: int, seed, key: str = "row_id",
                    tag_cols: Sequence[str] = tuple(fv.CYCLE_TAG_COLUMNS),
                    drop_cols: Sequence[str] = tuple(fv.CYCLE_DROP_COLUMNS)) -> DataFrame:
    """One annotation cycle: sample n, index 0..n-1 in sample order, blank
    the tag/rationale/note columns, drop pairing ids, tag with the cycle."""
    s = sample_n(df, n, seed, key, position="index")
    s = assign_blank(s, tag_cols, " ")
    s = drop_columns(s, drop_cols)
    return s.withColumn("cycle", F.lit(cycle))


def masked_copy(df: DataFrame, tag_cols: Sequence[str], drop_cols: Sequence[str] = ()) -> DataFrame:
    """The second rater's packet: same rows, tags blanked, ids dropped."""
    return assign_blank(drop_columns(df, drop_cols), tag_cols, " ")
