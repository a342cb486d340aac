"""Exact ranks, running sums and predecessors without a single-partition window.

``Window.orderBy(...)`` with no partition key plans ``Exchange SinglePartition``:
every row goes to one task. Here the order is cut into *buckets* that are
monotone in the order (a hex prefix of an md5 order key, or ranges between the
quantiles of a numeric order column). Rows are windowed per bucket in parallel; only the
per-bucket summary (at most ``n_buckets`` rows) is ordered as a whole, and is
broadcast back. Results are exactly those of the global window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col_of

BUCKET = "_tz_bkt"
HEX_CHARS = 4          # 16**4 = 65,536 buckets per stratum
RANGE_BUCKETS = 1024


def seeded_hash(key, seed) -> Column:
    """md5 of ``'<seed>:<key>'``: a reproducible pseudo-random order key that is
    the same in every engine and under any partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col_of(key).cast("string")))


def hex_bucket(h, chars: int = HEX_CHARS) -> Column:
    """Lexical prefix of a lower-case hex string: monotone in its order."""
    return F.substring(col_of(h), 1, chars)


def _with_bucket(df: DataFrame, bucket: Column) -> DataFrame:
    """Attach the bucket as a non-nullable column. Otherwise the optimizer
    infers ``isnotnull(bucket)`` for the join side only, the two shuffles of
    the input differ, and the input is read twice instead of reusing one
    exchange."""
    b = df.withColumn(BUCKET, bucket)
    fill = F.lit("") if b.schema[BUCKET].dataType.simpleString() == "string" else F.lit(0)
    return b.withColumn(BUCKET, F.coalesce(F.col(BUCKET), fill.cast(b.schema[BUCKET].dataType)))


def _join_small(big: DataFrame, small: DataFrame, keys: list[str], bounded: bool, how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` that also matches NULL keys (a NULL stratum is a
    stratum). ``bounded``: the caller guarantees the small side's size (a
    bucket summary of at most n_buckets rows, or a hot-strata table of at most
    rows / ROWS_PER_BUCKET rows), so it is broadcast; otherwise AQE's runtime
    size check picks the join."""
    ren = {k: f"_tz_k{i}" for i, k in enumerate(keys)}
    right = small.withColumnsRenamed(ren)
    right = F.broadcast(right) if bounded else right
    cond = [F.col(k).eqNullSafe(F.col(r)) for k, r in ren.items()]
    return big.join(right, cond, how).drop(*ren.values())


def exact_row_number(df: DataFrame, order: Sequence[Column], bucket: Column,
                     by: Sequence[str] = (), out: str = "rank", carry: DataFrame | None = None,
                     total: str | None = None) -> DataFrame:
    """``row_number() over (partition by by order by order)`` (1-based).

    ``bucket`` must be non-decreasing along ``order`` within each stratum.
    The per-bucket counts are read off the windowed rows (max row number), so
    the input is shuffled once and the count branch reuses that exchange.
    ``carry`` (a small table keyed by the strata, e.g. per-class quotas) is
    joined to the per-bucket offsets, never to the rows directly: the row join
    stays keyed by (stratum, bucket), so a hot stratum cannot skew it.
    ``total`` names an optional output column with the stratum's row count.
    """
    by = list(by)
    b = _with_bucket(df, bucket)
    ranked = b.withColumn("_tz_rn", F.row_number().over(Window.partitionBy(*by, BUCKET).orderBy(*order)))
    counts = ranked.groupBy(*by, BUCKET).agg(F.max("_tz_rn").alias("_tz_n"))
    before = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_tz_n").over(Window.partitionBy(*by)).alias(total)] if total else []
    offsets = counts.select(*by, BUCKET, F.coalesce(F.sum("_tz_n").over(before), F.lit(0)).alias("_tz_off"), *extra)
    if carry is not None:
        offsets = _join_small(offsets, carry, by, bounded=False)
    joined = _join_small(ranked, offsets, [*by, BUCKET], bounded=not by)
    return joined.withColumn(out, (F.col("_tz_off") + F.col("_tz_rn")).cast("long")).drop(
        BUCKET, "_tz_rn", "_tz_off")


ROWS_PER_BUCKET = 1 << 13   # strata above this size are split into buckets: whole rows, texts too, are sorted in them


def seeded_rank(df: DataFrame, key: str, seed, by: Sequence[str] = (), out: str = "rank",
                total: str | None = None) -> DataFrame:
    """Rank rows inside each stratum by the seeded hash of ``key`` (ties by key).

    ``key`` must be unique within a stratum for the rank to be reproducible.
    Without strata the whole table is cut into hex-prefix buckets. With
    strata, only *hot* strata (more than ``ROWS_PER_BUCKET`` rows) are split,
    each into ceil(size / ROWS_PER_BUCKET) hash ranges, so the tables that
    are broadcast back stay within (rows / ROWS_PER_BUCKET + hot strata) rows
    however many small strata there are, and small strata need no join.
    """
    h = seeded_hash(key, seed)
    tmp = df.withColumn("_tz_h", h)
    if not by:
        res = exact_row_number(tmp, [F.col("_tz_h"), F.col(key)], hex_bucket("_tz_h"), (), out, total=total)
        return res.drop("_tz_h")
    if total:
        raise ValueError("total is only computed without strata")
    by = list(by)
    counts = tmp.groupBy(*by).agg(F.count(F.lit(1)).alias("_tz_cnt"))
    hot = counts.where(F.col("_tz_cnt") > ROWS_PER_BUCKET).select(
        *by, F.ceil(F.col("_tz_cnt") / F.lit(ROWS_PER_BUCKET)).cast("long").alias("_tz_nb"))
    b = _join_small(tmp, hot, by, bounded=True, how="left")   # at most rows / ROWS_PER_BUCKET rows
    frac = F.conv(F.substring("_tz_h", 1, 8), 16, 10).cast("long")    # 32-bit prefix, monotone in the hash
    bucket = F.when(F.col("_tz_nb").isNotNull(), F.floor(frac * F.col("_tz_nb") / F.lit(float(1 << 32))))
    b = _with_bucket(b, F.coalesce(bucket, F.lit(0)).cast("long"))
    ranked = b.withColumn("_tz_rn", F.row_number().over(
        Window.partitionBy(*by, BUCKET).orderBy(F.col("_tz_h"), F.col(key))))
    per = ranked.where(F.col("_tz_nb").isNotNull()).groupBy(*by, BUCKET).agg(F.max("_tz_rn").alias("_tz_n"))
    before = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*by, BUCKET, F.coalesce(F.sum("_tz_n").over(before), F.lit(0)).alias("_tz_off"))
    joined = _join_small(ranked, offsets, [*by, BUCKET], bounded=True, how="left")
    return joined.withColumn(out, (F.coalesce(F.col("_tz_off"), F.lit(0)) + F.col("_tz_rn")).cast("long")).drop(
        BUCKET, "_tz_rn", "_tz_off", "_tz_nb", "_tz_h")


def order_bounds(df: DataFrame, order_col: str, n_buckets: int = RANGE_BUCKETS) -> list[float]:
    """Cut points of a numeric order column at its quantiles: one
    column-pruned aggregate. Pass the result as ``bounds`` to several
    order-dependent operators over frames that share the column, so it is
    computed once."""
    at = [(k + 1) / n_buckets for k in range(n_buckets - 1)]
    got = df.agg(F.percentile_approx(F.col(order_col).cast("double"), at, 10 * n_buckets)).first()[0]
    return sorted(set(got or []))


def _with_range_bucket(df: DataFrame, order_col: str, n_buckets: int,
                       bounds: Sequence[float] | None = None) -> DataFrame:
    """Buckets of a numeric order column between cut points (its quantiles
    when not given), so a bucket holds about an equal share of the rows
    wherever the values lie. Any cut points give monotone buckets: stale ones
    cost balance, never correctness. The bucket is found in two steps, among
    every k-th cut point and then among the k from there on."""
    cuts = sorted(float(b) for b in (bounds if bounds is not None else order_bounds(df, order_col, n_buckets)))
    x = F.col(order_col).cast("double")
    k = max(1, int(len(cuts) ** 0.5))
    parts = [cuts[i:i + k] for i in range(0, len(cuts), k)]
    if not parts:
        return _with_bucket(df, F.lit(0).cast("long"))
    lit = lambda v: F.array(*[F.lit(c) for c in v]).cast("array<double>")
    below = lambda v: F.size(F.filter(v, lambda c: c <= x))
    part = below(lit([p[0] for p in parts]))
    inner = below(F.element_at(F.array(*[lit(p) for p in parts]), part))
    bucket = F.when(x.isNull() | (part == 0), F.lit(0)).otherwise((part - 1) * k + inner)
    return _with_bucket(df, bucket.cast("long"))


def ordered_index(df: DataFrame, order: Sequence[str], out: str = "index",
                  n_buckets: int = RANGE_BUCKETS, bounds: Sequence[float] | None = None) -> DataFrame:
    """Dense 0-based position along a given order (``reset_index(drop=True)``).
    The first order column must be numeric; later ones break ties."""
    order = list(order)
    b = _with_range_bucket(df, order[0], n_buckets, bounds)
    res = exact_row_number(b.withColumnRenamed(BUCKET, "_tz_rb"), [F.col(c) for c in order], F.col("_tz_rb"), (),
                           out).drop("_tz_rb")
    return res.withColumn(out, F.col(out) - 1)


def previous_value(df: DataFrame, order: Sequence[str], value: str, out: str,
                   n_buckets: int = RANGE_BUCKETS, bounds: Sequence[float] | None = None) -> DataFrame:
    """``lag(value)`` along a global order; NULL for the first row."""
    order = list(order)
    b = _with_range_bucket(df, order[0], n_buckets, bounds)
    wb = Window.partitionBy(BUCKET).orderBy(*order)
    b = b.withColumn("_tz_rn", F.row_number().over(wb)).withColumn("_tz_lag", F.lag(value).over(wb))
    # last row of each bucket, then the last row of the nearest earlier bucket
    last = b.groupBy(BUCKET).agg(F.max_by(F.col(value), F.struct(*order)).alias("_tz_last"))
    last = last.withColumn("_tz_bprev", F.lag("_tz_last").over(Window.orderBy(BUCKET))).drop("_tz_last")
    joined = _join_small(b, last, [BUCKET], bounded=True)
    return joined.withColumn(
        out, F.when(F.col("_tz_rn") == 1, F.col("_tz_bprev")).otherwise(F.col("_tz_lag"))
    ).drop(BUCKET, "_tz_rn", "_tz_lag", "_tz_bprev")


def last_preceding(df: DataFrame, order: Sequence[str], value: Column, out: str,
                   n_buckets: int = RANGE_BUCKETS, bounds: Sequence[float] | None = None) -> DataFrame:
    """``last(value, ignorenulls) over (order by order rows between unbounded
    preceding and 1 preceding)``: the nearest earlier non-null value."""
    order = list(order)
    b = _with_range_bucket(df, order[0], n_buckets, bounds).withColumn("_tz_v", value)
    before = Window.partitionBy(BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("_tz_in", F.last("_tz_v", ignorenulls=True).over(before))
    per = b.where(F.col("_tz_v").isNotNull()).groupBy(BUCKET).agg(
        F.max_by(F.col("_tz_v"), F.struct(*order)).alias("_tz_last"))
    # every bucket (also those without a non-null value) gets the carry from
    # the buckets before it; the table has at most n_buckets rows
    allb = b.select(BUCKET).distinct()
    carry = allb.join(per, BUCKET, "left").withColumn(
        "_tz_carry", F.last("_tz_last", ignorenulls=True).over(
            Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1))).drop("_tz_last")
    joined = _join_small(b, carry, [BUCKET], bounded=True)
    return joined.withColumn(out, F.coalesce(F.col("_tz_in"), F.col("_tz_carry"))).drop(
        BUCKET, "_tz_v", "_tz_in", "_tz_carry")


def running_sums(df: DataFrame, order: Sequence[Column], bucket: Column, sums: dict[str, Column],
                 by: Sequence[str] = (), totals: bool = False) -> DataFrame:
    """Inclusive running sums (``sum(x) over (partition by by order by order rows
    unbounded preceding)``) for each expression in ``sums``; output names are
    the dict keys. ``bucket`` must be non-decreasing along ``order``. Bucket
    totals come from the windowed rows (one shuffle of the input)."""
    by = list(by)
    b = _with_bucket(df, bucket)
    for name, expr in sums.items():
        b = b.withColumn(f"_tz_x_{name}", expr)
    inside = Window.partitionBy(*by, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for n in sums:
        b = b.withColumn(f"_tz_r_{n}", F.sum(f"_tz_x_{n}").over(inside))
    totals_t = b.groupBy(*by, BUCKET).agg(*[F.sum(f"_tz_x_{n}").alias(f"_tz_t_{n}") for n in sums])
    before = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    grand = [F.sum(f"_tz_t_{n}").over(Window.partitionBy(*by)).alias(f"{n}_total") for n in sums] if totals else []
    offsets = totals_t.select(*by, BUCKET, *[
        F.coalesce(F.sum(f"_tz_t_{n}").over(before), F.lit(0)).alias(f"_tz_o_{n}") for n in sums], *grand)
    joined = _join_small(b, offsets, [*by, BUCKET], bounded=not by)
    for n in sums:
        joined = joined.withColumn(n, F.col(f"_tz_o_{n}") + F.col(f"_tz_r_{n}"))
    drop = [BUCKET] + [f"_tz_{k}_{n}" for n in sums for k in ("x", "o", "r")]
    return joined.drop(*drop)
