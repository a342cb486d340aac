"""Row generation, set operations and lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import last_preceding, previous_value
from .sampling import stratified_split


def concat_rows(*dfs: DataFrame) -> DataFrame:
    """Bag union aligned by column name; missing columns are NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def replicate(df: DataFrame, target_rows: int, out: str = "rep", key: str | None = None) -> DataFrame:
    """Repeat the table ceil(target_rows / n) times (test scaffolding).
    One count action; the repetition is a row-local explode, not a join. With
    ``key`` the rows get a new unique id, ``rep_id``."""
    n = df.count()
    k = max(1, -(-target_rows // n)) if n else 1
    rep = df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return rep.withColumn("rep_id", F.concat_ws(":", F.col(key).cast("string"), F.col(out).cast("string"))) if key else rep


def augment(df: DataFrame, key: str = "row_id", text: str = "text", rtnl: str = "rtnl", trgt: str = "trgt",
            clear_rtnl: bool = True) -> DataFrame:
    """Every row with ``trgt > 0`` is followed by a copy whose text is its
    rationale. One pass (explode), no union, no shuffle. Adds ``seq`` (0 for
    the original, 1 for the copy), ``parent_id`` (the original's key on the
    copy) and ``agmt`` (1 on copies). ``clear_rtnl`` blanks the copy's
    rationale to ' ', as the reference does after flagging. ``aug_id`` is a
    row id that is unique where ``key`` is: the copy shares its parent's key."""
    others = [c for c in df.columns if c not in (text, rtnl)]
    orig = F.struct(*[F.col(c) for c in others], F.col(text).alias(text), F.col(rtnl).alias(rtnl),
                    F.lit(0).alias("seq"), F.lit(None).cast(df.schema[key].dataType).alias("parent_id"),
                    F.lit(0).alias("agmt"))
    copy = F.struct(*[F.col(c) for c in others], F.col(rtnl).alias(text),
                    (F.lit(" ") if clear_rtnl else F.col(rtnl)).alias(rtnl),
                    F.lit(1).alias("seq"), F.col(key).alias("parent_id"), F.lit(1).alias("agmt"))
    rows = F.when(F.coalesce(F.col(trgt) > 0, F.lit(False)), F.array(orig, copy)).otherwise(F.array(orig))
    return df.select(F.inline(rows)).withColumn("aug_id", aug_id(key))


def aug_id(key: str):
    """Unique id of an augmented row: its key and which copy it is."""
    return F.concat_ws(":", F.col(key).cast("string"), F.col("seq").cast("string"))


def flag_augmented(df: DataFrame, order: list[str], text: str = "text", rtnl: str = "rtnl",
                   out: str = "agmt", bounds: Sequence[float] | None = None) -> DataFrame:
    """W1 (faithful): 1 where ``text`` equals the previous row's rationale
    along ``order`` (NULL never equals NULL). Computed without a global
    single-partition window."""
    # 256-bit digests go through the window and the broadcast, not the texts
    d = df.withColumns({"_tz_td": F.sha2(text, 256), "_tz_rd": F.sha2(rtnl, 256)})
    d = previous_value(d, order, "_tz_rd", "_tz_prev", bounds=bounds)
    return d.withColumn(out, F.coalesce(F.col("_tz_td") == F.col("_tz_prev"), F.lit(False)).cast("int")).drop(
        "_tz_prev", "_tz_td", "_tz_rd")


def parent_of(df: DataFrame, order: list[str], flag: str = "agmt", key: str = "row_id",
              out: str = "parent_key", bounds: Sequence[float] | None = None) -> DataFrame:
    """For each flagged row, the key of the nearest preceding unflagged
    row (an as-of lookup); NULL on unflagged rows."""
    d = last_preceding(df, order, F.when(F.col(flag) == 0, F.col(key)), "_tz_p", bounds=bounds)
    return d.withColumn(out, F.when(F.col(flag) == 1, F.col("_tz_p"))).drop("_tz_p")


def semi(df: DataFrame, other: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Rows of ``df`` whose ``left_on`` appears in ``other.right_on``
    (existence only: duplicates on the right never multiply rows)."""
    return df.join(other.select(F.col(right_on).alias("_tz_k")), F.col(left_on) == F.col("_tz_k"), "left_semi")


def assemble_train(aug: DataFrame, test_size: float = 0.2, by: str = "trgt", seed=56, key: str = "row_id",
                   out: str = "split") -> DataFrame:
    """Leak-safe split: originals split by class; copies join the train
    side only when their parent is in train; the test side holds originals
    only. Returns every kept row with ``split``."""
    orig = aug.where(F.col("agmt") == 0)
    split = stratified_split(orig, test_size, by, seed, key, out)
    train_keys = split.where(F.col(out) == "train").select(key)
    copies = semi(aug.where(F.col("agmt") == 1), train_keys, "parent_id", key).withColumn(out, F.lit("train"))
    return split.unionByName(copies)


def split_and_augment(df: DataFrame, test_size: float = 0.2, by: str = "trgt", seed=56, key: str = "row_id",
                      out: str = "split", **kw) -> DataFrame:
    """O7 from the originals: split them by class, then add the rationale
    copies of train rows where they stand. The same rows as
    :func:`assemble_train` on the augmented table, without its join."""
    aug = augment(stratified_split(df, test_size, by, seed, key, out), key, **kw)
    return aug.where((F.col("agmt") == 0) | (F.col(out) == "train"))


def split_report(df: DataFrame, split: str = "split") -> DataFrame:
    """Row count per split."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"))


def flag_and_parent(df: DataFrame, order: list[str], key: str = "row_id", text: str = "text",
                    rtnl: str = "rtnl", flag: str = "agmt", out: str = "parent_key",
                    bounds: Sequence[float] | None = None) -> DataFrame:
    """W1 then J5 in one pass over the rows: the faithful previous-row flag
    and, for flagged rows, the key of the nearest preceding unflagged row.
    One shuffle windows each order bucket; the flag of a bucket's first row
    and the carry of earlier buckets come from a per-bucket summary (at most
    n_buckets rows, broadcast back)."""
    from pyspark.sql import Window

    from .ranks import BUCKET, RANGE_BUCKETS, _join_small, _with_range_bucket
    df = df.withColumns({"_tz_td": F.sha2(text, 256), "_tz_rd": F.sha2(rtnl, 256)})
    text, rtnl = "_tz_td", "_tz_rd"  # digests, not texts, are windowed and broadcast
    b = _with_range_bucket(df, order[0], RANGE_BUCKETS, bounds)
    w = Window.partitionBy(BUCKET).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("_tz_rn", F.row_number().over(w))
    b = b.withColumn("_tz_fl", F.coalesce(F.col(text) == F.lag(rtnl).over(w), F.lit(False)))
    unflagged_later = F.when((F.col("_tz_rn") > 1) & ~F.col("_tz_fl"), F.col(key))
    b = b.withColumn("_tz_in", F.last(unflagged_later, ignorenulls=True).over(before))
    pos = F.struct(*order)
    summary = b.groupBy(BUCKET).agg(
        F.min_by(F.col(text), pos).alias("_tz_t1"), F.min_by(F.col(key), pos).alias("_tz_k1"),
        F.max_by(F.col(rtnl), pos).alias("_tz_rlast"),
        F.max_by(F.col(key), F.when((F.col("_tz_rn") > 1) & ~F.col("_tz_fl"), pos)).alias("_tz_ulast"))
    ws = Window.orderBy(BUCKET)   # one row per non-empty bucket
    summary = summary.withColumn("_tz_f1", F.coalesce(F.col("_tz_t1") == F.lag("_tz_rlast").over(ws), F.lit(False)))
    summary = summary.withColumn("_tz_lastu", F.coalesce(F.col("_tz_ulast"), F.when(~F.col("_tz_f1"), F.col("_tz_k1"))))
    summary = summary.withColumn("_tz_carry", F.last("_tz_lastu", ignorenulls=True).over(
        ws.rowsBetween(Window.unboundedPreceding, -1))).select(BUCKET, "_tz_f1", "_tz_k1", "_tz_carry")
    j = _join_small(b, summary, [BUCKET], bounded=True)
    is_flagged = F.when(F.col("_tz_rn") == 1, F.col("_tz_f1")).otherwise(F.col("_tz_fl"))
    from_first = F.when((F.col("_tz_rn") > 1) & ~F.col("_tz_f1"), F.col("_tz_k1"))
    parent = F.coalesce(F.col("_tz_in"), from_first, F.col("_tz_carry"))
    return j.withColumn(flag, is_flagged.cast("int")).withColumn(out, F.when(is_flagged, parent)).drop(
        BUCKET, "_tz_rn", "_tz_fl", "_tz_in", "_tz_f1", "_tz_k1", "_tz_carry", "_tz_td", "_tz_rd")
