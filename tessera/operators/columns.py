"""Projections, filters and predicates (P1-P14). All are narrow (no shuffle)
except head_by, a top-n."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns; absent names are ignored, as is the stray '/;' column."""
    return df.drop(*cols, "/;")


def suffix_columns(df: DataFrame, suffix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Append ``suffix`` to every column not in ``keep``."""
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in df.columns if c not in keep})


def assign_blank(df: DataFrame, cols: Sequence[str], value: str = " ") -> DataFrame:
    """Set annotation columns to a constant placeholder."""
    return df.withColumns({c: F.lit(value) for c in cols})


def drop_sentinel(df: DataFrame, col: str = "Unique ID", sentinel: str = fv.SENTINEL_ID) -> DataFrame:
    """P5: drop rows whose id equals the junk sentinel; NULL ids are kept."""
    return df.where(~F.col(col).eqNullSafe(F.lit(sentinel)))


def normalize_ids(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Float ids -> LONG; NULL/NaN -> 0, half-even rounding."""
    return df.withColumns({
        c: F.bround(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)), 0).cast("long")
        for c in cols})


def condense_responses(df: DataFrame, pilot: int = 0, key: str | None = "row_id") -> DataFrame:
    """De-identify and reduce a raw response sheet: drop contact columns,
    add ``pilot``, ids to LONG, drop sentinel rows, ``Cleaned Message`` ->
    ``text``, fixed column order. ``key`` (the sheet's index) is kept first."""
    d = drop_columns(df, fv.RAW_SHEET_DROP)
    d = d.withColumn("pilot", F.lit(pilot))
    d = normalize_ids(d, ["EmailPairID", "WithinPatientID", "MHP ID"])
    d = drop_sentinel(d, "Unique ID")
    d = d.withColumnRenamed("Cleaned Message", "text")
    cols = ([key] if key else []) + fv.CONDENSED_ORDER
    return d.select(*[F.col(f"`{c}`") for c in cols])


def any_positive(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows where any of ``cols`` equals 1."""
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.col(c) == 1, F.lit(False))
    return df.where(cond)


def head_by(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """First ``n`` rows along ``order``, sorted (a top-n: no full sort;
    the n rows themselves pass through one task)."""
    return df.orderBy(*order).limit(n)


def composite_indicator(df: DataFrame, cols: Sequence[str], out: str = "trgt") -> DataFrame:
    """P10: 1 if any column is truthy (non-zero; a missing value counts as
    truthy, as NaN does in Python), else 0."""
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.col(c) != 0, F.lit(True))
    return df.withColumn(out, cond.cast("int"))


def disagreements(df: DataFrame, codes: Sequence[str], s1: str, s2: str, suffix: str = "_dis") -> DataFrame:
    """1 where the two raters' (normalised) tags differ."""
    return df.withColumns({
        f"{c}{suffix}": (~F.col(f"{c}_{s1}").eqNullSafe(F.col(f"{c}_{s2}"))).cast("int") for c in codes})


def triangulate(df: DataFrame, codes: Sequence[str], model_suffix: str = "_gpt",
                out_suffix: str = "_triangulate") -> DataFrame:
    """1 only where human = 1 and model = 1; anything missing -> 0.
    Both columns must be numeric: a string '1' is not 1 (as in pandas), and
    Spark would silently cast it, so string tags are refused; run
    ``normalize_tags`` first."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for c in codes:
        for name in (c, f"{c}{model_suffix}"):
            if types.get(name) == "string":
                raise TypeError(f"{name} is a string column; normalise tags before triangulating")
    return df.withColumns({
        f"{c}{out_suffix}": F.coalesce((F.col(c) == 1) & (F.col(f"{c}{model_suffix}") == 1),
                                       F.lit(False)).cast("int") for c in codes})


def finalize_triangulated(df: DataFrame, codes: Sequence[str] | None = None,
                          id_cols: Sequence[str] = tuple(fv.ID_COLUMNS)) -> DataFrame:
    """Drop human/model/rationale/explanation columns of triangulated codes
    and the id columns; rename ``{code}_triangulate`` -> ``{code}``."""
    if codes is None:
        codes = [c[: -len("_triangulate")] for c in df.columns if c.endswith("_triangulate")]
    if not codes:
        return df
    drop = [x for c in codes for x in (c, f"{c}_gpt", f"{c}_rtnl_gpt", f"{c}_expl_gpt")] + list(id_cols)
    return drop_columns(df, drop).withColumnsRenamed({f"{c}_triangulate": c for c in codes})


def fill_placeholders(df: DataFrame, cols: Sequence[str] | None = None, value: str = ".") -> DataFrame:
    """Whole-cell ' ' -> '.' on text columns, then remaining NULLs -> '.'."""
    cols = cols if cols is not None else [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumns({c: F.coalesce(F.when(F.col(c) == " ", F.lit(value)).otherwise(F.col(c)), F.lit(value))
                           for c in cols})
