"""Tag normalisation (T1 strict, T2 lenient)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.text import BLANK_PATTERN, NUMBER_PATTERN, col_of


def tag_strict(c, numeric: bool = False) -> Column:
    """Blank, whitespace-only or NULL -> 0; an integer literal -> its value;
    anything else is an error (raised whatever the session's ANSI setting).
    A ``numeric`` column is truncated toward zero, NULL and NaN -> 0, as a
    sheet that reads as floats because of its empty cells is."""
    c = col_of(c)
    if numeric:
        return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)).try_cast("bigint"), F.lit(0).cast("bigint"))
    s = c.cast("string")
    as_int = F.trim(s).try_cast("bigint")
    return (F.when(c.isNull() | s.rlike(BLANK_PATTERN), F.lit(0))
            .when(as_int.isNull(), F.raise_error(F.concat(F.lit("tag is not an integer: "), s)))
            .otherwise(as_int)).cast("bigint")


def tag_coerce(c) -> Column:
    """Not a number -> 0; numbers truncated toward zero (``to_numeric(errors=
    'coerce').fillna(0).astype(int)``). The grammar check comes first because
    engines disagree on strings such as '1d', '1_000' and 'inf'."""
    s = col_of(c).cast("string")
    num = F.trim(s).try_cast("double")
    return F.when(s.rlike(NUMBER_PATTERN), F.coalesce(num.try_cast("bigint"), F.lit(0).cast("bigint"))).otherwise(
        F.lit(0).cast("bigint"))


def normalize_tags(df: DataFrame, cols: Sequence[str], mode: str = "strict") -> DataFrame:
    """Tags as LONG. Strict mode reads numeric columns as numbers."""
    if mode == "coerce":
        return df.withColumns({c: tag_coerce(c) for c in cols})
    if mode != "strict":
        raise KeyError(mode)
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}
    return df.withColumns({c: tag_strict(c, c in numeric) for c in cols})
