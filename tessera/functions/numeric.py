"""Numeric column expressions (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of


def softplus(z) -> Column:
    """log(1 + exp(z)), stable for large |z|."""
    z = col_of(z)
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col_of(z)))


def ratio(num, den) -> Column:
    """num / den as DOUBLE, NULL when den is 0 or NULL (never raises under ANSI)."""
    return F.try_divide(col_of(num).cast("double"), col_of(den).cast("double"))
