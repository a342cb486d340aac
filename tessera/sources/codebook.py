"""S3: the codebook as a (tiny, broadcast) table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import fixed_values as fv

CODEBOOK_SCHEMA = StructType([
    StructField("alias", StringType(), False),
    StructField("name", StringType(), True),
    StructField("definition", StringType(), True),
    StructField("clarification", StringType(), True),
    StructField("examples", StringType(), True),
])


def codebook(spark: SparkSession, rows=None, aliases=None) -> DataFrame:
    """Codebook rows (alias, name, definition, clarification, examples); missing
    clarification/examples become ''. Strings are taken verbatim (no trim)."""
    rows = rows if rows is not None else fv.CODEBOOK
    df = spark.createDataFrame([tuple(r) for r in rows], CODEBOOK_SCHEMA)
    if aliases is not None:
        df = df.where(F.col("alias").isin(list(aliases)))
    return df.withColumns({"clarification": F.coalesce("clarification", F.lit("")),
                           "examples": F.coalesce("examples", F.lit(""))})
