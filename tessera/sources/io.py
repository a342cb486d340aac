"""Sources and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.text import pystrip

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table_path(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, path: str, schema: StructType | None = None,
               row_id: str | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """Read a table; ``row_id`` names the column that plays the sheet's
    index and is exposed as ``row_id`` (first column). A declared ``schema``
    skips inference. Filters and projections applied later reach the scan."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    if row_id and row_id != "row_id":
        df = df.withColumnRenamed(row_id, "row_id")
    if row_id:
        df = df.select("row_id", *[F.col(f"`{c}`") for c in df.columns if c != "row_id"])
    return df


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition of a table of fewer files than the cluster has
    cores (e.g. one small file with one row group); a no-op on larger ones. Filters and column
    pruning still reach the scan through the repartition."""
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) < want:  # file names only; no job runs
        return df.repartition(want)
    return df


def load(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(base, name))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """A term list, one per line, stripped, empty lines dropped. Keeps the
    file order in ``pos`` (sequential redaction depends on it)."""
    lines = spark.read.text(path).select(pystrip("value").alias("term"))
    return lines.where(F.col("term") != "").withColumn("pos", F.monotonically_increasing_id())


def terms_list(terms: DataFrame) -> list[str]:
    """The term table as a driver-side list, in order (sequential redaction
    needs every term at each row)."""
    return [r.term for r in terms.orderBy("pos").collect()]


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite",
                fmt: str = "parquet") -> None:
    """One table per stage; ``partition_by=['cycle']`` gives per-cycle
    directories that later reads prune, and then an overwrite replaces the
    partitions that ``df`` holds and leaves the others."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    w.save(path)


RUN = "_run"


def _fingerprint(cols: Sequence[str]) -> list:
    """Number of rows and a digest that does not depend on their order."""
    digest = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in cols]).cast("decimal(38,0)"))
    return [F.count(F.lit(1)).alias("n_rows"), F.coalesce(digest, F.lit(0)).cast("string").alias("digest")]


def write_partitions(df: DataFrame, path: str, by: Sequence[str]) -> str:
    """S4, re-runnable: replaces the partitions (values of ``by``) that ``df``
    holds and commits them in a manifest; returns the run's id. A rerun leaves
    what it wrote before, never a second copy. A run that dies before its
    manifest is written leaves partitions that :func:`read_partitions` does not
    show; running it again mends them. An empty ``df`` changes nothing."""
    by, run = list(by), uuid.uuid4().hex
    if RUN in df.columns:
        raise ValueError(f"{RUN} is the name of the run's column")
    write_table(df.withColumn(RUN, F.lit(run)), f"{path}/data", by)
    written = df.sparkSession.read.schema(_with_run(df.schema)).parquet(f"{path}/data").where(F.col(RUN) == run)
    rest = [c for c in df.columns if c not in by]
    manifest = written.groupBy(*by, RUN).agg(*_fingerprint(rest or by))
    write_table(manifest, f"{path}/manifest", by)
    return run


def _with_run(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(RUN, StringType())])


def read_partitions(spark: SparkSession, path: str, schema: StructType, by: Sequence[str]) -> DataFrame:
    """The rows of committed partitions of a table of :func:`write_partitions`.
    Filters on ``by`` prune the scan. Without a committed run: no rows."""
    try:
        done = read_manifest(spark, path, schema, by)
    except AnalysisException:  # no folder yet
        return spark.createDataFrame([], schema)
    data = spark.read.schema(_with_run(schema)).parquet(f"{path}/data")
    done = done.select(F.col(RUN).alias("_tz_run"), *[F.col(c).alias(f"_tz_{c}") for c in by])
    same = F.col(RUN) == F.col("_tz_run")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_tz_{c}"))
    return data.join(done, same, "left_semi").select(*[F.col(f"`{c}`") for c in schema.names])


def read_manifest(spark: SparkSession, path: str, schema: StructType, by: Sequence[str]) -> DataFrame:
    """A row per committed partition: ``by``, the run, n_rows and digest."""
    fields = [f for f in schema.fields if f.name in by]
    more = [StructField(RUN, StringType()), StructField("n_rows", LongType()), StructField("digest", StringType())]
    return spark.read.schema(StructType([*more, *fields])).parquet(f"{path}/manifest").select(*by, RUN, "n_rows", "digest")


def check_partitions(spark: SparkSession, path: str, schema: StructType, by: Sequence[str]) -> DataFrame:
    """The partitions whose rows are not those of the manifest (files lost or
    changed afterwards): ``by`` and both fingerprints."""
    rest = [c for c in schema.names if c not in by]
    now = read_partitions(spark, path, schema, by).groupBy(*by).agg(*_fingerprint(rest or by))
    now = now.select(*[F.col(c).alias(f"_tz_{c}") for c in by], F.col("n_rows").alias("found_rows"), F.col("digest").alias("found_digest"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_tz_{c}"))
    both = read_manifest(spark, path, schema, by).join(now, same, "left")
    differ = ~F.col("n_rows").eqNullSafe(F.col("found_rows")) | ~F.col("digest").eqNullSafe(F.col("found_digest"))
    return both.where(differ).select(*by, "n_rows", "digest", "found_rows", "found_digest")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header row and no index column."""
    df.write.mode(mode).option("header", True).csv(path)


def profile(df: DataFrame, order: Sequence[str] | None = None, head: int = 5) -> DataFrame:
    """Non-null count and type per column, in one pass over the data. With
    ``order`` also ``first``: the column's values in the first ``head`` rows
    along it, as strings parted by ' | ' (missing ones empty)."""
    cols = df.columns
    counts = df.agg(F.count(F.lit(1)).alias("__rows"),
                    *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    firsts = {}
    if order is not None:
        rows = df.orderBy(*order).limit(head).select(*[F.col(f"`{c}`").cast("string").alias(f"s{i}")
                                                       for i, c in enumerate(cols)]).collect()
        firsts = {i: " | ".join(r[i] or "" for r in rows) for i in range(len(cols))}
    stack = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype"),
                               F.lit(i).alias("position"), F.col(f"c{i}").alias("non_null"),
                               *([F.lit(firsts[i]).alias("first")] if firsts else []))
                      for i, c in enumerate(cols)])
    return counts.select(F.col("__rows").alias("n_rows"), F.inline(stack)).select(
        "position", "column_name", "dtype", "non_null", "n_rows", *(["first"] if firsts else []))
