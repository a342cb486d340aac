"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
NO_ID = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share: ``spark.checkpoint.dir`` of the
    session. Only a local master may go without (a scratch folder is made)."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-llm-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back:
    lineage is cut, and the files survive a lost executor."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def key_id(col: str) -> Column:
    """The id as a long that is never null; null ids sort last."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID))


def with_key(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """(_id, _ord, _text): ``_id`` orders the documents, ``_ord`` tells apart
    different texts under one id (0 where ids are unique). Rows that repeat
    both id and text share a key and so are one document. ``carry`` adds the
    whole rows, as the struct ``_row`` without the text."""
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("_row")] if carry else []
    base = docs.select(key_id(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *rest)
    names = ["_id", "_ord", "_text", *(["_row"] if carry else [])]
    ids = base.select("_id")
    if ids.groupBy("_id").count().where("count > 1").isEmpty():
        return base.withColumn("_ord", F.lit(0)).select(*names)
    marked = base.withColumn("_h", F.xxhash64("_text", F.length("_text")))
    kinds = marked.select("_id", "_h").distinct()
    ranked = kinds.withColumn("_ord", (F.row_number().over(Window.partitionBy("_id").orderBy("_h")) - 1).cast("int"))
    return marked.join(ranked, ["_id", "_h"]).select(*names)


def whole(batches: Iterator[pa.RecordBatch], schema: pa.Schema | None = None) -> pa.Table | None:
    """All rows of a partition (for partitions whose size Spark bounds)."""
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
