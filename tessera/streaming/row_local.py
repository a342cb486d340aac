"""Row-local operators on streaming DataFrames.

The reference has no streaming. What carries over unchanged is every
row-local operator (tag normalisation, term/token/numeral redaction, entity
spans, reply parsing, triangulation): they are plain projections, so the same
function serves a batch DataFrame and a ``readStream`` one. Kappa streams
through its confusion cells (:mod:`.agreement`). Sampling, ranks, splits and
AP need the whole table and stay batch-only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.text import redact_terms, strip_numerals, strip_tokens


def clean_text(df: DataFrame, text: str = "text", terms: Sequence[str] | None = None) -> DataFrame:
    """Markers and names -> ' ', salience tokens -> ' ', digit/newline runs ->
    ' ' (the training-text cleaning), batch or streaming alike."""
    d = redact_terms(df, [text], terms)
    d = strip_tokens(d, text)
    return strip_numerals(d, text)


def clean_text_stream(spark: SparkSession, source_dir: str, schema: StructType, sink_dir: str,
                      checkpoint_dir: str, text: str = "text", fmt: str = "parquet",
                      available_now: bool = True) -> StreamingQuery:
    """File stream in -> :func:`clean_text` -> file sink. ``checkpoint_dir``
    must be on shared storage so the query restarts exactly-once after an
    executor or driver loss. ``available_now`` processes what is there and
    stops (incremental batch); otherwise the query keeps running."""
    src = spark.readStream.schema(schema).format(fmt).load(source_dir)
    w = (clean_text(src, text).writeStream.format(fmt)
         .option("path", sink_dir).option("checkpointLocation", checkpoint_dir).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
