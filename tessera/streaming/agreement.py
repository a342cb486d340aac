"""Kappa over a stream of paired annotations.

Cohen's kappa depends on the rows only through the confusion cells
(tag, a, b, count), which Structured Streaming keeps as the state of an
ordinary streaming aggregation. Each micro-batch then turns the (tiny) cell
table into kappa per tag with the batch operator and overwrites the result
table, so the report always covers every pair seen so far.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.agreement import confusion_cells, kappa_from_cells
from ..operators.labels import normalize_tags


def kappa_stream(pairs: DataFrame, codes: Sequence[str], s1: str, s2: str, sink_dir: str,
                 checkpoint_dir: str, available_now: bool = True, coerce: bool = True) -> StreamingQuery:
    """``pairs`` is a streaming DataFrame with ``{code}_{s1}`` / ``{code}_{s2}``
    columns. ``checkpoint_dir`` (shared storage) holds the aggregation state, so
    a restarted query resumes with the same cells."""
    cols = [f"{c}_{s}" for c in codes for s in (s1, s2)]
    d = normalize_tags(pairs, cols, "coerce") if coerce else pairs
    cells = confusion_cells(d, codes, s1, s2)

    def write(batch: DataFrame, _batch_id: int) -> None:
        kappa_from_cells(batch).write.mode("overwrite").parquet(sink_dir)

    w = (cells.writeStream.outputMode("complete").option("checkpointLocation", checkpoint_dir)
         .foreachBatch(write))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
