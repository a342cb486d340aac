"""Kappa over a stream of tags that may be corrected.

Each event says what a rater answered, on a row and tag, and when (``seq``).
The answers are state; an event newer than the stored one replaces it, and the
row's pair moves from its old confusion cell to its new: the old one is
retracted. An older event, or one seen before, changes nothing. A null value
withdraws an answer. Rows are dealt over a fixed number of buckets by their
key's hash, and a bucket's answers are one state, so a micro-batch costs a
Python call for each bucket it touches and not for each row. The cells' totals
are a table of tags x classes^2 rows, written once for each micro-batch as the
totals before it and its changes, so a batch that is played again writes the same.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import AtomicType, BinaryType, DoubleType, FloatType, TimestampType

from ..operators.agreement import kappa_from_cells
from ..sources.io import write_table

BUCKETS = 1024
_CHANGES = "tag string, a int, b int, delta long"
_STATE = "answers binary"
_ANSWERS = pa.schema([("key", pa.string()), ("tag", pa.string()), ("a", pa.int32()), ("at_a", pa.int64()), ("b", pa.int32()), ("at_b", pa.int64())])


def _packed(now: dict[tuple, list]) -> bytes:
    """A bucket's answers as a compressed Arrow table."""
    cols = [*zip(*((*k, *v) for k, v in now.items()))]
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ANSWERS)], schema=_ANSWERS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _ANSWERS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(answers: bytes) -> dict[tuple, list]:
    key, tag, *kept = (c.to_pylist() for c in pa.ipc.open_stream(pa.py_buffer(answers)).read_all().columns)
    return dict(zip(zip(key, tag), map(list, zip(*kept))))


def _move(bucket: tuple, events: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The changes of a bucket's cells, and its answers as they are now."""
    now = _unpacked(state.get[0]) if state.exists else {}
    before: dict[tuple, tuple] = {}
    for part in events:
        for key, tag, rater, value, seq in zip(*(part[c].tolist() for c in ("key", "tag", "rater", "value", "seq"))):
            at = (key, tag)
            kept = now.get(at)
            if kept is None:
                kept = now[at] = [None, -1, None, -1]
            place = 0 if rater == "a" else 2
            if seq > kept[place + 1]:
                before.setdefault(at, (kept[0], kept[2]))
                kept[place], kept[place + 1] = None if value is None or value != value else int(value), int(seq)
    if before:
        state.update((_packed(now),))
    cells: Counter = Counter()
    for at, old in before.items():
        new = (now[at][0], now[at][2])
        if old != new:
            for pair, n in ((old, -1), (new, 1)):
                if None not in pair:
                    cells[at[1], *pair] += n
    yield pd.DataFrame([(*c, n) for c, n in cells.items() if n], columns=["tag", "a", "b", "delta"])


def _as_text(events: DataFrame, key: str):
    """A string that is the same for equal keys only; null stays null."""
    kind, col = events.schema[key].dataType, F.col(key)
    if isinstance(kind, BinaryType):
        return F.hex(col)
    if isinstance(kind, TimestampType):
        return F.unix_micros(col).cast("string")
    if not isinstance(kind, AtomicType):
        return F.to_json(F.struct(col))
    return (col + F.lit(0).cast(kind) if isinstance(kind, (DoubleType, FloatType)) else col).cast("string")  # -0.0 is 0.0


def cell_changes(events: DataFrame, key: str = "key", buckets: int = BUCKETS) -> DataFrame:
    """(tag, a, b, delta) of a streaming DataFrame of events: ``key``, tag, rater
    (``a`` or ``b``), value and seq (from 0 on; events without one are passed
    over), summed within a bucket of keys. Answers are kept for good, as a
    correction may come at any time. A task holds one bucket's answers at a
    time: more ``buckets`` keep them small beyond some 100 million keys. A
    stream keeps the number it was started with."""
    rows = events.select(_as_text(events, key).alias("key"), "tag", "rater", F.col("value").cast("int").alias("value"), F.col("seq").cast("long").alias("seq"))
    rows = rows.where("seq >= 0").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    return rows.groupBy("bucket").applyInPandasWithState(_move, _CHANGES, _STATE, "append", GroupStateTimeout.NoTimeout)


def _totals(spark: SparkSession, sink_dir: str, before: int | None = None) -> DataFrame:
    """The cells after the last batch (before number ``before``)."""
    schema = "tag string, a int, b int, cnt long, batch int"
    try:
        t = spark.read.schema(schema).parquet(f"{sink_dir}/totals")
    except AnalysisException:  # nothing written yet
        t = spark.createDataFrame([], schema)
    if before is not None:
        t = t.where(F.col("batch") < before)
    last = t.agg(F.max("batch")).first()[0]
    return t.where((F.col("batch") == F.lit(last)) & F.col("tag").isNotNull()).drop("batch")


def kappa_corrections(events: DataFrame, sink_dir: str, checkpoint_dir: str, key: str = "key", available_now: bool = True,
                      buckets: int = BUCKETS) -> StreamingQuery:
    """Starts the stream. ``sink_dir`` and ``checkpoint_dir`` are shared
    storage; read the result with :func:`corrected_kappa`."""
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        cells = batch.select("tag", "a", "b", F.col("delta").alias("cnt")).unionByName(_totals(spark, sink_dir, number))
        cells = cells.groupBy("tag", "a", "b").agg(F.sum("cnt").alias("cnt")).where("cnt <> 0")
        mark = spark.createDataFrame([(None, None, None, 0)], "tag string, a int, b int, cnt long")  # a batch without cells shows too
        out = cells.unionByName(mark).withColumn("batch", F.lit(number))
        write_table(out.coalesce(1), f"{sink_dir}/totals", ["batch"])  # at most tags x classes^2 rows

    w = cell_changes(events, key, buckets).writeStream.outputMode("append").option("checkpointLocation", checkpoint_dir).foreachBatch(write)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")).start()


def corrected_kappa(spark: SparkSession, sink_dir: str) -> DataFrame:
    """Kappa per tag after the last batch."""
    return kappa_from_cells(_totals(spark, sink_dir))
