"""Mixing sources to target weights.

The words of a source, document after document, form one long row that is cut
into blocks of ``block`` words (the last may be shorter). The mix is a list of
output shards; each shard's slots are shared out over the sources by a
multinomial draw (conditioned on the targets still open, so that the totals
come out right). The k-th slot of a source takes the block that a pseudorandom
permutation of its block numbers puts at k; a further pass over the source
uses another permutation. Slots and blocks meet in one join by (source, block
number).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.batches import row_parts

from .common import WORD, n_parts, saved

BLOCK = 64
SHARD_SLOTS = 4096
WEIGHTS = (3.0, 1.0, 2.0)
BROADCAST_SOURCES = 100_000


def water_fill(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Targets that sum to ``share`` of all sizes, in proportion to the
    weights; none above ``most`` times its source's size, the excess reshared
    by weight among the others until none is above."""
    target, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = share * sum(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = unit * weights[i]
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ = [i for i in open_ if i not in set(over)]
    return target


def shard_counts(totals: list[int], shard_slots: int, seed: int) -> Iterator[np.ndarray]:
    """Per output shard, how many slots each source gets: a multinomial draw
    over the sources' open totals, held to what a source has left, at any
    number of slots. What a draw loses so stays open for the next shards, so
    every source ends at its total."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left = np.array(totals, dtype=np.int64)
    while (n := int(left.sum())) > 0:
        got = np.minimum(rng.multinomial(min(n, shard_slots), left / n), left)
        left -= got
        yield got


def permuted(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(n), at k; n and key by element. A
    four-round Feistel network over the next even number of bits, walked on
    until it falls below n."""
    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))).astype(np.uint64) + np.uint64(1)) >> np.uint64(1))
    mask = (np.uint64(1) << bits) - np.uint64(1)

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    x, n, key = k.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    todo = np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            v, b, m, s = x[todo], bits[todo], mask[todo], key[todo]
            left, right = v >> b, v & m
            for r in range(4):
                left, right = right, left ^ (mix(right + s * np.uint64(2 * r + 1) + np.uint64(r)) & m)
            x[todo] = (left << b) | right
            todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def _drawn(batches: Iterator[pa.RecordBatch], blocks: np.ndarray, slots: np.ndarray, shard_slots: int,
           seed: int) -> Iterator[pa.RecordBatch]:
    """What each output shard takes from each source."""
    for _ in batches:
        pass
    first = np.zeros(len(slots), dtype=np.int64)
    for shard, got in enumerate(shard_counts(slots.tolist(), shard_slots, seed)):
        i = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i), pa.array(blocks[i]), pa.array(np.full(len(i), shard, dtype=np.int64)), pa.array(first[i]),
             pa.array(got[i])], names=["_s", "blocks", "shard", "first", "slots"])
        first += got


def _slots(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            for at in range(0, r["slots"], 200_000):
                k = np.arange(r["first"] + at, r["first"] + min(at + 200_000, r["slots"]), dtype=np.int64)
                n = np.full(len(k), r["blocks"], dtype=np.int64)
                turn = k // n
                base = int.from_bytes(hashlib.blake2b(f"{seed}:{r['_s']}".encode(), digest_size=7).digest(), "little")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["_s"]] * len(k), pa.int64()), pa.array(permuted(k % n, n, base + turn * 7919)),
                     pa.array(turn), pa.array([r["shard"]] * len(k), pa.int64()), pa.array(k)],
                    names=["_s", "_b", "turn", "shard", "slot"])


def word_count(text_col: str):
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")


class Mix:
    """``rows``: one row per document with its size, source and word offset
    there; ``sources``: a row per source with size, target, blocks and slots;
    ``pieces``: a row per document and block taken: the word range, the pass
    over the source (``turn``), the output shard and the slot."""

    def __init__(self, rows: DataFrame, sources: DataFrame, pieces: DataFrame) -> None:
        self.rows, self.sources, self.pieces = rows, sources, pieces


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK,
        shard_slots: int = SHARD_SLOTS, seed: int = 17, stripes: int = 256) -> Mix:
    """Mix the sources of ``docs``. ``weights`` repeat over the sources in
    code-point order (the null source last).

    Null text has no words. Rows that repeat others are stretches of words of
    their own. A text of any length is cut into blocks; other columns are not
    read here, and :func:`mixed_documents` carries them under any names. An empty table, or one without a word, has an empty mix. The
    table of sources (a few numbers for each) goes through the driver;
    documents, blocks, slots and the shards' draws do not.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"),
                       word_count(text_col).alias("size"),
                       F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"))
    # order by hash within a source: stripes bound each window, however large the source
    rows = saved(rows.withColumn("_stripe", F.pmod(F.xxhash64("_id", "_h", F.lit(seed)), F.lit(stripes)).cast("int")),
                 "mix-sizes")
    found = sorted(rows.groupBy("_source").agg(F.sum("size").alias("size")).collect(),
                   key=lambda r: (r["_source"] is None, r["_source"] or ""))
    sizes = [r["size"] for r in found]
    target = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)
    blocks = [-(-s // block) for s in sizes]
    slots = [min(int(most) * b, round(t * b / s)) if s else 0 for s, t, b in zip(sizes, target, blocks, strict=True)]
    sources = spark.createDataFrame(
        [(i, r["_source"], s, t, b, n) for i, (r, s, t, b, n) in
         enumerate(zip(found, sizes, target, blocks, slots, strict=True))],
        "_s long, _ss string, source_size long, target double, blocks long, slots long")
    # what each output shard takes from each source: a row each, made by one task, handed out and expanded to the slots
    n, block_counts, slot_counts = sum(slots), np.array(blocks, dtype=np.int64), np.array(slots, dtype=np.int64)
    drawn = spark.range(1, numPartitions=1).mapInArrow(
        lambda b: _drawn(b, block_counts, slot_counts, max(shard_slots, n // 1000), seed),
        "_s long, blocks long, shard long, first long, slots long")
    drawn = drawn.repartition(max(1, min(n, 10_000, n_parts(spark)))).mapInArrow(
        lambda b: _slots(b, seed), "_s long, _b long, turn long, shard long, slot long")
    # word offsets of the documents in their sources
    small = F.broadcast(sources) if len(found) <= BROADCAST_SOURCES else sources
    rows = rows.join(small, F.col("_source").eqNullSafe(F.col("_ss"))).drop("_ss", "blocks", "slots")
    run = Window.partitionBy("_s", "_stripe").orderBy("_id", "_h").rowsBetween(Window.unboundedPreceding, 0)
    base = rows.groupBy("_s", "_stripe").agg(F.sum("size").alias("_sum"))
    base = base.withColumn("_base", F.sum("_sum").over(Window.partitionBy("_s").orderBy("_stripe")) - F.col("_sum"))
    placed = rows.withColumn("_run", F.sum("size").over(run) - F.col("size")).join(
        base.select("_s", "_stripe", "_base"), ["_s", "_stripe"])
    placed = placed.withColumn("_at", F.col("_run") + F.col("_base")).drop("_run", "_base", "_stripe", "_source")
    parts = placed.where("size > 0").withColumn("_b", F.explode(F.sequence(
        F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.col("size") - 1) / block))))
    start = F.greatest(F.lit(0).cast("long"), F.col("_b") * block - F.col("_at"))
    stop = F.least(F.col("size"), (F.col("_b") + 1) * block - F.col("_at"))
    # Spark takes the slots to be as few as the rows they are expanded from, and would send them all to the driver
    pieces = parts.select("_id", "_h", "_s", "_b", "_at", start.alias("start"), stop.alias("stop")).join(
        drawn.hint("merge"), ["_s", "_b"])
    return Mix(placed, sources, pieces)


def taken(m: Mix, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, size, source_size, target, taken (words, repeats counted)."""
    got = m.pieces.groupBy("_s", "_at").agg(F.sum(F.col("stop") - F.col("start")).alias("_taken"))
    got = got.select(F.col("_s").alias("_s2"), F.col("_at").alias("_at2"), "_taken")
    # documents without words share their offset with the next; the others' offsets differ
    where = F.when(F.col("size") > 0, F.col("_at")).otherwise(F.lit(None))
    rows = m.rows.withColumn("_where", where)
    rows = rows.join(got, (F.col("_s") == F.col("_s2")) & (F.col("_where") == F.col("_at2")), "left")
    return rows.select(F.col("_id").alias(id_col), "size", "source_size", "target",
                       F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


def _cut(batches: Iterator[pa.RecordBatch], text_at: str, out_schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    word = regex.compile(WORD)
    for part in (p for b in batches for p in row_parts(b, text_at)):
        rows = []
        for r in part.to_pylist():
            spans = [m.span() for m in word.finditer(r[text_at] or "")]
            by_turn: dict[int, list] = {}
            for p in r.pop("_tz_p"):
                by_turn.setdefault(p["turn"], []).append((p["start"], p["stop"]))
            text = r[text_at]
            for turn in sorted(by_turn):
                runs: list[list[int]] = []
                for a, z in sorted(set(by_turn[turn])):
                    if runs and runs[-1][1] >= a:
                        runs[-1][1] = max(runs[-1][1], z)
                    else:
                        runs.append([a, z])
                rows.append(r | {text_at: "\n".join(text[spans[a][0]:spans[z - 1][1]] for a, z in runs)})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, out_schema)


def mixed_documents(docs: DataFrame, m: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix as documents: for each pass over its source, one row per
    document with the words taken (whole runs of blocks, line breaks kept;
    runs are joined by a line break) and its other columns. Rows that repeat
    both id and text all get the union of their takings."""
    from pyspark.sql.pandas.types import to_arrow_schema

    per = m.pieces.groupBy(F.col("_id").alias("_tz_id2"), F.col("_h").alias("_tz_h")).agg(
        F.collect_list(F.struct("turn", "start", "stop")).alias("_tz_p"))
    d = docs.join(per, docs[id_col].eqNullSafe(F.col("_tz_id2"))
                  & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col("_tz_h"))).drop("_tz_id2", "_tz_h")
    schema = docs.schema
    arrow = to_arrow_schema(schema)
    return d.mapInArrow(lambda b: _cut(b, text_col, arrow), schema)
