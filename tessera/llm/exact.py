"""Exact deduplication by Grace hashing.

Each scan partition first groups its own rows, so that a text which makes up a
third of the input leaves a partition once. What is left is dealt out by
digest and grouped again. Both passes are the same routine: rows enter an
open-addressing table that compares complete contents; when the table outgrows
its memory, its groups and all later rows go to spill files by the next four
bits of the digest, and each file is treated alike, until a bucket fits.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE

TABLE_BYTES = 96 << 20
_HEAD = struct.Struct("<32sqq?q")

Group = tuple[bytes, bytes, int, int | None]  # digest, content, rows, smallest id


class ContentTable:
    """Open addressing with linear probing; entries are distinct contents."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.groups: list[list] = []
        self.bytes = 0

    def add(self, digest: bytes, content: bytes, n: int, least: int | None) -> None:
        mask, slots, groups = len(self.slots) - 1, self.slots, self.groups
        at = int.from_bytes(digest[-8:], "little") & mask
        while slots[at] >= 0:
            g = groups[slots[at]]
            if g[0] == digest:
                if g[1] != content:
                    raise ValueError(f"two texts with the SHA-256 {digest.hex()}")
                g[2] += n
                g[3] = least if g[3] is None else g[3] if least is None else min(g[3], least)
                return
            at = (at + 1) & mask
        slots[at] = len(groups)
        groups.append([digest, content, n, least])
        self.bytes += len(content) + 300
        if 2 * len(groups) > len(slots):
            self._grow()

    def _grow(self) -> None:
        mask = 4 * len(self.slots) - 1
        self.slots = slots = [-1] * (mask + 1)
        for i, g in enumerate(self.groups):
            at = int.from_bytes(g[0][-8:], "little") & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = i


def grace(rows: Iterable[Group], table_bytes: int = TABLE_BYTES, level: int = 0) -> Iterator[Group]:
    """Groups of equal contents, with at most about ``table_bytes`` in memory
    (a single larger text is held alone)."""
    table, rows = ContentTable(), iter(rows)
    for row in rows:
        table.add(*row)
        if table.bytes > table_bytes and len(table.groups) > 1 and level < 64:
            break
    else:
        yield from map(tuple, table.groups)
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        files = [open(os.path.join(folder, f"{i:x}"), "wb") for i in range(16)]

        def spill(digest, content, n, least):
            part = digest[level >> 1] >> 4 if level % 2 == 0 else digest[level >> 1] & 15
            files[part].write(_HEAD.pack(digest, len(content), n, least is None, least or 0))
            files[part].write(content)

        for g in table.groups:
            spill(*g)
        del table
        for row in rows:
            spill(*row)
        for f in files:
            f.close()
        for f in files:
            yield from grace(_spilled(f.name), table_bytes, level + 1)
            os.unlink(f.name)


def _spilled(path: str) -> Iterator[Group]:
    with open(path, "rb") as f:
        while head := f.read(_HEAD.size):
            digest, size, n, no_id, least = _HEAD.unpack(head)
            yield digest, f.read(size), n, None if no_id else least


def _rows(batches: Iterator[pa.RecordBatch], counted: bool) -> Iterator[Group]:
    for b in batches:
        digests, texts, ids = b.column("_d"), b.column("_t").cast(pa.binary()), b.column("_id").to_pylist()
        counts = b.column("_n").to_pylist() if counted else [1] * b.num_rows
        for i in range(b.num_rows):
            yield digests[i].as_py(), texts[i].as_py(), counts[i], ids[i]


def _groups(batches: Iterator[pa.RecordBatch], counted: bool, table_bytes: int) -> Iterator[pa.RecordBatch]:
    part: list[Group] = []
    size = 0

    def batch() -> pa.RecordBatch:
        d, t, n, i = zip(*part, strict=True)
        columns = [pa.array(d, pa.binary()), pa.array(n, pa.int64()), pa.array(i, pa.int64())]
        names = ["_d", "_n", "_id"]
        if not counted:
            columns.append(pa.array(t, pa.binary()))
            names.append("_t")
        return pa.RecordBatch.from_arrays(columns, names=names)

    for g in grace(_rows(batches, counted), table_bytes):
        part.append(g)
        size += len(g[1])
        if size > 8 << 20 or len(part) >= 10_000:
            yield batch()
            part, size = [], 0
    if part:
        yield batch()


def normalized(text_col: str):
    """Every run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after :func:`normalized`; the row with the
    smallest id stays. Null text counts as empty, and empty texts form a group
    like any other. Null ids are ignored for keep_id; a group of null ids only
    has a null keep_id and its rows are kept. Rows that repeat an id within a
    group are decided alike. Other columns of ``docs`` are not read. An empty
    table gives an empty table.
    """
    base = docs.select(F.col(id_col).alias("_id"), normalized(text_col).alias("_t"))
    digest = F.sha2(F.col("_t"), 256)
    rows = base.select(F.unhex(digest).alias("_d"), "_t", F.col("_id").cast("long").alias("_id"))
    local = rows.mapInArrow(lambda b: _groups(b, False, table_bytes), "_d binary, _n long, _id long, _t binary")
    groups = local.repartition("_d").mapInArrow(lambda b: _groups(b, True, table_bytes),
                                                "_d binary, _n long, _id long")
    groups = groups.select(F.lower(F.hex("_d")).alias("_k"), F.col("_n").alias("group_size"),
                           F.col("_id").alias("keep_id"))
    mine = base.select(F.col("_id").alias(id_col), digest.alias("text_sha256"))
    return mine.join(groups, mine["text_sha256"] == groups["_k"]).select(
        id_col, "keep_id", "group_size",
        (F.col(id_col).cast("long").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")
