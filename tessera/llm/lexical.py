"""Ranked lexical search over K2-treaps.

Scan tasks cut their documents into chunks of bounded size. A chunk's grid has
a row for each term and a column for each document; its points are the impacts
of the terms. The grid is kept as a quadtree: a cell's node holds its greatest
point, which is taken out of the cells below, and four bits tell which of
these are not empty. A query follows the paths of its terms' rows jointly,
range of documents by range of documents, the one with the highest bound
first, and leaves out what cannot reach the best ``k`` found so far. The bound
never underrates, so the ranking is exact.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, saved
from .decontaminate import words

CHUNK_DOCS = 8192
CHUNK_POINTS = 1_000_000
QUERY_BYTES = 4 << 20
STATES = 128  # document ranges that are taken further at once

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all beyond ASCII, A-Z lowered."""
    return (text or "").encode().translate(_FOLD).split()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def length_norm(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of documents of ``n`` terms, in a collection of ``docs`` and ``total``."""
    return 75 + (25 * n * docs) // max(total, 1)


def term_weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


# -- the treap --------------------------------------------------------------

def _offset_type(bits: int) -> str:
    return "<u1" if bits <= 8 else "<u2" if bits <= 16 else "<u4"


def build(row: np.ndarray, col: np.ndarray, value: np.ndarray, bits: int) -> dict[str, object]:
    """The treap of points in a grid of side 2**bits, level by level: number of
    nodes, bits of the cells below, greatest values (as what they lack to the
    node above), and the places of these points within their cells."""
    z = np.zeros(len(row), dtype=np.uint64)
    for b in range(bits):
        z |= ((row >> b & 1) << (2 * b + 1) | (col >> b & 1) << (2 * b)).astype(np.uint64)
    order = np.argsort(z)
    z, row, col, value = z[order], row[order], col[order], value[order]
    out = {"top": int(value.max()), "sizes": [], "widths": [], "below": b"", "lacks": b"", "rows": b"", "cols": b""}
    parts = {k: [] for k in ("below", "lacks", "rows", "cols")}
    before, above = np.zeros(1, dtype=np.uint64), np.array([out["top"]])
    for level in range(bits + 1):
        cell = z >> np.uint64(2 * (bits - level))
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        here = cell[first]
        parent = np.searchsorted(before, here >> np.uint64(2))
        if level:
            bit = np.zeros(4 * len(before), dtype=bool)
            bit[4 * parent + (here & np.uint64(3)).astype(np.int64)] = True
            parts["below"].append(np.packbits(bit))
        top = np.maximum.reduceat(value, first)
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(z)]))
        at = np.flatnonzero(value == top[group])
        at = at[np.r_[True, group[at][1:] != group[at][:-1]]]  # the first greatest point of each cell
        lack, mask = above[parent] - top, (1 << (bits - level)) - 1
        out["sizes"].append(len(first))
        out["widths"].append(2 if lack.max() < 1 << 16 else 4)
        parts["lacks"].append(lack.astype(f"<u{out['widths'][-1]}"))
        parts["rows"].append((row[at] & mask).astype(_offset_type(bits - level)))
        parts["cols"].append((col[at] & mask).astype(_offset_type(bits - level)))
        stay = np.ones(len(z), dtype=bool)
        stay[at] = False
        z, row, col, value, before, above = z[stay], row[stay], col[stay], value[stay], here, top
        if not len(z):
            break
    return out | {k: b"".join(x.tobytes() for x in v) for k, v in parts.items()}


class Treap:
    """A treap opened for search. Each level ends with an empty node, to which
    the paths into empty cells lead."""

    def __init__(self, rec: dict) -> None:
        self.bits, self.docs = rec["bits"], np.frombuffer(rec["docs"], dtype="<i8")
        self.doc_bits = max(0, int(len(self.docs) - 1).bit_length())
        self.value, self.row, self.col, self.child = [], [], [], []
        at = {k: 0 for k in ("below", "lacks", "rows", "cols")}

        def take(name: str, kind: str, n: int) -> np.ndarray:
            got = np.frombuffer(rec[name], dtype=kind, count=n, offset=at[name])
            at[name] += got.nbytes
            return got

        for level, (n, width) in enumerate(zip(rec["sizes"], rec["widths"])):
            kind = _offset_type(self.bits - level)
            lack = take("lacks", f"<u{width}", n).astype(np.int64)
            if level:
                old = rec["sizes"][level - 1]
                bit = np.flatnonzero(np.unpackbits(take("below", "u1", -(-4 * old // 8)), count=4 * old))
                child = np.full(4 * (old + 1), n, dtype=np.int32)
                child[bit] = np.arange(n, dtype=np.int32)
                self.child.append(child)
                value = self.value[-1][bit >> 2] - lack
            else:
                value = rec["top"] - lack
            self.value.append(np.r_[value, 0])
            self.row.append(np.r_[take("rows", kind, n).astype(np.int64), -1])
            self.col.append(np.r_[take("cols", kind, n).astype(np.int64), 0])
        # the greatest value below each node
        self.rest = [v[c].reshape(-1, 4).max(axis=1) for v, c in zip(self.value[1:], self.child)]
        self.rest.append(np.zeros(len(self.value[-1]), dtype=np.int64))

    def search(self, rows: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Puts the documents of the highest sums of weight x value over ``rows``
        into ``best``."""
        found = np.zeros(1 << self.doc_bits, dtype=np.int64)  # sums of the points met so far
        heap, count, step = [], 0, max(1, min(STATES, (1 << 18) // len(rows)))

        def reach(level: int, j: np.ndarray, nodes: np.ndarray) -> None:
            nonlocal count
            bits = self.bits - level
            state, path = np.nonzero(self.row[level][nodes] == (rows & ((1 << bits) - 1)))
            if len(state):
                at = nodes[state, path]
                np.add.at(found, (j[state] << bits) + self.col[level][at], weights[path] * self.value[level][at])
            rest = self.rest[level][nodes] @ weights
            ranges = found.reshape(-1, 1 << min(bits, self.doc_bits))
            bound = ranges[j].max(axis=1) + rest
            open_ = bound >= best.floor
            done = np.flatnonzero(open_ & (rest == 0))
            if len(done):
                r, c = np.nonzero(ranges[j[done]] >= best.floor)
                at = (j[done[r]] << bits) + c
                best.add(found[at], self.docs[at])
            left = np.flatnonzero(open_ & (rest > 0))
            left = left[np.argsort(-bound[left], kind="stable")]
            for k in range(0, len(left), step):
                part = left[k:k + step]
                heapq.heappush(heap, (-int(bound[part[0]]), count, level, j[part], nodes[part], bound[part]))
                count += 1

        reach(0, np.zeros(1, dtype=np.int64), np.zeros((1, len(rows)), dtype=np.int32))
        while heap and -heap[0][0] >= best.floor:
            _, _, level, j, nodes, bound = heapq.heappop(heap)
            stay = bound >= best.floor
            j, nodes, bits = j[stay], nodes[stay], self.bits - level - 1
            slot = 4 * nodes.astype(np.int64) + 2 * (rows >> bits & 1)
            right = ((2 * j + 1) << bits) < len(self.docs)
            reach(level + 1, np.r_[2 * j, 2 * j[right] + 1],
                  np.concatenate([self.child[level][slot], self.child[level][slot[right] + 1]]))


class Best:
    """The ``k`` best of (score, document): highest first, ties by lowest id."""

    def __init__(self, k: int) -> None:
        self.k, self.floor = k, 1  # a score must be above 0
        self.score = self.doc = np.empty(0, dtype=np.int64)

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.r_[self.score, score], np.r_[self.doc, doc]
        order = np.lexsort((doc, -score))[:self.k]
        self.score, self.doc = score[order], doc[order]
        if len(order) == self.k:
            self.floor = max(1, int(self.score[-1]))


# -- index ------------------------------------------------------------------

INDEX = ("docs binary, terms binary, df binary, bits int, top long, sizes array<long>, widths array<long>, "
         "below binary, lacks binary, rows binary, cols binary")
_INDEX = pa.schema([("docs", pa.binary()), ("terms", pa.binary()), ("df", pa.binary()), ("bits", pa.int32()),
                    ("top", pa.int64()), ("sizes", pa.list_(pa.int64())), ("widths", pa.list_(pa.int64())),
                    ("below", pa.binary()), ("lacks", pa.binary()), ("rows", pa.binary()), ("cols", pa.binary())])


def _chunk(ids: list[int], lengths: list[int], vocab: dict[bytes, int], kinds: list[np.ndarray], tfs: list[np.ndarray],
           docs: int, total: int) -> dict:
    size = np.array([len(x) for x in kinds])
    n = np.array(lengths, dtype=np.int64)
    place = np.empty(len(n), dtype=np.int64)  # short documents first: alike in m, so cells are alike in impact
    by_length = np.argsort(n, kind="stable")
    place[by_length] = np.arange(len(n))
    kind, tf = np.concatenate(kinds), np.concatenate(tfs)
    df = np.bincount(kind, minlength=len(vocab))
    by_df = np.argsort(-df, kind="stable")  # frequent terms first
    row = np.empty(len(df), dtype=np.int64)
    row[by_df] = np.arange(len(df))
    names = list(vocab)
    bits = max(1, int(len(df) - 1).bit_length(), int(len(n) - 1).bit_length())
    tree = build(row[kind], np.repeat(place, size), impact(tf, np.repeat(length_norm(n, docs, total), size)), bits)
    return {"docs": np.array(ids, dtype="<i8")[by_length].tobytes(), "terms": b" ".join([names[k] for k in by_df.tolist()]),
            "df": df[by_df].astype("<u4").tobytes(), "bits": bits, **tree}


def _indexed(batches: Iterator[pa.RecordBatch], docs: int, total: int, most_docs: int, most_points: int) -> Iterator[pa.RecordBatch]:
    ids, lengths, vocab, kinds, tfs, points = [], [], {}, [], [], 0
    for b in batches:
        for i, raw in zip(b.column("_id").to_pylist(), b.column("_text")):
            tf = Counter(raw.as_py().translate(_FOLD).split())
            if not tf:
                continue  # no query can find it
            ids.append(i)
            lengths.append(tf.total())
            kinds.append(np.fromiter([vocab.setdefault(w, len(vocab)) for w in tf], dtype=np.int64, count=len(tf)))
            tfs.append(np.fromiter(tf.values(), dtype=np.int64, count=len(tf)))
            points += len(tf)
            if len(ids) >= most_docs or points >= most_points:
                yield pa.RecordBatch.from_pylist([_chunk(ids, lengths, vocab, kinds, tfs, docs, total)], schema=_INDEX)
                ids, lengths, vocab, kinds, tfs, points = [], [], {}, [], [], 0
    if ids:
        yield pa.RecordBatch.from_pylist([_chunk(ids, lengths, vocab, kinds, tfs, docs, total)], schema=_INDEX)


class Index:
    """Chunks of an indexed collection, its number of documents with terms,
    and that of their terms."""

    def __init__(self, chunks: DataFrame, docs: int, total: int) -> None:
        self.chunks, self.docs, self.total = chunks, docs, total


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_docs: int = CHUNK_DOCS,
                chunk_points: int = CHUNK_POINTS) -> Index:
    """Every document with a term, indexed where it is read: no shuffle. A
    chunk ends at ``chunk_docs`` documents or ``chunk_points`` points (a longer
    document is whole in one). Null and empty texts hold no terms; null ids
    sort after all others; rows that repeat are documents of their own; only
    the two columns are read."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    n = F.size(words(F.col("_text")))
    count, total = rows.select(n.alias("_n")).agg(F.count_if(F.col("_n") > 0), F.coalesce(F.sum("_n"), F.lit(0))).first()
    raw = rows.select("_id", F.col("_text").cast("binary").alias("_text"))
    out = raw.mapInArrow(lambda b: _indexed(b, count, total, chunk_docs, chunk_points), INDEX)
    return Index(saved(out, "treaps"), count, total)


# -- search -----------------------------------------------------------------

def _wanted(chunk_terms: bytes, wanted: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the wanted terms that a chunk holds, and their rows."""
    got = [(wanted[t], r) for r, t in enumerate(chunk_terms.split(b" ")) if t in wanted]
    both = np.array(got, dtype=np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _frequencies(batches: Iterator[pa.RecordBatch], wanted: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(len(wanted), dtype=np.int64)
    for b in batches:
        for held, raw in zip(b.column("terms"), b.column("df")):
            term, row = _wanted(held.as_py(), wanted)
            df[term] += np.frombuffer(raw.as_py(), dtype="<u4")[row]
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["_t", "df"])


def _searched(batches: Iterator[pa.RecordBatch], wanted: dict[bytes, int],
              asked: list[tuple[int, np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    best = [Best(k) for _ in asked]
    for b in batches:
        for at in range(b.num_rows):
            rec = b.slice(at, 1).to_pylist()[0]
            term, row = _wanted(rec["terms"], wanted)
            if not len(term):
                continue
            rows = np.full(len(wanted), -1, dtype=np.int64)
            rows[term] = row
            tree = Treap(rec)
            for (_, kinds, weights), top in zip(asked, best):
                held = rows[kinds] >= 0
                if held.any():
                    tree.search(rows[kinds[held]], weights[held], top)
    sizes = [len(x.doc) for x in best]
    q = np.repeat(np.array([a[0] for a in asked], dtype=np.int64), sizes)
    doc, score = (np.concatenate([getattr(x, name) for x in best]) if best else q for name in ("doc", "score"))
    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(doc), pa.array(score)], names=["_q", "_d", "score"])


def search(index: Index, queries: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text",
           doc_col: str = "doc_id", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The ``k`` documents of highest score for each row of ``queries``: the
    query's id, rank (from 1), the document's id and score; ties go to the
    lowest id, null last.

    Queries go to the executors in blocks of about ``query_bytes`` of text,
    all against every chunk. Null and empty queries, and those without a term
    of the collection, have no rows; rows that repeat are each answered; an
    empty table of documents or queries gives an empty table."""
    spark = queries.sparkSession
    rows = queries.select(F.monotonically_increasing_id().alias("_q"), F.col(id_col).alias("_i"),
                          F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = saved(rows, "queries")
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = max(1, -(-size // query_bytes))
    out = spark.createDataFrame([], "_q long, _d long, score long")
    for block in range(blocks):
        mine = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == block)
        asked = [(r._q, Counter(terms(r._text))) for r in mine.select("_q", "_text").collect()]  # a block of bounded size
        wanted = {t: n for n, t in enumerate(sorted(set().union(*[c for _, c in asked])))}
        if not wanted:
            continue
        df = index.chunks.select("terms", "df").mapInArrow(lambda b, w=wanted: _frequencies(b, w), "_t long, df long")
        weight = np.zeros(len(wanted), dtype=np.int64)
        for r in df.groupBy("_t").agg(F.sum("df").alias("df")).collect():  # a row for each term of the block
            weight[r._t] = term_weight(index.docs, r.df)
        plan = []
        for q, c in asked:
            kinds = np.array([wanted[t] for t in c], dtype=np.int64)
            weights = weight[kinds] * np.array(list(c.values()), dtype=np.int64)
            plan.append((q, kinds[weights > 0], weights[weights > 0]))
        plan = [p for p in plan if len(p[1])]
        found = index.chunks.mapInArrow(lambda b, w=wanted, p=plan: _searched(b, w, p, k), "_q long, _d long, score long")
        out = out.unionByName(found)
    over = Window.partitionBy("_q").orderBy(F.desc("score"), "_d")
    out = out.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)
    return out.join(rows.select("_q", "_i"), "_q").select(
        F.col("_i").alias(id_col), "rank", F.nullif("_d", F.lit(NO_ID)).alias(doc_col), "score")
