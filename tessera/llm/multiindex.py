"""Embedding near-duplicates by an inverted multi-index.

The vector's halves have codebooks of their own; a pair of nearest codewords
names one of K x K cells, and every vector is filed in its cell. A vector
visits cells in the order of the summed distances of its halves (the order of
the multi-sequence traversal) until the target recall is reached: the number
of visits is the quantile, at that recall, of the rank at which the cells of
neighbours come up. These are partners made from sampled vectors at the bound
itself, the farthest that a pair can be; and, where they are enough and come up
later, the true pairs that a bounded set of queries meets by brute force among
all rows. What a vector meets in a visited cell is verified by the cosine in
double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_id, saved, whole
from .components import Joined, components

SAMPLE = 16_384
CALIBRATION = 512
LEAST_PAIRS = 300
CELL_ROWS = 16_384


def unit(rows: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors, in double precision, of a list column of equal lengths."""
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.combine_chunks()
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    v = flat.reshape(len(rows), -1)
    top = np.abs(v).max(axis=1, keepdims=True)  # scaled first: squares may over- or underflow
    v = v / top
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means, started from rows spread over the sample; deterministic."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = _distances(x, c).argmin(axis=1)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :]


class Index:
    """The two codebooks, and how many cells a vector visits."""

    def __init__(self, first: np.ndarray, second: np.ndarray, visits: int = 1) -> None:
        self.first, self.second, self.visits = first, second, visits

    def _halves(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.first.shape[1]
        return _distances(v[:, :h], self.first), _distances(v[:, h:], self.second)

    def cells(self, v: np.ndarray) -> np.ndarray:
        a, b = self._halves(v)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)

    def traversal(self, v: np.ndarray) -> np.ndarray:
        """The nearest ``visits`` cells per vector, nearest first. The t-th cell
        of the traversal has (a + 1) * (b + 1) <= t for the ranks a, b of its
        codewords, so only that corner of the grid is summed."""
        a, b = self._halves(v)
        t = min(self.visits, a.shape[1] * b.shape[1])
        order_a, order_b = a.argsort(axis=1, kind="stable"), b.argsort(axis=1, kind="stable")
        near_a, near_b = np.take_along_axis(a, order_a, 1), np.take_along_axis(b, order_b, 1)
        corner = [(i, j) for i in range(min(t, a.shape[1])) for j in range(min(t // (i + 1), b.shape[1]))]
        i, j = np.array(corner).T
        best = (near_a[:, i] + near_b[:, j]).argsort(axis=1, kind="stable")[:, :t]
        return order_a[np.arange(len(v))[:, None], i[best]] * len(self.second) + order_b[
            np.arange(len(v))[:, None], j[best]]

    def rank(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """At which place of q's traversal the cell of x comes, row by row."""
        a, b = self._halves(q)
        at = self.cells(x)
        out = np.empty(len(q), dtype=np.int64)
        for r in range(len(q)):
            s = a[r, at[r] // len(self.second)] + b[r, at[r] % len(self.second)]
            out[r] = np.searchsorted(np.sort(b[r]), s - a[r] - 1e-12 * (1 + abs(s)), side="left").sum()
        return out

    def either(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A pair is found if one of the two visits the other's cell: the lower
        of both ranks counts."""
        return np.minimum(self.rank(a, b), self.rank(b, a))


def _ranks(batches: Iterator[pa.RecordBatch], index: Index, queries: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        v = unit(batch.column("_v"))
        for at in range(0, len(v), 4096):
            near = v[at:at + 4096] @ queries.T
            x, q = np.nonzero((near >= least) & (near < 1 - 1e-12))
            for i in range(0, len(x), 4096):
                a, b = queries[q[i:i + 4096]], v[at + x[i:i + 4096]]
                yield pa.RecordBatch.from_arrays([pa.array(index.either(a, b))], names=["rank"])


def _filed(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    names = ["_cell", "_visit", "_node", "_w", "_v"]
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            b = batch.slice(at, 2048)
            v, n = unit(b.column("_v")), b.num_rows
            own = [b.column(c) for c in ("_node", "_w", "_v")]
            yield pa.RecordBatch.from_arrays([pa.array(index.cells(v)), pa.array(np.zeros(n, bool)), *own], names=names)
            cells = index.traversal(v)
            for t in range(cells.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(cells[:, t]), pa.array(np.ones(n, bool)), *own], names=names)


def _verified(batches: Iterator[pa.RecordBatch], index: Index, least: float) -> Iterator[pa.RecordBatch]:
    """(u, v, n): links, and for u alone (v null) how many vectors more it is
    linked with."""
    t = whole(batches)
    if t is None:
        return
    t = t.sort_by([("_cell", "ascending"), ("_chunk", "ascending"), ("_visit", "ascending"), ("_node", "ascending")])
    cell, chunk, node, weight = (t.column(c).to_numpy() for c in ("_cell", "_chunk", "_node", "_w"))
    visit = np.asarray(t.column("_visit").to_numpy(), dtype=bool)
    starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (chunk[1:] != chunk[:-1])])
    u, v, credit_to, credit = [], [], [], []
    for s, e in zip(starts.tolist(), np.r_[starts[1:], len(cell)].tolist()):
        m = s + int((~visit[s:e]).sum())  # members first, visitors after them
        if m == s or m == e:
            continue
        own, w = unit(t.column("_v").slice(s, m - s)), weight[s:m]
        joined, rows = Joined(e - s), max(1, (1 << 22) // (m - s))
        for at in range(m, e, rows):
            top = min(at + rows, e)
            visitors = unit(t.column("_v").slice(at, top - at))
            near = (visitors @ own.T >= least) & (node[at:top, None] != node[None, s:m])
            hit = np.flatnonzero(near.any(axis=1))
            if not len(hit):
                continue
            credit_to.append(node[at + hit])
            credit.append(near[hit] @ w)
            # members that do not visit the visitor's cell learn of the link here
            met = np.flatnonzero(near.any(axis=0))
            theirs, homes = index.traversal(own[met]), index.cells(visitors[hit])
            missed = near[np.ix_(hit, met)].T & ~(theirs[:, :, None] == homes[None, None, :]).any(axis=1)
            credit_to.append(node[s + met])
            credit.append(missed @ weight[at + hit])
            for i in hit.tolist():
                joined.row(at - s + i, np.flatnonzero(near[i]))
        # a vector may be member and visitor here: links go by node
        u += [int(node[s + a]) for a, _ in joined.links]
        v += [int(node[s + b]) for _, b in joined.links]
    if credit_to:
        to, n = np.concatenate(credit_to), np.concatenate(credit).astype(np.int64)
        nodes, at = np.unique(to, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.nulls(len(nodes), pa.int64()),
                                          pa.array(np.bincount(at, weights=n).astype(np.int64))], names=["u", "v", "n"])
    if u:
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()),
                                          pa.array(np.zeros(len(u), np.int64))], names=["u", "v", "n"])


def at_bound(x: np.ndarray, toward: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x``, and unit vectors whose cosine to them is ``least``, each
    turned towards its row of ``toward``; parallel rows are left out."""
    side = toward - (toward * x).sum(axis=1)[:, None] * x
    norm = np.sqrt((side * side).sum(axis=1))
    fine = norm > 1e-9
    x, side = x[fine], side[fine] / norm[fine, None]
    return x, least * x + np.sqrt(max(0.0, 1 - least * least)) * side


def bound_visits(index: Index, sample: np.ndarray, least: float, recall: float) -> int:
    """Visits that find the share ``recall`` of partners at the bound, turned in
    directions of no preference and in those in which the data differ: the more
    of the two."""
    rng = np.random.default_rng(0)
    visits = 1
    for toward in (rng.normal(size=sample.shape), sample[rng.permutation(len(sample))]):
        pairs = at_bound(sample, toward, least)
        if len(pairs[0]):
            visits = max(visits, int(np.quantile(index.either(*pairs), recall, method="higher")) + 1)
    return visits


def fitted(kinds: DataFrame, n: int, least: float, recall: float, sample_size: int, calibration: int) -> Index:
    """Codebooks from at most ``sample_size`` rows, chosen by hash. Visits from
    4 x ``calibration`` rows, not those of the codebooks where there are others,
    and their partners at the bound; and from the pairs of ``calibration`` of
    them among all rows, if there are ``LEAST_PAIRS``."""
    part = kinds.select("_v").orderBy(F.xxhash64("_node"), "_node").limit(sample_size + 4 * calibration).toArrow()
    sample = unit(part.column("_v"))
    sample, held = sample[:sample_size], sample[-4 * calibration:]
    h = sample.shape[1] // 2
    k = max(1, min(int(np.sqrt(n / 8)), len(sample) // 8, 4096))
    index = Index(codebook(sample[:, :h], k), codebook(sample[:, h:], k))
    index.visits = bound_visits(index, held, least, recall)
    queries = held[-calibration:]
    ranks = kinds.select("_v").mapInArrow(lambda b: _ranks(b, index, queries, least), "rank long")
    pairs, at = ranks.agg(F.count("rank"), F.percentile_approx("rank", recall, 10_000)).first()
    if pairs >= LEAST_PAIRS:
        index.visits = max(index.visits, int(at) + 1)
    return index


def _links(kinds: DataFrame, index: Index, least: float, cell_rows: int) -> DataFrame:
    filed = kinds.mapInArrow(lambda b: _filed(b, index),
                             kinds.select(F.lit(0).cast("long").alias("_cell"), F.lit(True).alias("_visit"), "*").schema)
    # a hot cell is cut into chunks of its members; its visitors go to every chunk
    members = kinds.select("_v").mapInArrow(lambda b: _cells_only(b, index), "_cell long").groupBy("_cell").count()
    hot = saved(members.where(F.col("count") > cell_rows).select(
        "_cell", F.ceil(F.col("count") / cell_rows).cast("int").alias("_chunks")), "hot-cells")
    if hot.isEmpty():
        filed = filed.withColumn("_chunk", F.lit(0))
    else:
        chunks = F.coalesce("_chunks", F.lit(1))
        filed = filed.join(hot, "_cell", "left").withColumn("_chunk", F.explode(F.when(
            F.col("_visit"), F.sequence(F.lit(0), chunks - 1)).otherwise(
            F.array(F.pmod(F.xxhash64("_node"), chunks).cast("int"))))).drop("_chunks")
    return saved(filed.repartition("_cell", "_chunk").mapInArrow(
        lambda b: _verified(b, index, least), "u long, v long, n long"), "links")


def _cells_only(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(index.cells(unit(b.column("_v"))))], names=["_cell"])


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95,
                     recall: float = 0.99, sample_size: int = SAMPLE, calibration: int = CALIBRATION,
                     cell_rows: int = CELL_ROWS) -> DataFrame:
    """Per row of ``vectors``: id, n_links (other vectors linked directly),
    component_id (smallest id reachable, its own included), kept.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing. Vectors of different lengths never link; each length
    has an index of its own. Rows with equal vectors link with one another.
    Rows that repeat an id are one node: their links are pooled. Null ids sort
    last. An empty table gives an empty table."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                      & F.exists(v, lambda x: x != 0), F.lit(False))
    # adding 0 turns -0 into 0, so that equal vectors are equal as keys
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.when(fine, F.transform(v, lambda x: x + 0.0)).alias("_v"))
    kinds = saved(rows.where("_v is not null").groupBy("_v").agg(
        F.min(key_id("_id")).alias("_node"), F.count(F.lit(1)).alias("_w")).select("_node", "_w", "_v"), "vectors")
    lengths = kinds.groupBy(F.size("_v").alias("n")).count().collect()  # a number per length
    found = None
    for r in sorted(lengths, key=lambda r: r["n"]):
        same = kinds.where(F.size("_v") == r["n"])
        if r["n"] == 1:  # one number: its sign is all that counts, and no half is left for a codebook
            same = same.withColumn("_v", F.concat("_v", F.array(F.lit(0.0))))
        got = _links(same, fitted(same, r["count"], least, recall, sample_size, calibration), least, cell_rows)
        found = got if found is None else found.unionByName(got)
    result = rows.select(F.col("_id"), "_v")
    if found is None:
        return result.select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
                             F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    comp = components(found.where("v is not null").select("u", "v"))
    credits = found.where("v is null").groupBy(F.col("u").alias("_u")).agg(F.sum("n").alias("_n"))
    kinds = kinds.join(credits, kinds["_node"] == credits["_u"], "left").join(
        comp, kinds["_node"] == comp["node"], "left")
    kinds = saved(kinds.select(F.col("_v").alias("_k"), (F.coalesce("_n", F.lit(0)) + F.col("_w") - 1).alias("n_links"),
                               F.coalesce("component", "_node").alias("_c")), "kinds")
    result = result.join(kinds, F.col("_v") == F.col("_k"), "left")
    own = F.col("_c").isNull() | (F.col("_c") == key_id("_id"))
    return result.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                         F.when(own, F.col("_id")).otherwise(F.col("_c")).alias("component_id"), own.alias("kept"))
