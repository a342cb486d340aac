"""Toxic passages by maximum-scoring segments.

Words and their beginnings are hashed to a fixed number of buckets. A bucket
has the log-odds between toxic and clean labelled documents under an
informative Dirichlet prior (the corpus's own counts), where they are
significant. A token scores by its whole word or else by the longest beginning
that tells anything, less a drift that makes clean text score below zero. One linear scan of a
document (Ruzzo and Tompa) gives all its maximal-scoring segments. Their
scores follow an extreme-value law on clean text, whose parameters come from
the scores (lambda) and from clean labelled documents (K); a document's
evidence is the least probability of its r best segments under that law, and a
logistic curve turns it into a score from 0 to 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

BUCKETS = 1 << 20
TRAIN_ROWS = 50_000
BEGINNINGS = (7, 5, 4)  # bytes of a word that back off for it
_rng = np.random.Generator(np.random.PCG64(20))
_TABLE = _rng.integers(0, 1 << 63, size=64 * 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def tokens(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(buckets, start, stop) of each token, offsets into the returned bytes:
    runs of letters, digits and non-ASCII characters of the lower-cased text.
    A row of buckets: the word's, then its beginnings'; -1 if it has none."""
    raw = (text or "").lower().encode()
    buf = np.frombuffer(raw, dtype=np.uint8)
    at = np.flatnonzero(_IN_WORD[buf])
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return none.reshape(0, 1 + len(BEGINNINGS)), none, none, raw
    first = np.flatnonzero(np.r_[True, np.diff(at) > 1])
    size = np.diff(np.r_[first, len(at)])
    place = np.arange(len(at)) - np.repeat(first, size)
    mixed = _TABLE[((place & 63) << 8) | buf[at]]
    out = np.empty((len(first), 1 + len(BEGINNINGS)), dtype=np.int64)
    for level, k in enumerate((None, *BEGINNINGS)):
        part = mixed if k is None else np.where(place < k, mixed, np.uint64(0))
        h = (np.add.reduceat(part, first) + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15)
        out[:, level] = (h >> np.uint64(44)).astype(np.int64)
        if k is not None:
            out[size <= k, level] = -1
    return out, at[first], at[first] + size, raw


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments [start, stop) of a score sequence, by one
    linear scan. Runs of one sign are taken together first."""
    n = len(score)
    good = score > 0
    if not good.any():
        return []
    edge = np.flatnonzero(np.r_[True, good[1:] != good[:-1]])
    sums = np.add.reduceat(score, edge).tolist()
    stops = np.r_[edge[1:], n].tolist()
    total, held = 0.0, []  # held: start, stop, sum before it, sum through it, index of the next smaller left
    for start, stop, s, up in zip(edge.tolist(), stops, sums, good[edge].tolist()):
        if not up:
            total += s
            continue
        left, total = total, total + s
        right, first = total, start
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= left:
                j = held[j][4]
            if j < 0 or held[j][3] >= right:
                held.append((first, stop, left, right, j))
                break
            first, left = held[j][0], held[j][2]
            del held[j:]
    return [(a, z, right - left) for a, z, left, right, _ in held]


@dataclass
class Model:
    """odds: per bucket, 0 where they tell nothing; lam, log_k: the
    extreme-value law; a, b: the curve."""

    odds: np.ndarray
    drift: float = 1.0
    lam: float = 1.0
    log_k: float = 0.0
    a: float = -2.0
    b: float = 1.0
    alpha: float = 0.05

    def scores(self, buckets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(buckets))
        for level in reversed(range(buckets.shape[1])):
            got = np.where(buckets[:, level] >= 0, self.odds[buckets[:, level]], 0)
            out = np.where(got != 0, got, out)
        return out - self.drift

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]], np.ndarray, np.ndarray, bytes]:
        """Token count, the segments as (start, stop, normalised score), and
        where tokens begin and end."""
        bucket, start, stop, raw = tokens(text)
        n = len(bucket)
        if not n:
            return 0, [], start, stop, raw
        shift = np.log(n) + self.log_k
        got = [(a, z, self.lam * s - shift) for a, z, s in segments(self.scores(bucket))]
        return n, got, start, stop, raw

    def evidence(self, found: list[tuple[int, int, float]]) -> float:
        """-log of the least probability, under the law, of the sum of the r
        best normalised scores, over r."""
        best, total = 0.0, 0.0
        for r, x in enumerate(sorted((x for _, _, x in found), reverse=True), 1):
            total += x
            if x <= 0 and r > 1 or total <= 0:
                break
            p = total - (r - 1) * np.log(max(total, 1e-9)) + lgamma(r + 1) + lgamma(r)
            best = max(best, float(p))
        return best

    def probability(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-(self.a + self.b * np.log1p(evidence)))))


def count(texts, n: np.ndarray) -> None:
    """Adds to n: per bucket, the distinct words of each document that have it,
    over all documents, those labelled clean, and toxic. A word counts once a
    document, a beginning once for each word that has it."""
    for text, label in texts:
        words = tokens(text)[0]
        words = words[np.unique(words[:, 0], return_index=True)[1]]
        used = words[words >= 0]
        np.add.at(n[0], used, 1)
        if label is not None:
            np.add.at(n[1 + label], used, 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros((3, BUCKETS), dtype=np.int64)
    for b in batches:
        count(zip((t.as_py() for t in b.column("_t")), b.column("_y").to_pylist(), strict=True), n)
    used = np.flatnonzero(n[0])
    for at in range(0, len(used), 50_000):
        i = used[at:at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(i), *(pa.array(x[i]) for x in n)],
                                         names=["bucket", "n", "clean", "toxic"])


def _evidences(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = model.value
    for b in batches:
        out = []
        for text in b.column("_t"):
            n, found, *_ = m.passages(text.as_py())
            out.append((n, max((x for *_, x in found), default=None), m.evidence(found)))
        if out:
            n, top, e = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("_y"), pa.array(n, pa.int64()), pa.array(top, pa.float64()),
                                              pa.array(e, pa.float64())], names=["y", "n", "top", "evidence"])


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int) -> DataFrame:
    """All documents as (_t, _y): _y is the label of a training row, else
    null. Training rows: ids whose crc32 mod 4 is not 2, at most ``train_rows``
    of them (those least by hash); that table is broadcast, its size bounded."""
    ok = labels.where((F.crc32(F.col(id_col).cast("string")) % 4 != 2) & F.col(label_col).isin(0, 1))
    rows = ok.groupBy(F.col(id_col).alias("_i")).agg(F.max(label_col).cast("int").alias("_y"))
    rows = saved(rows.orderBy(F.xxhash64("_i"), "_i").limit(train_rows), "training-rows")
    return docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("_t")).join(
        F.broadcast(rows), F.col("_d") == F.col("_i"), "left").select("_t", "_y")


def log_odds(n: np.ndarray, prior: float, least_z: float, density: float, least_odds: float) -> Model:
    """The model without its curve, from the counts of :func:`count`."""
    every, clean, toxic = n.astype(float)
    if not clean.any() or not toxic.any():
        return Model(np.zeros(BUCKETS, dtype=np.float32))
    alpha = prior * (clean.sum() + toxic.sum()) * every / every.sum() + 1e-9
    n_t, n_c, n_a = toxic.sum(), clean.sum(), alpha.sum()
    odds = (np.log((toxic + alpha) / (n_t + n_a - toxic - alpha)) - np.log((clean + alpha) / (n_c + n_a - clean - alpha)))
    z = odds / np.sqrt(1 / (toxic + alpha) + 1 / (clean + alpha))
    odds[(np.abs(z) < least_z) | (np.abs(odds) < least_odds)] = 0
    up = odds[odds > 0]
    drift = density * float(up.mean()) if len(up) else 1.0
    # on clean text the expected score is below zero, or the drift is raised until it is
    p = (clean + alpha) / (n_c + n_a)
    while float(p @ (odds - drift)) >= -drift / 2:
        drift *= 1.5
    return Model(odds.astype(np.float32), drift, lam=_lambda(p, odds - drift))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        train_rows: int = TRAIN_ROWS, prior: float = 0.3, least_z: float = 3.0, density: float = 0.005,
        least_odds: float = 1.5) -> Model:
    """Learn the scores from labelled training rows and the whole corpus.

    ``prior`` is the weight of the corpus counts against the labelled ones,
    ``least_z`` the significance and ``least_odds`` the size (1.5: 4.5 times as
    common) below which a bucket's log-odds count as none: in a large corpus
    many slight differences are significant. ``density`` the share of toxic tokens that a passage needs to rise.
    Without rows of both classes the model scores every text alike."""
    spark = docs.sparkSession
    rows = labelled(docs, labels, id_col, text_col, label_col, train_rows)
    counts = rows.mapInArrow(_counts, "bucket long, n long, clean long, toxic long").groupBy("bucket").agg(
        F.sum("n").alias("n"), F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # at most BUCKETS rows, whatever the corpus
    got, n = counts.toArrow(), np.zeros((3, BUCKETS), dtype=np.int64)
    for to, c in zip(n, ("n", "clean", "toxic"), strict=True):
        to[got.column("bucket").to_numpy()] = got.column(c).to_numpy()
    model = log_odds(n, prior, least_z, density, least_odds)
    if not model.odds.any():
        return model
    for step in (calibrate_law, calibrate_curve):
        shared = spark.sparkContext.broadcast(model)
        seen = rows.where("_y is not null").mapInArrow(
            lambda b, m=shared: _evidences(b, m), "y int, n long, top double, evidence double").toPandas()
        step(model, seen)
    return model


def calibrate_law(model: Model, seen) -> None:
    """Gumbel: the mean of lambda S - ln n on clean text is ln K + Euler's constant."""
    top = seen[(seen.y == 0) & seen.top.notna()].top
    model.log_k = float(top.mean()) - 0.5772156649 if len(top) > 1 else 0.0


def calibrate_curve(model: Model, seen) -> None:
    if seen.y.nunique() > 1:
        model.a, model.b = _logistic(np.log1p(seen.evidence.to_numpy()), seen.y.to_numpy(float))


def _lambda(p: np.ndarray, score: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1."""
    low, high = 0.0, 1.0
    while high < 64 and float(p @ np.exp(np.minimum(high * score, 600))) < 1:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if float(p @ np.exp(np.minimum(mid * score, 600))) < 1 else (low, mid)
    return max(high, 1e-6)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method, with a slight pull to keep it finite."""
    a, b = -1.0, 0.5
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        grad = design.T @ (y - p) - 1e-3 * np.array([0, b])
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), max(float(b), 1e-6)


def _scores(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = model.value
    kind = pa.list_(pa.struct([("text", pa.string()), ("score", pa.float64())]))
    for b in batches:
        score, spans = [], []
        for text in b.column("_t"):
            _, found, start, stop, raw = m.passages(text.as_py())
            score.append(m.probability(m.evidence(found)))
            spans.append([{"text": raw[start[a]:stop[z - 1]].decode(errors="replace"), "score": x}
                          for a, z, x in found if x > 0 and -np.expm1(-np.exp(-x)) <= m.alpha])
        yield pa.RecordBatch.from_arrays([b.column("_d"), pa.array(score, pa.float64()), pa.array(spans, kind)],
                                         names=["_d", "score", "passages"])


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: _d (the id), score, passages (lower-cased text and
    normalised score of every significant one, in order). Null and empty texts
    have no passage and the score of a document without evidence; rows that
    repeat score alike; a null id stays null. A text of any length is scanned
    whole, in linear time. An empty table gives an empty table. Nothing but the
    text is an input: other columns may have any names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("_d"), F.col(text_col).alias("_t"))
    return rows.mapInArrow(lambda b: _scores(b, shared),
                           "_d long, score double, passages array<struct<text:string,score:double>>")


def _clean(batches: Iterator[pa.RecordBatch], model, text_col: str, least: float) -> Iterator[pa.RecordBatch]:
    m = model.value
    for b in batches:
        keep = [m.probability(m.evidence(m.passages(t.as_py())[1])) < least for t in b.column(text_col)]
        yield b.filter(pa.array(keep, pa.bool_()))


def clean_documents(docs: DataFrame, model: Model, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, whose score is below ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda b: _clean(b, shared, text_col, least), docs.schema)
