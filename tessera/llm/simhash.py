"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are grouped into partitions, correlated bits together. If two
fingerprints differ in at most t bits and the thresholds t_i >= -1 satisfy
sum(t_i + 1) = t + 1, some partition differs in at most t_i bits. Dynamic
programming picks the (unequal) t_i whose estimated cost, probes plus
candidates, is least; t_i = -1 leaves a partition out. Each fingerprint is
filed under its exact value of every partition used and probes all values
within t_i; what meets under a value is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, key_id, saved, whole
from .components import Joined, components

SAMPLE = 4096
HOT = 4096
PROBE_COST = 40.0


# -- fingerprints -----------------------------------------------------------

def fingerprint(text: bytes, shingle: int = 3) -> int:
    """``text``: lower-cased UTF-8 with words parted by single spaces."""
    if not text:
        return 0
    buf = np.frombuffer(text, dtype=np.uint8)
    gaps = np.flatnonzero(buf == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(text)]
    n = max(1, len(starts) - shingle + 1)
    ends = ends[min(shingle, len(starts)) - 1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(text[a:z], 42) for a, z in zip(starts[at:at + (1 << 16)], ends[at:at + (1 << 16)])],
                     dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("_t").cast(pa.binary())
        got = np.array([fingerprint(t.as_py(), shingle) for t in texts], dtype=np.uint64).view(np.int64)
        rest = [c for c in b.schema.names if c != "_t"]
        yield pa.RecordBatch.from_arrays([*map(b.column, rest), pa.array(got)], names=[*rest, "_fp"])


def row_hashes(docs: DataFrame, text_col: str = "text") -> list[Column]:
    """Hashes of a row's text and of the whole row, null and empty text apart;
    with the id they name a row, as long as it is not repeated in whole."""
    return [F.xxhash64(text_col, F.length(text_col)).alias("_tz_ht"),
            F.xxhash64(*[x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]).alias("_tz_hr")]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 row_key: bool = False) -> DataFrame:
    """(_id, _fp) per row, with ``row_key`` also :func:`row_hashes`; A-Z are
    lower-cased, other letters stay."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    text = F.btrim(F.regexp_replace(text, SPACE, " "), F.lit(" "))
    hashes = row_hashes(docs, text_col) if row_key else []
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), *hashes, text.alias("_t"))
    return rows.mapInArrow(lambda b: _fingerprints(b, shingle),
                           f"_id long, {'_tz_ht long, _tz_hr long, ' if row_key else ''}_fp long")


# -- the plan ---------------------------------------------------------------

def grouped_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits, sizes as even as can be; each starts with the free
    bit that is most correlated with others and takes its closest bits."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    bits -= bits.mean(axis=0)
    norm = np.sqrt((bits**2).sum(axis=0))
    corr = np.abs(bits.T @ bits) / np.maximum(norm[:, None] * norm[None, :], 1e-9)
    np.fill_diagonal(corr, 0)
    free, out = list(range(64)), []
    for i in range(m):
        size = 64 // m + (i < 64 % m)
        inner = corr[np.ix_(free, free)].sum(axis=1)
        group = [free.pop(int(np.argmax(inner)))]
        while len(group) < size:
            near = corr[np.ix_(free, group)].sum(axis=1)
            group.append(free.pop(int(np.argmax(near))))
        out.append(sorted(group))
    return out


def thresholds(groups: list[list[int]], sample: np.ndarray, n: int, most: int) -> tuple[float, list[int]]:
    """Least cost and the threshold of each group, by dynamic programming over
    the groups; candidates are estimated on pairs of the sample."""
    a = sample[:-1] if len(sample) > 1 else sample
    pairs = [a ^ np.roll(sample, s)[:len(a)] for s in range(1, min(len(sample), 65))] or [np.array([~np.uint64(0)])]
    diff = np.concatenate(pairs)
    diff = diff[diff != 0] if (diff != 0).any() else np.array([~np.uint64(0)])
    cost = []
    for g in groups:
        mask = np.uint64(sum(1 << b for b in g))
        dist = np.bitwise_count(diff & mask)
        row = [0.0]
        for t in range(most + 1):
            # at least what evenly spread bits would give: the sample is small beside 2^bits
            even = sum(comb(len(g), r) for r in range(t + 1)) / 2.0 ** len(g)
            rate = max(float((dist <= t).mean()), even)
            probes = sum(comb(len(g), r) for r in range(t + 1))
            row.append(n * PROBE_COST * (probes + (t > 0)) + 0.5 * n * n * rate)
        cost.append(row)
    best = {0: (0.0, [])}
    for row in cost:
        now: dict[int, tuple[float, list[int]]] = {}
        for used, (c, picks) in best.items():
            for t in range(-1, most + 1):
                k = used + t + 1
                if k <= most + 1 and (k not in now or c + row[t + 1] < now[k][0]):
                    now[k] = (c + row[t + 1], [*picks, t])
        best = now
    return best.get(most + 1, (float("inf"), []))


def allocation(sample: np.ndarray, n: int, most: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions used, for the cheapest number of
    partitions. Always complete: sum(t + 1) is most + 1."""
    plans = []
    for m in range(1, most + 4):
        groups = grouped_bits(sample, m)
        cost, picks = thresholds(groups, sample, n, most)
        plans.append((cost, m, [(g, t) for g, t in zip(groups, picks) if t >= 0]))
    return min(plans, key=lambda p: p[:2])[2]


# -- probe and verify -------------------------------------------------------

def _masked(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    return fp & np.uint64(sum(1 << b for b in bits))


def _keys(fp: np.ndarray, plan: list[tuple[list[int], int]], base: np.ndarray | None = None):
    """(row, key, probe only) of all entries; key is 64 bits, mixed from the
    partition's number, its value and the key of the bucket above."""
    for i, (bits, t) in enumerate(plan):
        value = _masked(fp, bits)
        for r in range(t + 1):
            for flips in combinations(bits, r):
                v = value ^ np.uint64(sum(1 << b for b in flips))
                x = v if base is None else v ^ (base * np.uint64(0xD6E8FEB86659FD93))
                x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1) * np.uint64(0xC2B2AE3D27D4EB4F)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                yield x ^ (x >> np.uint64(32)), r > 0


def _entries(batches: Iterator[pa.RecordBatch], plan, deeper: bool) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for b in batches:
            node = b.column("_node")
            fp = b.column("_fp").to_numpy(zero_copy_only=False).view(np.uint64)
            base = b.column("_key").to_numpy(zero_copy_only=False).view(np.uint64) if deeper else None
            own = np.asarray(b.column("_probe").to_numpy(zero_copy_only=False), dtype=bool) if deeper else None
            for key, probe in _keys(fp, plan, base):
                probe = own if deeper else np.full(len(fp), probe)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), node, b.column("_fp"), pa.array(probe)],
                                                 names=["_key", "_node", "_fp", "_probe"])


def _linked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    t = whole(batches)
    if t is None:
        return
    key, node, fp = (t.column(c).to_numpy() for c in ("_key", "_node", "_fp"))
    probe = np.asarray(t.column("_probe").to_numpy(), dtype=bool)
    order = np.lexsort((node, probe, key))
    key, node, fp, probe = key[order], node[order], fp[order].view(np.uint64), probe[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    stops = np.r_[starts[1:], len(key)]
    sizes = stops - starts
    found: list[tuple[int, int]] = []

    pair = starts[sizes == 2]  # most buckets: both rows at once
    close = (np.bitwise_count(fp[pair] ^ fp[pair + 1]) <= most) & ~probe[pair] & (node[pair] != node[pair + 1])
    found += zip(node[pair[close]].tolist(), node[pair[close] + 1].tolist())
    for s, e in zip(starts[sizes > 2].tolist(), stops[sizes > 2].tolist()):
        filed = int((~probe[s:e]).sum())  # these come first; probes are compared with them only
        joined, rows = Joined(e - s), max(1, (1 << 22) // max(1, filed))
        for at in range(s, e, rows):
            top = min(at + rows, e)
            near = np.bitwise_count(fp[at:top, None] ^ fp[None, s:s + filed]) <= most
            near &= node[at:top, None] != node[None, s:s + filed]
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                joined.row(at - s + i, np.flatnonzero(near[i]))
        found += [(int(node[s + a]), int(node[s + b])) for a, b in joined.links]
    for at in range(0, len(found), 100_000):
        u, v = zip(*found[at:at + 100_000])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


_ENTRY = "_key long, _node long, _fp long, _probe boolean"


def near_pairs(prints: DataFrame, most: int = 3, hot: int = HOT, sample_size: int = SAMPLE) -> DataFrame:
    """Edges (u, v) between rows of ``prints`` (_node long, _fp long, distinct)
    at ``most`` or fewer differing bits: complete up to connection (a bucket
    gives a spanning forest of its links, not all pairs). The plan is made on
    a sample of at most ``sample_size`` rows.

    A value that more than ``hot`` entries share is not compared as a whole:
    what meets there agrees, or nearly, in that partition, so its entries are
    filed again under the values of ``most + 1`` even groups of all bits, one
    of which must agree exactly. This repeats at finer cuts while buckets stay
    hot; what is left at the last cut is compared block by block."""
    n = prints.count()
    part = prints.select("_fp").orderBy(F.xxhash64("_fp")).limit(sample_size)
    sample = np.array([r[0] for r in part.collect()], dtype=np.int64).view(np.uint64)
    if n < 2:
        return prints.select(F.col("_node").alias("u"), F.col("_node").alias("v")).limit(0)
    plan = allocation(sample, n, most)
    entries = prints.select("_node", "_fp").mapInArrow(lambda b: _entries(b, plan, False), _ENTRY)
    done = []
    for level in range(1, 4):
        counts = entries.groupBy("_key").count().where(F.col("count") > hot).select("_key").checkpoint()
        if counts.isEmpty():
            break
        done.append(entries.join(counts, "_key", "left_anti"))
        rng = np.random.default_rng(level)
        shuffled = rng.permutation(64).tolist()
        cuts = [(sorted(shuffled[i::most + 1]), 0) for i in range(most + 1)]
        entries = entries.join(counts, "_key", "left_semi").select("_key", "_node", "_fp", "_probe").mapInArrow(
            lambda b, cuts=cuts: _entries(b, cuts, True), _ENTRY)
    done.append(entries)
    out = None
    for e in done:
        links = e.repartition("_key").mapInArrow(lambda b: _linked(b, most), "u long, v long")
        out = links if out is None else out.unionByName(links)
    return out


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                   most: int = 3, hot: int = HOT, row_key: bool = False) -> DataFrame:
    """Per row of ``docs``: id, fingerprint (16 hex digits), component_id (the
    smallest id reachable over links, its own included). With ``row_key`` also
    _tz_ht and _tz_hr (:func:`row_hashes`) and _c, a number of the component's own:
    components may share a component_id where ids repeat or are null.

    Null and empty texts have the fingerprint zero and link like any other. A
    text of fewer words than ``shingle`` is one shingle. Rows that repeat an
    id keep a row each. Null ids sort last: a component of null ids only has a
    null component_id. An empty table gives an empty table."""
    prints = saved(fingerprints(docs, id_col, text_col, shingle, row_key), "fingerprints")
    kinds = saved(prints.groupBy("_fp").agg(F.min(key_id("_id")).alias("_least")), "kinds")
    # nodes are the prints themselves; ids may repeat or be null
    links = near_pairs(kinds.select(F.col("_fp").alias("_node"), "_fp"), most, hot)
    comp = components(links)
    member = kinds.join(comp, kinds["_fp"] == comp["node"], "left").select(
        F.col("_fp").alias("_f"), "_least", F.coalesce("component", "_fp").alias("_c"))
    member = saved(member, "members")
    roots = saved(member.groupBy("_c").agg(F.min("_least").alias("component_id")), "roots")
    member = member.join(roots, "_c").select("_f", "_c", "component_id")
    out = prints.join(member, prints["_fp"] == member["_f"])
    none = key_id("_id") == F.col("component_id")
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
                      F.when(none, F.col("_id")).otherwise(F.col("component_id")).alias("component_id"),
                      *(["_tz_ht", "_tz_hr", "_c"] if row_key else []))
