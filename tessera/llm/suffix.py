"""Repeated passages by a collection Burrows-Wheeler transform.

Every string of ``least`` bytes has a minimizer: the 32 bytes in it whose hash
is least (the leftmost of equals). Neighbouring strings with one minimizer form
a stretch of text, and equal strings have equal minimizers, so stretches meet
by the minimizer's hash. Stretches that are equal as a whole collapse to the
earliest. Where one minimizer is left with several different stretches, these
are the documents of a collection whose transform is built column by column:
each round puts one more symbol of every stretch, from its end, into the
transform, and carries the longest common prefixes along, both in files that
are read and written from front to back. Neighbours in it with ``least`` or
more bytes in common are equal strings; all but the earliest are marked.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.batches import row_parts

from .common import saved, with_key

LEAST = 100
GRAM = 32
BLOCK = 1 << 16
LOCAL_BYTES = 32 << 20
CUT_BYTES = 4 << 20
ROW_BYTES = 200  # of a string as a Python object with its key and place
TRANSFORM_BYTES = 16 << 20
HOT = 50_000
FILE_ROWS = 1 << 20
_POS = 17

_rng = np.random.Generator(np.random.PCG64(7))
_BYTE = _rng.integers(0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, dtype=np.uint64)], dtype=np.uint64)


def _gram_hash(v: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every run of ``gram`` symbols, by doubling."""
    h, size, power = v, 1, _R
    with np.errstate(over="ignore"):
        for bit in bin(gram)[3:]:
            h = h[:-size] * np.uint64(power) + h[size:]
            size, power = 2 * size, power * power & _MASK
            if bit == "1":
                h = h[:-1] * np.uint64(_R) + v[size:size + len(h) - 1]
                size, power = size + 1, power * _R & _MASK
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


class Stretches:
    """Cuts texts into stretches of one minimizer each."""

    def __init__(self, least: int = LEAST) -> None:
        self.least, self.gram = least, min(GRAM, least)
        n = BLOCK + least + 1
        self.up, self.down = _powers(_R, n), _powers(pow(_R, -1, 1 << 64), n)

    def of(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, count, minimizer, content hash) of the stretches of a text:
        count strings, the first at start."""
        got = [self._block(buf[at:at + BLOCK + self.least - 1], at)
               for at in range(0, max(0, len(buf) - self.least + 1), BLOCK)]
        if not got:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none.view(np.uint64), none.view(np.uint64)
        return tuple(np.concatenate(x) for x in zip(*got))

    def _block(self, buf: np.ndarray, at: int):
        v = _BYTE[buf]
        h = _gram_hash(v, self.gram)
        # the least hash of each string; of equals the leftmost
        key = (h >> np.uint64(_POS) << np.uint64(_POS)) | np.arange(len(h), dtype=np.uint64)
        width, reach = self.least - self.gram + 1, 1
        while 2 * reach <= width:
            key = np.minimum(key[:-reach], key[reach:])
            reach *= 2
        if width > reach:
            key = np.minimum(key[:-(width - reach)], key[width - reach:])
        pos = (key & np.uint64((1 << _POS) - 1)).astype(np.int64)
        start = np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]])
        count = np.diff(np.r_[start, len(pos)])
        sums = np.r_[np.uint64(0), np.cumsum(v * self.down[:len(v)], dtype=np.uint64)]
        content = (sums[start + count + self.least - 1] - sums[start]) * self.up[start]
        content = (content ^ (content >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return start + at, count, h[pos[start]], content


_STRETCH = "_c long, _x long, _id long, _at long, _f boolean"


def _marks(ids: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marked starts (document, start, count), adjoining ones as one."""
    order = np.lexsort((at, ids))
    ids, at, n = ids[order], at[order], n[order]
    if not len(ids):
        return ids, at, n
    first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (at[1:] != at[:-1] + n[:-1])])
    return ids[first], at[first], np.add.reduceat(n, first)


def _stretch_batch(c, x, ids, at, flag) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c.view(np.int64)), pa.array(x.view(np.int64)), pa.array(ids), pa.array(at),
         pa.array(np.full(len(c), flag))], names=["_c", "_x", "_id", "_at", "_f"])


def _stretches(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows of _f false: stretches, the earliest of equal ones among some MB of
    text. Rows of _f true: marks; _x is their number of starts."""
    cut, parts, size = Stretches(least), [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        c, x, ids, at = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((at, ids, x, c))
        c, x, ids, at = c[order], x[order], ids[order], at[order]
        new = np.r_[True, (c[1:] != c[:-1]) | (x[1:] != x[:-1])]
        for s in range(0, int(new.sum()), 100_000):
            i = np.flatnonzero(new)[s:s + 100_000]
            yield _stretch_batch(c[i], x[i], ids[i], at[i], False)
        d, a, n = _marks(ids[~new], at[~new], (c[~new] & np.uint64(0xFFFF)).astype(np.int64))
        for s in range(0, len(d), 100_000):
            k = d[s:s + 100_000].view(np.uint64) * np.uint64(_R)
            yield _stretch_batch(k, n[s:s + 100_000], d[s:s + 100_000], a[s:s + 100_000], True)

    with np.errstate(over="ignore"):
        for b in batches:
            for i, o, t in zip(b.column("_id").to_pylist(), b.column("_ord").to_pylist(), b.column("_text"), strict=True):
                buf = np.frombuffer(t.as_py().encode(), dtype=np.uint8)
                start, count, h, x = cut.of(buf)
                if len(start):
                    c = (h >> np.uint64(16) << np.uint64(16)) | count.astype(np.uint64)
                    parts.append((c, x, np.full(len(c), i, dtype=np.int64), start + (o << 40)))
                    size += len(buf)
                    if size > LOCAL_BYTES:
                        yield from flush()
                        parts, size = [], 0
        if parts:
            yield from flush()


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (_c, _x, _id, _at). Marks stretches that an earlier equal
    one exists for; passes on (_f false) the others where their minimizer has
    more than one."""
    last = None  # (key, count-and-key, content) of the row before
    held = None  # the first stretch of the running minimizer, while it is alone
    for b in batches:
        c, x, ids, at = (b.column(k).to_numpy(zero_copy_only=False) for k in ("_c", "_x", "_id", "_at"))
        marked = np.asarray(b.column("_f").to_numpy(zero_copy_only=False), dtype=bool)
        if marked.any():
            yield _stretch_batch(c[marked], x[marked], ids[marked], at[marked], True)
            c, x, ids, at = c[~marked], x[~marked], ids[~marked], at[~marked]
        if not len(c):
            continue
        k = c >> 16
        c0, x0, k0 = last if last else (~c[0], ~x[0], ~k[0])
        new = (c != np.r_[c0, c[:-1]]) | (x != np.r_[x0, x[:-1]])
        fresh = k != np.r_[k0, k[:-1]]
        last = (c[-1], x[-1], k[-1])
        if (~new).any():
            old = ~new
            d, a, n = _marks(ids[old], at[old], c[old] & 0xFFFF)
            yield _stretch_batch(np.zeros(len(d), np.int64), n, d, a, True)
        c, x, ids, at, k, fresh = (v[new] for v in (c, x, ids, at, k, fresh))
        if not len(c):
            continue
        out = ~fresh
        out[:-1] |= ~fresh[1:]
        if held is not None and not fresh[0]:
            yield _stretch_batch(*held, False)
        if not (held is not None and len(c) == 0):
            held = None
        if not out[-1]:  # alone so far
            held = tuple(v[-1:] for v in (c, x, ids, at))
        if out.any():
            yield _stretch_batch(c[out], x[out], ids[out], at[out], False)


def _lists(column: pa.ListArray, *names: str) -> tuple[np.ndarray, ...]:
    """Where each row's list of structs begins (and the last ends) in the
    fields' arrays, and those; null is an empty list."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.r_[0, np.cumsum(size, dtype=np.int64)], *(pc.struct_field(flat, n).to_numpy(zero_copy_only=False) for n in names)


def _cut_out(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the stretches. Of a hot minimizer each string goes by
    itself, under its own hash."""
    key, ids, at, out, size = [], [], [], [], 0
    for b in batches:
        bound, c, begin, hot = _lists(b.column("_p"), "_c", "_at", "_hot")
        for r, (i, o, t) in enumerate(zip(b.column("_id").to_pylist(), b.column("_ord").to_pylist(), b.column("_text"),
                                          strict=True)):
            raw, mine = t.as_py().encode(), slice(bound[r], bound[r + 1])
            for k, first, single in zip(c[mine].tolist(), begin[mine].tolist(), hot[mine].tolist(), strict=True):
                n, start = k & 0xFFFF, first & ((1 << 40) - 1)
                if single:
                    for j in range(start, start + n):
                        g = raw[j:j + least]
                        key.append(hash_bytes(g))
                        ids.append(i)
                        at.append(j + (o << 40))
                        out.append(g)
                    size += n * (least + ROW_BYTES)
                else:
                    key.append(k >> 16)
                    ids.append(i)
                    at.append(first)
                    out.append(raw[start:start + n + least - 1])
                    size += n + least + ROW_BYTES
                if size > CUT_BYTES:
                    yield _pieces(key, ids, at, out)
                    key, ids, at, out, size = [], [], [], [], 0
    if key:
        yield _pieces(key, ids, at, out)


def hash_bytes(g: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(g) - (1 << 63)


def _pieces(key, ids, at, out) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(ids, pa.int64()), pa.array(at, pa.int64()),
                                       pa.array(out, pa.binary())], names=["_k", "_id", "_at", "_s"])


# -- the transform ----------------------------------------------------------

class Transform:
    """Burrows-Wheeler transform of a collection and the longest common
    prefixes of neighbours, built column by column from the strings' ends.

    Three files run in step, a row per suffix in sorted order: the symbol
    before it (byte + 1, or 0 where the string begins), its common prefix with
    the row above, and its string and length. A round reads them once to rank
    the symbols and once to write them anew with its rows put in."""

    def __init__(self, strings: list[bytes], folder: str, rows: int = FILE_ROWS) -> None:
        self.folder, self.block, self.m = folder, rows, len(strings)
        self.size = np.array([len(s) for s in strings], dtype=np.int64)
        self.data = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.end = np.cumsum(self.size)
        longest = int(self.size.max(initial=0))
        self.bits = longest.bit_length() + 1
        wide = self.m.bit_length() + self.bits > 32
        self.types = (np.uint16 if self.data.max(initial=0) == 255 else np.uint8, np.uint16 if longest > 254 else np.uint8,
                      np.uint64 if wide else np.uint32)
        self.turn, self.rows = 0, self.m
        at, who = np.arange(self.m), np.arange(self.m)  # rows put in by the last round, and whose
        self._write([(self._symbol(who, 0), np.zeros(self.m, self.types[1]), self._whose(who, 0))])
        for j in range(1, longest + 1):
            keep = self.size[who] >= j
            at, who = self._round(at[keep], who[keep], j)

    def _symbol(self, who: np.ndarray, j: int) -> np.ndarray:
        out = np.zeros(len(who), dtype=self.types[0])
        more = self.size[who] > j
        out[more] = self.data[self.end[who[more]] - j - 1] + self.types[0](1)
        return out

    def _whose(self, who: np.ndarray, j: int) -> np.ndarray:
        return (who << self.bits | j).astype(self.types[2])

    def _paths(self, turn: int) -> list[str]:
        return [os.path.join(self.folder, f"{n}-{turn % 2}") for n in ("symbol", "prefix", "whose")]

    def _write(self, blocks) -> None:
        files = [open(p, "wb") for p in self._paths(self.turn + 1)]
        for columns in blocks:
            for f, c in zip(files, columns, strict=True):
                c.tofile(f)
        for f in files:
            f.close()
        for p in self._paths(self.turn):  # what was read is done with
            if os.path.exists(p):
                os.unlink(p)
        self.turn += 1

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        files = [open(p, "rb") for p in self._paths(self.turn)]
        try:
            while True:
                got = [np.fromfile(f, dtype=t, count=self.block) for f, t in zip(files, self.types)]
                if not len(got[0]):
                    return
                yield tuple(got)
        finally:
            for f in files:
                f.close()

    def _round(self, at: np.ndarray, who: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        symbol, rank, prefix, new, row, count = self._ranked(at)
        ahead = self.m + np.r_[0, np.cumsum(count[1:])]  # rows before the suffixes that begin with symbol 1, 2, ...
        to = ahead[symbol - 1] + rank
        order = np.argsort(to, kind="stable")
        to, prefix, new, row = to[order], prefix[order], new[order], row[order]
        put, mine = to[new], who[np.searchsorted(at, row[new])]
        columns = (self._symbol(mine, j), prefix[new].astype(self.types[1]), self._whose(mine, j))
        self._write(self._merged(put, columns, to[~new], prefix[~new].astype(self.types[1])))
        self.rows += len(put)
        return put, mine

    def _ranked(self, at: np.ndarray):
        """For the symbols of the rows ``at``, and for each that is the next of
        its symbol after one of them: symbol, rank among its kind, one more
        than the shortest common prefix since the one before, whether its row
        is in ``at``, and the row. Also the count of each symbol."""
        count, low = np.zeros(257, np.int64), np.full(257, 1 << 30, np.int64)
        seen, seen_new = np.zeros(257, bool), np.zeros(257, bool)
        found, base = [], 0
        for sym, lcp, _ in self.blocks():
            n = len(sym)
            a, z = np.searchsorted(at, (base, base + n))
            fresh = np.zeros(n, dtype=bool)
            fresh[at[a:z] - base] = True
            here = np.bincount(sym, minlength=257)
            first = np.cumsum(here) - here
            order = np.argsort(sym, kind="stable")
            kind = sym[at[a:z] - base]
            mine = np.split(at[a:z][np.argsort(kind, kind="stable")] - base, np.cumsum(np.bincount(kind, minlength=257))[:-1])
            ask_s, ask_p, ask_from, ask_rank = [], [], [], []
            for s in range(1, 257):
                if not here[s] or not (len(mine[s]) or seen_new[s]):
                    continue
                own = order[first[s]:first[s] + here[s]]
                marked = np.zeros(here[s] + 1, dtype=bool)
                i = np.searchsorted(own, mine[s])
                marked[i] = marked[i + 1] = True
                marked[0] |= seen_new[s]
                r = np.flatnonzero(marked[:-1])
                start = own[r - 1] + 1
                if r[0] == 0:
                    start[0] = 0
                ask_s.append(np.full(len(r), s))
                ask_p.append(own[r])
                ask_from.append(start)
                ask_rank.append(r)
            last_block = base + n == self.rows
            kinds = np.flatnonzero(here)
            end = order[first[kinds] + here[kinds] - 1]
            if ask_s:
                s, p, start, r = (np.concatenate(x) for x in (ask_s, ask_p, ask_from, ask_rank))
                shortest = np.zeros(len(s), dtype=np.int64)
                known = (r > 0) | seen[s]  # the first of its kind has nothing before it
                shortest[known] = _least_between(lcp, start[known], p[known] + 1)
                top = known & (r == 0)
                shortest[top] = np.minimum(shortest[top], low[s[top]])
                shortest[known] += 1
                found.append((s, count[s] + r, shortest, fresh[p], p + base))
            if not last_block:
                low = np.minimum(low, int(lcp.min()))
                low[kinds] = 1 << 30
                inner = end + 1 < n
                low[kinds[inner]] = _least_between(lcp, end[inner] + 1, np.full(int(inner.sum()), n))
                seen[kinds], seen_new[kinds] = True, fresh[end]
            count += here
            base += n
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none, none.astype(bool), none, count
        return *(np.concatenate(x) for x in zip(*found)), count

    def _merged(self, put: np.ndarray, columns, change: np.ndarray, changed: np.ndarray):
        """The rows with ``columns`` put in at ``put``, and prefixes changed."""
        before = put - np.arange(len(put))  # the old row that each goes before
        base = done = 0
        for old in self.blocks():
            n = len(old[0])
            a = np.searchsorted(before, base)
            z = np.searchsorted(before, base + n) if base + n < self.rows else len(before)
            size = n + z - a
            stay = np.ones(size, dtype=bool)
            stay[put[a:z] - done] = False
            out = []
            for c, more in zip(old, columns, strict=True):
                merged = np.empty(size, dtype=c.dtype)
                merged[stay] = c
                merged[put[a:z] - done] = more[a:z]
                out.append(merged)
            x, y = np.searchsorted(change, (done, done + size))
            out[1][change[x:y] - done] = changed[x:y]
            yield out
            base, done = base + n, done + size

    def equal(self, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(group, string, suffix length) of rows whose neighbours share
        ``least`` or more symbols with them."""
        group, before = 0, None
        for _, lcp, whose in self.blocks():
            tied = lcp >= least
            g = group + np.cumsum(~tied)
            if before is not None and tied[0]:
                yield before
            keep = np.flatnonzero(tied | np.r_[tied[1:], False])
            whose = whose.astype(np.int64)
            who, size = whose >> self.bits, whose & ((1 << self.bits) - 1)
            before = None if tied[-1] else (g[-1:], who[-1:], size[-1:])
            yield g[keep], who[keep], size[keep]
            group = int(g[-1])


def _least_between(v: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """min(v[start:stop]) for non-empty ranges, from tables of doubling reach."""
    size = stop - start
    if not len(size):
        return size
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(size), dtype=np.int64)
    table, reach = v, 1
    for k in range(int(level.max(initial=0)) + 1):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[start[at]], table[stop[at] - reach])
        if k < level.max(initial=0):
            table = np.minimum(table[:-reach], table[reach:])
            reach *= 2
    return out


def _may_share(keys: np.ndarray, strings: list[bytes], least: int) -> np.ndarray:
    """Which stretches may share a string with another: of two that do, the
    bytes that lead up to and through the minimizer, or from it on, agree over
    half of what the string has besides it. Loses none that share."""
    gram = min(GRAM, least)
    width, flank = least - gram + 1, (least - gram) // 2
    weight = _rng_words(gram + flank)
    out = np.zeros((2, len(strings)), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(strings), 5_000):
            some = strings[at:at + 5_000]
            size = np.array([len(x) for x in some])
            data = np.frombuffer(b"".join(some), dtype=np.uint8)
            f = np.cumsum(size) - size
            h = _gram_hash(_BYTE[data], gram)
            m = (h[f[:, None] + np.arange(width)] >> np.uint64(_POS)).argmin(axis=1)  # the leftmost of equals
            for side, begin in enumerate((m - flank, m)):
                fits = (begin >= 0) & (begin + gram + flank <= size)
                part = data[(f + begin)[fits, None] + np.arange(gram + flank)].astype(np.uint64)
                own = np.full(len(f), -1, dtype=np.int64).view(np.uint64) - np.arange(at, at + len(f), dtype=np.uint64)
                own[fits] = ((part + np.uint64(1)) * weight).sum(axis=1, dtype=np.uint64)
                out[side, at:at + 5_000] = own ^ (keys[at:at + 5_000].view(np.uint64) * np.uint64(_R))
    keep = np.zeros(len(strings), dtype=bool)
    for side in out:
        _, at, n = np.unique(side, return_inverse=True, return_counts=True)
        keep |= n[at] > 1
    return keep


def _rng_words(n: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(11))
    return rng.integers(0, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _transformed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (_k, _id, _at). Whole minimizers, a few MB of strings at a
    time, so that a worker's memory does not follow the partition's size. A
    string that came before under its key (as those of a hot minimizer do) is
    marked at once; the others may share more, and are transformed."""
    part: tuple[list, ...] = ([], [], [], [])  # key, document, place, string
    kept: tuple[list, ...] = ([], [], [])  # document, place, string, of those that may share
    again: tuple[list, ...] = ([], [], [])
    last, seen, size, kept_size = None, set(), 0, 0

    def flush(whole_part: bool) -> Iterator[pa.RecordBatch]:
        nonlocal part, kept, size, kept_size
        if part[0]:
            for r in np.flatnonzero(_may_share(np.array(part[0], dtype=np.int64), part[3], least)).tolist():
                for column, values in zip(kept, part[1:], strict=True):
                    column.append(values[r])
                kept_size += len(part[3][r])
            part, size = ([], [], [], []), 0
        if kept[0] and (whole_part or kept_size >= TRANSFORM_BYTES):
            done, kept, kept_size = kept, ([], [], []), 0
            yield from _equal_strings(*done, least)

    for b in batches:
        for k, i, at, s in zip(*(b.column(n).to_pylist() for n in ("_k", "_id", "_at", "_s")), strict=True):
            if k != last:
                if size >= CUT_BYTES:
                    yield from flush(False)
                last, seen = k, set()
            if s in seen:
                for column, value in zip(again, (i, at, len(s) - least + 1), strict=True):
                    column.append(value)
                continue
            seen.add(s)
            for column, value in zip(part, (k, i, at, s), strict=True):
                column.append(value)
            size += len(s)
        if len(again[0]) >= 10_000:
            yield _runs(*(np.array(v, dtype=np.int64) for v in again))
            again = ([], [], [])
    yield from flush(True)
    if again[0]:
        yield _runs(*(np.array(v, dtype=np.int64) for v in again))


def _runs(ids: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in _marks(ids, at, n)], names=["_id", "_at", "_n"])


def _equal_strings(ids: list[int], at: list[int], strings: list[bytes], least: int) -> Iterator[pa.RecordBatch]:
    """Marks of the strings of ``least`` bytes that occur earlier among these."""
    ids, at, found = np.array(ids, dtype=np.int64), np.array(at, dtype=np.int64), []

    def later(group: np.ndarray, doc: np.ndarray, start: np.ndarray) -> None:
        if not len(group):
            return
        order = np.lexsort((start, doc, group))
        group, doc, start = group[order], doc[order], start[order]
        old = np.r_[False, group[1:] == group[:-1]]
        found.append((doc[old], start[old]))

    with tempfile.TemporaryDirectory(prefix="transform-") as folder:
        made = Transform(strings, folder)
        none = np.zeros(0, dtype=np.int64)
        open_ = (none, none, none)  # the last group, which may go on in the next block
        for group, who, size in made.equal(least):
            got = tuple(np.concatenate(v) for v in zip(open_, (group, ids[who], at[who] + made.size[who] - size), strict=True))
            stop = int(np.searchsorted(got[0], got[0][-1])) if len(got[0]) else 0
            later(*(v[:stop] for v in got))
            open_ = tuple(v[stop:] for v in got)
        later(*open_)
    if found:
        d, a = (np.concatenate(v) for v in zip(*found, strict=True))
        if len(d):
            yield _runs(d, a, np.ones(len(d), dtype=np.int64))


# -- documents --------------------------------------------------------------

def _removed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    names = ["_id", "_ord", "n_bytes", "n_removed", "n_spans", "kept"]
    for b in batches:
        for part in row_parts(b, "_text"):
            out, (bound, at, n) = [], _lists(part.column("_p"), "_at", "_n")
            for t, first, last in zip(part.column("_text"), bound[:-1].tolist(), bound[1:].tolist(), strict=True):
                raw = t.as_py().encode()
                if first == last:
                    out.append((len(raw), 0, 0, raw))
                    continue
                edge = np.zeros(len(raw) + 1, dtype=np.int64)
                start = at[first:last] & ((1 << 40) - 1)
                stop = start + n[first:last] + least - 1
                np.add.at(edge, start, 1)
                np.add.at(edge, stop, -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(raw), int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
            n, r, k, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_ord"), pa.array(n, pa.int64()),
                                              pa.array(r, pa.int64()), pa.array(k, pa.int64()), pa.array(kept, pa.binary())],
                                             names=names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                   hot: int = HOT) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept (the remaining
    bytes, which may cut a character). A byte goes if a string of ``least``
    bytes that covers it also starts earlier: in a smaller id, or earlier in
    the same document. Strings are judged on the input.

    Null text is empty. Null ids come last, as one id. Different texts under
    one id are ordered by hash; rows that repeat id and text are one document
    with a row each. An empty table gives an empty table. ``least`` may be 2
    to 4000. Stretches are told apart by a 64-bit hash of their content beside
    48 bits of their minimizer; strings in a transform, byte by byte."""
    base = with_key(docs, id_col, text_col)
    once = base.dropDuplicates(["_id", "_ord"]) if _repeats(base) else base
    found = once.mapInArrow(lambda b: _stretches(b, least), _STRETCH)
    found = found.repartition(F.shiftright("_c", 16)).sortWithinPartitions("_c", "_x", "_id", "_at").mapInArrow(
        _earliest, _STRETCH)
    found = saved(found, "stretches")
    several = found.where("not _f").select("_c", "_id", "_at")
    key = F.shiftright("_c", 16).alias("_k")
    frequent = several.groupBy(key).count().where(F.col("count") > hot).select("_k", F.lit(True).alias("_hot"))
    frequent = saved(frequent, "frequent")
    if frequent.isEmpty():
        several = several.withColumn("_hot", F.lit(False))
    else:
        several = several.withColumn("_k", key).join(frequent, "_k", "left").withColumn(
            "_hot", F.coalesce("_hot", F.lit(False)))
    order = F.shiftright("_at", 40).cast("int").alias("_ord")
    spans = several.groupBy("_id", order).agg(F.collect_list(F.struct("_c", "_at", "_hot")).alias("_p"))
    strings = once.join(spans, ["_id", "_ord"]).mapInArrow(
        lambda b: _cut_out(b, least), "_k long, _id long, _at long, _s binary")
    strings = strings.repartition("_k").sortWithinPartitions("_k", "_id", "_at").mapInArrow(
        lambda b: _transformed(b, least), "_id long, _at long, _n long")
    marks = found.where("_f").select("_id", "_at", F.col("_x").alias("_n")).unionByName(strings)
    marks = marks.groupBy("_id", order).agg(F.collect_list(F.struct("_at", "_n")).alias("_p"))
    out = base.join(marks, ["_id", "_ord"], "left").mapInArrow(
        lambda b: _removed(b, least),
        "_id long, _ord int, n_bytes long, n_removed long, n_spans long, kept binary")
    from .common import NO_ID

    return out.select(F.nullif("_id", F.lit(NO_ID)).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")


def _repeats(base: DataFrame) -> bool:
    return not base.groupBy("_id", "_ord").count().where("count > 1").isEmpty()
