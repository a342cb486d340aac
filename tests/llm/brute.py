"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def closure(ids, links):
    label = {i: i for i in ids}
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    done = set()
    for i in sorted(ids):
        if i in done:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if x in done:
                continue
            done.add(x)
            label[x] = i
            todo += near[x] - done
    return label


def simhash(text, shingle=3):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + shingle]).encode(), 42) for i in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_components(docs, most=3):
    fp = {i: simhash(t) for i, t in docs}
    ids = sorted(fp)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if (fp[a] ^ fp[b]).bit_count() <= most]
    return {i: f"{f:016x}" for i, f in fp.items()}, closure(ids, links)


def repeats(docs, least=100):
    """{id: (n_bytes, n_removed, n_spans, sha256 of the rest)}"""
    seen, out = set(), {}
    for i, t in sorted(docs):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - least + 1):
            g = raw[s:s + least]
            if g in seen:
                gone[s:s + least] = True
            seen.add(g)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), spans,
                  hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    s = 0
    while s < min(len(a), len(b)) - p and a[-1 - s] == b[-1 - s]:
        s += 1
    return p + s >= max(len(a), len(b)) - 1


def line_dedup(docs, min_words=5):
    """{id: text without the lines that go}"""
    first, order = {}, []
    lines = {}
    for i, t in sorted(docs):
        for k, line in enumerate((t or "").split("\n")):
            w = tuple(WORD.findall(line.lower()))
            lines[i, k] = w
            if w and w not in first:
                first[w] = (i, k)
                order.append(w)
    by_size = defaultdict(list)
    gone = set()
    for w in order:  # in order of their first places
        if len(w) < min_words:
            continue
        if any(one_edit(w, v) for n in (len(w) - 1, len(w), len(w) + 1) for v in by_size[n]):
            gone.add(first[w])
        by_size[len(w)].append(w)
    out = {}
    for i, t in docs:
        keep = [line for k, line in enumerate((t or "").split("\n"))
                if not lines[i, k] or (first[lines[i, k]] == (i, k) and (i, k) not in gone)]
        out[i] = "\n".join(keep)
    return out


def cosine_links(vectors, least=0.95):
    """{id: other vectors linked}, {id: component}; ids must differ."""
    fine = [(i, np.array(v, float)) for i, v in vectors
            if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(i, j) for k, (i, a) in enumerate(fine) for j, b in fine[k + 1:]
             if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least]
    n = {i: 0 for i, _ in vectors}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return n, closure([i for i, _ in vectors], links)


NOISE = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def fold(text):
    return NOISE.sub(" ", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")).split(" ")


def contamination(docs, items, size=10):
    """(id, n_words, n_hit, spans, items) of each row"""
    grams = defaultdict(set)
    for i, t in items:
        w = [x for x in fold(t) if x]
        for k in range(max(0, len(w) - min(len(w), size) + 1) if w else 0):
            grams[tuple(w[k:k + size])].add("null" if i is None else str(i))
    sizes = {len(g) for g in grams}
    out = []
    for i, t in docs:
        w = [x for x in fold(t) if x]
        hit, found = np.zeros(len(w) + 2, bool), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in grams:
                    found |= grams[tuple(w[k:k + n])]
                    hit[k + 1:k + n + 1] = True
        spans, start = [], None
        for k in range(len(w)):
            if hit[k + 1]:
                start = k if start is None else start
                if not hit[k + 2]:
                    spans.append((start, k + 1))
                    start = None
        out.append((i, len(w), int(hit.sum()), spans, sorted(found)))
    return out


def targets(sizes, weights, share, most):
    """The level at which the capped shares add up, by halving."""
    low, high = 0.0, 4 * most * max(sizes, default=0) + 1
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(most * s, mid * w) for s, w in zip(sizes, weights)) < share * sum(sizes):
            low = mid
        else:
            high = mid
    return [min(most * s, high * w) for s, w in zip(sizes, weights)]
