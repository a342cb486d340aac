"""Packing documents into fixed windows beside their lexical neighbours.

Documents are dealt over shards by likeness: those whose least tokens under a
few fixed permutations of the vocabulary are the same (min-hashes) come
together, a group larger than a shard parting by one permutation more. Each
shard has an inverted index with the term weights of the whole corpus. A window
begins with a seed document; BM25 ranks the shard's unused documents by the
seed's terms, and they fill the window in that order. The document that
overflows is cut, and its rest is the next seed, so every window but a shard's
last is full. What is left at the end is cut into lengths that are powers of
two, which need no padding.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

WINDOW = 4096
SHARD_TOKENS = 1_500_000
CACHE_WORDS = 1_000_000
SLICE_BYTES = 8 << 20  # text tokenised at once
LIKENESS = 4  # permutations
LOWER = r"^[a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+$"


class Tokens:
    """Token ids of whole texts, for a tokenizer file of the ``tokenizers``
    library. If the tokenizer sees ASCII letters in lower case and never joins
    what white space parts, words are kept in a bounded table (those met
    first), so that each is encoded once; a text with the string of a special token, and any text for
    another tokenizer, is encoded whole."""

    _open: dict[str, Tokens] = {}

    def __init__(self, path: str) -> None:
        self.most_words = CACHE_WORDS
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        size = self.tok.get_vocab_size()
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.size_of_vocab = size
        self.ends_word = np.zeros(size, dtype=bool)
        self.ends_word[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.by_word = all(self._ids(x) == self._ids(y) for x, y in (
            ("Ab Cd, e", "ab cd , e"), ("a\t\nb", "a b"), (" x.y ", "x .y"))) and bool(self.ends_word.any())
        # words of lower-case letters may go to the model itself, past the steps that leave them as they are
        self.letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.to_model = all(self._word(x) == self._ids(x) for x in ("a", "the", "unheard", "straße", "él", "œuvre", "žlutý", "ñandú"))
        self.where: dict[str, int] = {}
        self.flat = np.empty(0, dtype=self.dtype)
        self.start, self.size = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self._add([""], [[]])  # what stands before or after the white space at a text's edge

    @classmethod
    def at(cls, path: str) -> Tokens:
        """One for each Python worker and path."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _add(self, words: list[str], ids: list[list[int]]) -> None:
        self._put(words, np.array([len(i) for i in ids], dtype=np.int64), np.array([i for x in ids for i in x], dtype=self.dtype))

    def _put(self, words: list[str], size: np.ndarray, flat: np.ndarray) -> None:
        self.where.update(zip(words, range(len(self.where), len(self.where) + len(words))))
        self.start = np.r_[self.start, len(self.flat) + np.cumsum(size) - size]
        self.size, self.flat = np.r_[self.size, size], np.r_[self.flat, flat]

    def _word(self, word: str) -> list[int]:
        mapped = word if word.isascii() else self.letters.pre_tokenize_str(word)[0][0]
        return [t.id for t in self.tok.model.tokenize(mapped)]

    def _learn(self, words: pa.Array) -> None:
        easy = pc.match_substring_regex(words, LOWER) if self.to_model else pa.array([False] * len(words))
        plain, other = words.filter(easy).to_pylist(), words.filter(pc.invert(easy)).to_pylist()
        self._add(plain, [self._word(w) for w in plain])
        self._add(other, [e.ids for e in self.tok.encode_batch_fast(other, add_special_tokens=False)])

    def encode(self, texts: pa.Array, end: int | None = None) -> Iterator[np.ndarray]:
        """The ids of each text (no nulls), and ``end`` after them if given."""
        last = np.array([] if end is None else [end], dtype=self.dtype)
        if not self.by_word:
            for e in self.tok.encode_batch_fast(texts.to_pylist(), add_special_tokens=False):
                yield np.concatenate([np.array(e.ids, dtype=self.dtype), last])
            return
        odd = np.zeros(len(texts), dtype=bool)
        for t in self.special:
            odd |= pc.match_substring(texts, t, ignore_case=True).to_numpy(zero_copy_only=False)
        # ASCII letters in lower case, punctuation after one set apart: neither changes what the tokenizer sees
        low = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([.,;:!?])", r"\1 \2")
        lists = pc.ascii_split_whitespace(low)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        names = words.to_pylist()
        new = [w not in self.where for w in names]
        n, words_before, ids_before = sum(new), len(self.where), len(self.flat)
        if n:
            self._learn(words.filter(pa.array(new)))
        kind = np.fromiter(map(self.where.__getitem__, names), dtype=np.int64, count=len(names))
        at = kind[coded.indices.to_numpy()] if len(names) else np.empty(0, dtype=np.int64)
        size = self.size[at]
        stop = np.cumsum(size)
        flat = self.flat[np.repeat(self.start[at] - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]
        if len(self.where) > self.most_words:  # the table is full: what it holds stays, and new words are for this call alone
            for _ in range(n):
                self.where.popitem()
            self.start, self.size, self.flat = self.start[:words_before], self.size[:words_before], self.flat[:ids_before]
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        cut = np.r_[0, np.r_[0, stop][ends]]
        for k in range(len(texts)):
            if odd[k]:
                yield np.concatenate([np.array(self._ids(texts[k].as_py()), dtype=self.dtype), last])
            else:
                yield np.concatenate([flat[cut[k]:cut[k + 1]], last])


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of bounded size (a longer text is one by itself)."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < len(texts):
        n = max(1, int(np.searchsorted(np.cumsum(size[at:at + 20_000]), SLICE_BYTES)))
        yield at, texts.slice(at, n)
        at += n


TOKENISED = "_id long, _h long, _n long, " + "".join(f"_m{k} int, " for k in range(1, LIKENESS + 1)) + "_ids binary"
FREQUENCIES = -1  # the ``_n`` of a row whose ids are a task's document frequencies


def _tokenized(batches: Iterator[pa.RecordBatch], path: str, end_id: int, words: int) -> Iterator[pa.RecordBatch]:
    tok = Tokens.at(path)
    tok.most_words = words
    vocab = max(tok.size_of_vocab, end_id + 1)
    ranks = np.stack([np.random.default_rng(k).permutation(vocab).astype(np.int32) for k in range(LIKENESS)])
    df, names = np.zeros(vocab, dtype="<u8"), ["_id", "_h", "_n", *[f"_m{k + 1}" for k in range(LIKENESS)], "_ids"]
    types = [pa.int64()] * 3 + [pa.int32()] * LIKENESS + [pa.binary()]
    for b in batches:
        for at, texts in _slices(b.column("_text")):
            ids = list(tok.encode(texts, end_id))
            for x in ids:
                df[np.unique(x)] += 1
            flat, first = np.concatenate(ids), np.cumsum([0, *[len(x) for x in ids[:-1]]])
            least = np.stack([np.minimum.reduceat(r[flat], first) for r in ranks], axis=1)
            yield pa.RecordBatch.from_arrays([
                b.column("_id").slice(at, len(ids)), b.column("_h").slice(at, len(ids)), pa.array([len(x) for x in ids], pa.int64()),
                *[pa.array(least[:, k]) for k in range(LIKENESS)], pa.array([x.tobytes() for x in ids], pa.binary())], names=names)
    pa.default_memory_pool().release_unused()  # the worker lives on beside those of other stages
    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([None, 0, FREQUENCIES, *[0] * LIKENESS, df.tobytes()], types)], names=names)


def _added_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for raw in b.column("_ids"):
            df = np.frombuffer(raw.as_py(), dtype="<u8")
            total = df if total is None else total + df
    if total is not None:
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["_t", "_df"])


class Bm25:
    """An inverted index of one shard. ``idf``: the corpus's, by token id;
    ``mean``: the corpus's mean length. Terms of weight 0 (those in over half
    of all documents) are left out."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75) -> None:
        self.n = len(docs)
        sizes = np.array([len(d) for d in docs], dtype=np.float64)
        kinds = [np.unique(d, return_counts=True) for d in docs]
        doc = np.repeat(np.arange(self.n), [len(t) for t, _ in kinds])
        term = np.concatenate([t for t, _ in kinds]).astype(np.int64)
        tf = np.concatenate([c for _, c in kinds]).astype(np.float64)
        order = np.argsort(term, kind="stable")
        self.terms, self.first, df = np.unique(term[order], return_index=True, return_counts=True)
        self.last = self.first + df
        self.doc, tf = doc[order], tf[order]
        norm = k1 * (1 - b + b * sizes / max(1.0, mean))
        self.weight = np.repeat(idf[self.terms], df) * tf * (k1 + 1) / (tf + norm[self.doc])
        self.useful = idf[self.terms] > 0
        self.kinds = [t for t, _ in kinds]

    def scores(self, d: int) -> np.ndarray:
        at = np.searchsorted(self.terms, self.kinds[d].astype(np.int64))
        at = at[self.useful[at]]
        spans = [slice(a, z) for a, z in zip(self.first[at].tolist(), self.last[at].tolist())]
        if not spans:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.doc[s] for s in spans]),
                           weights=np.concatenate([self.weight[s] for s in spans]), minlength=self.n)


def pack(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length)."""
    index = Bm25(docs, idf, mean)
    free = np.ones(len(docs), dtype=bool)
    at, nxt, seq, room = 0, 0, [], window
    current, ranked, seed = None, None, None
    while True:
        if current is None:  # the next document of this window
            if not seq:
                while nxt < len(docs) and not free[nxt]:
                    nxt += 1
                if nxt == len(docs):
                    break
                seed, ranked, current = nxt, None, nxt
            else:
                if ranked is None:
                    near = index.scores(seed)
                    near[~free] = -1
                    ranked = iter(np.argsort(-near, kind="stable").tolist())
                current = next((d for d in ranked if free[d]), None)
                if current is None:
                    break
            free[current], at = False, 0
        take = min(room, len(docs[current]) - at)
        seq.append((current, at, take))
        at, room = at + take, room - take
        done = at == len(docs[current])
        if not room:
            yield seq
            seq, room, seed, ranked = [], window, current, None
        if done:
            current = None
    while seq:  # the last window, not full: powers of two
        size = 1 << ((window - room).bit_length() - 1)
        out, left = [], size
        while left:
            d, a, n = seq[0]
            take = min(n, left)
            out.append((d, a, take))
            left -= take
            seq = seq[1:] if take == n else [(d, a + take, n - take), *seq[1:]]
        room += size
        yield out


PIECES = "_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([("_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def _packed(batches: Iterator[pa.RecordBatch], width: int, idf: np.ndarray, mean: float, window: int,
            shard_tokens: int) -> Iterator[pa.RecordBatch]:
    dtype = np.uint16 if width == 2 else np.uint32
    shard, ids, docs, size, number = None, [], [], 0, 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal number
        rows, held = [], 0
        for seq in pack(docs, idf, mean, window):
            offset = 0
            for d, a, n in seq:
                rows.append((ids[d], a, n, len(docs[d]), (shard << 32) + number, offset,
                             docs[d][a:a + n].astype("<u4").tobytes()))
                offset += n
            held += offset
            number += 1
            if held > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

    for b in batches:
        for s, i, raw in zip(b.column("_shard").to_pylist(), b.column("_id").to_pylist(), b.column("_ids"), strict=True):
            if docs and (s != shard or size >= shard_tokens):
                yield from flush()
                ids, docs, size, number = [], [], 0, number if s == shard else 0
            shard = s
            ids.append(i)
            docs.append(np.frombuffer(raw.as_py(), dtype=dtype))
            size += len(docs[-1])
    if docs:
        yield from flush()


def vocab_width(path: str) -> int:
    return np.dtype(Tokens.at(path).dtype).itemsize


def _cells(docs: DataFrame, most: int) -> DataFrame:
    """``docs`` with ``_cell``: documents of like least tokens, at most about
    ``most`` tokens of them. A heavier group parts by its next least token, one
    that is heavy under all by document, and rows that repeat by row."""
    least = [F.col(f"_m{k}") for k in range(1, LIKENESS + 1)]
    paths = [F.xxhash64(F.lit(k), *least[:k]) for k in range(1, LIKENESS + 1)] + [F.xxhash64(F.lit(0), *least, F.col("_h"))]
    size = docs.select(F.col("_n"), F.explode(F.array(*paths)).alias("_p")).groupBy("_p").agg(F.sum("_n").alias("_w"))
    # at most LIKENESS + 1 times tokens / most rows; as a table its size is known, and Spark broadcasts it while it is small
    heavy = saved(size.where(F.col("_w") > most), "heavy")
    out, cell = docs, None
    for k, path in reversed(list(enumerate(paths, 1))):
        out = out.join(heavy.select(F.col("_p").alias(f"_p{k}"), F.ceil(F.col("_w") / most).alias(f"_w{k}")), path == F.col(f"_p{k}"), "left")
        inner = F.xxhash64(path, F.pmod(F.xxhash64("_row"), F.col(f"_w{k}"))) if cell is None else cell
        cell = F.when(F.col(f"_p{k}").isNull(), path).otherwise(inner)
    return out.select("_id", "_h", "_row", "_ids", cell.alias("_cell"))


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
                   window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Pieces of all documents: the id column, start, length, doc_tokens (with
    ``end_id``), sequence_id, offset, and ids (little-endian unsigned 32-bit).

    ``path``: the tokenizer's file, on every executor; ids are the library's
    own, strings of special tokens included. ``cache_words`` bounds the table
    of words that each Python worker keeps (about 200 bytes each). Document
    frequencies and the mean length are the corpus's; a shard holds about
    ``shard_tokens``, documents alike in their tokens first of all. Null and
    empty texts are documents of ``end_id`` alone. Rows that repeat, in id or
    in whole, are documents of their own; a text of any length is packed whole,
    over as many windows as it takes; other columns are not read. An empty
    table gives an empty table. Reruns on the same files agree."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_h", F.xxhash64("_id", "_text"))
    ids = rows.mapInArrow(lambda b: _tokenized(b, path, end_id, cache_words), TOKENISED)
    ids = saved(ids.withColumn("_row", F.monotonically_increasing_id()), "tokens")
    df = ids.where(F.col("_n") == FREQUENCIES).select("_ids").mapInArrow(_added_frequencies, "_t long, _df long")
    df = {r._t: r._df for r in df.groupBy("_t").agg(F.sum("_df").alias("_df")).collect()}  # a row for each token of the vocabulary
    ids = ids.where("_n >= 0")
    n, total = ids.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    idf = np.zeros(max(df, default=0) + 1)
    for t, c in df.items():
        idf[t] = max(0.0, np.log((n - c + 0.5) / (c + 0.5)))
    shards, width, mean = max(1, -(-total // shard_tokens)), vocab_width(path), total / max(1, n)
    dealt = _cells(ids, shard_tokens).withColumn("_shard", F.pmod(F.xxhash64("_cell"), F.lit(shards)))
    dealt = dealt.repartition(shards, "_shard").sortWithinPartitions("_shard", "_cell", "_h", "_row").select("_shard", "_id", "_ids")
    held = docs.sparkSession.sparkContext.broadcast(idf)  # a number for each token of the vocabulary
    out = dealt.mapInArrow(lambda b: _packed(b, width, held.value, mean, window, shard_tokens), PIECES)
    return out.withColumnRenamed("_id", id_col)
