"""Fixed-length token-id encoding with attention masks, over white-space
tokens and hashed ids (SQL only) or the subwords of a public vocabulary."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import list_array, text_parts

WS_SPLIT = r"[\t\n\x{0B}\f\r ]+"
PAD = 0


WS_EDGES = r"^[\t\n\x{0B}\f\r ]+|[\t\n\x{0B}\f\r ]+$"


def tokens(text) -> F.Column:
    """Whitespace tokens. The text is trimmed first, so ``split`` yields no
    empty tokens and no (interpreted) higher-order filter is needed."""
    t = F.col(text) if isinstance(text, str) else text
    trimmed = F.regexp_replace(t, WS_EDGES, "")
    empty = F.array().cast("array<string>")
    return F.when(t.isNull() | (trimmed == ""), empty).otherwise(F.split(trimmed, WS_SPLIT))


def token_id(token) -> F.Column:
    """A stable id for every token: 60 bits of its md5, from 2 on (0 is padding,
    1 is kept free for an unknown token). No vocabulary has to be counted,
    joined or cut off, and other engines compute the same ids."""
    return F.conv(F.substring(F.md5(token), 1, 15), 16, 10).cast("long") + 2


def encode_batch(df: DataFrame, key: str, text: str = "text", max_len: int = 512, overflow: bool = True,
                 labels: Sequence[str] = ()) -> DataFrame:
    """Token ids in windows of ``max_len``, padded, with the attention mask and
    the ``labels`` columns. The whole text is encoded: consecutive windows are
    rows with ``chunk`` 0, 1, ... ``overflow=False`` is the reference's
    truncation to the first window. Row by row, no shuffle; ``key`` may repeat."""
    toks = df.select(key, *labels, tokens(text).alias("_toks"))
    return _windows(toks, key, max_len, overflow, labels, PAD, token_id)


def _windows(toks: DataFrame, key: str, max_len: int, overflow: bool, labels: Sequence[str], pad: int, to_id=None,
             first: int | None = None, last_id: int | None = None) -> DataFrame:
    """Windows of ``_toks``: each with ``first`` before and ``last_id`` after its
    tokens where given, padded to ``max_len``."""
    toks = toks.withColumn("n_tokens", F.size("_toks"))
    room = max_len - (first is not None) - (last_id is not None)
    if overflow:
        last = F.greatest(F.ceil(F.col("n_tokens") / room) - 1, F.lit(0)).cast("int")
        toks = toks.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    else:
        toks = toks.withColumn("chunk", F.lit(0))
    ids = F.slice("_toks", F.col("chunk") * room + 1, F.lit(room))
    ids = F.transform(ids, to_id) if to_id else ids
    ends = [F.array(F.lit(x).cast("long")) if x is not None else None for x in (first, last_id)]
    if any(e is not None for e in ends):
        ids = F.concat(*[x for x in (ends[0], ids, ends[1]) if x is not None])
    toks = toks.withColumn("_ids", ids)
    more = F.lit(max_len) - F.size("_ids")
    mask = F.concat(F.array_repeat(F.lit(1), F.size("_ids")), F.array_repeat(F.lit(0), more))
    return toks.select(key, *(["chunk"] if overflow else []), "n_tokens",
                       F.concat("_ids", F.array_repeat(F.lit(pad).cast("long"), more)).alias("input_ids"),
                       mask.alias("attention_mask"), *labels)


_OPEN: dict[str, object] = {}


def _tokenizer(path: str):
    """One tokenizer for each Python worker and file."""
    if path not in _OPEN:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        _OPEN[path] = Tokenizer.from_file(path)
    return _OPEN[path]


def subword_ids(text, path: str):
    """A column with the subword ids of a whole text, by the vocabulary file at
    ``path`` (which every executor can read), without special tokens."""
    @F.arrow_udf("array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for some in text_parts(texts):
                found = _tokenizer(path).encode_batch_fast([t or "" for t in some], add_special_tokens=False)
                ids = [np.array(e.ids, dtype=np.int64) for e in found]
                yield list_array([len(x) for x in ids], pa.array(np.concatenate(ids)))

    return run(F.col(text) if isinstance(text, str) else text)


def encode_subwords(df: DataFrame, key: str, path: str, text: str = "text", max_len: int = 512, overflow: bool = True,
                    labels: Sequence[str] = (), first: int | None = None, last: int | None = None, pad: int = PAD) -> DataFrame:
    """T12 with a public subword vocabulary: as :func:`encode_batch`, by the
    tokenizer file at ``path`` (a file of the ``tokenizers`` library; nothing is
    trained here). ``first`` and ``last``: ids that open and close every window,
    within ``max_len``. The whole text is encoded; ``overflow=False`` is the
    reference's truncation. Null and empty texts give one window of padding and
    the ids that open and close it. Row by row; ``key`` may repeat."""
    if max_len <= (first is not None) + (last is not None):
        raise ValueError("max_len leaves no room for tokens")
    toks = df.select(key, *labels, subword_ids(text, path).alias("_toks"))
    return _windows(toks, key, max_len, overflow, labels, pad, None, first, last)
