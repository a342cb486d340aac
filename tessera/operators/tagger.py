"""A trained entity recogniser: a sequence tagger over tokens.

Tags are O, B-label and I-label. The score of a tag sequence is the sum of the
log-odds of each token under its tag (emission) and of each tag after the tag
and the token before it (transition): the token before, the *cue*, tells names
apart that no list holds. Both are counts, made by grouping the tokens of all
annotated texts; rare tokens count by their shape. Texts are tagged with the
best sequence (Viterbi), line by line, in Arrow batches on the executors.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import text_parts
from ..functions.text import slices
from ..session import ensure_checkpoint_dir
from .entities import SPAN_DATATYPE

TOKEN = r"[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]+|[\n!-/:-@\[-`{-~]"
_TOKEN = re.compile("[A-Za-z\x80-\U0010ffff]+|[0-9]+|[\n!-/:-@\\[-`{-~]")
BREAK = "\n"  # lines are sequences of their own: what comes before the first token
VOCAB = 20_000
MIN_COUNT = 5
BACKOFF = 4  # weight, in tokens, of the transitions without their cue
TOKENS_AT_ONCE = 500_000
PART_BYTES = 4 << 20  # text that is tagged at once
KEPT_TOKENS = 200_000  # distinct tokens whose codes a worker keeps
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("text", pa.string())]))

# A token's observation: digits by their number, punctuation as it is, letters by their case (ASCII).
SHAPES = [("^[0-9]{1,2}$", "<d>"), ("^[0-9]{3,4}$", "<dd>"), ("^[0-9]+$", "<ddd>"), ("^[A-Z]$", "<X>"), ("^[A-Z]+$", "<XX>"),
          ("^[A-Z][^A-Z]+$", "<Xx>"), ("[A-Z]", "<xX>")]
_SHAPES = [(re.compile(p), s) for p, s in SHAPES]
ENDS = (".", "!", "?", ":", BREAK)  # after these a capital tells little: such shapes are observations of their own
OPENING = {"<Xx>": "<^Xx>", "<X>": "<^X>"}


def shape(token: Column) -> Column:
    out = F.when(token.rlike("^[\n!-/:-@\\[-`{-~]$"), token)
    for p, s in SHAPES:
        out = out.when(token.rlike(p), s)
    return out.otherwise("<x>")


def _shape(token: str) -> str:
    if len(token) == 1 and not token.isalnum() and token < "\x80":
        return token
    return next((s for p, s in _SHAPES if p.search(token)), "<x>")


def tagged(text: Column, spans: Column) -> Column:
    """struct<tokens, tags>, two arrays of one length. Of overlapping spans the
    one that starts first counts (then the shorter); a token is cut where a
    span begins or ends."""
    asc = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("stop"), s["label"].alias("label"))))
    empty = F.array().cast("array<struct<start:int,stop:int,label:string>>")
    apart = F.aggregate(asc, empty, lambda acc, s: F.when(
        (s["stop"] > s["start"]) & ((F.size(acc) == 0) | (s["start"] >= F.element_at(acc, -1)["stop"])),
        F.concat(acc, F.array(s))).otherwise(acc))

    def cut(kept: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(kept, lambda s: s["stop"]))
        gaps = F.zip_with(starts, F.concat(F.transform(kept, lambda s: s["start"]), F.array(F.length(text))), lambda a, z: F.struct(
            a.alias("start"), z.alias("stop"), F.lit(None).cast("string").alias("label")))
        ranges = F.flatten(F.zip_with(gaps, kept, lambda g, s: F.when(s.isNull(), F.array(g)).otherwise(F.array(g, s))))
        return F.zip_with(slices(text, ranges), ranges, lambda x, r: F.struct(
            F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0)).alias("tokens"), r["label"].alias("label")))

    def label(part: Column) -> Column:
        n, name = F.size(part["tokens"]), part["label"]
        inside = F.concat(F.array(F.concat(F.lit("B-"), name)), F.array_repeat(F.concat(F.lit("I-"), name), n - 1))
        return F.when(name.isNull(), F.array_repeat(F.lit("O"), n)).when(n > 0, inside).otherwise(F.array().cast("array<string>"))

    def both(parts: Column) -> Column:
        return F.struct(F.flatten(F.transform(parts, lambda p: p["tokens"])).alias("tokens"), F.flatten(F.transform(parts, label)).alias("tags"))

    return F.transform(F.transform(F.array(F.coalesce(apart, empty)), cut), both)[0]


def tag_counts(df: DataFrame, text: str = "text", spans: str = "spans", vocab: int = VOCAB,
               min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(emission, transition): ``(tag, obs, n)`` and ``(prev, cue, tag, n)``
    over all rows. Tokens that occur ``min_count`` times, the ``vocab`` most
    frequent of them at most (ties by token), are observations of their own;
    the others count by shape. Null texts have no tokens, null spans none.

    Two passes: words are counted, then tags, cues and observations."""
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.select(tagged(F.coalesce(F.col(text), F.lit("")), F.col(spans)).alias("_s"))
    # the outer forms, then a test: inner ones would tokenise in filters as well
    words = rows.select(F.explode_outer("_s.tokens").alias("_t")).where(F.col("_t").rlike("^[A-Za-z0-9\\x{80}-\\x{10FFFF}]")).groupBy("_t").agg(F.count(F.lit(1)).alias("n"))
    words = words.where(F.col("n") >= min_count).orderBy(F.desc("n"), "_t").limit(vocab)
    known = words.select(F.col("_t").alias("_w")).checkpoint()  # at most ``vocab`` words
    at = rows.select("_s.tokens", "_s.tags", F.posexplode_outer("_s.tokens").alias("_i", "_t")).where("_i IS NOT NULL")
    opens, before = F.col("_i") == 0, F.col("_i") - 1
    at = at.select("_t", F.get("tags", F.col("_i")).alias("tag"),
                   F.when(opens, BREAK).otherwise(F.get("tokens", before)).alias("_pt"),
                   F.when(opens, "O").otherwise(F.get("tags", before)).alias("prev"))
    for token, out in (("_t", "_w1"), ("_pt", "_w2")):
        at = at.join(F.broadcast(known.withColumnRenamed("_w", out)), F.col(token) == F.col(out), "left")
    own = shape(F.col("_t"))
    opening = F.when(F.col("_pt").isin(*ENDS) & own.isin(*OPENING), F.concat(F.lit("<^"), F.substring(own, 2, 9))).otherwise(own)
    at = at.select("tag", "prev", F.coalesce("_w1", opening).alias("obs"), F.coalesce("_w2", shape(F.col("_pt"))).alias("cue"))
    # one pass for both tables: each token counts once in either
    none = F.lit(None).cast("string")
    kinds = F.inline(F.array(F.struct(F.col("tag"), F.col("obs"), none.alias("prev"), none.alias("cue")),
                             F.struct(F.col("tag"), none.alias("obs"), F.col("prev"), F.col("cue"))))
    both = at.select(kinds).groupBy("tag", "obs", "prev", "cue").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    return both.where("obs IS NOT NULL").select("tag", "obs", "n"), both.where("obs IS NULL").select("prev", "cue", "tag", "n")


class _Kept(dict):
    """Results of a function, kept."""

    def __init__(self, of: Callable[[str], int]) -> None:
        self.of = of

    def __missing__(self, token: str) -> int:
        self[token] = n = self.of(token)
        return n


class Tagger:
    """Scores made from the counts. They hold at most ``vocab`` words and the
    shapes, so their size has a bound; executors get them as a broadcast."""

    def __init__(self, emission: list[tuple], transition: list[tuple]) -> None:
        seen = {t for t, _, _ in emission}
        labels = sorted({t[2:] for t in seen if t != "O"})
        self.tags = ["O", *[f"{x}-{lab}" for lab in labels for x in "BI"]]
        self.obs = {o: i for i, o in enumerate(sorted({o for _, o, _ in emission} | {c for _, c, _, _ in transition} | {BREAK}))}
        k, v, at = len(self.tags), len(self.obs) + 1, {t: i for i, t in enumerate(self.tags)}  # the last: never seen
        count = np.zeros((v, k))
        for t, o, n in emission:
            count[self.obs[o], at[t]] = n
        self.emit = self._log((10 * count + 1) / (10 * count.sum(axis=0) + v))
        cued = np.zeros((v, k, k))
        for p, c, t, n in transition:
            cued[self.obs[c], at[p], at[t]] = n
        plain = cued.sum(axis=0)
        plain = (10 * plain + 1) / (10 * plain.sum(axis=1, keepdims=True) + k)
        self.move = self._log((cued + BACKOFF * plain) / (cued.sum(axis=2, keepdims=True) + BACKOFF))
        for i, t in enumerate(self.tags):
            if t[0] == "I":  # only after its own B or I
                others = [j for j, p in enumerate(self.tags) if p[1:] != t[1:]]
                self.move[:, others, i] = -10**9

    @staticmethod
    def _log(p: np.ndarray) -> np.ndarray:
        """Thousandths of natural logarithms, as integers: sums have no order."""
        return np.array([math.floor(1000 * math.log(x)) for x in p.ravel().tolist()], dtype=np.int64).reshape(p.shape)

    def _code(self, token: str) -> int:
        """What a token is as a cue, as an observation where a sentence opens,
        whether the next one opens, and whether it is a line break; in one number."""
        kind = token if token in self.obs else _shape(token)
        cue = self.obs.get(kind, len(self.obs))
        return cue << 32 | self.obs.get(OPENING.get(kind, kind), len(self.obs)) << 2 | (token in ENDS) << 1 | (token == BREAK)

    def codes(self, tokens: list[str]) -> np.ndarray:
        """:meth:`_code` of each token; those of tokens met before are kept."""
        kept = self.__dict__.setdefault("_kept", _Kept(self._code))
        if len(kept) > KEPT_TOKENS:
            kept.clear()
        return np.fromiter(map(kept.__getitem__, tokens), dtype=np.int64, count=len(tokens))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_kept"}

    def observe(self, tokens: list[str], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's observation and what it is as a cue; ``first`` marks
        the tokens that begin a line."""
        return self._observe(self.codes(tokens), first)

    @staticmethod
    def _observe(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        opens = first.copy()
        opens[1:] |= (codes[:-1] & 2).astype(bool)
        cue = codes >> 32
        return np.where(opens, (codes & 0xFFFFFFFF) >> 2, cue), cue

    def best(self, obs: np.ndarray, cue: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The best tags of lines that stand one after another in ``obs``; of
        equal sequences the one whose last tags come first. All lines go
        forward together, longest first."""
        order = np.argsort(-sizes, kind="stable")
        size, start = sizes[order], (np.cumsum(sizes) - sizes)[order]
        out = np.zeros(len(obs), dtype=np.int64)
        if not len(size) or not size[0]:
            return out
        active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # lines longer than t
        score = self.move[self.obs[BREAK], 0] + self.emit[obs[start[:active[0]]]]
        back = []
        for t in range(1, int(size[0])):
            m = active[t]
            way = np.take(self.move, cue[start[:m] + t - 1], axis=0)
            way += score[:m, :, None]
            back.append(way.argmax(axis=1).astype(np.uint8 if len(self.tags) < 256 else np.int32))
            score[:m] = way.max(axis=1) + self.emit[obs[start[:m] + t]]
        tag = score.argmax(axis=1)
        for t in range(int(size[0]) - 1, -1, -1):
            m = active[t]
            out[start[:m] + t] = tag[:m]
            if t:
                tag[:m] = back[t - 1][np.arange(m), tag[:m]]
        return out

    def spans(self, texts: list[str | None]) -> list[list[dict]]:
        found, part, held = [], [], 0
        for text in texts:
            part.append((text or "", _TOKEN.findall(text or "")))
            held += len(part[-1][1])
            if held >= TOKENS_AT_ONCE:
                found += self._spans(part)
                part, held = [], 0
        return found + self._spans(part)

    def _spans(self, texts: list[tuple[str, list[str]]]) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in texts]
        codes = self.codes([t for _, tokens in texts for t in tokens])
        of_text = np.repeat(np.arange(len(texts)), [len(tokens) for _, tokens in texts])
        breaks = (codes & 1).astype(bool)
        line = of_text + np.cumsum(breaks)  # a text's last line and each break end one
        at = np.flatnonzero(~breaks)
        size = np.bincount(line[at], minlength=len(texts) + int(breaks.sum()))
        start = np.cumsum(size) - size
        first = np.zeros(len(at) + 1, dtype=bool)
        first[start] = True
        tags = self.best(*self._observe(codes[at], first[:-1]), size)
        begins = np.concatenate([[0], np.cumsum(np.bincount(of_text[breaks], minlength=len(texts)) + 1)])  # each text's first line
        lines: list[str] = []
        last = -1
        for k in np.unique(line[at][tags > 0]).tolist():
            i = int(np.searchsorted(begins, k, side="right")) - 1
            if i != last:
                last, lines = i, texts[i][0].split(BREAK)
                places = np.cumsum([0, *(len(x) + 1 for x in lines)]).tolist()
            own, place = lines[k - int(begins[i])], places[k - int(begins[i])]
            for m, t in zip(_TOKEN.finditer(own), tags[start[k]:start[k] + size[k]].tolist()):
                tag = self.tags[t]
                if tag[0] == "B":
                    out[i].append({"start": place + m.start(), "end": place + m.end(), "label": tag[2:]})
                elif tag[0] == "I":
                    out[i][-1]["end"] = place + m.end()
        for (text, _), some in zip(texts, out):
            for s in some:
                s["text"] = text[s["start"]:s["end"]]
        return out


def fit_tagger(df: DataFrame, text: str = "text", spans: str = "spans", vocab: int = VOCAB, min_count: int = MIN_COUNT) -> Tagger:
    """A tagger from texts with annotated spans (0-based code points, end
    exclusive, as :func:`entities.detect_entities` gives them). Counts cover
    all rows; the count tables, bounded by ``vocab`` words and the tags, come
    to the driver. Without annotations everything is O."""
    emission, transition = tag_counts(df, text, spans, vocab, min_count)
    return Tagger([tuple(r) for r in emission.select("tag", "obs", "n").collect()],
                  [tuple(r) for r in transition.select("prev", "cue", "tag", "n").collect()])


def tag_entities(df: DataFrame, model: Tagger, text: str = "text", out: str = "spans") -> DataFrame:
    """``df`` with a spans column by ``model``: whole texts, row by row. Null
    and empty texts have no spans."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(SPAN_DATATYPE)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for some in text_parts(texts, PART_BYTES):
                yield pa.array(held.value.spans(some), _SPANS)

    return df.withColumn(out, run(F.col(text)))


def span_report(df: DataFrame, gold: str = "gold", found: str = "spans", seen: DataFrame | None = None) -> DataFrame:
    """Precision, recall and F1 per label, exact spans. ``seen`` (column
    ``text``): entity texts of the training rows; then ``n_new`` and
    ``recall_new`` count the gold spans whose text is not among them."""
    rows = df.select(F.monotonically_increasing_id().alias("_r"), gold, found)

    def long(c: str, flag: str) -> DataFrame:
        return rows.select("_r", F.explode(c).alias("_s")).select("_r", "_s.start", "_s.end", "_s.label", "_s.text", F.lit(1).alias(flag)) \
            .dropDuplicates(["_r", "start", "end", "label"])

    both = long(gold, "_g").join(long(found, "_f").drop("text"), ["_r", "start", "end", "label"], "full")
    new = F.lit(None).cast("int")
    if seen is not None:
        both = both.join(seen.select("text").distinct().withColumn("_seen", F.lit(1)), "text", "left")
        new = (F.col("_g").isNotNull() & F.col("_seen").isNull()).cast("int")
    both = both.withColumn("_new", new).withColumn("_hit", (F.col("_g").isNotNull() & F.col("_f").isNotNull()).cast("int"))
    n = both.groupBy("label").agg(F.count("_g").alias("n_gold"), F.count("_f").alias("n_found"), F.sum("_hit").alias("n_right"),
                                  F.sum("_new").alias("n_new"), F.sum(F.col("_new") * F.col("_hit")).alias("_right_new"))

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b)

    right = F.col("n_right")
    return n.select("label", "n_gold", "n_found", "n_right", share(right, F.col("n_found")).alias("precision"),
                    share(right, F.col("n_gold")).alias("recall"), share(2 * right, F.col("n_gold") + F.col("n_found")).alias("f1"),
                    "n_new", share(F.col("_right_new"), F.col("n_new")).alias("recall_new"))
