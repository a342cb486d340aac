"""Benchmark decontamination: documents against the n-grams of test items.

The items' windows of normalised words are a hash set that every executor
holds; each window of a document looks its hash up there, and a hit counts once
the words themselves agree. Hits are merged into spans of words, which can be
cut out of the texts, or their documents dropped. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, key_id, saved

SIZE = 10
BLOCK_BYTES = 48 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased texts
_PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*+[0-9A-Za-z\x{80}-\x{10FFFF}]++"


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all beyond ASCII, with A-Z in
    lower case. Null has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lower, _BETWEEN), "")


def item_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(_item, _l, _gram): the windows of each item, ``_l`` words long. Shorter
    items are one window; items without words have none."""
    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("_item"), words(F.col(text_col)).alias("_w"))
    rows = rows.where(F.size("_w") > 0).withColumn("_l", F.least(F.size("_w"), F.lit(size)))
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.size("_w") - F.col("_l") + 1)))
    return rows.select("_item", "_l", F.slice("_w", F.col("_i"), F.col("_l")).alias("_gram")).distinct()


def row_key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Columns that tell documents apart: the id and 96 bits of the text's hash."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return [key_id(id_col).alias("_k"), F.xxhash64(t).alias("_k1"), F.hash(t).alias("_k2")]


KEY = ["_k", "_k1", "_k2"]


def _blocks(grams: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The windows in blocks small enough for a broadcast each, by hash."""
    total = grams.agg(F.sum(F.length(F.array_join("_gram", " ")) * 2 + 96)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    return [grams if n == 1 else grams.where(F.pmod("_h", F.lit(n)) == k) for k in range(n)]


def hits(docs: DataFrame, grams: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(_k, _k1, _k2, _n, _i, _l, _g): a row with ``_i`` 0 for every document,
    and one for each place ``_i`` (from 1) where a window of ``_l`` words
    stands. Larger window sets are searched block by block."""
    sizes = sorted(r[0] for r in grams.select("_l").distinct().collect())  # at most ``size`` numbers
    rows = docs.select(*row_key(docs, id_col, text_col), words(F.col(text_col)).alias("_w")).withColumn("_n", F.size("_w"))
    if not sizes:
        none = [F.lit(None).cast("int").alias("_l"), F.lit(None).cast("long").alias("_g")]
        return rows.select(*KEY, "_n", F.lit(0).alias("_i"), *none)
    found = None
    for k, block in enumerate(_blocks(grams, block_bytes)):
        at = (rows if k == 0 else rows.where("_n > 0")).withColumn("_i", F.explode(F.sequence(F.lit(int(k > 0)), F.col("_n"))))
        at = at.withColumn("_s", F.lit(sizes[0]) if len(sizes) == 1 else F.explode(F.array(*map(F.lit, sizes))))
        fits = (F.col("_i") > 0) & (F.col("_i") + F.col("_s") - 1 <= F.col("_n"))
        here = F.slice("_w", F.greatest(F.col("_i"), F.lit(1)), F.col("_s"))
        at = at.withColumn("_x", F.when(fits, F.xxhash64(here)))
        got = at.join(F.broadcast(block), F.col("_x") == F.col("_h"), "left")
        verified = (F.col("_s") == F.col("_l")) & (here == F.col("_gram"))  # after the look-up, whose key is one long
        got = got.where(((F.col("_i") == 0) & (F.col("_s") == sizes[0])) | (F.col("_g").isNotNull() & verified))
        got = got.select(*KEY, "_n", "_i", "_l", "_g")
        found = got if found is None else found.unionByName(got)
    return found


def spans(found: DataFrame) -> DataFrame:
    """(_k, _k1, _k2, n_hit, spans): per document with hits, the words hit and
    the merged spans [start, stop) of word numbers from 0, in order."""
    at = found.where("_i > 0").groupBy(*KEY, "_i").agg(F.max("_l").alias("_l"))
    over = Window.partitionBy(*KEY).orderBy("_i")
    before = F.max(F.col("_i") + F.col("_l")).over(over.rowsBetween(Window.unboundedPreceding, -1))
    at = at.withColumn("_new", F.coalesce(F.col("_i") > before, F.lit(True)).cast("int"))
    at = at.withColumn("_s", F.sum("_new").over(over))
    one = at.groupBy(*KEY, "_s").agg((F.min("_i") - 1).alias("start"), (F.max(F.col("_i") + F.col("_l")) - 1).alias("stop"))
    return one.groupBy(*KEY).agg(F.sum(F.col("stop") - F.col("start")).cast("long").alias("n_hit"),
                                 F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def items_of(found: DataFrame, grams: DataFrame, windows: DataFrame) -> DataFrame:
    """(_k, _k1, _k2, items): the items with occurring windows, sorted as
    strings. Documents with the same set of windows share one look-up, so that
    a window of many documents and many items is paired once, not per document."""
    sets = found.where("_i > 0").groupBy(*KEY).agg(F.array_sort(F.collect_set("_g")).alias("_gs"))
    sets = sets.withColumn("_set", F.sha2(F.array_join("_gs", ","), 256))
    owners = windows.join(grams, ["_l", "_gram"]).select("_g", "_item")
    kinds = sets.groupBy("_set").agg(F.first("_gs").alias("_gs"))
    kinds = kinds.select("_set", F.explode("_gs").alias("_g")).join(owners, "_g").select("_set", "_item").distinct()
    kinds = kinds.groupBy("_set").agg(F.array_sort(F.collect_list("_item")).alias("items"))
    return sets.drop("_gs").join(kinds, "_set").drop("_set")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", size: int = SIZE,
                  block_bytes: int = BLOCK_BYTES, keyed: bool = False) -> DataFrame:
    """One row per document: the id, n_words, n_hit, spans (of word numbers,
    [start, stop)), items (ids as strings, sorted) and contaminated.

    The windows held by each executor are at most ``block_bytes``; more are
    searched in several passes. Null and empty texts have no words and no hits;
    a null item id is listed as ``null``, and items that share an id are one
    item. Rows that repeat an id and a text each get a row; texts of any length
    are scanned whole; an empty table of documents gives an empty table, one of
    items leaves everything clean. Other columns are not read. ``keyed`` adds
    the key columns by which :func:`remove_spans` finds the rows again."""
    windows = saved(item_windows(items, item_col, item_text, size), "windows")
    grams = windows.select("_l", "_gram").distinct().withColumn("_h", F.xxhash64("_gram"))
    grams = saved(grams.withColumn("_g", F.monotonically_increasing_id()), "grams")
    found = saved(hits(docs, grams, id_col, text_col, block_bytes), "hits")
    per = spans(found).join(items_of(found, grams, windows), KEY)
    none = F.array().cast("array<struct<start:int,stop:int>>")
    out = found.where("_i = 0").join(per, KEY, "left")
    return out.select(
        *(KEY if keyed else []), F.nullif("_k", F.lit(NO_ID)).alias(id_col), F.col("_n").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("spans", none).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def _without(text: Column, gone: Column) -> Column:
    """``text`` without the words of the spans and what stands before each."""
    def rest(pieces: Column) -> Column:
        stops = F.concat(F.transform(gone, lambda s: s["start"]), F.array(F.size(pieces)))
        starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda s: s["stop"]))
        kept = F.zip_with(starts, stops, lambda a, z: F.array_join(F.slice(pieces, a + 1, z - a), ""))
        tail = F.substring(text, F.length(F.array_join(pieces, "")) + 1, F.lit(2147483647))
        return F.concat(F.array_join(kept, ""), tail)

    # bound to a variable, so that the text is cut into words once and not for each span
    return F.transform(F.array(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))), rest)[0]


def _judged(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, **kw) -> DataFrame:
    """Each row as the struct ``_row``, with n_words, n_hit and spans."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *row_key(docs, id_col, text_col))
    found = contamination(docs, items, id_col, text_col, keyed=True, **kw).where("contaminated")
    # rows that repeat share a key; the hashes decide alike for all of them
    found = found.dropDuplicates(KEY).select(*KEY, "n_words", "n_hit", "spans")
    return rows.join(found, KEY, "left")


def remove_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with the hit words cut out of the texts; clean rows unchanged.
    A document may end up empty. See :func:`contamination`."""
    rows = _judged(docs, items, id_col, text_col, **kw)
    text = F.col("_row")[text_col]
    new = F.when(F.col("spans").isNull(), text).otherwise(_without(text, F.col("spans")))
    return rows.select(*[(new if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns])


def remove_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     most: float = 0.0, **kw) -> DataFrame:
    """The rows of ``docs`` of whose words a share of at most ``most`` is hit."""
    rows = _judged(docs, items, id_col, text_col, **kw)
    keep = rows.where(F.col("n_hit").isNull() | (F.col("n_hit") <= most * F.col("n_words")))
    return keep.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
