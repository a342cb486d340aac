"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions.

The symbols of a line are its words. Two different lines are near when one
edit (a word put in, left out or exchanged) turns one into the other. A line
of n words emits its neighbourhood as hashed keys (length, place, hash of the
words before, hash of the words after): one key for each word left out, and
one for each gap, where a line one word longer meets it. All lines under a key
are within one edit of one another, so each but the earliest links with the
earliest alone, and no pairs are made.

Most lines have no partner, and need not emit: an edit leaves the first or the
last half of a line as it is, so lines whose halves occur nowhere else are
left out first, and the others emit for the half that may hold the edit.
Links are verified on the words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, saved, with_key

MIN_WORDS = 5


def normal(line: Column) -> Column:
    """Lower case, words parted by single spaces."""
    low = F.lower(line)
    odd = F.contains(low, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(low, F.lit(c))
    return F.btrim(F.when(odd, F.regexp_replace(low, SPACE, " ")).otherwise(low), F.lit(" "))


def _half(m: Column) -> Column:
    return F.floor(m / 2).cast("int")


def _ends(n: Column) -> Column:
    """Hashes of the first and the last half of a normal line, for a partner
    of up to n words and for one of n + 1; where these halves are of one
    length, once."""
    short, long = _half(n), _half(n + 1)
    def end(side: int, h: Column) -> Column:
        half = F.call_function("substring_index", F.col("_t"), F.lit(" "), h if side == 0 else -h)
        return F.xxhash64(F.lit(side), half).bitwiseAND(F.lit((1 << 48) - 1))  # only a filter: 48 bits do

    first, last = (lambda h: end(0, h)), (lambda h: end(1, h))
    return F.when(short == long, F.array(first(short), last(short))).otherwise(
        F.array(first(short), last(short), first(long), last(long)))


def _run_hash(words: Column, blocks: Column, b: Column, k: Column) -> Column:
    """Hash of the first k words, from the hashes of whole blocks of b words
    and the words after them, so that it costs about b + k / b."""
    c = F.floor(k / b).cast("int")
    return F.xxhash64(k, F.slice(blocks, F.lit(1), c), F.slice(words, c * b + 1, k - c * b))


def _blocks(words: Column, n: Column, b: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / b).cast("int")),
                       lambda c: F.xxhash64(F.slice(words, c * b + 1, b)))


def _apart(df: DataFrame, by: str) -> DataFrame:
    """A small grouped table, dealt out anew: a join with it then shuffles both
    sides itself, and only then can Spark split a hot key of the large side."""
    return df.repartition(F.col(by))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once: the optimizer copies a plain one into
    every expression that uses it, but not across a generator."""
    return df.withColumn(name, F.explode(F.array(value)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_words: int = MIN_WORDS, carry: bool = False, links_table: bool = False) -> DataFrame:
    """Per row of the keyed documents (_id, _ord): n_lines, n_exact, n_near
    and text without the removed lines; with ``carry`` also _row, the other
    columns of ``docs``.

    Lines are parted by a line feed. A line with words, however short, goes if
    an equal normalised line (:func:`normal`) comes earlier, by (id, line
    number); one of at least ``min_words`` words (one edit in five leaves four
    fifths alike) also if it is the first of its kind and the first of another
    such kind within one edit comes earlier. Lines without words stay. Null text is empty and has one empty
    line; null ids come last; different texts under one id are ordered by
    hash, and rows that repeat id and text are one document with a row each.
    An empty table gives an empty table.

    ``links_table`` writes the near links to a table of their own: a plan of
    half the size, which spares the driver, for a second shuffle of the texts.
    """
    base = with_key(docs, id_col, text_col, carry)
    split = F.split("_text", "\n", -1)
    lines = _once(base.select("_id", "_ord", F.posexplode(split).alias("_line", "_raw")), "_t", normal(F.col("_raw")))
    lines = _once(lines, "_n", F.octet_length("_t") - F.octet_length(F.replace("_t", F.lit(" "))) + 1)
    ends = F.when(F.col("_n") >= min_words, _ends(F.col("_n"))).otherwise(F.array().cast("array<long>"))
    lines = saved(lines.where(F.col("_t") != "").select(F.xxhash64("_t").alias("_h1"), F.hash(F.lit(1), "_t").alias("_h2"), "_id", "_ord",
                                                        "_line", ends.alias("_ends")), "lines")
    place = F.struct("_id", "_ord", "_line")

    # one row per kind of line (96 bits of hash): its first place, with its halves, and how often it occurs
    kinds = lines.groupBy("_h1", "_h2").agg(F.min(F.struct("_id", "_ord", "_line", "_ends")).alias("_first"),
                                            F.count(F.lit(1)).alias("_c"))
    kinds = kinds.select("_h1", "_h2", F.inline(F.array(F.struct("_first", "_c"))))  # both uses share one shuffle
    first = F.struct("_first._id", "_first._ord", "_first._line")

    # equal lines
    many = kinds.where("_c > 1").select("_h1", "_h2", first.alias("_keep"))
    many = _apart(many, "_keep._id")
    equal = lines.select("_h1", "_h2", "_id", "_ord", "_line").join(many, ["_h1", "_h2"]).where(place != F.col("_keep"))
    equal = equal.groupBy("_id", "_ord").agg(F.collect_set("_line").alias("_equal"))

    # lines with a half that occurs elsewhere; the bits of half: first and last at n words, first and last at n + 1
    bits = F.when(F.size("_ends") == 2, F.array(F.lit(5), F.lit(10))).otherwise(F.array(*map(F.lit, (1, 2, 4, 8))))
    ends = kinds.select("_first.*").where(F.size("_ends") > 0).select("_id", "_ord", "_line", F.inline(F.arrays_zip(
        F.col("_ends"), bits.alias("_bits"))).alias("_a", "_bits"))
    shared = ends.groupBy("_a").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_a")
    halves = ends.join(_apart(shared.withColumn("_s", F.xxhash64("_a")), "_s"), "_a", "left_semi").groupBy("_id", "_ord", "_line").agg(
        F.sum("_bits").cast("int").alias("half"))
    wanted = halves.groupBy("_id", "_ord").agg(F.collect_list(F.struct(F.col("_line").alias("line"), "half")).alias("_want"))

    # their neighbourhoods
    cand = _once(base.select("_id", "_ord", "_text").join(wanted, ["_id", "_ord"]), "_lines", split)
    cand = cand.select("_id", "_ord", "_lines", F.inline("_want").alias("_line", "_half"))
    cand = _once(cand, "_w", F.split(normal(F.element_at("_lines", F.col("_line") + 1)), " ", -1)).drop("_lines")
    cand = cand.withColumn("_n", F.size("_w")).withColumn("_more", F.explode(F.array(F.lit(0), F.lit(1))))
    cand = cand.withColumn("_m", F.col("_n") + F.col("_more")).withColumn(
        "_b", F.ceil(F.sqrt(F.col("_m"))).cast("int")).withColumn("_v", F.reverse("_w"))
    cand = cand.withColumn("_wb", _blocks(F.col("_w"), F.col("_n"), F.col("_b"))).withColumn(
        "_vb", _blocks(F.col("_v"), F.col("_n"), F.col("_b")))
    m, h = F.col("_m"), _half(F.col("_m"))
    bits = F.expr("shiftright(_half, 2 * _more)")
    front, back = bits.bitwiseAND(F.lit(1)) > 0, bits.bitwiseAND(F.lit(2)) > 0  # which half is shared
    at = F.when(front & back, F.sequence(F.lit(0), m - 1)).when(front, F.sequence(h, m - 1)).when(
        back, F.sequence(F.lit(0), h - 1))
    keys = cand.withColumn("_i", F.explode(at))
    i = F.col("_i")

    # 64 bits of hash beside the length and the place of the edit; links are verified on the words
    keys = keys.select(F.xxhash64(_run_hash(F.col("_w"), F.col("_wb"), F.col("_b"), i),
                                  _run_hash(F.col("_v"), F.col("_vb"), F.col("_b"), m - 1 - i)).alias("_key"),
                       "_m", "_i", "_id", "_ord", "_line")
    by = ["_key", "_m", "_i"]
    met = keys.groupBy(*by).agg(F.min(place).alias("_keep"), F.count(F.lit(1)).alias("_c")).where("_c > 1")
    links = keys.join(_apart(met.select(*by, "_keep"), "_keep._id"), by).where(F.col("_keep") < place)
    links = links.groupBy("_id", "_ord", "_line").agg(F.min(F.struct("_keep", "_m", "_i")).alias("_l")).select(
        "_id", "_ord", "_line", "_l.*")
    if links_table:
        links = saved(links, "links")

    # the earlier lines' words, once each, then to all that link with them: a hot line is a hot key, which Spark can split
    asked = links.groupBy(F.col("_keep._id").alias("_id"), F.col("_keep._ord").alias("_ord")).agg(
        F.collect_set("_keep._line").alias("_ask"))
    sent = _once(base.select("_id", "_ord", "_text").join(asked, ["_id", "_ord"]), "_lines", split)
    sent = sent.select("_id", "_ord", "_lines", F.explode("_ask").alias("_line"))
    sent = sent.select(F.struct("_id", "_ord", "_line").alias("_keep"), F.element_at("_lines", F.col("_line") + 1).alias("_other"))
    sent = sent.dropDuplicates(["_keep"])  # rows that repeat send the same
    near = links.join(_apart(sent.withColumn("_s", F.xxhash64("_keep")), "_s").drop("_s"), "_keep")
    near = near.groupBy("_id", "_ord").agg(F.collect_list(F.struct(
        F.col("_line").alias("line"), F.col("_m").alias("m"), F.col("_i").alias("i"), F.col("_other").alias("other"))).alias("_near"))

    out = base.join(equal, ["_id", "_ord"], "left").join(near, ["_id", "_ord"], "left")
    out = _once(out, "_lines", split)

    def rest(line: Column, x: Column) -> Column:
        """Words without the one at x.i; a line one word shorter has none there."""
        words = F.split(normal(line), " ", -1)
        return F.when(F.size(words) == x["m"], F.concat(F.slice(words, F.lit(1), x["i"]), F.slice(
            words, x["i"] + 2, F.greatest(x["m"] - 1 - x["i"], F.lit(0))))).otherwise(words)

    close = F.filter(F.coalesce("_near", F.array().cast("array<struct<line:int,m:int,i:int,other:string>>")),
                     lambda x: rest(F.element_at("_lines", x["line"] + 1), x) == rest(x["other"], x))
    out = out.withColumn("_gone", F.coalesce("_equal", F.array().cast("array<int>")))
    out = _once(out, "_close", F.transform(close, lambda x: x["line"])).withColumn("_all", F.array_union("_gone", "_close"))
    kept = F.when(F.size("_all") == 0, F.col("_text")).otherwise(
        F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_all"),
                                 lambda k: F.element_at("_lines", k + 1)), "\n"))
    return out.select("_id", "_ord", F.size("_lines").alias("n_lines"), F.size("_gone").alias("n_exact"),
                      F.size("_close").alias("n_near"), kept.alias("text"), *(["_row"] if carry else []))
