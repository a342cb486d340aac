"""Fill-in-the-middle: every text cut at two token borders and put together anew.

``regexp_count`` gives a text's number of tokens n. A pattern made for the row
takes the prefix as a possessive group of exactly a tokens, the middle as one
of b - a, and the rest as suffix, in a single match; the replacement template
of the row's form puts them in order between sentinels. Possessive counted
groups are loops without backtracking, so long texts need no deep stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN_FROM = 90  # of 100
SPM_BELOW = 20  # of 100


def draws(id_col: Column, seed: str = "1", n: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers of a row: the first groups of eight digits of
    sha256('seed:id'). A null id is written as nothing."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in s)


def _possessive(unit: str) -> str:
    """The unit for a counted group: its own + loops give nothing back."""
    return unit.replace("]+", "]++")


def pattern(a: Column, b: Column, unit: str = UNIT) -> Column:
    """A row's pattern: groups of a and of b - a units, and the rest."""
    one = f"(?:{_possessive(unit)})"
    return F.concat(F.lit(f"(?s)\\A({one}{{"), a.cast("string"), F.lit(f"}}+)({one}{{"), (b - a).cast("string"),
                    F.lit("}+)(.*+)\\z"))


def fields(output: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The three texts between the sentinels of a psm or spm output, in its
    order. No text holds a sentinel and none overlaps itself, so the cuts are
    where they were made."""
    return F.split(F.substring(output, len(sentinels[0]) + 1, 2147483647), "|".join(map(_quoted, sentinels)), -1)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text again, from an output and its form alone."""
    got = fields(output, sentinels)
    return (F.when(form == "psm", F.concat(got[0], got[2], got[1]))
            .when(form == "spm", F.concat(got[1], got[2], got[0])).otherwise(output))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = UNIT, seed: str = "1",
                   plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW,
                   sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """One row per document: the id, n (tokens), form (plain, psm, spm),
    prefix, middle and suffix (null where plain) and output. Row by row, no
    shuffle.

    ``unit``: alternatives that tokenise any text whole. ``sentinels`` have the
    same length and are no one's prefix or suffix of another. Null and empty texts, and texts
    that hold a sentinel, are plain (a null text counts as empty); a null id
    draws as the empty id; rows that repeat come out alike; an empty table
    gives an empty table; only the two columns are read, so others may have
    any names. A text of any length is cut whole."""
    p, s, m = sentinels
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_text", text)
    h = draws(F.col("_id"), seed)
    rows = rows.withColumn("_n", F.regexp_count("_text", F.lit(unit)).cast("long"))
    x, y = h[0] % (F.col("_n") + 1), h[1] % (F.col("_n") + 1)
    marked = (F.col("_text") == "") | F.contains("_text", F.lit(p)) | F.contains("_text", F.lit(s)) | \
        F.contains("_text", F.lit(m))
    form = (F.when(marked | (h[2] % 100 >= plain_from), "plain").when(h[3] % 100 < spm_below, "spm").otherwise("psm"))
    rows = rows.withColumn("_form", form).withColumn("_pattern", pattern(F.least(x, y), F.greatest(x, y), unit))
    put = F.when(F.col("_form") == "psm", f"{_quoted(p)}$1{_quoted(s)}$3{_quoted(m)}$2") \
        .otherwise(f"{_quoted(s)}$3{_quoted(p)}$1{_quoted(m)}$2")
    rows = rows.withColumn("_out", F.when(F.col("_form") == "plain", F.col("_text"))
                           .otherwise(F.regexp_replace("_text", F.col("_pattern"), put)))
    cut = F.col("_form") != "plain"
    got = fields(F.col("_out"), sentinels)
    spm = F.col("_form") == "spm"
    return rows.select(
        F.col("_id").alias(id_col), F.col("_n").alias("n"), F.col("_form").alias("form"),
        F.when(cut, F.when(spm, got[1]).otherwise(got[0])).alias("prefix"), F.when(cut, got[2]).alias("middle"),
        F.when(cut, F.when(spm, got[0]).otherwise(got[1])).alias("suffix"), F.col("_out").alias("output"))
