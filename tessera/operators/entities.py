"""Entity spans: the built-in recogniser (gazetteer + e-mail + phone, pure
Spark SQL) and a pluggable recogniser run through ``mapInPandas``.

A span is ``struct<start:int, end:int, label:string, text:string>`` with
0-based code-point offsets, end exclusive, in document order.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .. import fixed_values as fv
from ..functions.text import col_of, literal_guard_pattern

SPAN_TYPE = "array<struct<start:int,end:int,label:string,text:string>>"
SPAN_DATATYPE = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()),
                                      StructField("label", StringType()), StructField("text", StringType())]))
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"[0-9]{3}-[0-9]{4}"
ALNUM = "[A-Za-z0-9]"


def default_gazetteer() -> dict[str, str]:
    return {n: "PERSON" for n in fv.CLIENT_NAMES}


def _escape_re(term: str) -> str:
    # portable escaping (java.util.regex and RE2 agree on backslash escapes)
    return "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in term)


def _sorted_terms(gazetteer: Mapping[str, str]) -> list[str]:
    # longest first, so a name never stops at one of its prefixes
    return sorted(gazetteer, key=lambda t: (-len(t), t))


def recogniser_pattern(gazetteer: Mapping[str, str]) -> str:
    """``[^A-Za-z0-9](EMAIL|PHONE|term|...)`` run over ``' ' + text``: one
    boundary character, consumed, then the entity, which no letter or digit
    may follow. Addresses come first, so that a name at the start of one does
    not eat it."""
    alt = "|".join([EMAIL, PHONE] + [_escape_re(t) for t in _sorted_terms(gazetteer)])
    return f"[^A-Za-z0-9](?:{alt})(?!{ALNUM})"


def candidate_guard(text, gazetteer: Mapping[str, str]) -> Column:
    """Exact pre-filter: a span needs a gazetteer term as a substring, an '@'
    or a phone-shaped digit run. The term test is a first-character
    look-ahead alternation, far cheaper than the full recogniser."""
    t = col_of(text)
    cond = F.contains(t, F.lit("@")) | t.rlike(PHONE)
    if gazetteer:
        cond = cond | t.rlike(literal_guard_pattern(_sorted_terms(gazetteer)))
    return cond


def builtin_spans(text, gazetteer: Mapping[str, str] | None = None) -> Column:
    """Spans of gazetteer terms (whole words), e-mail addresses and phone
    numbers, as SQL expressions: one ``regexp_extract_all`` scan over the rows
    that pass :func:`candidate_guard` finds the matches, one ``split`` the text
    between them, whose lengths place them."""
    gaz = dict(default_gazetteer() if gazetteer is None else gazetteer)
    t = col_of(text)
    padded = F.concat(F.lit(" "), t)
    pattern = F.lit(recogniser_pattern(gaz))
    found = F.regexp_extract_all(padded, pattern, 0)
    before = F.transform(F.split(padded, pattern, -1), F.length)
    wholes = F.zip_with(found, F.slice(before, F.lit(1), F.size(found)), lambda w, n: F.struct(w.alias("w"), n.alias("n")))
    init = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN_TYPE).alias("spans"))
    labels = F.create_map(*[x for k, v in sorted(gaz.items()) for x in (F.lit(k), F.lit(v))])

    def step(acc, m):
        start = acc["pos"] + m["n"]                                    # of the entity in text: the character before it is in padded alone
        ent = F.substring(m["w"], 2, 2147483647)
        end = start + F.length(ent)
        label = (F.when(ent.rlike("^" + EMAIL + "$"), F.lit("EMAIL"))
                 .when(ent.rlike("^" + PHONE + "$"), F.lit("PHONE"))
                 .otherwise(F.element_at(labels, ent)))
        span = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"),
                        label.alias("label"), ent.alias("text"))
        return F.struct((start + F.length(m["w"])).alias("pos"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    spans = F.aggregate(wholes, init, step)["spans"]
    return F.when(candidate_guard(t, gaz), spans).otherwise(F.array().cast(SPAN_TYPE))


def joined_spans(first, second) -> Column:
    """The spans of ``first`` and those of ``second`` that overlap none of
    them, in document order."""
    a, b = col_of(first), col_of(second)
    apart = F.filter(b, lambda s: ~F.exists(a, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))
    return F.array_sort(F.concat(a, apart))


def detect_entities(df: DataFrame, text: str = "text", out: str = "spans",
                    fn: Callable[[str], Sequence[tuple]] | None = None,
                    gazetteer: Mapping[str, str] | None = None, model=None) -> DataFrame:
    """Add a spans column. By default the built-in recogniser runs as SQL
    expressions. ``model``: a trained :class:`tagger.Tagger`; its spans are
    added to the built-in ones where they overlap none of these. ``fn`` (text
    -> [(start, end, label), ...], any other recogniser) runs alone, on Arrow
    batches through ``mapInPandas``."""
    if model is not None:
        from .tagger import tag_entities

        both = tag_entities(df.withColumn("_tz_own", builtin_spans(text, gazetteer)), model, text, "_tz_more")
        return both.withColumn(out, joined_spans("_tz_own", "_tz_more")).drop("_tz_own", "_tz_more")
    if fn is None:
        return df.withColumn(out, builtin_spans(text, gazetteer))
    schema = StructType(df.schema.fields + [StructField(out, SPAN_DATATYPE)])

    def run(batches):
        for pdf in batches:
            col = []
            for s in pdf[text]:
                if s is None:
                    col.append([])
                    continue
                col.append([{"start": int(a), "end": int(b), "label": str(lbl), "text": s[a:b]}
                            for a, b, lbl in fn(s)])
            pdf[out] = col
            yield pdf

    return df.mapInPandas(run, schema)


def spans_long(df: DataFrame, key: str = "doc_id", spans: str = "spans") -> DataFrame:
    """One row per span: (key, span_no, start, end, label, text)."""
    # the outer form, then a test of the row: an inner one would run the recogniser in a filter as well
    rows = df.select(key, F.posexplode_outer(spans).alias("span_no", "s")).where(F.col("span_no").isNotNull())
    return rows.select(
        key, "span_no", "s.start", "s.end", "s.label", F.col("s.text").alias("span_text"))
