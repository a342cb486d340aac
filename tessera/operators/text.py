"""Text redaction and cleaning (T3-T8). Row-local: no shuffle, codegen only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import col_of, replace_terms_fold, replace_terms_guarded, slices

# Above this many terms a nested replace() tree gets too deep for codegen: an
# expression folds over an array literal instead, and redact_terms goes through
# the automaton of termlist.py (same result).
NESTED_LIMIT = 400


def default_terms() -> list[str]:
    """Markers first, then the client names, in list order."""
    return list(fv.MANUAL_MARKERS) + list(fv.CLIENT_NAMES)


def order_terms(terms: Sequence[str], longest_first: bool = False) -> list[str]:
    terms = [t for t in terms if t]
    if longest_first:
        terms = sorted(terms, key=lambda t: -len(t))  # stable: ties keep list order
    return terms


def redact_terms_expr(c, terms: Sequence[str], token: str = " ", longest_first: bool = False,
                      word_boundary: bool = False) -> Column:
    """Sequential, case-sensitive substring replacement of each term by
    ``token`` (faithful default). ``longest_first`` orders terms by length so a
    name is never cut by one of its prefixes; ``word_boundary`` only replaces
    whole words (regex, terms quoted)."""
    terms = order_terms(terms, longest_first)
    col = col_of(c)
    if word_boundary:
        from ..functions.text import java_quote
        alt = "|".join(java_quote(t) for t in terms)
        return F.regexp_replace(col, rf"(?<![\p{{L}}\p{{N}}_])(?:{alt})(?![\p{{L}}\p{{N}}_])",
                                F.lit(token.replace("\\", "\\\\").replace("$", "\\$")))
    if len(terms) > NESTED_LIMIT:
        return replace_terms_fold(col, terms, token)
    return replace_terms_guarded(col, terms, token)


def redact_terms(df: DataFrame, cols: Sequence[str] = ("text", "rtnl"), terms: Sequence[str] | None = None,
                 token: str = " ", longest_first: bool = False, word_boundary: bool = False) -> DataFrame:
    """T3 on each of ``cols`` (the default also redacts the rationale, which
    later becomes training text)."""
    terms = default_terms() if terms is None else list(terms)
    if len(terms) > NESTED_LIMIT and not word_boundary:
        from .termlist import redact_term_list
        return redact_term_list(df, cols, order_terms(terms, longest_first), token)
    return df.withColumns({c: redact_terms_expr(c, terms, token, longest_first, word_boundary)
                           for c in cols if c in df.columns})


def strip_numerals(df: DataFrame, col: str = "text", token: str = " ") -> DataFrame:
    """Runs of Unicode decimal digits, CR and LF -> one ``token``."""
    return df.withColumn(col, F.regexp_replace(F.col(col), r"[\p{Nd}\r\n]+", token))


def strip_tokens(df: DataFrame, col: str = "text", tokens: Sequence[str] = tuple(fv.SALIENCE_TOKENS),
                 token: str = " ") -> DataFrame:
    """Remove exact delimiter tokens (each -> ``token``), in order."""
    return df.withColumn(col, replace_terms_guarded(col, list(tokens), token))


def text_for_nlp(c, null_text: str = "keep") -> Column:
    """``'keep'`` leaves NULL as NULL; ``'nan'`` stringifies it the way
    ``astype(str)`` does before an NLP pass."""
    c = col_of(c)
    return c if null_text == "keep" else F.coalesce(c, F.lit(null_text))


def _kept(spans, labels: Sequence[str]) -> Column:
    lab = F.array(*[F.lit(x) for x in labels])
    return F.filter(col_of(spans), lambda s: F.array_contains(lab, s["label"]))


def merge_spans(spans) -> Column:
    """Sort spans by start and merge overlapping ones into (start, end) pairs."""
    asc = F.array_sort(F.transform(col_of(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc, s):
        n = F.size(acc)
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, n - 1),
                         F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((n > 0) & (s["start"] < last["end"]), grown).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(asc, empty, step)


def redact_spans_expr(text, spans, labels: Sequence[str] = tuple(fv.REDACT_LABELS), token: str = " ",
                      null_text: str = "keep") -> Column:
    """T4: each kept span [start, end) (0-based code points) -> one ``token``.
    Overlapping spans are merged into one first; the text between them is cut
    out once and joined."""
    t = text_for_nlp(text, null_text)

    def rest(merged: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(merged, lambda s: s["end"]))
        stops = F.concat(F.transform(merged, lambda s: s["start"]), F.array(F.length(t)))
        gaps = F.zip_with(starts, stops, lambda a, z: F.struct(a.alias("start"), z.alias("stop")))
        return F.array_join(slices(t, gaps), token)

    merged = merge_spans(_kept(spans, labels))
    return F.when(t.isNull(), t).when(F.size(merged) > 0, F.transform(F.array(merged), rest)[0]).otherwise(t)


def redact_spans(df: DataFrame, text: str = "text", spans: str = "spans",
                 labels: Sequence[str] = tuple(fv.REDACT_LABELS), out: str | None = None, **kw) -> DataFrame:
    return df.withColumn(out or text, redact_spans_expr(text, spans, labels, **kw))


def redact_entities_expr(text, spans, labels: Sequence[str] = tuple(fv.REDACT_LABELS),
                         token: str = fv.PII_TOKEN, null_text: str = "keep") -> Column:
    """T5: every occurrence, anywhere, of each kept entity's text -> ``token``,
    entity by entity in document order (also inside other words)."""
    t = text_for_nlp(text, null_text)
    kept = _kept(spans, labels)
    return F.aggregate(kept, t, lambda acc, s: F.replace(acc, s["text"], F.lit(token)))


def redact_entities(df: DataFrame, text: str = "text", spans: str = "spans",
                    labels: Sequence[str] = tuple(fv.REDACT_LABELS), out: str | None = None, **kw) -> DataFrame:
    return df.withColumn(out or text, redact_entities_expr(text, spans, labels, **kw))
