"""Column expressions for text. All run JVM-side inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's str.strip() removes: Unicode White_Space plus the
# information separators \x1c-\x1f (str.isspace is true for them).
_PY_SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
PY_STRIP_PATTERN = rf"^{_PY_SPACE}+|{_PY_SPACE}+$"

# Number grammar shared by pandas' to_numeric and this library (no '1d', no
# '1_000', no 'inf'): engines disagree outside it, so everything else is
# "not a number".
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# whitespace-only as Python's regex ``^\s*$`` sees it (Unicode spaces too)
BLANK_PATTERN = rf"^{_PY_SPACE}*$"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pystrip(c) -> Column:
    """Python ``str.strip()`` semantics (Unicode whitespace both ends)."""
    return F.regexp_replace(col_of(c), PY_STRIP_PATTERN, "")


def java_quote(term: str) -> str:
    """Quote a literal for java.util.regex (\\Q..\\E, with embedded \\E split)."""
    return r"\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E"


def _class_char(ch: str) -> str:
    return r"\x{%x}" % ord(ch)


def literal_guard_pattern(terms: Iterable[str]) -> str:
    """One regex that finds any of ``terms``: a first-character look-ahead
    followed by the quoted alternation. The look-ahead lets the matcher skip
    most positions without trying every alternative."""
    terms = [t for t in terms if t]
    firsts = sorted({t[0] for t in terms})
    head = "(?=[" + "".join(_class_char(c) for c in firsts) + "])"
    return head + "(?:" + "|".join(java_quote(t) for t in terms) + ")"


def replace_sequential(c, terms: Iterable[str], token: str) -> Column:
    """``str.replace(term, token)`` for each term in order (exact, case-sensitive)."""
    out = col_of(c)
    for t in terms:
        if t:
            out = F.replace(out, F.lit(t), F.lit(token))
    return out


def replace_terms_guarded(c, terms: list[str], token: str) -> Column:
    """Sequential literal replacement that is only evaluated on rows where some
    term occurs. Exact: if no term occurs, no replacement can change the text."""
    col = col_of(c)
    if not terms:
        return col
    guard = col.rlike(literal_guard_pattern(terms))
    return F.when(guard, replace_sequential(col, terms, token)).otherwise(col)


def replace_terms_fold(c, terms: list[str], token: str) -> Column:
    """Same result as :func:`replace_sequential` for very long term lists: one
    higher-order ``aggregate`` over an array literal instead of a deep tree."""
    col = col_of(c)
    arr = F.array(*[F.lit(t) for t in terms if t])
    folded = F.aggregate(arr, col, lambda acc, t: F.replace(acc, t, F.lit(token)))
    guard = col.rlike(literal_guard_pattern(terms))
    return F.when(guard, folded).otherwise(col)


def slices(text: Column, ranges: Column, few: int = 16) -> Column:
    """The parts ``[start, stop)`` (code points) of a text, for an array of
    structs. Many parts are taken from an array of the text's characters, so
    that the work stays in proportion to the text's length."""
    def size(r: Column) -> Column:
        return F.greatest(r["stop"] - r["start"], F.lit(0))

    def from_chars(chars: Column) -> Column:
        return F.transform(ranges, lambda r: F.array_join(F.slice(chars, r["start"] + 1, size(r)), ""))

    direct = F.transform(ranges, lambda r: F.substring(text, r["start"] + 1, size(r)))
    return F.when(F.size(ranges) <= few, direct).otherwise(F.transform(F.array(F.split(text, "")), from_chars)[0])
