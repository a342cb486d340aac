"""Large term lists (S2, T3): sequential literal replacement at a cost that does
not grow with the list.

An Aho-Corasick automaton finds the terms that occur in a text in one scan, and
only these are replaced, in list order. A replacement can make a term occur that
did not before, but only one that shares a character with the token (any term,
if the token is empty); a second automaton looks for those after each
replacement. The result is that of replacing every term of the list in turn.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 16 << 20  # of terms that an executor holds at once


class TermList:
    """The terms in list order; a term listed twice is replaced at both places."""

    def __init__(self, terms: Sequence[str], token: str) -> None:
        self.terms, self.token = [t for t in terms if t], token
        self.all = self._automaton(range(len(self.terms)))
        made = range(len(self.terms)) if not token else [k for k, t in enumerate(self.terms) if set(t) & set(token)]
        self.made = self._automaton(made)

    def _automaton(self, places):
        import ahocorasick

        at: dict[str, list[int]] = {}
        for k in places:
            at.setdefault(self.terms[k], []).append(k)
        out = ahocorasick.Automaton()
        for t, ks in at.items():
            out.add_word(t, tuple(ks))
        out.make_automaton()
        return out if at else None

    @staticmethod
    def _found(automaton, text: str) -> set[int]:
        return {k for ks in {ks for _, ks in automaton.iter(text)} for k in ks} if automaton is not None else set()

    def replace(self, text: str | None) -> str | None:
        if text is None or self.all is None:
            return text
        known = self._found(self.all, text)
        todo, last = sorted(known), -1
        while todo:
            k = heapq.heappop(todo)
            term = self.terms[k]
            if k <= last or term not in text:
                continue
            text, last = text.replace(term, self.token), k
            for new in self._found(self.made, text) - known:
                known.add(new)
                if new > k:
                    heapq.heappush(todo, new)
        return text


_HELD: dict[str, TermList] = {}


def _at_worker(key: str, terms: Sequence[str], token: str) -> TermList:
    """Built once for each Python worker; a worker keeps the last four."""
    if key not in _HELD:
        while len(_HELD) >= 4:
            _HELD.pop(next(iter(_HELD)))
        _HELD[key] = TermList(terms, token)
    return _HELD[key]


def blocks(terms: Sequence[str], most: int = BLOCK_CHARS) -> list[list[str]]:
    """Runs of the list of at most ``most`` characters each (a longer term is
    one by itself). Replacing run by run is replacing the list."""
    out: list[list[str]] = []
    size = 0
    for t in terms:
        if not out or size + len(t) > most:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t)
    return out


def redact_term_list(df: DataFrame, cols: Sequence[str], terms: Sequence[str], token: str = " ", most: int = BLOCK_CHARS) -> DataFrame:
    """T3 by automaton on each of ``cols``: whole texts, row by row; a null
    stays null. The list goes to the executors as a broadcast, or, where it is
    longer than ``most`` characters, as several, applied one after another."""
    out = df
    for part in blocks(terms, most):
        held, key = df.sparkSession.sparkContext.broadcast(part), uuid.uuid4().hex

        def replaced(c: Column, held=held, key=key) -> Column:
            @F.pandas_udf("string")
            def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
                terms = _at_worker(key, held.value, token)
                for texts in batches:
                    yield texts.map(terms.replace, na_action="ignore")

            return run(c)

        out = out.withColumns({c: replaced(F.col(f"`{c}`")) for c in cols if c in df.columns})
    return out
