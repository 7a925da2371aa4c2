"""Queries as plans: one exact predicate and one score over ``text_norm``, both plain columns.

Proximity is a regular expression: the distance of a match is the span it covers, so
``A BEFORE/w B`` is A, at most w - |A| - |B| characters, B.  Unordered pairs may also
overlap; the finitely many texts in which two terms overlap are spelled out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import reduce
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import occurrences, quoted
from quire.plans.dsl import WINDOW, ParsedQuery

K1, B = 1.2, 0.75
#: An unordered query of up to so many terms tries their orders as expressions.
MOST_UNORDERED = 6
Norm = Callable[[str], str]


def holds(text: Column, term: str) -> Column:
    return text.contains(F.lit(term)) if term else F.lit(False)


def overlaps(a: str, b: str, window: int) -> list[str]:
    """Every text of at most ``window`` characters that two overlapping terms make."""
    out = set()
    for x, y in ((a, b), (b, a)):
        for shift in range(len(x)):
            shared = min(len(x) - shift, len(y))
            if x[shift : shift + shared] == y[:shared]:
                merged = x[:shift] + y + x[shift + len(y) :]
                if len(merged) <= window:
                    out.add(merged)
    return sorted(out)


def _gap(a: str, b: str, window: int) -> str | None:
    left = window - len(a) - len(b)
    return f"(?s){quoted(a)}.{{0,{left}}}{quoted(b)}" if left >= 0 else None


def in_order(text: Column, terms: list[str], window: int) -> Column:
    """The terms one after another without overlap, from the first's start to the last's end at most ``window``."""
    if sum(map(len, terms)) > window:
        return F.lit(False)
    if len(terms) == 2:
        return text.rlike(_gap(*terms, window))
    first = terms[0]
    # From each start of the first term, as much text as the window holds, earliest matches taken.
    begins = F.regexp_extract_all(text, F.lit(f"(?s)(?=({quoted(first)}.{{0,{window - len(first)}}}))"), F.lit(1))
    chain = "(?s)^" + ".*?".join(map(quoted, terms))
    return F.exists(begins, lambda x: x.rlike(chain))


def fits(text: str, terms: list[str], window: int) -> bool:
    """Whether all terms come in some order, without overlap, from a first start to a last end of at most ``window``.

    From each start, the earliest end of every set of terms follows from those of the
    sets with one term less; the number of orders does not matter.
    """
    full = (1 << len(terms)) - 1
    starts = sorted({i for t in set(terms) for i in range(len(text)) if text.startswith(t, i)})
    for start in starts:
        ends = {0: start}
        for known in range(full):
            at = ends.get(known)
            if at is None:
                continue
            for k, term in enumerate(terms):
                if not known >> k & 1:
                    found = text.find(term, at, start + window)
                    if found >= 0 and (known or found == start):
                        both = known | 1 << k
                        ends[both] = min(ends.get(both, len(text)), found + len(term))
        if full in ends:
            return True
    return False


def in_any_order(text: Column, terms: list[str], window: int) -> Column:
    """``fits`` for texts that hold all terms, of which there are few; so many orders are no expression."""

    @F.pandas_udf("boolean")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda x: fits(x, terms, window))

    return run(text)


def within(text: Column, terms: list[str], window: int, ordered: bool) -> Column:
    """Whether the terms come within the window, in order or in any."""
    every = reduce(lambda a, b: a & b, [holds(text, t) for t in terms])
    if len(terms) == 1:
        return every
    if ordered:
        return every & in_order(text, terms, window)
    if len(terms) == 2:
        found = [in_order(text, list(p), window) for p in ({tuple(terms), tuple(terms[::-1])})]
        found += [holds(text, m) for m in overlaps(*terms, window)]
    elif len(terms) > MOST_UNORDERED:
        return every & in_any_order(text, terms, window)
    else:
        found = [in_order(text, list(p), window) for p in sorted(set(permutations(terms)))]
    return every & reduce(lambda a, b: a | b, found)


@dataclass(frozen=True)
class Plan:
    """The terms of a query after normalization, and what they ask for."""

    mode: str
    terms: tuple[str, ...]
    excluded: tuple[str, ...]
    window: int
    ordered: bool
    bool_op: str | None
    wild: tuple[str, ...] = ()  # the pieces around each one-character wildcard


def plan(query: ParsedQuery, norm: Norm, extended: bool = False) -> Plan:
    """With ``extended``, ``?`` stands for one character; otherwise it is left out like other punctuation."""
    terms = tuple(t for t in map(norm, query.terms) if t)
    excluded = tuple(t for t in map(norm, query.excluded) if t)
    window = WINDOW if query.within_chars is None else query.within_chars
    ordered = bool(query.ordered) or query.mode == "before"
    wild = tuple(norm(p) for p in query.terms[0].split("?")) if extended and query.mode == "wildcard" and query.terms else ()
    if not terms:  # nothing is left: the raw text is looked for
        return Plan("keyword", (norm(query.raw),), (), window, False, None)
    if query.mode in ("keyword", "phrase", "wildcard") and not excluded:
        terms = terms[:1]
    mode = query.mode if query.mode in ("near", "before", "boolean", "wildcard") else "keyword"
    return Plan(mode, terms, excluded, window, ordered, query.bool_op, wild)


def predicate(p: Plan, text: Column) -> Column:
    if p.mode in ("near", "before"):
        found = within(text, list(p.terms), p.window, p.ordered)
        without = p.excluded
    elif p.mode == "boolean":
        join = (lambda a, b: a | b) if p.bool_op == "or" else (lambda a, b: a & b)
        found, without = reduce(join, [holds(text, t) for t in p.terms]), p.excluded
    elif p.wild:
        found, without = text.rlike("(?s)" + ".".join(map(quoted, p.wild))), p.excluded
    else:
        found, without = reduce(lambda a, b: a & b, [holds(text, t) for t in p.terms]), p.excluded
    for term in without:
        found = found & ~holds(text, term)
    return found


def leaves(p: Plan) -> list[tuple[str, list[str]]]:
    """(what is counted, what its weight is of): phrases weigh as their characters, proximity as its bigrams."""
    if p.mode in ("near", "before"):
        return [(g, [g]) for t in p.terms for g in ([t[i : i + 2] for i in range(len(t) - 1)] or [t])]
    if p.wild:
        return [(w, list(w)) for w in p.wild if w]
    return [(t, list(t)) for t in p.terms if t]


@dataclass(frozen=True)
class Stats:
    lines: int
    mean_length: float
    with_gram: Mapping[str, int]

    def weight(self, gram: str) -> float:
        df = self.with_gram[gram]
        return math.log(1 + (self.lines - df + 0.5) / (df + 0.5))


def statistics(lines: DataFrame, grams: set[str]) -> Stats:
    """Number of lines, mean token count and lines with each gram, in one pass."""
    named = sorted(grams)
    counts = [F.count_if(F.col("text_norm").contains(F.lit(g))).alias(f"g{i}") for i, g in enumerate(named)]
    row = lines.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"), *counts).first()
    return Stats(row["n"], row["mean"] or 0.0, {g: row[f"g{i}"] for i, g in enumerate(named)})


def score(p: Plan, stats: Stats, text: Column, dl: Column) -> Column:
    """BM25 over the query's leaves with exact lengths."""
    total = F.lit(0.0)
    for counted, weighed in leaves(p):
        weight = sum(stats.weight(g) for g in weighed)
        tf = occurrences(text, counted)
        length = K1 * (1 - B + B * dl / F.lit(stats.mean_length or 1.0))
        total = total + F.when(tf > 0, F.lit(weight) * (K1 + 1) * tf / (tf + length)).otherwise(F.lit(0.0))
    return total


def grams_needed(p: Plan) -> set[str]:
    return {g for _, weighed in leaves(p) for g in weighed}
