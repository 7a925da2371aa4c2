"""Metadata filters of lines and of the catalog: axes are joined by AND, values of an axis by OR."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    """An empty axis leaves all lines in."""

    canons: tuple[str, ...] = ()
    works: tuple[str, ...] = ()
    authors: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    titles: tuple[str, ...] = ()
    juans: tuple[int, ...] = ()


def _any(column: Column, values: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [column.contains(F.lit(v)) for v in values])


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def of_lines(f: Filters) -> Column:
    """Types and categories say nothing of a line and leave it in; see ``of_catalog`` for works of a type."""
    parts = []
    if f.works:
        parts.append(F.col("work_id").isin(*f.works))
    if f.authors:
        parts.append(_any(F.col("author"), f.authors))
    if f.titles:
        parts.append(_any(F.col("title"), f.titles))
    if f.juans:
        parts.append(F.col("juan").isin(*f.juans))
    if f.canons:
        parts.append(F.col("canon").isin(*f.canons))
    return _all(parts)


def of_catalog(f: Filters) -> Column:
    parts = []
    if f.works:
        parts.append(F.col("work_id").isin(*f.works))
    if f.authors:
        parts.append(_any(F.col("author"), f.authors))
    if f.titles:
        parts.append(_any(F.col("title"), f.titles))
    if f.types:
        parts.append(F.col("work_type").isin(*f.types))
    if f.canons:
        parts.append(F.col("canon").isin(*f.canons))
    return _all(parts)
