"""Ranked search: one scan, filters below the limit, the best k by score and then id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans import match
from quire.plans.dsl import ParsedQuery
from quire.plans.filters import Filters, of_lines
from quire.schema import HIT

LIMIT = 50


def search(
    lines: DataFrame, query: ParsedQuery, norm: match.Norm, filters: Filters = Filters(), limit: int = LIMIT, stats: match.Stats | None = None, extended: bool = False, late_filter: bool = False
) -> DataFrame:
    """The best ``limit`` hits.  With ``late_filter`` the filters see only those hits, as a filter after the limit would."""
    p = match.plan(query, norm, extended)
    stats = stats or match.statistics(lines, match.grams_needed(p))
    kept = lines if late_filter else lines.where(of_lines(filters))
    found = kept.where(match.predicate(p, F.col("text_norm"))).withColumn("score", match.score(p, stats, F.col("text_norm"), F.col("dl")))
    best = found.orderBy(F.desc("score"), "line_id").limit(limit)
    return (best.where(of_lines(filters)) if late_filter else best).select(*HIT)
