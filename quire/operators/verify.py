"""Is a quote a line of the corpus, and if not, which lines are closest?

Exact: the hash of the normalized quote, then the text itself.  Similar: lines that
share bigrams with the quote, the best by weight reranked by edit distance on
characters.  Both exist for one quote and for a table of quotes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import grams_of, norm_hash, similarity
from quire.plans.match import Norm, Stats, statistics
from quire.schema import HIT

RECALL, SIMILAR = 80, 5


@dataclass(frozen=True)
class Report:
    is_original: bool
    exact_hit: dict | None
    similar: list[dict]


def exact(lines: DataFrame, normalized: str) -> DataFrame:
    import hashlib

    same = (F.col("norm_hash") == hashlib.sha256(normalized.encode()).hexdigest()) & (F.col("text_norm") == normalized)
    return lines.where(same).withColumn("score", F.lit(1.0)).orderBy("line_id").limit(1).select(*HIT)


def similar(lines: DataFrame, normalized: str, recall: int | None = RECALL, limit: int = SIMILAR, stats: Stats | None = None) -> DataFrame:
    """The closest lines.  ``recall`` lines go to the edit distance; none means all that share a bigram."""
    grams = grams_of(normalized, 2)
    stats = stats or statistics(lines, set(grams))
    weight = F.lit(0.0)
    for gram in sorted(set(grams)):
        times = float(grams.count(gram))
        weight = weight + F.when(F.col("text_norm").contains(F.lit(gram)), F.lit(times * stats.weight(gram))).otherwise(F.lit(0.0))
    near = lines.where("text_norm <> ''").withColumn("weight", weight).where("weight > 0")
    if recall is not None:
        near = near.orderBy(F.desc("weight"), "line_id").limit(recall)
    scored = near.withColumn("score", similarity(F.col("text_norm"), F.lit(normalized))).where("score > 0")
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("line_id").orderBy(F.desc("score"), "seq"))).where("n = 1")
    return best.orderBy(F.desc("score"), "line_id").limit(limit).select(*HIT)


def verify(lines: DataFrame, quote: str, norm: Norm) -> Report:
    normalized = norm(quote)
    if not normalized:
        return Report(False, None, [])
    hit = exact(lines, normalized).collect()
    if hit:
        return Report(True, hit[0].asDict(), [])
    return Report(False, None, [r.asDict() for r in similar(lines, normalized).collect()])


def verify_batch(lines: DataFrame, quotes: DataFrame) -> DataFrame:
    """(quote_id, is_original, line_id) of a table (quote_id, quote_norm): one equi-join on the hash."""
    firsts = lines.groupBy("norm_hash", "text_norm").agg(F.min("line_id").alias("line_id"))
    keyed = quotes.withColumn("norm_hash", norm_hash(F.col("quote_norm"))).withColumnRenamed("quote_norm", "text_norm")
    joined = keyed.join(firsts, ["norm_hash", "text_norm"], "left")
    found = F.col("line_id").isNotNull() & (F.col("text_norm") != "")
    return joined.select("quote_id", found.alias("is_original"), F.when(found, F.col("line_id")).alias("line_id"))
