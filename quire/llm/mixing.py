"""Mixing sources to target weights by repetition rates.

Token counts are aggregated per source (map-side combined, so a source with a
third of all rows is one small partial row per task).  Targets come from filling
the sources in order of the rate at which they reach their cap; each document is
then emitted floor(rate) times, plus once more if a draw seeded by a hash of its
id and text is below the rate's fraction.  Reruns agree because nothing else is random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import carried, restored, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of a hash of id and text; null draws as empty."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) to those and ``target``.

    A source is at its cap iff cap / weight is at most the level left for it and
    those that come later in that order; the rest share what is left by weight.
    The windows run over one row per source.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_source) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    rated = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double"))
    rated = rated.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    held = rated.withColumn("level", level).withColumn("capped", F.col("ratio") <= F.col("level"))
    rest = F.max(F.when(~F.col("capped"), F.col("level"))).over(whole)
    return held.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * rest).alias("target"))


def rated(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """(row, size, source_size, target, copies): all columns of ``docs`` as one struct, and what is made of each row."""
    rows = docs.select(carried(docs).alias("row"), F.col("source").alias("own"), size_of(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("drawn"))
    sizes = docs.select("source", size_of(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    out = rows.join(targets(sizes, **how), F.col("own").eqNullSafe(F.col("source")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate).cast("long") + (F.col("drawn") < rate - F.floor(rate)).cast("long")
    return out.select("row", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``.

    Null texts have size 0 and null sources form one source; an empty table stays
    empty; rows that share id and text draw alike, others apart, also without an id.
    Columns of ``docs`` with these four names are replaced; all others stay.
    """
    made = ["size", "source_size", "target", "copies"]
    return rated(docs, seed, **how).select(*restored([c for c in docs.columns if c not in made]), *made)


def emit(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the columns of ``docs``, whatever their names, each row as often as it is taken."""
    copies = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return rated(docs, **how).where("copies > 0").select("row", copies).select(*restored(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mix(docs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def rates_sql(docs: str) -> str:
    return f"""
    sized AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {docs}),
    by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    rated AS (SELECT *, (source_size * 2)::DOUBLE AS cap,
        [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM by_source),
    ranked AS (SELECT *, cap / weight AS ratio FROM rated),
    levels AS (SELECT *, ((SELECT sum(source_size) FROM by_source)::DOUBLE * 1.5::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
    rates AS (SELECT source, source_size, CASE WHEN ratio <= level THEN cap
        ELSE weight * (SELECT max(level) FROM levels WHERE ratio > level) END AS target FROM levels),
    rated_docs AS (SELECT d.*, r.source_size, r.target,
        CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0 END AS rate,
        ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '') || ':' || coalesce(d.text, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw
        FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
    mixed AS (SELECT *, floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT AS copies FROM rated_docs)"""


SQL = f"WITH {rates_sql('documents')} SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed"
