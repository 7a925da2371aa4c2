"""The stages of the corpus pipeline: each takes the documents that the one before kept.

All but the last return the columns of ``docs``, whatever their names: what a stage
adds for itself never meets a name of the caller's.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import line_dedup, mixing, ngram_join, packing, toxicity
from quire.llm.common import carried, cut, restored, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity classifier rejects (a score of 0.5 or more).

    Null and empty texts score alike, by the classifier's bias, and stay as they are
    if that is below 0.5; texts of any length are scored whole; rows that repeat are
    scored alike and all stay or go.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    kept = toxicity.score(docs, model).where("score < 0.5")
    return kept.select(*restored(docs.columns, text=F.col("text")))


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that repeat an earlier one; a document that loses all it says goes.

    Null, empty and blank texts stay.  Rows that repeat an id and text are one
    document; of lines that tie, the first by doc_id (null last), then by a hash of
    the text, then by number stays.  A column ``n_chars`` is counted anew.
    """
    found = line_dedup.kept_lines(docs, line_dedup.PERCENT)
    blank = F.coalesce("kept", F.lit("")).rlike(r"^\s*$")
    stays = found.where(~(blank & (F.col("n_removed") > 0)))
    return stays.select(*restored(docs.columns, text=F.col("kept"), n_chars=F.length("kept").cast("long")))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8: that of the smallest id.

    Null and empty texts are linked with nothing and stay.  Rows without an id are
    named by a hash of their text, after all ids, so those that repeat a text are one
    document; rows that repeat an id are one document, of which one row stays.
    """
    name = F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62))
    named = docs.select(name.alias("id"), carried(docs).alias("row"))
    groups = cut(ngram_join.join(named.select(F.col("id").alias("doc_id"), F.col("row.text").alias("text")), k=5, percent=80))
    kept = groups.groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias("n")).where("c = doc_id")
    out = named.join(kept.select(F.col("doc_id").alias("id")), "id", "left_semi")
    if kept.where("n > 1").limit(1).count():
        out = out.dropDuplicates(["id"])
    return out.select(*restored(docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight takes it.

    Null and empty texts have size 0, and are taken at their source's rate like any
    other; a null source is a source; rows that share id and text draw alike.
    """
    return mixing.emit(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences, in the columns of ``packing.pack`` alone.

    A null or empty text is the end token only; a long one is cut into pieces; rows
    that repeat are packed each for itself.
    """
    return packing.pack(docs.select("doc_id", "text"))
