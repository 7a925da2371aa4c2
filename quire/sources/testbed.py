"""Any table of documents as a corpus: each text line becomes a line with an id, a work and a chapter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import PUNCT, citation, norm_hash, strip_punct, token_count

TAG, LABEL = "2026R2", "BED"
PAGE, COLUMN, CHAPTER = 87, 29, 20


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ``documents``; its texts are NFKC already and in no Han script, so the key is the text without punctuation."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    raw = docs.select("doc_id", "source", F.upper(F.substring("lang", 1, 1)).alias("canon"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    number = F.lpad(F.col("doc_id").cast("string"), 6, "0")
    place = F.col("at") % PAGE
    lb = F.concat(
        F.lpad((F.floor(F.col("at") / PAGE) + 1).cast("string"), 4, "0"),
        F.substring(F.lit("abc"), (F.floor(place / COLUMN) + 1).cast("int"), F.lit(1)),
        F.lpad((place % COLUMN + 1).cast("string"), 2, "0"),
    )
    xml_id = F.concat("canon", F.substring("source", 4, 99), F.lit("n"), number)
    out = raw.select(
        F.concat(xml_id, F.lit("_p"), lb).alias("line_id"), F.concat("canon", number).alias("work_id"), "canon", F.concat(F.lit("doc "), F.col("doc_id")).alias("title"),
        F.col("source").alias("author"), F.lit(TAG).alias("tag"), (F.floor(F.col("at") / CHAPTER) + 1).cast("long").alias("juan"), F.trim("line").alias("text_raw"),
        F.concat(xml_id, F.lit(".xml")).alias("path"), (F.col("at") + 1).cast("long").alias("seq"),
    )
    out = out.withColumn("text_norm", strip_punct(F.col("text_raw")))
    return out.withColumns(
        {"norm_hash": norm_hash(F.col("text_norm")), "citation": citation(F.col("line_id"), F.col("tag"), LABEL), "n_chars": F.length("text_norm"), "dl": token_count(F.col("text_norm"))}
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    canon, number = F.upper(F.substring("lang", 1, 1)), F.lpad(F.col("doc_id").cast("string"), 6, "0")
    return docs.join(labels, "doc_id", "left").select(
        F.concat(canon, number).alias("work_id"), canon.alias("canon"), F.concat(canon, F.substring("source", 4, 99), F.lit("n"), number, F.lit(".xml")).alias("path"),
        F.concat(F.lit("doc "), F.col("doc_id")).alias("title"), F.col("source").alias("author"), F.lit("").alias("dynasty"),
        F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("category"), F.col("lang").alias("work_type"),
    )


def _escaped(text: str) -> str:
    return text.replace("'", "''")


#: The same in SQL: ``l0`` to ``lines`` and ``catalog``.
LINES_SQL = f"""l0 AS (SELECT doc_id, source, upper(substring(lang, 1, 1)) AS canon, i - 1 AS at_, trim(string_split(text, chr(10))[i], ' ') AS text_raw
    FROM documents, range(1, 1 + len(string_split(text, chr(10)))) t(i)),
l1 AS (SELECT *, canon || substring(source, 4) || 'n' || lpad(doc_id::VARCHAR, 6, '0') AS xml_id, canon || lpad(doc_id::VARCHAR, 6, '0') AS work_id,
    lpad((at_ // {PAGE} + 1)::VARCHAR, 4, '0') || substring('abc', ((at_ % {PAGE}) // {COLUMN} + 1)::INT, 1) || lpad(((at_ % {PAGE}) % {COLUMN} + 1)::VARCHAR, 2, '0') AS lb,
    translate(text_raw, '{_escaped(PUNCT)}', '') AS text_norm FROM l0),
lines AS (SELECT xml_id || '_p' || lb AS line_id, work_id, canon, 'doc ' || doc_id AS title, source AS author, '{TAG}' AS tag, (at_ // {CHAPTER} + 1)::BIGINT AS juan,
    text_raw, text_norm, sha256(text_norm) AS norm_hash,
    '({LABEL} 2026.R2, ' || canon || substring(source, 4) || ', no. ' || lpad(doc_id::VARCHAR, 6, '0') || ', p. ' || (at_ // {PAGE} + 1) || ', ' || substring(lb, 5) || ')' AS citation,
    xml_id || '.xml' AS path, (at_ + 1)::BIGINT AS seq, length(text_norm)::INT AS n_chars,
    (CASE length(text_norm) WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 * length(text_norm) - 3 END)::INT AS dl FROM l1)"""
CATALOG_SQL = """catalog AS (SELECT upper(substring(d.lang, 1, 1)) || lpad(d.doc_id::VARCHAR, 6, '0') AS work_id, upper(substring(d.lang, 1, 1)) AS canon,
    upper(substring(d.lang, 1, 1)) || substring(d.source, 4) || 'n' || lpad(d.doc_id::VARCHAR, 6, '0') || '.xml' AS path, 'doc ' || d.doc_id AS title, d.source AS author,
    '' AS dynasty, coalesce(l.quality::VARCHAR, '') AS category, d.lang AS work_type FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
