"""Corpus to artifact: files that are unchanged keep their parsed lines, the others are parsed again."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import catalog as cat
from quire.schema import CATALOG, LINES, WORKS, require
from quire.sinks import publish
from quire.sources import corpus, tei


class BuildError(corpus.CorpusError):
    pass


def assemble(parsed: DataFrame, catalog: DataFrame, tag: str, label: str, to_traditional: Mapping[str, str] = {}, gaiji: Mapping[str, str] = {}) -> DataFrame:
    """Parsed lines (path, seq, line_id, work_id, juan, text_raw) and their catalog rows as index lines.

    Titles and authors are always the catalog's of today, reused lines or not.
    """
    about = catalog.select("path", F.col("work_id").alias("catalog_work"), "title", "author")
    joined = parsed.join(about, "path")
    keyed = joined.withColumn("text_norm", tx.search_key(F.col("text_raw"), to_traditional, gaiji))
    told = keyed.withColumns(
        {
            "tag": F.lit(tag), "canon": tx.canon_of(F.col("work_id")), "norm_hash": tx.norm_hash(F.col("text_norm")),
            "citation": tx.citation(F.col("line_id"), F.lit(tag), label), "n_chars": F.length("text_norm"), "dl": tx.token_count(F.col("text_norm")),
        }
    )
    return require(told, LINES)


def selected_files(spark: SparkSession, scope: Path, manifest: corpus.Manifest) -> DataFrame:
    """Listed files with a catalog row, without skipped canons; a path that leaves the corpus is an error."""
    listed = corpus.read_file_list(spark, str(scope / "files.txt"))
    outside = listed.where(~corpus.below(F.col("path"))).select("path").take(1)
    if outside:
        raise BuildError(f"path outside the corpus: {outside[0]['path']}")
    rows = corpus.read_catalog(spark, str(scope / "catalog.jsonl"))
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    last = placed.groupBy("path").agg(F.max_by(F.struct(*[f.name for f in CATALOG]), "_at").alias("r")).select("r.*")
    return cat.selected(listed, last, (*tx.SKIPPED_CANONS, *manifest.exclude_canons))


def write_index(lines: DataFrame, folder: Path) -> tuple[DataFrame, dict]:
    """Lines, and how many of them have each gram of one or two characters, in the order of grams so that a lookup reads few row groups.

    Returns the lines as written, and their number and mean length.
    """
    publish.write_lines(lines, folder)
    written = lines.sparkSession.read.schema(LINES).parquet(f"file://{folder}/lines")
    each = written.select(F.explode(F.array_distinct(F.concat(tx.grams(F.col("text_norm"), 1), tx.grams(F.col("text_norm"), 2)))).alias("gram"))
    publish.write_grams(each.groupBy("gram").agg(F.count("*").alias("df")), folder)
    row = written.agg(F.count("*").alias("lines"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("mean_length")).first()
    return written, row.asDict()


def index_lines(lines: DataFrame, catalog: DataFrame, index_root: str, meta: Mapping[str, object]) -> Path:
    """Publish lines that are parsed already, with their catalog, as the current index; ``meta`` has tag and scope_hash."""
    root, name = Path(index_root), f"{meta['tag']}-{meta['scope_hash']}"
    with publish.single_writer(root):
        aside = publish.stage(root, name)
        written, size = write_index(require(lines, LINES), aside)
        require(catalog, CATALOG).write.parquet(f"file://{aside}/catalog")
        publish.write_json(aside / "meta.json", {"scope": "", **meta, "work_count": cat.work_count(written)} | size)
        return publish.publish(root, name, aside)


def xml_root(corpus_root: Path) -> Path:
    for found in (corpus_root / "xml-p5", corpus_root / "src" / "xml-p5"):
        if found.is_dir():
            return found
    raise BuildError(f"no documents below {corpus_root}")


def build(spark: SparkSession, corpus_root: str, scope: str, index_root: str, golden: str | None = None, gaiji: Mapping[str, str] = {}, traditional: bool = True) -> Path:
    """Build a scope and make it current; a failed build leaves the current one as it is.

    ``golden`` is an id that must be among the lines if its work is in the catalog.
    """
    base, root = Path(corpus_root) / "scopes" / corpus.require_segment(scope), Path(index_root)
    manifest = corpus.read_manifest(str(base / "MANIFEST.json"))
    with publish.single_writer(root):
        files = selected_files(spark, base, manifest).cache()
        documents = tei.read_files(spark, f"file://{xml_root(Path(corpus_root)).resolve()}")
        have = documents.join(files.select("path", "work_id"), "path")
        previous = publish.read_current(root)
        parsed, reused = have, None
        if previous and (root / previous / "works").is_dir():
            works = spark.read.schema(WORKS).parquet(f"file://{root / previous}/works")
            keyed = have.select("path", "work_id", "xml_sha256")
            same = cat.unchanged(keyed, works).select("path")
            old = spark.read.schema(LINES).parquet(f"file://{root / previous}/lines").join(same, "path", "left_semi")
            reused = old.select("path", "seq", "line_id", "work_id", "juan", "text_raw")
            parsed = have.join(same, "path", "left_anti")
        lines = tei.read_lines(parsed)
        aside = publish.stage(root, manifest.artifact)
        lines.write.parquet(f"file://{aside}/parsed")
        lines = spark.read.parquet(f"file://{aside}/parsed")
        broken = lines.where("error is not null").select("path", "error").limit(1).collect()
        if broken:
            raise BuildError(f"{broken[0]['path']}: {broken[0]['error']}")
        whole = lines.select("path", "seq", "line_id", "work_id", "juan", "text_raw")
        whole = whole.unionByName(reused) if reused is not None else whole
        script = tx.script_map(spark, "Hans-Hant") if traditional else {}
        written, size = write_index(assemble(whole, files, manifest.tag, manifest.label, script, gaiji), aside)
        if golden:
            work = tx.work_of_text(golden.partition("_p")[0])
            expected = files.where(F.col("work_id") == work).limit(1).count()
            if expected and not written.where(F.col("line_id") == golden).limit(1).count():
                raise BuildError(f"line {golden} is missing from the build")
        counts = cat.line_counts(written).withColumnRenamed("work_id", "_w")
        works = have.select("path", "work_id", "xml_sha256").join(counts.select("path", "line_count"), "path", "left")
        require(works.withColumn("line_count", F.coalesce("line_count", F.lit(0))), WORKS).write.parquet(f"file://{aside}/works")
        require(files, CATALOG).write.parquet(f"file://{aside}/catalog")
        count = cat.work_count(spark.read.parquet(f"file://{aside}/works"), manifest.work_count)
        publish.write_json(aside / "meta.json", {"tag": manifest.tag, "scope": manifest.scope, "scope_hash": manifest.scope_hash, "work_count": count, "label": manifest.label} | size)
        files.unpersist()
        return publish.publish(root, manifest.artifact, aside)
