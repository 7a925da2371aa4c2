"""Catalog, works and releases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import release_order
from quire.plans.filters import Filters, of_catalog


def entries(catalog: DataFrame, tag: str, scope_hash: str, filters: Filters = Filters()) -> DataFrame:
    kept = catalog.where(of_catalog(filters)).orderBy("work_id", "path")
    return kept.select("work_id", "title", "author", "dynasty", "category", "work_type", F.lit(tag).alias("tag"), F.lit(scope_hash).alias("scope_hash"))


def selected(listed: DataFrame, catalog: DataFrame, skipped: tuple[str, ...]) -> DataFrame:
    """Listed paths with their catalog rows, without those that have none and those of skipped canons."""
    return listed.join(catalog, "path").where(~F.col("canon").isin(*skipped))


def line_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("work_id", "path").agg(F.count("*").alias("line_count"))


def work_count(works: DataFrame, declared: int = 0) -> int:
    """The manifest's number where it gives one, else the number of files."""
    return declared if declared > 0 else works.select("path").distinct().count()


def ordered_tags(tags: DataFrame) -> DataFrame:
    return tags.orderBy(release_order(F.col("tag")), "tag")


def newest_tag(tags: DataFrame) -> str | None:
    row = tags.agg(F.max_by("tag", release_order(F.col("tag"))).alias("tag")).first()
    return row["tag"] if row else None


def common_tags(remote: DataFrame, pinned: DataFrame) -> DataFrame:
    return remote.select("tag").intersect(pinned.select("tag"))


def prunable(tags: DataFrame, current: str | None) -> DataFrame:
    return tags.select("tag").distinct().where(~F.col("tag").eqNullSafe(F.lit(current))).orderBy("tag")


def unchanged(files: DataFrame, works: DataFrame) -> DataFrame:
    """Files (path, work_id, xml_sha256) whose lines can be taken from the last build."""
    return files.join(works, ["path", "work_id", "xml_sha256"], "left_semi")


def changed(files: DataFrame, works: DataFrame) -> DataFrame:
    return files.join(works, ["path", "work_id", "xml_sha256"], "left_anti")
