"""Shared plumbing of the operators: tables, durable cuts of the lineage, components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set, a temporary one of a local session (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quire-checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def quoted(columns: list[str]) -> list[Column]:
    """Columns by names that may hold dots."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def carried(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, so that no name in a plan clashes with one of the caller's."""
    return F.struct(*quoted(docs.columns))


def restored(columns: list[str], row: str = "row", **replaced: Column) -> list[Column]:
    """The columns that ``carried`` packed, some of them replaced."""
    return [replaced[c].alias(c) if c in replaced else F.col(row).getField(c).alias(c) for c in columns]


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more.

    The first collection lets go of what Python held, the second of what that held.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    pa.default_memory_pool().release_unused()


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder, with options of the writer, and read it back.

    The result has no lineage, so a lost executor costs no recomputation of what
    came before, and what was written (hash salts, arbitrary choices) stays fixed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.options(**options).parquet(path)
    del df
    out = spark.read.schema(schema).parquet(path)
    out._cut = path
    return out


def free(*frames: DataFrame) -> None:
    """Delete the files behind tables that ``cut`` made and no later plan reads."""
    for df in frames:
        if path := getattr(df, "_cut", None):
            spark = df.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components: ``nodes(id)``, ``edges(a, b)`` to ``(id, component_id)``.

    Alternates large-star and small-star steps, each a map-side combined minimum
    and an equi-join, until the edges are stars around each component's smallest
    id.  Every round is cut to the shared folder; only two counters reach the driver.
    """
    stars = cut(
        edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct()
    )
    before = None
    for _ in range(max_rounds):
        both = stars.select("u", "v").unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = cut(
            both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = cut(
            joined.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        free(large)
        free(stars)
        stars = small
        now = stars.agg(F.count("*"), F.countDistinct("u"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 30)))).first()
        if now == before and now[0] == now[1]:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return nodes.join(stars.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select(
        "id", F.coalesce("root", "id").alias("component_id")
    )
