"""A folder of documents as a stream of parsed lines: new files are parsed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.sources.tei import read_lines


def read_stream(spark: SparkSession, folder: str, glob: str = "*.xml", files_per_batch: int = 1000) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return read_lines(found.select(F.col("path"), "content"))


def append_to(lines: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Every file once: the checkpoint knows which were read, the sink which batches were written."""
    return lines.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
