"""New files as a stream: an extension of the incremental refresh for folders that only grow.

A file stream never reports a deleted file, so it cannot replace the diff of two snapshots; it
chunks what is new and appends it to a table that search operators can read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symdex import schema
from symdex.functions.paths import has_indexed_size, is_indexed_name, skipped_by_name, skipped_by_parent
from symdex.functions.skip import skip_reason
from symdex.operators.chunks import chunk_files
from symdex.sources.corpus import relative, with_text

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def new_files(spark: SparkSession, root: str) -> DataFrame:
    """The stream of files below a folder that pass the name, folder and size tests (schema FILE)."""
    df = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").load(root).where(has_indexed_size(F.col("length")))
    df = df.select(relative(F.col("path"), root).alias("file_path"), (F.unix_micros("modificationTime") / 1e6).alias("file_mtime"), F.col("length").alias("file_size"), "content")
    parts = F.split("file_path", "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return df.where(is_indexed_name(F.col("file_path")) & ~skipped_by_name(dirs) & ~skipped_by_parent(dirs))


def ingest(spark: SparkSession, root: str, target: str, checkpoint: str) -> StreamingQuery:
    """Chunk all files that have come since the last run and append them to `target` (schema CHUNK), then stop.

    The checkpoint makes a repeated or broken run write each file once: every batch has a folder of
    its own, which a repetition replaces.
    """

    def write(batch: DataFrame, number: int) -> None:
        files = batch.where(skip_reason(F.col("file_path"), F.col("content")).isNull())
        chunk_files(with_text(files).select("file_path", "text", "file_mtime")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return new_files(spark, root).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chunks(spark: SparkSession, target: str) -> DataFrame:
    """All chunks that have been taken in."""
    return spark.read.schema(schema.CHUNK).parquet(f"{target}/batch=*")
