"""Continuous ingestion of new capture files with Structured Streaming.

Picks up files whose paths it has not seen.  Files that are rewritten under a known path
need the file state of ``plans.collection.Collection``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heliograph.functions.cdxj import with_parts


def capture_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Lines of files that appear in ``folder``, as captures with their file's path."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.text(folder).select("value", F.col("_metadata.file_path").alias("src_path"), F.col("_metadata.file_modification_time").alias("file_time"))
    return with_parts(lines).where("surt is not null and ts is not null")


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, max_files: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Appends new captures to a Parquet table by year; every line lands once."""
    stream = capture_stream(spark, folder, max_files).withColumn("year", F.substring("ts", 1, 4))
    writer = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).partitionBy("year").outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
