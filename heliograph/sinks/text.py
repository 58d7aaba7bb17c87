"""Text sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.runtime import delete_path, scratch_path


def write_lines(lines: DataFrame, path: str, column: str = "value", compression: str = "none") -> None:
    """A folder of text files, in the order of the frame."""
    lines.select(F.coalesce(column, F.lit("")).alias("value")).write.mode("overwrite").text(path, compression=compression)


def write_one_file(lines: DataFrame, path: str, column: str = "value") -> int:
    """One local file in the frame's order; lines stream through, none are held.

    Returns the number of lines.  The file appears under its name when complete.
    """
    count = 0
    with open(path + ".tmp", "w", encoding="utf-8") as out:
        for row in lines.select(column).toLocalIterator(prefetchPartitions=True):
            out.write((row[0] or "") + "\n")
            count += 1
    os.replace(path + ".tmp", path)
    return count


def rewrite_parquet(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replaces a Parquet folder that ``rows`` may be read from."""
    spark = rows.sparkSession
    draft = scratch_path(spark, "rewrite")
    writer = rows.write.partitionBy(*partition_by) if partition_by else rows.write
    writer.parquet(draft)
    back = spark.read.parquet(draft).write.mode("overwrite")
    (back.partitionBy(*partition_by) if partition_by else back).parquet(path)
    delete_path(spark, draft)


def captures_table(captures: DataFrame, path: str, collection: str | None = None, partitions: int | None = None) -> None:
    """Captures as Parquet sorted by key, so that min/max statistics select row groups.

    With the name of a collection the table is partitioned by it and only that partition
    is replaced.
    """
    by = [partitions, "surt", "ts"] if partitions else ["surt", "ts"]
    ordered = captures.repartitionByRange(*by).sortWithinPartitions("surt", "ts")
    if collection is None:
        ordered.write.mode("overwrite").parquet(path)
    else:
        named = ordered.withColumn("collection", F.lit(collection))
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)


def write_by_period(captures: DataFrame, path: str, months: bool = False) -> None:
    """One folder per year, or per year and month, each sorted by key.

    A period's rows are spread by key, so a year with most captures is written by several
    tasks.
    """
    periods = {"year": F.substring("ts", 1, 4)} | ({"month": F.substring("ts", 5, 2)} if months else {})
    dated = captures.withColumns(periods).repartitionByRange(*periods, "surt", "ts").sortWithinPartitions(*periods, "surt", "ts")
    dated.write.mode("overwrite").partitionBy(*periods).parquet(path)
