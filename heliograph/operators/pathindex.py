"""Path indexes: from lists of archives, upserts, and resolving captures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.functions.cdxj import field_path
from heliograph.schema import order_columns


def arclist_to_path_index(lines: DataFrame, column: str = "value") -> DataFrame:
    """``filename, path`` of every line that is neither blank nor a comment: what follows the
    last ``/``, and the line itself.  Other columns stay, so the place is kept."""
    from heliograph.sources.flat import content_lines

    rows = content_lines(lines, column)
    place = [c for c in lines.columns if c not in (column, "filename", "path")]
    return rows.select(F.substring_index(column, "/", -1).alias("filename"), F.col(column).alias("path"), *place)


def path_index_lines(index: DataFrame, separator: str = "\t") -> DataFrame:
    return index.select(F.concat_ws(separator, "filename", "path").alias("value"))


def upsert(index: DataFrame) -> DataFrame:
    """One row per file name, the last in source order; a blank name is no entry.

    With no place columns the greatest path counts.
    """
    order = order_columns(index) or [F.col("path")]
    named = index.where("filename <> ''").groupBy("filename")
    return named.agg(F.max_by("path", F.struct(*order)).alias("path"))


def resolve(captures: DataFrame, index: DataFrame, field: str = "filename", json: str = "json") -> DataFrame:
    """``captures`` with the ``path`` their payload's file lies at; null if it is unknown."""
    names = upsert(index).select(F.col("filename").alias("hg_file"), F.col("path").alias("hg_path"))
    keyed = captures.drop("path").withColumn("hg_name", F.get_json_object(json, field_path(field)))
    return keyed.join(names, F.col("hg_name") == F.col("hg_file"), "left").withColumn("path", F.col("hg_path")).drop("hg_name", "hg_file", "hg_path")
