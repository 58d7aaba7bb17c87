"""Column layout shared by sources, operators and sinks.

A capture is ``surt, ts, json`` plus the raw line ``value`` it came from, and the place
it came from: ``src_path, src_block, src_pos``.  The place is the order key of every
operator that keeps "the first" of something, since tables have no order of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = ("src_path", "src_block", "src_pos")

CAPTURE = T.StructType(
    [
        T.StructField("value", T.StringType()),
        T.StructField("surt", T.StringType()),
        T.StructField("ts", T.StringType()),
        T.StructField("json", T.StringType()),
        T.StructField("src_path", T.StringType()),
        T.StructField("src_block", T.LongType()),
        T.StructField("src_pos", T.LongType()),
    ]
)
IDX = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("shard_num", T.IntegerType()),
    ]
)
LOC = T.StructType([T.StructField("shard", T.StringType()), T.StructField("path", T.StringType())])
PATH_INDEX = T.StructType([T.StructField("filename", T.StringType()), T.StructField("path", T.StringType())])


def order_columns(df: DataFrame) -> list[F.Column]:
    """The order columns that ``df`` has; without any, the raw line."""
    return [F.col(c) for c in ORDER if c in df.columns] or [F.col(c) for c in ("value",) if c in df.columns]
