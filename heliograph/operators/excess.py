"""Keys with too many captures: finding, removing, and both at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.runtime import materialise

DEFAULT_THRESHOLD = 1000
#: A list of keys up to this size is broadcast; a larger one is joined by shuffle.
BROADCAST_KEYS, BROADCAST_BYTES = 1_000_000, 64 << 20


def key_counts(captures: DataFrame, key: str = "surt") -> DataFrame:
    """``surt, count``; blank keys are not counted.  Hot keys are combined on the map side."""
    counted = captures.where(F.trim(F.col(key)) != "").groupBy(F.col(key).alias("surt"))
    return counted.agg(F.count("*").alias("count"))


def excessive_find(captures: DataFrame, threshold: int = DEFAULT_THRESHOLD, key: str = "surt") -> DataFrame:
    """Keys with strictly more than ``threshold`` captures."""
    return key_counts(captures, key).where(F.col("count") > threshold)


def by_count(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("count"), "surt")


def excessive_remove(captures: DataFrame, keys: DataFrame, key: str = "surt") -> DataFrame:
    """Captures whose key is not listed; those without a key stay.

    The keys to remove are the hot ones, so their rows must not meet in one task: the
    list is broadcast if it is small.  A longer list is joined by shuffle, where its keys
    cannot hold much each, and adaptive execution splits what is left of skew.
    """
    # Stored: its size is asked for before it is joined, and finding it may have taken a count of everything.
    listed = materialise(keys.select(F.col("surt").alias("hg_key")).where("hg_key is not null").distinct(), "listed")
    size = listed.limit(BROADCAST_KEYS + 1).agg(F.count("*").alias("n"), F.sum(F.octet_length("hg_key")).alias("b")).first()
    if size.n <= BROADCAST_KEYS and (size.b or 0) <= BROADCAST_BYTES:
        listed = F.broadcast(listed)
    return captures.join(listed, F.col(key) == F.col("hg_key"), "left_anti")


def excessive_auto(captures: DataFrame, threshold: int = DEFAULT_THRESHOLD, key: str = "surt") -> DataFrame:
    return excessive_remove(captures, excessive_find(captures, threshold, key), key)


def threshold_sweep(captures: DataFrame, thresholds: list[int], key: str = "surt") -> DataFrame:
    """``threshold, n_keys, n_captures`` above each threshold, from one count per key."""
    counts = key_counts(captures, key)
    levels = F.array(*(F.lit(t) for t in sorted(set(thresholds))))
    passed = counts.select("count", F.explode(F.filter(levels, lambda t: F.col("count") > t)).alias("threshold"))
    found = passed.groupBy("threshold").agg(F.count("*").alias("n_keys"), F.sum("count").alias("n_captures"))
    every = captures.sparkSession.createDataFrame([(t,) for t in sorted(set(thresholds))], "threshold int")
    return every.join(F.broadcast(found), "threshold", "left").fillna(0, ["n_keys", "n_captures"])
