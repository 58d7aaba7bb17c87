"""Per-key results although a few keys hold most rows, by eager aggregation.

Both inputs of a join are reduced to one compact state per join key before they
meet, on the map side first, so a key with a third of all rows costs a row per
map task and not a task of its own.  Counts of joined rows are products of counts,
sums are scaled by the other side's count, and the states roll up to coarser keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: measure -> (partial over rows, roll-up over states)
MEASURES = {"sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max), "count": (F.count, F.sum)}


def compact(rows: DataFrame, on: list[str], measures: dict[str, tuple[str, str]], count_as: str) -> DataFrame:
    """One state per key: the number of rows and the given measures.

    measures: result column -> (``sum``/``min``/``max``/``count``, source column).
    """
    aggregates = [MEASURES[kind][0](F.col(column)).alias(name) for name, (kind, column) in measures.items()]
    return rows.groupBy(*on).agg(F.count(F.lit(1)).alias(count_as), *aggregates)


def eager_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_measures: dict[str, tuple[str, str]] | None = None,
    right_measures: dict[str, tuple[str, str]] | None = None,
    how: str = "inner",
) -> DataFrame:
    """Per key: ``left_rows``, ``right_rows``, ``joined_rows`` and the measures of each side.

    ``joined_rows`` is the size of the plain join's group; the measures are those of the
    side itself (``joined_measures`` turns sums into sums over joined rows).  Null keys
    match null keys.  ``how`` is ``inner``, ``left`` or ``full``; a side without the key
    counts 0 rows and gives null measures.  Only the key and measured columns are read.
    """
    left_measures, right_measures = left_measures or {}, right_measures or {}
    if set(left_measures) & set(right_measures):
        raise ValueError("a measure's name is used twice")
    a = compact(left, on, left_measures, "left_rows").alias("a")
    b = compact(right, on, right_measures, "right_rows").alias("b")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in on))
    zero = F.lit(0).cast("long")
    joined = a.join(b, same, how).select(
        *((F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")) if how == "full" else F.col(f"a.{k}")).alias(k) for k in on),
        F.coalesce("left_rows", zero).alias("left_rows"),
        F.coalesce("right_rows", zero).alias("right_rows"),
        *left_measures,
        *right_measures,
    )
    return joined.withColumn("joined_rows", F.col("left_rows") * F.col("right_rows"))


def joined_measures(states: DataFrame, left_sums: list[str] = (), right_sums: list[str] = ()) -> DataFrame:
    """Sums as they are over the joined rows: each scaled by the other side's count."""
    for name in left_sums:
        states = states.withColumn(name, F.col(name) * F.col("right_rows"))
    for name in right_sums:
        states = states.withColumn(name, F.col(name) * F.col("left_rows"))
    return states


def roll_up(states: DataFrame, by: list, measures: dict[str, str]) -> DataFrame:
    """Combines states to coarser keys; measures: column -> ``sum``/``min``/``max``/``count``."""
    return states.groupBy(*by).agg(*(MEASURES[kind][1](F.col(name)).alias(name) for name, kind in measures.items()))


def key_statistics(rows: DataFrame, key: str, distinct: F.Column, low_high: str) -> DataFrame:
    """Per key: ``n_rows``, ``n_distinct`` of an expression, and the least and greatest of a column.

    The rows and the distinct (key, value) pairs are two inputs with the key in common.
    Joined plainly, a key with n rows and d values would give n * d rows; here each side
    is one state per key before the join.  The pairs are spread by key and value, so a
    hot key's values are counted by all tasks.  Null keys form one group; null values are
    no value.
    """
    pairs = rows.select(key, distinct.alias("value")).where("value is not null").distinct()
    states = eager_join(rows, pairs, [key], {"first": ("min", low_high), "last": ("max", low_high)}, how="left")
    return states.select(key, F.col("left_rows").alias("n_rows"), F.col("right_rows").alias("n_distinct"), "first", "last")


def heavy_keys(statistics: DataFrame, key: str, total: int, least_share: float) -> DataFrame:
    """Keys holding at least ``least_share`` of ``total`` rows; a null key is none."""
    return statistics.where(F.col(key).isNotNull() & (F.col("n_rows") / F.lit(total) >= F.lit(least_share))).withColumn("share", F.col("n_rows") / F.lit(total))
