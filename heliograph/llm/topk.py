"""Most frequent items among billions, exactly, by prefix refinement.

Values are grouped by leading bits of their hash.  The count of a group bounds the
count of every value in it from above.  Counting the values of the few heaviest
groups in full gives k real counts, whose least is a lower bound of the k-th
count; groups below it are dropped, the prefixes of the others are lengthened, until
the values themselves are counted.  No level holds more than ``max_groups`` groups,
however many distinct values there are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.runtime import materialise

FIRST_BITS = 12


def _prefix(bits: int) -> F.Column:
    return F.shiftrightunsigned("hash", 64 - bits)


def _within(values: DataFrame, groups: DataFrame, bits: int) -> DataFrame:
    """Rows whose prefix is among ``groups``: at most ``max_groups`` longs, so broadcast."""
    return values.join(F.broadcast(groups.select("prefix")), _prefix(bits) == F.col("prefix"), "left_semi")


def _first(values: DataFrame, k: int) -> DataFrame:
    return values.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def most_frequent(rows: DataFrame, column: str, k: int, *, max_groups: int = 1 << 20) -> DataFrame:
    """The ``k`` most frequent non-null values: ``value, n``, the counts exact.

    Ties at the k-th place go to the value that sorts first.  With fewer than ``k``
    distinct values all come out; an empty table gives no row.  If all values are about
    equally frequent no bound can exclude any prefix; then the last count runs over all
    that remain, as a spilling aggregation.
    """
    values = rows.select(F.col(column).alias("value")).where("value is not null").withColumn("hash", F.xxhash64("value"))
    bits, bound, remaining, previous = min(FIRST_BITS, int(math.log2(max_groups))), 1, values, None
    while True:
        groups = materialise(remaining.groupBy(_prefix(bits).alias("prefix")).agg(F.count("*").alias("n")), "prefixes")
        heaviest = groups.orderBy(F.desc("n"), "prefix").limit(2 * k)
        probed = _first(_within(values, heaviest, bits), k).collect()  # k rows
        if len(probed) == k:
            bound = max(bound, probed[-1]["n"])
        kept = groups.where(F.col("n") >= bound)
        left = kept.count()
        remaining = _within(values, kept, bits)
        step = int(math.log2(max_groups / max(left, 1)))
        # Longer prefixes help while light groups are left and the next level fits.
        if left <= 4 * k or step < 4 or bits + step > 60 or left == previous:
            return _first(remaining, k)
        previous, bits = left, bits + min(step, 12)
