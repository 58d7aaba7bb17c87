"""14-digit timestamps, kept and compared as text."""

from __future__ import annotations

from pyspark.sql import functions as F

#: What a shorter timestamp is filled up with: January, the first, midnight.
FILL = "00000101000000"


def normalize(timestamp: str) -> str:
    """A bound as 14 digits; ValueError unless it consists of digits.

    Missing places are taken from FILL, surplus ones dropped, so ``2021`` is the first
    second of 2021, also as an upper bound.
    """
    if not timestamp.isdigit():
        raise ValueError(f"timestamp must consist of digits: {timestamp!r}")
    return (timestamp + FILL[len(timestamp) :])[:14]


def normalized(column) -> F.Column:
    """``normalize`` for a column; null where the text is not all digits."""
    fill = F.substring(F.lit(FILL), F.length(column) + 1, F.lit(14))
    return F.when(column.rlike("^[0-9]+$"), F.left(F.concat(column, fill), F.lit(14)))


def between(column, lower: str | None, upper: str | None) -> F.Column | None:
    """Both bounds are inclusive; None if there is none."""
    found = None
    if lower:
        found = column >= normalize(lower)
    if upper:
        top = column <= normalize(upper)
        found = top if found is None else found & top
    return found
