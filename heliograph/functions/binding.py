"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F


def let(value: F.Column, body: Callable[[F.Column], F.Column]) -> F.Column:
    """``body(value)`` with the value computed once.

    Columns are trees: a value used in several places, each in a branch of its own, would
    be repeated there, and nested uses multiply.
    """
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)
