"""Lookups: key match, time range, field predicates, sort, distinct-on and limit."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions import timestamps
from heliograph.functions.cdxj import field_text, payload_is_object
from heliograph.functions.patterns import guarded, to_jvm
from heliograph.schema import order_columns

MAX_KEY, MAX_FILTER = 10_000, 2_000
#: Longer operators first: ``!~`` contains ``~`` and ``!=`` contains ``=``.
OPERATORS = ("!~", "~", "!=", "=")
MATCH_TYPES = ("exact", "prefix", "domain", "subdomains")


def match_key(key: str, match_type: str = "exact") -> tuple[str, bool]:
    """The key to look up and whether it is a prefix.

    ``domain`` matches the host itself with all its paths, ``subdomains`` everything below the
    host but not the host itself; a key without ``)`` is a plain prefix for both.
    """
    if not key or len(key) > MAX_KEY or "\0" in key:
        raise ValueError("a search key has 1 to 10000 characters and no NUL")
    if match_type in ("domain", "subdomains"):
        host, close, _ = key.partition(")")
        return (host + (")" if match_type == "domain" else ",") if close else key), True
    return key, match_type == "prefix"


def key_predicate(key: str, match_type: str = "exact", column: str = "surt") -> F.Column:
    """Pushed to the scan as an equality or as a prefix, where min/max statistics of
    files sorted by key play the part of a sparse index."""
    wanted, prefix = match_key(key, match_type)
    return F.col(column).startswith(wanted) if prefix else F.col(column) == wanted


@dataclass(frozen=True)
class FieldRule:
    field: str
    op: str
    value: str

    @staticmethod
    def parse(expression: str) -> FieldRule:
        if len(expression) > MAX_FILTER or "\0" in expression:
            raise ValueError("a filter has at most 2000 characters and no NUL")
        for op in OPERATORS:
            field, found, value = expression.partition(op)
            if found:
                rule = FieldRule(field.strip(), op, value.strip())
                if "~" in op:
                    guarded(rule.value)
                return rule
        raise ValueError(f"not a filter expression: {expression}")

    def predicate(self, json: str = "json") -> F.Column:
        """Missing and null fields satisfy no rule, not even a negated one."""
        text = field_text(F.col(json), self.field)
        if self.op == "=":
            return text == self.value
        if self.op == "!=":
            return text != self.value
        found = text.rlike(to_jvm(self.value))
        return found if self.op == "~" else ~found


def field_predicate(expressions: list[str], json: str = "json") -> F.Column | None:
    """All rules together; a payload that is no object satisfies none."""
    # The payload is checked last, for what is left.
    rules = [F.coalesce(FieldRule.parse(e).predicate(json), F.lit(False)) for e in expressions]
    return reduce(lambda a, b: a & b, [*rules, payload_is_object(F.col(json))]) if rules else None


def sort_captures(captures: DataFrame) -> DataFrame:
    """By key and time; equal ones stay in source order."""
    return captures.orderBy("surt", "ts", *order_columns(captures))


def first_per_capture(captures: DataFrame) -> DataFrame:
    """Keeps the first row of each (surt, ts) in source order.

    Rows without key or time are all kept.  The rank limit is applied before the
    exchange too, so a hot (surt, ts) sends one row per task.
    """
    order = order_columns(captures) or [F.lit(0)]
    rank = F.row_number().over(Window.partitionBy("surt", "ts").orderBy(*order))
    whole = captures.where("surt is not null and ts is not null")
    kept = whole.withColumn("hg_rank", rank).where("hg_rank = 1").drop("hg_rank")
    return kept.unionByName(captures.where("surt is null or ts is null"))


def search(
    captures: DataFrame,
    key: str,
    match_type: str = "exact",
    *,
    from_ts: str | None = None,
    to_ts: str | None = None,
    filters: list[str] | None = None,
    where: Column | None = None,
    sort: bool = False,
    dedupe: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Captures of a key, restricted by inclusive time bounds, field rules and a condition.

    Arguments are checked at once.  With any restriction a capture must have a payload;
    with field rules the payload must be a JSON object.  ``where`` is
    any condition on the captures' columns.  Order of application: filter,
    first per (surt, ts), sort, limit.  ``limit`` 0 or None means all; with a limit and no
    ``sort`` the first rows in source order come out.
    """
    found = captures.where(key_predicate(key, match_type))
    period = timestamps.between(F.col("ts"), from_ts, to_ts)
    rules = field_predicate(filters or [])
    if period is not None or rules is not None:
        found = found.where("json is not null")
    for condition in (period, rules, where):
        if condition is not None:
            found = found.where(condition)
    if dedupe:
        found = first_per_capture(found)
    if sort:
        found = sort_captures(found)
    elif limit:
        found = found.orderBy(*order_columns(found))
    return found.limit(limit) if limit else found
