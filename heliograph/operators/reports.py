"""Queries users compose from the operators: histograms, top lists, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.functions.cdxj import field_path, payload_is_object
from heliograph.functions.surt import surt_parts


def histogram(captures: DataFrame, value: F.Column, name: str = "value") -> DataFrame:
    """How often each value occurs, most frequent first; null is a value of its own."""
    return captures.groupBy(value.alias(name)).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc_nulls_last(name))


def field_histogram(captures: DataFrame, field: str, json: str = "json") -> DataFrame:
    return histogram(captures, F.get_json_object(json, field_path(field)))


def missing_fields(captures: DataFrame, fields: list[str], json: str = "json") -> DataFrame:
    """Per field: ``field, n_present, n_missing``; a null member is present."""
    names = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    counts = captures.agg(F.count("*").alias("n"), *(F.count_if(F.array_contains(names, f)).alias(f"hg_{i}") for i, f in enumerate(fields)))
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"hg_{i}").alias("n_present"), (F.col("n") - F.col(f"hg_{i}")).alias("n_missing")) for i, f in enumerate(fields)))
    return counts.select(F.inline(rows))


def captures_per_domain(captures: DataFrame, top: int = 20, surt: str = "surt") -> DataFrame:
    return histogram(captures, F.substring_index(surt, ")", 1), "domain").limit(top)


def largest_responses(captures: DataFrame, top: int = 20, json: str = "json", columns: tuple[str, ...] = ("surt", "ts")) -> DataFrame:
    size = F.get_json_object(json, "$.length").try_cast("long").alias("length")
    return captures.select(*columns, size).where("length is not null").orderBy(F.desc("length"), *columns).limit(top)


def keys_below(captures: DataFrame, prefix: str, surt: str = "surt") -> DataFrame:
    """Distinct keys under a prefix."""
    return captures.where(F.col(surt).startswith(prefix)).select(surt).distinct()


def repeated_captures(captures: DataFrame, surt: str = "surt", ts: str = "ts") -> DataFrame:
    return captures.groupBy(surt, ts).agg(F.count("*").alias("count")).where("count > 1")


def replay_urls(captures: DataFrame, base: str, ts: str = "ts", json: str = "json") -> DataFrame:
    """``url``: where each capture is replayed; captures without a URL have none."""
    url = F.get_json_object(json, "$.url")
    return captures.withColumn("replay_url", F.when(url.isNotNull(), F.concat_ws("/", F.lit(base.rstrip("/")), ts, url)))


def with_surt_parts(captures: DataFrame, surt: str = "surt") -> DataFrame:
    return captures.withColumns(surt_parts(F.col(surt)))


def quality_label(status) -> F.Column:
    """A label from the HTTP status: high for success, medium for a redirect, else low."""
    code = status.try_cast("int")
    return F.when(code.between(200, 299), "high").when(code.between(300, 399), "medium").when(code.isNull(), "unknown").otherwise("low")


def per_year(captures: DataFrame, ts: str = "ts") -> DataFrame:
    return captures.groupBy(F.substring(ts, 1, 4).alias("year")).agg(F.count("*").alias("count"))


def per_month(captures: DataFrame, ts: str = "ts") -> DataFrame:
    return captures.groupBy(F.substring(ts, 1, 4).alias("year"), F.substring(ts, 5, 2).alias("month")).agg(F.count("*").alias("count"))


def validation(captures: DataFrame, surt: str = "surt", ts: str = "ts", json: str = "json") -> DataFrame:
    """One row: lines, lines of two parts or more, with a 14-digit time, with a payload
    that is an object."""
    return captures.agg(
        F.count("*").alias("n_lines"),
        F.count_if(F.col(surt).isNotNull() & F.col(ts).isNotNull()).alias("n_parts"),
        F.count_if(F.col(ts).rlike("^[0-9]{14}$")).alias("n_times"),
        F.count_if(F.coalesce(payload_is_object(F.col(json)), F.lit(False))).alias("n_payloads"),
    )


def percent(part: int, whole: int) -> float:
    return round(100 * part / whole, 1) if whole else 0.0
