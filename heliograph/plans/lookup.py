"""Lookups over files of both kinds: flat capture files and clusters."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.surt import url_to_surt
from heliograph.operators.search import match_key, search
from heliograph.schema import CAPTURE
from heliograph.sources.flat import discover, read_captures, resolve_inputs
from heliograph.sources.zipnum import read_zipnum

log = logging.getLogger(__name__)


def surt_of(spark: SparkSession, url: str) -> str:
    key = spark.range(1).select(url_to_surt(F.lit(url))).first()[0]
    if key is None:
        raise ValueError(f"not a URL: {url!r}")
    return key


def lookup(spark: SparkSession, patterns: list[str], key: str | None = None, url: str | None = None, match_type: str = "exact", *, skip_errors: bool = False, **restrictions) -> DataFrame:
    """Captures from all files that ``patterns`` name; give either a key or a URL.

    FileNotFoundError if no pattern matches a file.  With ``skip_errors`` that gives an empty
    result, and an index that cannot be read is passed over.
    """
    if (key is None) == (url is None):
        raise ValueError("give either a key or a url")
    key = key if key is not None else surt_of(spark, url)
    match_key(key, match_type)
    files = discover(patterns)
    if not files and not skip_errors:
        raise FileNotFoundError(f"nothing matches {patterns}")
    flat, indexes = resolve_inputs(files)
    parts = [read_captures(spark, flat, invalid_utf8="skip")] if flat else []
    for idx in indexes:
        try:
            part = read_zipnum(spark, idx)
            part.schema  # noqa: B018  (plans the source, which finds a broken index now)
            parts.append(part)
        except Exception as e:
            if not skip_errors:
                raise
            log.warning("passed over %s: %s", idx, e)
    captures = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], CAPTURE)
    return search(captures, key, match_type, **restrictions)
