"""Text sources: capture lines, lists of archives, path indexes, pattern and key lists."""

from __future__ import annotations

import fnmatch
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.cdxj import stripped, with_parts
from heliograph.operators.blocklist import Blocklist
from heliograph.sources.paths import matching, walk

# Endings of files a directory is searched for, and what they hold.
FLAT, COMPRESSED, SPARSE = ".cdxj", ".cdxj.gz", ".idx"


def excluded(name: str, patterns: list[str]) -> str | None:
    """The first pattern that a file's base name matches."""
    base = os.path.basename(name)
    return next((p for p in patterns if fnmatch.fnmatch(base, p)), None)


def collect_files(paths: list[str], exclude: list[str] | None = None) -> list[str]:
    """Files as given, directories walked for all their files, in order; paths that do
    not exist are passed over.  Paths may be URIs of any file system."""
    found = [f for path in paths for f in walk(path) or []]
    return [f for f in found if excluded(f, exclude or []) is None]


def discover(patterns: list[str]) -> list[str]:
    """Index files: directories are searched for the known endings, other patterns are
    recursive globs.  Local ones absolute, all sorted, each once."""
    found: set[str] = set()
    for pattern in patterns:
        files = walk(pattern)
        if files is None:
            found.update(matching(pattern))
        else:
            found.update(files if files == [pattern] else [f for f in files if f.endswith((FLAT, COMPRESSED, SPARSE))])
    return sorted({os.path.abspath(f) if "://" not in f and not f.startswith("file:") else f for f in found})


def file_type(path: str) -> str:
    if path.endswith(SPARSE):
        return "zipnum_idx"
    return "zipnum_data" if path.endswith(COMPRESSED) else "cdxj"


def index_of_data(path: str) -> str:
    """The ``.idx`` beside compressed data."""
    index = path.removesuffix(COMPRESSED) + SPARSE
    if walk(index) != [index]:
        raise FileNotFoundError(index)
    return index


def resolve_inputs(paths: list[str]) -> tuple[list[str], list[str]]:
    """Flat files and cluster indexes; an index reached in two ways counts once."""
    flat = [p for p in paths if file_type(p) == "cdxj"]
    indexes = [index_of_data(p) if file_type(p) == "zipnum_data" else p for p in paths if file_type(p) != "cdxj"]
    return flat, list(dict.fromkeys(indexes))


def read_lines(spark: SparkSession, paths: list[str] | str, exact: bool = False) -> DataFrame:
    """Lines with their place: ``value, src_path, src_block, src_pos``.

    Lines end at ``\\n``, ``\\r\\n`` or ``\\r``, with ``exact`` at ``\\n`` only.  Compressed files are
    read through.  The place sorts as the lines stand in their files: splits of a file
    come in order of their start, lines of a split by a growing number.
    """
    reader = spark.read.option("lineSep", "\n") if exact else spark.read
    lines = reader.text(paths)
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("src_path"),
        F.col("_metadata.file_block_start").alias("src_block"),
        F.monotonically_increasing_id().alias("src_pos"),
    )


def read_captures(spark: SparkSession, paths: list[str] | str, invalid_utf8: str = "keep") -> DataFrame:
    """Capture files as CAPTURE rows; lines without two parts have null ``surt`` and ``ts``.

    invalid_utf8: ``keep`` the bytes, ``skip`` such lines, or ``repair`` them.
    """
    lines = read_lines(spark, paths)
    if invalid_utf8 == "skip":
        lines = lines.where(F.is_valid_utf8("value"))
    elif invalid_utf8 == "repair":
        lines = lines.withColumn("value", F.make_valid_utf8("value"))
    elif invalid_utf8 != "keep":
        raise ValueError("invalid_utf8 is keep, skip or repair")
    named = with_parts(lines)
    return named.select("value", "surt", "ts", "json", "src_path", "src_block", "src_pos")


def arclist_files(directory: str) -> list[str]:
    """The ``.txt`` files of a directory itself, sorted; ValueError if it is none."""
    files = walk(directory, recursive=False)
    if files is None or files == [directory]:
        raise ValueError(f"not a directory: {directory}")
    return [f for f in files if f.endswith(".txt")]


def content_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines stripped, without blank ones and ``#`` comments."""
    clean = lines.withColumn(column, stripped(F.col(column)))
    return clean.where((F.col(column) != "") & ~F.col(column).startswith("#"))


def read_arclist(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return content_lines(read_lines(spark, paths))


def read_path_index(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``filename, path`` with the place; lines of one column are no entries and only the
    first path of several is taken."""
    parts = F.split("value", "\t")
    rows = content_lines(read_lines(spark, paths)).where(F.size(parts) >= 2)
    return rows.select(F.get(parts, F.lit(0)).alias("filename"), F.get(parts, F.lit(1)).alias("path"), "src_path", "src_block", "src_pos")


def read_blocklist(spark: SparkSession, path: str) -> Blocklist:
    """Patterns are a short list for the driver."""
    return Blocklist.of(r.value for r in spark.read.text(path).toLocalIterator())


def read_excessive_list(spark: SparkSession, path: str) -> DataFrame:
    """``surt``: the first word of each line."""
    rows = content_lines(spark.read.text(path))
    return rows.select(F.get(F.split("value", r"\s+"), F.lit(0)).alias("surt"))
