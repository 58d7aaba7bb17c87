"""Queries that run the commands of the command line over files of the tables."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.cli import main
from heliograph.functions.cdxj import with_parts
from heliograph.operators.payload import field_column
from heliograph.queries.captures import _BLOCKED, _BOTH, _COUNTS, _PATTERNS, CAP, J, _incoming
from heliograph.queries.common import query
from heliograph.queries.files import _WARC, _values, archived_captures
from heliograph.runtime import scratch_path, table
from heliograph.sinks.text import write_lines
from heliograph.sources.flat import read_lines
from heliograph.sources.paths import filesystem, join, put_text
from heliograph.sources.zipnum import read_zipnum


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder of this machine: commands print and write where they run."""
    path = scratch_path(spark, name)
    system, inner = filesystem(path)
    system.create_dir(inner, recursive=True)
    return inner


def _run(spark: SparkSession, *arguments: str, printed: str | None = None) -> None:
    with contextlib.ExitStack() as stack:
        if printed:
            stack.enter_context(contextlib.redirect_stdout(stack.enter_context(open(printed, "w", encoding="utf-8"))))
        if code := main(list(arguments), spark):
            raise RuntimeError(f"{arguments[0]} ended with {code}")


def _files(spark: SparkSession, d: str) -> str:
    path = join(_folder(spark, "command"), "captures")
    write_lines(_values(spark, d), path)
    return path


@query("cli_merge", f"with {_BOTH} select value from cap union all select value from inc")
def cli_merge(spark: SparkSession, d: str) -> DataFrame:
    one, out = _files(spark, d), join(_folder(spark, "command"), "out")
    two = join(_folder(spark, "command"), "incoming")
    write_lines(_incoming(spark, d), two)
    _run(spark, "merge", out, one, two, "--exclude", "_*", "--exclude", "*.crc")
    return read_lines(spark, out).select("value")


@query("cli_blocklist", f"with {CAP} select value from cap where not {_BLOCKED}")
def cli_blocklist(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark, "command")
    put_text(join(folder, "patterns"), (f"{p}\n" for p in _PATTERNS))
    _run(spark, "blocklist", "-i", _files(spark, d), "-b", join(folder, "patterns"), "-o", join(folder, "out"))
    return read_lines(spark, join(folder, "out")).select("value")


@query("cli_excess", f"with {_COUNTS} select value, 'auto' as mode from cap where surt in (select surt from counts where count <= 15) union all select surt || ' ' || count, 'find' from counts where count > 15")
def cli_excess(spark: SparkSession, d: str) -> DataFrame:
    source, folder = _files(spark, d), _folder(spark, "command")
    for mode in ("auto", "find"):
        _run(spark, "excess", mode, "-i", source, "-n", "15", "-o", join(folder, mode))
    found = [read_lines(spark, join(folder, m)).select("value", F.lit(m).alias("mode")) for m in ("auto", "find")]
    return found[0].unionByName(found[1])


@query("cli_addfield", f"with {CAP} select surt, ts, 'demo' as collection, {J('url')} as url from cap")
def cli_addfield(spark: SparkSession, d: str) -> DataFrame:
    out = join(_folder(spark, "command"), "out")
    _run(spark, "addfield", "-i", _files(spark, d), "-f", "collection=demo", "-o", out)
    lines = with_parts(read_lines(spark, out))
    return lines.select("surt", "ts", *(field_column(F.col("json"), f).alias(f) for f in ("collection", "url")))


@query("cli_extract", f"with {CAP} select {J('mime')} as value from cap where json_exists(json, '$.mime')")
def cli_extract(spark: SparkSession, d: str) -> DataFrame:
    out = join(_folder(spark, "command"), "out")
    _run(spark, "extract", "-f", "mime", "-r", "-s", "-i", _files(spark, d), printed=out)
    return read_lines(spark, out).select("value")


@query("cli_search", f"with {CAP} select value from cap where starts_with(surt, 'example,vedon)') and ts >= '2010' and {J('status')} = '200' and regexp_matches({J('mime')}, 'html')")
def cli_search(spark: SparkSession, d: str) -> DataFrame:
    """Over the files of a folder, found by a glob."""
    out = join(_folder(spark, "command"), "out")
    rules = ("--filter", "status=200", "--filter", "mime~html", "--from", "2010", "--sort")
    _run(spark, "search", "--url", "http://vedon.example/", "--match-type", "domain", f"{_files(spark, d)}/part-*", *rules, printed=out)
    return read_lines(spark, out).select("value")


@query("cli_zipnum", f"with {CAP} select value from cap")
def cli_zipnum(spark: SparkSession, d: str) -> DataFrame:
    folder = join(_folder(spark, "command"), "z")
    _run(spark, "to-zipnum", "-i", _files(spark, d), "-o", folder, "-c", "400", "-s", "0.2", "--base", "b")
    out = join(_folder(spark, "command"), "out")
    _run(spark, "from-zipnum", "-i", join(folder, "b.idx"), printed=out)
    return read_lines(spark, out).select("value")


@query("cli_path_index", "select string_split(trim(warc_path, ' '), '/')[-1] || chr(9) || trim(warc_path, ' ') as value from warc_listing where trim(warc_path, ' ') <> ''")
def cli_path_index(spark: SparkSession, d: str) -> DataFrame:
    lists, out = join(_folder(spark, "command"), "lists"), join(_folder(spark, "command"), "out")
    write_lines(table(spark, d, "warc_listing").where("trim(warc_path) <> ''"), lists, "warc_path")
    _run(spark, "path-index", "-d", lists, printed=out)
    return read_lines(spark, out).select("value")


@query("cli_collection", "select url, ts, status, 'demo' as collection " + _WARC)
def cli_collection(spark: SparkSession, d: str) -> DataFrame:
    """Archives of a collection to a cluster; a second run finds nothing to read."""
    root, out = _folder(spark, "command"), _folder(spark, "command")
    archived_captures(spark, d, join(root, "demo"))
    for _ in range(2):
        _run(spark, "collection", "demo", "--collections-dir", root, "--output-dir", out, "--temp-dir", join(root, "state"), "--incremental", "--no-compress", "--threshold", "1000000000")
    rows = read_zipnum(spark, join(out, "demo", "demo.idx"))
    return rows.select("ts", *(F.get_json_object("json", f"$.{f}").alias(f) for f in ("url", "status", "collection")))
