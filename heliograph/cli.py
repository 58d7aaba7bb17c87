"""``python -m heliograph COMMAND``: the operators for files, one process per command.

Exit codes: 0 done, 1 an error, 124 a timeout, 130 interrupted.  ``-`` as an output is the
standard output.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.cdxj import surt_of_line
from heliograph.operators import excess, merge, pathindex, payload
from heliograph.operators.blocklist import apply_blocklist
from heliograph.operators.search import MATCH_TYPES
from heliograph.plans import collection, lookup
from heliograph.runtime import scratch_path, shared_dir
from heliograph.sinks import kv
from heliograph.sinks.text import write_one_file
from heliograph.sinks.zipnum import write_zipnum
from heliograph.sources import flat, warc, zipnum
from heliograph.sources.paths import filesystem, join, walk


class Failed(Exception):
    pass


def session() -> SparkSession:
    """A session of its own for the command; what is set outside is kept."""
    builder = SparkSession.builder.appName("heliograph").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.sql.python.filterPushdown.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _inputs(paths: list[str]) -> list[str]:
    """Files as Spark can read them; the standard input is stored first."""
    found = []
    for path in paths:
        if path == "-":
            path = scratch_path(SparkSession.active(), "input") + ".txt"  # where all executors read it
            system, inner = filesystem(path)
            system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(inner) as held:
                while block := sys.stdin.buffer.read(1 << 20):
                    held.write(block)
        elif walk(path) is None:
            raise Failed(f"no such file: {path}")
        found.append(path)
    return found


def _output(lines: DataFrame, path: str, column: str = "value") -> int:
    if path != "-":
        return write_one_file(lines, path, column)
    count = 0
    for row in lines.select(column).toLocalIterator():
        print(row[0] or "")
        count += 1
    return count


def _ordered(lines: DataFrame) -> DataFrame:
    return lines.orderBy("src_path", "src_block", "src_pos")


def _say(verbose: bool, *words: object) -> None:
    if verbose:
        print(*words, file=sys.stderr)


def run_merge(o: argparse.Namespace, spark: SparkSession) -> None:
    files = flat.collect_files(o.paths, o.exclude)
    if not files:
        raise Failed("nothing to merge")
    n = _output(merge.merge_sorted(flat.read_lines(spark, files)), o.output)
    _say(o.verbose and not o.quiet, f"{len(files)} files, {n} lines")


def run_blocklist(o: argparse.Namespace, spark: SparkSession) -> None:
    lines = flat.read_lines(spark, _inputs([o.input]))
    kept = _output(_ordered(apply_blocklist(lines, flat.read_blocklist(spark, *_inputs([o.blocklist])))), o.output)
    _say(o.verbose, f"kept {kept}, blocked {lines.count() - kept}")


def _keyed(spark: SparkSession, path: str) -> DataFrame:
    return flat.read_lines(spark, _inputs([path])).withColumn("surt", surt_of_line(F.col("value")))


def run_excess(o: argparse.Namespace, spark: SparkSession) -> None:
    lines = _keyed(spark, o.input)
    if o.mode == "find":
        found = excess.by_count(excess.excessive_find(lines, o.threshold))
        _output(found.select(F.concat_ws(" ", "surt", "count").alias("value")), o.output)
        return
    if o.mode == "remove":
        kept = excess.excessive_remove(lines, flat.read_excessive_list(spark, *_inputs([o.blocklist])))
    else:
        kept = excess.excessive_auto(lines, o.threshold)
    n = _output(_ordered(kept), o.output)
    _say(o.verbose, f"kept {n}, removed {lines.count() - n}")


def run_addfield(o: argparse.Namespace, spark: SparkSession) -> None:
    if bool(o.field) == bool(o.function):
        raise Failed("give either --field or --function")
    try:
        fields = payload.parse_assignments(o.field) if o.field else None
    except ValueError as e:
        raise Failed(str(e)) from e
    lines = flat.read_lines(spark, _inputs([o.input]))
    changed = payload.add_fields(lines, fields, payload.load_function(o.function) if o.function else None)
    _output(_ordered(changed), o.output)


def run_extract(o: argparse.Namespace, spark: SparkSession) -> None:
    rows = payload.extract_field(flat.read_lines(spark, _inputs(o.input or ["-"])), o.field, o.raw, o.default or "")
    shown = rows.where(F.col("outcome").isin("found", "missing"))
    if o.skip_missing and o.default is None:
        shown = shown.where("outcome = 'found'")
    _output(_ordered(shown), "-", "extracted")


def run_search(o: argparse.Namespace, spark: SparkSession) -> None:
    found = lookup.lookup(
        spark, o.files, key=o.surt, url=o.url, match_type=o.match_type, skip_errors=o.skip_errors,
        from_ts=o.from_ts, to_ts=o.to_ts, filters=o.filter, sort=o.sort, dedupe=o.dedupe, limit=o.limit,
    )
    _output(found, "-")


def run_to_zipnum(o: argparse.Namespace, spark: SparkSession) -> None:
    lines = flat.read_lines(spark, _inputs([o.input]), exact=True)
    index = write_zipnum(
        lines, o.output, base=o.base, chunk_size=o.chunk_size, shard_size_mb=o.shard_size, single_shard=o.single_shard,
        compress_level=o.compress_level, idx_name=o.idx_file, loc_name=o.loc_file,
    )
    _say(True, f"{index.count()} blocks")


def run_from_zipnum(o: argparse.Namespace, spark: SparkSession) -> None:
    rows = zipnum.read_zipnum(spark, *_inputs([o.input]), base_dir=o.base_dir, loc=o.loc)
    if not _output(rows.orderBy("src_block", "src_pos"), "-"):
        raise Failed("the index is empty")


def _arclists(o: argparse.Namespace) -> list[str]:
    if bool(o.input) == bool(o.directory):
        raise Failed("give either files or a directory")
    return flat.arclist_files(o.directory) if o.directory else _inputs(o.input)


def run_path_index(o: argparse.Namespace, spark: SparkSession) -> None:
    files = _arclists(o)
    entries = pathindex.arclist_to_path_index(flat.read_lines(spark, files)) if files else None
    if entries is None or not _output(pathindex.path_index_lines(_ordered(entries), o.output_separator), "-"):
        raise Failed("no entries")


def _server(o: argparse.Namespace) -> kv.Server:
    return kv.Server(o.host, o.port, o.db, o.password, o.socket, o.ssl, o.timeout)


def _load(o: argparse.Namespace, entries: DataFrame, dry_run: bool) -> None:
    if o.username:
        _say(True, "the user name is ignored")
    if not o.password and not o.socket and o.host not in ("localhost", "127.0.0.1", "::1"):
        _say(True, "the server is remote and no password is given")
    sent, failed = kv.load(entries, kv.ServerSink(_server(o), o.batch_size, dry_run), o.key, o.clear)
    _say(True, f"{sent} entries submitted, {failed} errors")
    if failed:
        raise Failed("not all entries were taken")


def run_load_paths(o: argparse.Namespace, spark: SparkSession) -> None:
    _load(o, flat.read_path_index(spark, _inputs(o.input)), o.dry_run)


def run_load_arclists(o: argparse.Namespace, spark: SparkSession) -> None:
    _load(o, pathindex.arclist_to_path_index(flat.read_lines(spark, flat.arclist_files(o.directory))), False)


def run_collection(o: argparse.Namespace, spark: SparkSession) -> None:
    source = os.path.join(o.collections_dir, o.name)
    if not os.path.isdir(source):
        raise Failed(f"no such collection: {source}")
    blocklist = None
    if o.blocklist and os.path.isfile(o.blocklist):
        blocklist = flat.read_blocklist(spark, o.blocklist)
    elif o.blocklist:
        _say(True, f"no blocklist at {o.blocklist}; going on without")
    if o.incremental or o.keep_temp:
        state = join(o.temp_dir or join(shared_dir(spark, lasting=True), "collections"), o.name)
    else:
        state = scratch_path(spark, "collection")
    kept = collection.Collection(spark, state, o.name)
    done = kept.update(warc.archive_files([source]), warc.read_warcs)
    index, report = kept.build(os.path.join(o.output_dir, o.name), blocklist=blocklist, threshold=o.threshold, chunk_size=o.shard_size, compress_level=0 if o.no_compress else 6)
    _say(True, f"archives: {done}; blocks: {index.count()}")
    for row in report.collect():
        _say(True, f"{row.stage}: {row.n_captures} captures, {row.removed_percent} % removed")


def _server_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("-k", "--key", required=True)
    p.add_argument("--host", default="localhost")
    p.add_argument("--port", type=int, default=6379)
    p.add_argument("--db", type=int, default=0)
    p.add_argument("--password")
    p.add_argument("--socket")
    p.add_argument("--ssl", action="store_true")
    p.add_argument("--batch-size", type=int, default=kv.BATCH)
    p.add_argument("--timeout", type=float, default=10.0)
    p.add_argument("--clear", action="store_true")
    p.add_argument("--username", help="ignored: the connection authenticates by password")
    p.add_argument("--cluster", action="store_true", help="not needed: a hash's server is found by its first reply")
    p.add_argument("--pool-size", type=int, help="not needed: every partition has a connection")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="heliograph", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, text: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        p.set_defaults(run=run)
        p.add_argument("-v", "--verbose", action="store_true")
        return p

    p = command("merge", run_merge, "merge capture files in order")
    p.add_argument("output")
    p.add_argument("paths", nargs="+")
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("-q", "--quiet", action="store_true")
    p = command("blocklist", run_blocklist, "drop lines that match a pattern")
    p.add_argument("-i", "--input", default="-")
    p.add_argument("-b", "--blocklist", required=True)
    p.add_argument("-o", "--output", default="-")
    p = command("excess", run_excess, "find or remove keys with too many captures")
    p.add_argument("mode", choices=("find", "remove", "auto"))
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-b", "--blocklist")
    p.add_argument("-o", "--output", default="-")
    p.add_argument("-n", "--threshold", type=int, default=excess.DEFAULT_THRESHOLD)
    p = command("addfield", run_addfield, "set payload fields")
    p.add_argument("-i", "--input", default="-")
    p.add_argument("-o", "--output", default="-")
    p.add_argument("-f", "--field", action="append", default=[])
    p.add_argument("--function")
    p = command("extract", run_extract, "print a payload field")
    p.add_argument("-f", "--field", required=True)
    p.add_argument("-i", "--input", action="append")
    p.add_argument("-r", "--raw", action="store_true")
    p.add_argument("-d", "--default")
    p.add_argument("-s", "--skip-missing", action="store_true")
    p = command("search", run_search, "look captures up")
    which = p.add_mutually_exclusive_group(required=True)
    which.add_argument("--url")
    which.add_argument("--surt")
    p.add_argument("files", nargs="+")
    p.add_argument("--match-type", "--matchType", choices=MATCH_TYPES, default="exact")
    p.add_argument("--from", dest="from_ts")
    p.add_argument("--to", dest="to_ts")
    p.add_argument("--filter", action="append", default=[])
    p.add_argument("--limit", type=int)
    p.add_argument("--sort", action="store_true")
    p.add_argument("--dedupe", action="store_true")
    p.add_argument("--skip-errors", action="store_true")
    p.add_argument("--progress", action="store_true", help="not needed: Spark shows it")
    p = command("to-zipnum", run_to_zipnum, "write a cluster")
    p.add_argument("-i", "--input", default="-")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-s", "--shard-size", type=float, default=100)
    p.add_argument("--single-shard", action="store_true")
    p.add_argument("-c", "--chunk-size", type=int, default=3000)
    p.add_argument("--compress-level", type=int, choices=range(1, 10), default=6)
    p.add_argument("--base")
    p.add_argument("--workers", type=int, help="not needed: Spark decides")
    p.add_argument("--idx-file")
    p.add_argument("--loc-file")
    p = command("from-zipnum", run_from_zipnum, "print a cluster's captures")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("--base-dir")
    p.add_argument("--workers", type=int, help="not needed: Spark decides")
    p.add_argument("--loc")
    p = command("path-index", run_path_index, "make a path index of archive lists")
    p.add_argument("-i", "--input", action="append")
    p.add_argument("-d", "--directory")
    p.add_argument("--output-separator", default="\t")
    p = command("load-paths", run_load_paths, "load path indexes into a key/value server")
    p.add_argument("-i", "--input", action="append", required=True)
    p.add_argument("--dry-run", action="store_true")
    _server_options(p)
    p = command("load-arclists", run_load_arclists, "load archive lists into a key/value server")
    p.add_argument("-d", "--directory", required=True)
    _server_options(p)
    p = command("collection", run_collection, "build a cluster from a collection's archives")
    p.add_argument("name")
    p.add_argument("--blocklist")
    p.add_argument("--threshold", type=int, default=excess.DEFAULT_THRESHOLD)
    p.add_argument("--shard-size", type=int, default=3000)
    p.add_argument("--collections-dir", default=".")
    p.add_argument("--output-dir", default=".")
    p.add_argument("--temp-dir", help="where the state of an incremental collection is kept; the session's shared folder by default")
    p.add_argument("--jobs", type=int, help="not needed: Spark decides")
    p.add_argument("--no-compress", action="store_true", help="blocks are stored, not compressed")
    p.add_argument("--keep-temp", action="store_true")
    p.add_argument("--incremental", action="store_true")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    options = parser().parse_args(arguments)
    try:
        options.run(options, spark or session())
    except KeyboardInterrupt:
        return 130
    except TimeoutError as e:
        print(f"error: {e}", file=sys.stderr)
        return 124
    except (Failed, ValueError, OSError, AttributeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


