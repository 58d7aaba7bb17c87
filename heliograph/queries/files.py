"""Queries that write the tables to files and read them back, through every source and sink."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.cdxj import with_parts
from heliograph.operators import excess, merge, pathindex
from heliograph.operators.blocklist import apply_blocklist
from heliograph.operators.payload import add_fields, extract_field, field_column, load_function, parse_assignments
from heliograph.operators.search import search
from heliograph.plans import collection, lookup
from heliograph.queries.captures import _BLOCKED, _BOTH, _COUNTS, _ENTRIES, _PATTERNS, CAP, J, _captures, _cluster, _entries, _incoming, _shown
from heliograph.queries.common import query
from heliograph.queries.quality import _NESTED, _object
from heliograph.runtime import scratch_path, table
from heliograph.sinks import kv
from heliograph.sinks.text import captures_table, write_by_period, write_lines
from heliograph.sinks.zipnum import write_zipnum
from heliograph.sources import flat, warc, zipnum
from heliograph.sources.paths import filesystem, join, put_text

# ---------------------------------------------------------------- flat files


def _values(spark: SparkSession, d: str) -> DataFrame:
    return _captures(spark, d).select("value")


@query("flat_scan", f"with {CAP} select value, surt, ts, json from cap")
def flat_scan(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "flat")
    write_lines(_values(spark, d), path)
    return flat.read_captures(spark, flat.collect_files([path], ["_*", ".*"])).select("value", "surt", "ts", "json")


@query("gzip_scan", f"with {CAP} select value, surt, ts from cap")
def gzip_scan(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "gzip")
    write_lines(_values(spark, d), path, compression="gzip")
    return flat.read_captures(spark, flat.collect_files([path], ["*.crc", "_*"])).select("value", "surt", "ts")


def _by_tld(spark: SparkSession, d: str) -> str:
    """A folder per top-level domain, with files named after it."""
    root = scratch_path(spark, "tree")
    for name in ("example", "test", "invalid"):
        write_lines(_values(spark, d).where(F.col("value").startswith(f"{name},")), join(root, name, f"{name}.cdxj"))
    return root


@query("scan_excluding", f"with {CAP} select value from cap where starts_with(surt, 'example,') or starts_with(surt, 'test,')")
def scan_excluding(spark: SparkSession, d: str) -> DataFrame:
    """A tree of files without those whose names are excluded (and what Spark writes beside them)."""
    files = flat.collect_files([_by_tld(spark, d)], ["_*", "*.crc"])
    kept = [f for f in files if "/invalid/" not in f]
    assert len(kept) < len(files) and flat.collect_files(kept, ["part-*"]) == []
    return merge.merge_sorted(flat.read_lines(spark, kept).select("value"))


@query("discovered_globs", f"with {CAP} select value from cap where starts_with(surt, 'test,')")
def discovered_globs(spark: SparkSession, d: str) -> DataFrame:
    return flat.read_captures(spark, flat.discover([f"{_by_tld(spark, d)}/**/test.cdxj/part-*"])).select("value")


@query("lookup_files", f"with {_BOTH} select value from (select value from cap union all select value from inc) where starts_with(value, 'example,vedon)')")
def lookup_files(spark: SparkSession, d: str) -> DataFrame:
    """A domain in a folder that holds a cluster and a flat file."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    idx = _cluster(spark, d)[0]
    folder = idx.rsplit("/", 1)[0]
    write_lines(_incoming(spark, d).coalesce(1), join(folder, "flat"))
    parts = [f for f in flat.collect_files([join(folder, "flat")], ["_*", "*.crc", ".*"])]
    return lookup.lookup(spark, [idx, *parts], url="http://vedon.example/", match_type="domain").select("value")


@query("search_malformed", f"""with l as (select line_id, split_part(line, ' ', 1) as surt, split_part(line, ' ', 2) as ts,
  trim(array_to_string(string_split(line, ' ')[3:], ' '), ' \t\n\r') as json from cdxj_lines where line is not null and len(string_split(line, ' ')) >= 2)
  select line_id from l where starts_with(surt, 'example,') and regexp_full_match(json, $json${_object(_NESTED)}$json$, 's') and json_extract_string(json, '$.status') = '200'""")
def search_malformed(spark: SparkSession, d: str) -> DataFrame:
    """Rules over raw lines: a payload that is broken satisfies none."""
    lines = with_parts(table(spark, d, "cdxj_lines").select("line_id", F.col("line").alias("value"), F.col("line_id").alias("src_pos")))
    return search(lines, "example,", "prefix", filters=["status=200"]).select("line_id")


@query("search_predicate", f"with {CAP} select capture_id, surt, ts from cap where starts_with(surt, 'test,') and length(surt) > 60 and json is not null and {J('mime')} = 'text/html'")
def search_predicate(spark: SparkSession, d: str) -> DataFrame:
    """A condition of the caller's own beside the rules."""
    return _shown(search(_captures(spark, d), "test,", "prefix", filters=["mime=text/html"], where=F.length("surt") > 60))


@query("search_sorted_table", f"with {CAP} select capture_id, surt, ts from cap where starts_with(surt, 'example,ser')")
def search_sorted_table(spark: SparkSession, d: str) -> DataFrame:
    """A prefix in a table sorted by key, where statistics select row groups."""
    return _shown(search(spark.read.parquet(sorted_table(spark, d)), "example,ser", "prefix"))


def sorted_table(spark: SparkSession, d: str) -> str:
    path = scratch_path(spark, "sorted")
    captures_table(_captures(spark, d), path)
    return path


# ---------------------------------------------------------------- lists


@query("arclist_files", "select string_split(trim(warc_path, ' '), '/')[-1] as filename, trim(warc_path, ' ') as path from warc_listing where trim(warc_path, ' ') <> ''")
def arclist_files(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch_path(spark, "arclists")
    write_lines(table(spark, d, "warc_listing").where("trim(warc_path) <> ''"), folder, "warc_path")
    lists = flat.arclist_files(folder)
    return pathindex.arclist_to_path_index(flat.read_arclist(spark, lists)).select("filename", "path")


@query("path_index_file", f"with {_ENTRIES} select filename, arg_max(path, entry_id) as path from entries group by 1")
def path_index_file(spark: SparkSession, d: str) -> DataFrame:
    """Entries as lines in order, read back; of repeated names the last line counts."""
    path = scratch_path(spark, "paths")
    write_lines(pathindex.path_index_lines(_entries(spark, d).orderBy("src_pos")), path)
    return pathindex.upsert(flat.read_path_index(spark, path))


@query("path_index_hash", f"with {_ENTRIES} select filename, arg_max(path, entry_id) as path from entries group by 1")
def path_index_hash(spark: SparkSession, d: str) -> DataFrame:
    """The same, loaded into a hash in two runs."""
    sink, entries = kv.ParquetSink(scratch_path(spark, "hash")), _entries(spark, d)
    half = entries.approxQuantile("src_pos", [0.5], 0.1)[0]
    kv.load(entries.where(F.col("src_pos") <= half), sink, "paths", clear=True)
    kv.load(entries.where(F.col("src_pos") > half), sink, "paths")
    return sink.get(spark, "paths").select("filename", "path")


@query("blocklist_file", f"with {CAP} select capture_id, surt, ts from cap where not {_BLOCKED}")
def blocklist_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "blocklist")
    put_text(path, (f"{p}\n" for p in _PATTERNS))
    return _shown(apply_blocklist(_captures(spark, d), flat.read_blocklist(spark, path)))


@query("excessive_file", f"with {_COUNTS} select capture_id, surt, ts from cap where surt not in (select surt from counts where count > 100)")
def excessive_file(spark: SparkSession, d: str) -> DataFrame:
    """Keys found, written as a list by count, read back and removed."""
    path = scratch_path(spark, "excessive")
    listed = excess.by_count(excess.excessive_find(_captures(spark, d), 100))
    write_lines(listed.select(F.concat_ws(" ", "surt", "count").alias("value")), path)
    return _shown(excess.excessive_remove(_captures(spark, d), flat.read_excessive_list(spark, path)))


@query("extract_file", f"with {CAP} select coalesce({J('mime')}, '') as value from cap")
def extract_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "extracted")
    write_lines(extract_field(_captures(spark, d), "mime", raw=True), path, "extracted")
    return flat.read_lines(spark, path).select("value")


# ---------------------------------------------------------------- payload functions


@query("addfield_assignments", f"with {CAP} select capture_id, 'demo' as collection, 'a=b' as note from cap")
def addfield_assignments(spark: SparkSession, d: str) -> DataFrame:
    changed = with_parts(add_fields(_captures(spark, d), parse_assignments(["collection=x", "note=a=b", "collection=demo"])))
    return changed.select("capture_id", *(field_column(F.col("json"), f).alias(f) for f in ("collection", "note")))


_UPPER = """import json

def addfield(surt, timestamp, payload):
    if not payload:
        raise ValueError('nothing to change')
    mime = payload.get('mime')
    if mime is None:
        return payload
    text = mime if isinstance(mime, str) else json.dumps(mime, ensure_ascii=False, separators=(',', ':'))
    return payload | {'mime': text.upper()}
"""


@query("addfield_file", f"with {CAP} select capture_id, case when {J('mime')} is not null then upper({J('mime')}) end as mime, (json is not null) as added from cap")
def addfield_file(spark: SparkSession, d: str) -> DataFrame:
    """A function from a file; it refuses captures without payload, which pass unchanged."""
    path = scratch_path(spark, "function") + ".py"
    put_text(path, [_UPPER])
    changed = with_parts(add_fields(_captures(spark, d), function=load_function(filesystem(path)[1])))
    return changed.select("capture_id", field_column(F.col("json"), "mime").alias("mime"), "added")


# ---------------------------------------------------------------- clusters

_N = f"{CAP}, n as (select value, surt, row_number() over (order by value) - 1 as i from cap)"


@query("zipnum_idx_file", f"with {_N} select trim(split_part(value, '{{', 1)) as key from n where i % 500 = 0")
def zipnum_idx_file(spark: SparkSession, d: str) -> DataFrame:
    return zipnum.read_idx(spark, _cluster(spark, d)[0]).select("key")


@query("zipnum_layout", f"with {_N} select cast((max(i) // 500) + 1 as bigint) as n_blocks, 0::bigint as n_gaps, 0::bigint as n_misnamed, 0::bigint as n_unlisted, 0::bigint as n_faults from n")
def zipnum_layout(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a cluster of many shards, and what would be wrong with their rows: offsets that
    do not follow each other, shards not named after their number, shards the location list
    does not name, blocks that cannot be read."""
    from pyspark.sql import Window

    idx = _cluster(spark, d)[0]
    rows, loc = zipnum.read_idx(spark, idx), zipnum.read_loc(spark, idx[:-4] + ".loc")
    order = Window.partitionBy("shard").orderBy("offset")
    several = (rows.agg(F.max("shard_num")).first()[0] or 0) > 1
    name = F.format_string("demo-%02d.cdx.gz", "shard_num") if several else F.lit("demo.cdx.gz")
    placed = rows.withColumn("gap", F.col("offset") != F.coalesce(F.lag(F.col("offset") + F.col("length")).over(order), F.lit(0)))
    placed = placed.withColumn("misnamed", F.col("shard") != name).join(loc.select("shard", "path"), "shard", "left")
    faults = zipnum.read_zipnum(spark, idx, faults=True).count()
    counts = [F.count_if(F.col(c)).alias(f"n_{n}") for c, n in (("gap", "gaps"), ("misnamed", "misnamed"))]
    return placed.agg(F.count("*").alias("n_blocks"), *counts, F.count_if(F.col("path").isNull()).alias("n_unlisted")).withColumn("n_faults", F.lit(faults))


@query("zipnum_single", f"with {CAP} select value, 'one.cdx.gz' as shard from cap")
def zipnum_single(spark: SparkSession, d: str) -> DataFrame:
    folder = join(scratch_path(spark, "cluster"), "one")
    write_zipnum(_values(spark, d), folder, chunk_size=300, shard_size_mb=0.01, single_shard=True)
    return zipnum.read_zipnum(spark, join(folder, "one.idx")).select("value", F.substring_index("src_path", "/", -1).alias("shard"))


@query("zipnum_merged", f"with {_BOTH} select value from cap union all select value from inc")
def zipnum_merged(spark: SparkSession, d: str) -> DataFrame:
    """Two clusters read, merged and written as one."""
    root = scratch_path(spark, "clusters")
    write_zipnum(_values(spark, d), join(root, "a"), chunk_size=700)
    write_zipnum(_incoming(spark, d), join(root, "b"), chunk_size=90)
    both = merge.merge_sorted(*(zipnum.read_zipnum(spark, join(root, x, f"{x}.idx")).select("value") for x in "ab"))
    write_zipnum(both, join(root, "c"))
    return zipnum.read_zipnum(spark, join(root, "c", "c.idx")).select("value")


@query("zipnum_loc_file", """with l as (select loc_id, trim(shard_name || chr(9) || path, chr(9) || ' ') as line from zipnum_loc where shard_name is not null and path is not null)
  select split_part(line, chr(9), 1) as shard, arg_max(split_part(line, chr(9), 2), loc_id) as path from l where contains(line, chr(9)) group by 1""")
def zipnum_loc_file(spark: SparkSession, d: str) -> DataFrame:
    """The location rows as a file; of repeated shards the last row counts."""
    path = scratch_path(spark, "loc")
    rows = table(spark, d, "zipnum_loc").where("shard_name is not null and path is not null").orderBy("loc_id")
    write_lines(rows.select(F.concat_ws("\t", "shard_name", "path").alias("value")), path)
    return zipnum.read_loc(spark, path)


# ---------------------------------------------------------------- tables by period, collections, archives


@query("period_tables", f"with {CAP} select value, cast(substr(ts, 1, 4) as bigint) as year, cast(substr(ts, 5, 2) as bigint) as month from cap")
def period_tables(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "periods")
    write_by_period(_captures(spark, d), path, months=True)
    return spark.read.parquet(path).select("value", F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"))


@query("collection_runs", f"with {CAP} select value from cap where starts_with(surt, 'example,') or starts_with(surt, 'test,')")
def collection_runs(spark: SparkSession, d: str) -> DataFrame:
    """A collection over three runs: files of two domains, of a third one, which then goes again."""
    root = _by_tld(spark, d)
    files = {x: flat.collect_files([join(root, x)], ["_*", "*.crc"]) for x in ("example", "test", "invalid")}
    kept = collection.Collection(spark, scratch_path(spark, "collection"), "demo")
    for names in (("example", "invalid"), ("example", "invalid", "test"), ("example", "test")):
        kept.update([f for x in names for f in files[x]], lambda s, paths: flat.read_captures(s, paths) if paths else s.createDataFrame([], "value string, src_path string"))
    return kept.captures().select("value")


_WARC = """from (select json_extract_string(json_data, '$.url') as url, ts, json_extract_string(json_data, '$.status') as status,
  json_extract_string(json_data, '$.mime') as mime from captures) where url is not null and regexp_full_match(status, '[1-5][0-9]{2}') and mime is not null"""


@query("warc_files", "select url, ts, status, mime " + _WARC)
def warc_files(spark: SparkSession, d: str) -> DataFrame:
    """Captures written as archives of HTTP responses, a file per task, and indexed from them."""
    found = warc.read_warcs(spark, archived_captures(spark, d, scratch_path(spark, "archives")))
    return found.select("ts", *(F.get_json_object("json", f"$.{f}").alias(f) for f in ("url", "status", "mime")))


def archived_captures(spark: SparkSession, d: str, folder: str) -> list[str]:
    system, inner = filesystem(folder)
    system.create_dir(inner, recursive=True)
    fields = {f: F.get_json_object("json_data", f"$.{f}") for f in ("url", "status", "mime")}
    rows = table(spark, d, "captures").select("ts", *(c.alias(f) for f, c in fields.items())).where("url is not null and mime is not null")
    files = rows.where(F.col("status").rlike("^[1-5][0-9]{2}$")).mapInArrow(_archived(folder), "path string")
    return [r.path for r in files.collect()]  # a row per task


def _archived(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        path = join(folder, f"{context.partitionId()}-{context.taskAttemptId()}.warc.gz")
        system, inner = filesystem(path)
        with system.open_output_stream(inner, compression=None) as out:
            for batch in batches:
                for r in batch.to_pylist():
                    t = r["ts"]
                    date = f"{t[:4]}-{t[4:6]}-{t[6:8]}T{t[8:10]}:{t[10:12]}:{t[12:]}Z"
                    body = f"HTTP/1.1 {r['status']} X\r\nContent-Type: {r['mime']}\r\n\r\n{r['url']}".encode()
                    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {r['url']}\r\nWARC-Date: {date}\r\nContent-Type: application/http\r\nContent-Length: {len(body)}\r\n\r\n"
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(packer.compress(head.encode() + body + b"\r\n\r\n") + packer.flush())
        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    return run
