"""Queries for the engine's own operators, over the captures table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.cdxj import format_line, sort_key, surt_of_line, with_parts
from heliograph.functions.surt import surt_parts, url_to_surt
from heliograph.functions.timestamps import normalized
from heliograph.operators import excess, merge, pathindex, reports
from heliograph.operators.blocklist import Blocklist, apply_blocklist
from heliograph.operators.blocklist import blocklist_report as report_of
from heliograph.operators.payload import add_fields, extract_field, field_column
from heliograph.operators.search import first_per_capture, search, sort_captures
from heliograph.plans import collection
from heliograph.queries.common import query
from heliograph.runtime import scratch_path, table
from heliograph.sinks.zipnum import write_zipnum
from heliograph.sources.paths import join
from heliograph.sources.zipnum import read_zipnum

CAP = """cap as (select capture_id, surt_key as surt, ts, json_data as json,
  surt_key || ' ' || ts || coalesce(' ' || json_data, '') as value from captures)"""


def _captures(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "captures")
    value = format_line(F.col("surt_key"), F.col("ts"), F.col("json_data"))
    return rows.select("capture_id", F.col("surt_key").alias("surt"), "ts", F.col("json_data").alias("json"), value.alias("value"), F.col("capture_id").alias("src_pos"))


def _shown(found: DataFrame) -> DataFrame:
    return found.select("capture_id", "surt", "ts")


def _searched(name: str, condition: str, tail: str = "", **arguments):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _shown(search(_captures(spark, d), **arguments))

    return query(name, f"with {CAP} select capture_id, surt, ts from cap where {condition} {tail}")(run)


HOT = "example,lisholul,blog)/"
J = "json_extract_string(json, '$.{}')".format

_searched("search_exact", f"surt = '{HOT}'", key=HOT)
_searched("search_prefix", "starts_with(surt, 'example,ser')", key="example,ser", match_type="prefix")
_searched("search_domain", "starts_with(surt, 'example,vedon)')", key="example,vedon)/meteo", match_type="domain")
_searched("search_subdomains", "starts_with(surt, 'example,serholser,')", key="example,serholser)/", match_type="subdomains")
_searched("search_ts_range", "starts_with(surt, 'test,') and ts >= '20100101000000' and ts <= '20150601000000' and json is not null", key="test,", match_type="prefix", from_ts="2010", to_ts="201506")
_searched("search_field_eq", f"starts_with(surt, 'example,') and {J('mime')} = 'image/png'", key="example,", match_type="prefix", filters=["mime=image/png"])
_searched("search_field_ne", f"starts_with(surt, 'example,') and {J('status')} <> '200'", key="example,", match_type="prefix", filters=["status!=200"])
_searched("search_field_regex", f"starts_with(surt, 'invalid,') and regexp_matches({J('url')}, '^https://.*[0-9]')", key="invalid,", match_type="prefix", filters=["url~^https://.*[0-9]"])
_searched("search_field_not_regex", f"starts_with(surt, 'invalid,') and not regexp_matches({J('mime')}, 'html|css')", key="invalid,", match_type="prefix", filters=["mime!~html|css"])
search_multi = _searched(
    "search_multi",
    f"""starts_with(surt, 'example,lisholul,blog)') and ts between '20080101000000' and '20200101000000'
    and {J('status')} = '200' and regexp_matches({J('mime')}, 'html')
    qualify row_number() over (partition by surt, ts order by capture_id) = 1""",
    "order by surt, ts limit 500",
    key=HOT, match_type="domain", from_ts="2008", to_ts="2020", filters=["status=200", "mime~html"], dedupe=True, sort=True, limit=500,
)


@query("search_sort_limit", f"with {CAP} select capture_id, surt, ts from cap order by surt, ts, capture_id limit 1000")
def search_sort_limit(spark: SparkSession, d: str) -> DataFrame:
    return _shown(sort_captures(_captures(spark, d)).limit(1000))


@query("dedupe_surt_ts", f"with {CAP} select capture_id, surt, ts from cap qualify row_number() over (partition by surt, ts order by capture_id) = 1")
def dedupe_surt_ts(spark: SparkSession, d: str) -> DataFrame:
    return _shown(first_per_capture(_captures(spark, d)))


# ---------------------------------------------------------------- excessive keys

_COUNTS = f"{CAP}, counts as (select surt, count(*) as count from cap where trim(surt) <> '' group by 1)"


@query("excessive_find", f"with {_COUNTS} select surt, count from counts where count > 100")
def excessive_find(spark: SparkSession, d: str) -> DataFrame:
    return excess.excessive_find(_captures(spark, d), 100)


@query("excessive_remove", f"with {_COUNTS} select capture_id, surt, ts from cap where surt not in (select surt from counts where count > 100)")
def excessive_remove(spark: SparkSession, d: str) -> DataFrame:
    captures = _captures(spark, d)
    return _shown(excess.excessive_remove(captures, excess.excessive_find(captures, 100)))


@query("excessive_auto", f"with {_COUNTS} select capture_id, surt, ts from cap where surt in (select surt from counts where count <= 15)")
def excessive_auto(spark: SparkSession, d: str) -> DataFrame:
    return _shown(excess.excessive_auto(_captures(spark, d), 15))


@query("excessive_top5", f"with {_COUNTS} select surt, count from counts where count > 15 order by count desc, surt limit 5")
def excessive_top5(spark: SparkSession, d: str) -> DataFrame:
    return excess.by_count(excess.excessive_find(_captures(spark, d), 15)).limit(5)


@query(
    "threshold_sweep",
    f"""with {_COUNTS} select t.threshold, count(c.surt) as n_keys, coalesce(cast(sum(c.count) as bigint), 0) as n_captures
    from (values (10), (100), (1000), (1000000000)) t(threshold) left join counts c on c.count > t.threshold group by 1""",
)
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return excess.threshold_sweep(_captures(spark, d), [10, 100, 1000, 1_000_000_000])


# ---------------------------------------------------------------- merge and sets


def _incoming(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "incoming_captures")
    return rows.select(format_line(F.col("surt_key"), F.col("ts"), F.col("json_data")).alias("value"))


_BOTH = f"""{CAP}, inc as (select surt_key || ' ' || ts || coalesce(' ' || json_data, '') as value from incoming_captures)"""


@query("merge_union_all", f"with {_BOTH} select value from cap union all select value from inc")
def merge_union_all(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_sorted(_captures(spark, d).select("value"), _incoming(spark, d))


@query("merge_distinct", f"with {_BOTH} select value from cap union select value from inc")
def merge_distinct(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_distinct(_captures(spark, d), _incoming(spark, d))


@query(
    "order_violations",
    """select before, after from (select lag(line) over w as before, line as after from cdxj_lines
    window w as (partition by src_path order by src_pos, line_id)) where before > after""",
)
def order_violations(spark: SparkSession, d: str) -> DataFrame:
    return merge.order_violations(table(spark, d, "cdxj_lines"), ["src_path", "src_pos", "line_id"], "line")


@query("set_difference", f"with {_BOTH} (select value, 'left' as side from (select value from inc except all select value from cap))")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    captures = _captures(spark, d).select("value")
    return merge.same_rows(_incoming(spark, d), captures).where("side = 'left'")


# ---------------------------------------------------------------- blocklist

_PATTERNS = [
    "# hosts that are not wanted", "", r"^test,five)", r"^invalid,quohol,loja\)/feed", "/ads/", r'"status": ?"404"',
    r"\.(?:png|gif) [0-9]{14}", "contador.php?id=1".replace(".", r"\.").replace("?", r"\?"), "(unclosed", "^example,[a-z]+,m)/calendario ",
]
_BLOCKED = r"""(starts_with(value, 'test,five)') or starts_with(value, 'invalid,quohol,loja)/feed') or contains(value, '/ads/')
 or regexp_matches(value, '"status": ?"404"') or regexp_matches(value, '\.(?:png|gif) [0-9]{14}')
 or contains(value, 'contador.php?id=1') or regexp_matches(value, '^example,[a-z]+,m\)/calendario '))"""


@query("blocklist_filter", f"with {CAP} select capture_id, surt, ts from cap where not {_BLOCKED}")
def blocklist_filter(spark: SparkSession, d: str) -> DataFrame:
    return _shown(apply_blocklist(_captures(spark, d), Blocklist.of(_PATTERNS)))


@query("blocklist_report", f"with {CAP} select count(*) as n_lines, count_if(not {_BLOCKED}) as n_kept, count_if({_BLOCKED}) as n_blocked from cap")
def blocklist_report(spark: SparkSession, d: str) -> DataFrame:
    return report_of(_captures(spark, d), Blocklist.of(_PATTERNS))


@query("blocklist_many", f"with {CAP} select capture_id, surt, ts from cap where not regexp_matches(value, '/1[0-9a-d][0-9a-z]{{2}}')")
def blocklist_many(spark: SparkSession, d: str) -> DataFrame:
    """Eighteen thousand literal patterns, scanned for by one automaton."""
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    words = [f"/1{a}{b}{c}" for a in digits[:14] for b in digits for c in digits]
    return _shown(apply_blocklist(_captures(spark, d), Blocklist.of(words)))


# ---------------------------------------------------------------- payload fields


@query(
    "addfield_const",
    f"""with {CAP} select capture_id, 'demo' as collection, case when json is null then null else {J('url')} end as url,
    case when json is null then 1 when json_exists(json, '$.collection') then len(json_keys(json)) else len(json_keys(json)) + 1 end as n_fields from cap""",
)
def addfield_const(spark: SparkSession, d: str) -> DataFrame:
    changed = with_parts(add_fields(_captures(spark, d), {"collection": "demo"}))
    payload = F.col("json")
    return changed.select("capture_id", field_column(payload, "collection").alias("collection"), field_column(payload, "url").alias("url"), F.size(F.json_object_keys(payload)).cast("long").alias("n_fields"))


def _year_of(surt: str, timestamp: str, payload: dict) -> dict:
    return payload | {"year": int(timestamp[:4])}


@query("addfield_udf", f"with {CAP} select capture_id, substr(ts, 1, 4) as year from cap")
def addfield_udf(spark: SparkSession, d: str) -> DataFrame:
    changed = with_parts(add_fields(_captures(spark, d), function=_year_of))
    return changed.select("capture_id", field_column(F.col("json"), "year").alias("year"))


@query("extract_field_raw", f"with {CAP} select capture_id, coalesce({J('mime')}, '') as extracted from cap")
def extract_field_raw(spark: SparkSession, d: str) -> DataFrame:
    return extract_field(_captures(spark, d), "mime", raw=True).select("capture_id", "extracted")


@query("extract_field_json", f"with {CAP} select capture_id, case when json_exists(json, '$.hops') then cast(json -> '$.hops' as varchar) else 'none' end as extracted from cap")
def extract_field_json(spark: SparkSession, d: str) -> DataFrame:
    return extract_field(_captures(spark, d), "hops", default="none").select("capture_id", "extracted")


@query("extract_field_default", f"with {CAP} select capture_id, case when json_exists(json, '$.robot') then coalesce({J('robot')}, 'null') else '?' end as extracted from cap")
def extract_field_default(spark: SparkSession, d: str) -> DataFrame:
    """In the JVM: null and missing stay apart."""
    return _captures(spark, d).select("capture_id", field_column(F.col("json"), "robot", default="?").alias("extracted"))


@query("extract_counters", f"with {CAP} select case when json_exists(json, '$.gz') then 'found' else 'missing' end as outcome, count(*) as n from cap group by 1")
def extract_counters(spark: SparkSession, d: str) -> DataFrame:
    return extract_field(_captures(spark, d), "gz").groupBy("outcome").agg(F.count("*").alias("n"))


@query("field_histogram", f"with {CAP} select {J('mime')} as value, count(*) as count from cap group by 1")
def field_histogram(spark: SparkSession, d: str) -> DataFrame:
    return reports.field_histogram(_captures(spark, d), "mime")


@query(
    "missing_field_count",
    f"""with {CAP} select f.field, count_if(coalesce(list_contains(json_keys(json), f.field), false)) as n_present,
    count_if(not coalesce(list_contains(json_keys(json), f.field), false)) as n_missing
    from cap cross join (values ('status'), ('via'), ('url')) f(field) group by 1""",
)
def missing_field_count(spark: SparkSession, d: str) -> DataFrame:
    return reports.missing_fields(_captures(spark, d), ["status", "via", "url"])


# ---------------------------------------------------------------- keys and times


@query(
    "url_to_surt",
    r"""with u as (select capture_id, lower(json_extract_string(json_data, '$.url')) as url from captures),
    p as (select capture_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?]*)', 1), '^www[0-9]*\.', '') as host,
      regexp_replace(url, '^[a-z]+://[^/?]*', '') as tail, starts_with(url, 'https') as secure from u where url is not null),
    q as (select capture_id, regexp_replace(host, case when secure then ':443$' else ':80$' end, '') as host,
      regexp_replace(split_part(tail, '?', 1), '(.)/$', '\1') as path,
      array_to_string(list_sort(list_filter(string_split(case when contains(tail, '?') then substr(tail, instr(tail, '?') + 1) else '' end, '&'),
        lambda x: not regexp_matches(x, '^(jsessionid|phpsessid|sid|cfid|cftoken)='))), '&') as query from p)
    select capture_id, array_to_string(list_reverse(string_split(regexp_replace(host, ':.*$', ''), '.')), ',') || coalesce(nullif(regexp_extract(host, ':.*$'), ''), '')
      || ')' || case when path = '' then '/' else path end || case when query = '' then '' else '?' || query end as surt from q""",
)
def surt_of_url(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "captures").select("capture_id", F.get_json_object("json_data", "$.url").alias("url"))
    return rows.where("url is not null").select("capture_id", url_to_surt(F.col("url")).alias("surt"))


@query("normalize_ts", "select capture_id, n, left(left(ts, n) || substr('00000101000000', n + 1), 14) as ts from captures cross join (values (4), (6), (8), (10), (14)) v(n)")
def normalize_ts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "captures").select("capture_id", "ts", F.explode(F.array(*map(F.lit, (4, 6, 8, 10, 14)))).alias("n"))
    return rows.select("capture_id", "n", normalized(F.left("ts", F.col("n"))).alias("ts"))


@query("sort_keys", f"with {CAP} select capture_id, surt || ' ' || ts as key, surt as line_surt from cap")
def sort_keys(spark: SparkSession, d: str) -> DataFrame:
    captures = _captures(spark, d)
    return captures.select("capture_id", sort_key(F.col("value")).alias("key"), surt_of_line(F.col("value")).alias("line_surt"))


@query(
    "surt_parts",
    f"""with {CAP}, l as (select surt, string_split(regexp_replace(split_part(surt, ')', 1), ':[0-9]+$', ''), ',') as x from cap)
    select surt, x[1] as tld, x[2] as domain, case when len(x) > 2 then array_to_string(list_reverse(x[3:]), '.') end as subdomain from l""",
)
def parts_of_surt(spark: SparkSession, d: str) -> DataFrame:
    return _captures(spark, d).select("surt").withColumns(surt_parts(F.col("surt")))


# ---------------------------------------------------------------- path indexes

_ENTRIES = """entries as (select entry_id, trim(filename, ' ') as filename, trim(path, ' ') as path from path_index
  where trim(path, ' ') <> '' and trim(filename, ' ') <> '')"""


def _entries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "path_index").select(F.col("entry_id").alias("src_pos"), F.trim("filename").alias("filename"), F.trim("path").alias("path"))
    return rows.where("path <> '' and filename <> ''")


@query("arclist_path_index", "select list_id, string_split(trim(warc_path, ' '), '/')[-1] as filename, trim(warc_path, ' ') as path from warc_listing where trim(warc_path, ' ') <> ''")
def arclist_path_index(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "warc_listing").select("list_id", F.col("warc_path").alias("value"))
    return pathindex.arclist_to_path_index(rows).select("list_id", "filename", "path")


@query("path_index_upsert", f"with {_ENTRIES} select filename, arg_max(path, entry_id) as path from entries group by 1")
def path_index_upsert(spark: SparkSession, d: str) -> DataFrame:
    return pathindex.upsert(_entries(spark, d))


@query("path_index_size", f"with {_ENTRIES} select count(distinct filename) as n_keys from entries")
def path_index_size(spark: SparkSession, d: str) -> DataFrame:
    return pathindex.upsert(_entries(spark, d)).agg(F.count("*").alias("n_keys"))


@query(
    "resolve_paths",
    f"""with {CAP}, {_ENTRIES}, latest as (select filename, arg_max(path, entry_id) as path from entries group by 1)
    select capture_id, l.path from cap left join latest l on l.filename = {J('filename')}""",
)
def resolve_paths(spark: SparkSession, d: str) -> DataFrame:
    return pathindex.resolve(_captures(spark, d), _entries(spark, d)).select("capture_id", "path")


# ---------------------------------------------------------------- clusters

_CHUNK = 500


def _cluster(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    folder = join(scratch_path(spark, "cluster"), "demo")
    index = write_zipnum(_captures(spark, d).select("value"), folder, chunk_size=_CHUNK, shard_size_mb=0.5, with_chunk=True)
    return join(folder, "demo.idx"), index


@query(
    "zipnum_index",
    f"""with {CAP}, n as (select value, row_number() over (order by value) - 1 as i from cap)
    select trim(split_part(value, '{{', 1)) as key, cast(i // {_CHUNK} as bigint) as chunk from n where i % {_CHUNK} = 0""",
)
def zipnum_index(spark: SparkSession, d: str) -> DataFrame:
    return _cluster(spark, d)[1].select("key", "chunk")


@query("zipnum_roundtrip", f"with {CAP} select value from cap")
def zipnum_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return read_zipnum(spark, _cluster(spark, d)[0]).select("value")


@query("zipnum_search", f"with {CAP} select value from cap where starts_with(surt, 'example,vedon)')")
def zipnum_search(spark: SparkSession, d: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return search(read_zipnum(spark, _cluster(spark, d)[0]), "example,vedon)/", "domain").select("value")


@query(
    "resolve_blocks",
    """with loc as (select shard_name, arg_max(path, loc_id) as path from zipnum_loc where shard_name is not null group by 1)
    select idx_id, coalesce(l.path, case when ends_with(i.shard_name, '.cdx.gz') then i.shard_name else i.shard_name || '.cdx.gz' end) as path
    from zipnum_idx i left join loc l on l.shard_name = i.shard_name""",
)
def resolve_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Index rows with the file of their shard: of the location list, else by its name."""
    loc = table(spark, d, "zipnum_loc").where("shard_name is not null").groupBy("shard_name").agg(F.max_by("path", "loc_id").alias("found"))
    name = F.col("shard_name")
    own = F.when(name.endswith(".cdx.gz"), name).otherwise(F.concat(name, F.lit(".cdx.gz")))
    return table(spark, d, "zipnum_idx").join(loc, "shard_name", "left").select("idx_id", F.coalesce("found", own).alias("path"))


# ---------------------------------------------------------------- pipeline

_PIPE = f"{CAP}, kept as (select * from cap where not {_BLOCKED}), ok as (select surt from kept group by 1 having count(*) <= 100)"


@query("pipeline_full", f"with {_PIPE} select capture_id, surt, ts from kept where surt in (select surt from ok)")
def pipeline_full(spark: SparkSession, d: str) -> DataFrame:
    return _shown(collection.process(_captures(spark, d), blocklist=Blocklist.of(_PATTERNS), threshold=100).captures)


@query(
    "pipeline_qc",
    f"""with {_PIPE}, n as (select (select count(*) from cap) as a, (select count(*) from kept) as b, (select count(*) from kept where surt in (select surt from ok)) as c)
    select 'read' as stage, a as n_captures, 0.0::double as removed_percent from n
    union all select 'blocklist', b, round(100.0 * (a - b) / a, 1)::double from n
    union all select 'excessive keys', c, round(100.0 * (b - c) / b, 1)::double from n""",
)
def pipeline_qc(spark: SparkSession, d: str) -> DataFrame:
    stages = collection.process(_captures(spark, d), blocklist=Blocklist.of(_PATTERNS), threshold=100)
    stages.captures.write.format("noop").mode("overwrite").save()
    return stages.report(spark)


# ---------------------------------------------------------------- compositions


@query("captures_per_domain", f"with {CAP} select split_part(surt, ')', 1) as domain, count(*) as count from cap group by 1 order by 2 desc, 1 limit 20")
def captures_per_domain(spark: SparkSession, d: str) -> DataFrame:
    return reports.captures_per_domain(_captures(spark, d))


@query("largest_responses", f"with {CAP} select capture_id, surt, ts, try_cast({J('length')} as bigint) as length from cap where length is not null order by length desc, capture_id, surt, ts limit 20")
def largest_responses(spark: SparkSession, d: str) -> DataFrame:
    return reports.largest_responses(_captures(spark, d), columns=("capture_id", "surt", "ts"))


@query("subdomain_list", f"with {CAP} select distinct surt from cap where starts_with(surt, 'example,serholser,')")
def subdomain_list(spark: SparkSession, d: str) -> DataFrame:
    return reports.keys_below(_captures(spark, d), "example,serholser,")


@query("dup_captures", f"with {CAP} select surt, ts, count(*) as count from cap group by 1, 2 having count(*) > 1")
def dup_captures(spark: SparkSession, d: str) -> DataFrame:
    return reports.repeated_captures(_captures(spark, d))


@query("status_histogram", f"with {CAP} select {J('status')} as value, count(*) as count from cap group by 1")
def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return reports.field_histogram(_captures(spark, d), "status")


@query("replay_urls", f"with {CAP} select capture_id, 'https://replay.example/web/' || ts || '/' || {J('url')} as replay_url from cap")
def replay_urls(spark: SparkSession, d: str) -> DataFrame:
    return reports.replay_urls(_captures(spark, d), "https://replay.example/web/").select("capture_id", "replay_url")


@query(
    "quality_label",
    f"""with {CAP} select capture_id, case when try_cast({J('status')} as int) between 200 and 299 then 'high'
    when try_cast({J('status')} as int) between 300 and 399 then 'medium' when try_cast({J('status')} as int) is null then 'unknown' else 'low' end as quality from cap""",
)
def quality_label(spark: SparkSession, d: str) -> DataFrame:
    return _captures(spark, d).select("capture_id", reports.quality_label(F.get_json_object("json", "$.status")).alias("quality"))


@query("captures_per_year", f"with {CAP} select substr(ts, 1, 4) as year, count(*) as count from cap group by 1")
def captures_per_year(spark: SparkSession, d: str) -> DataFrame:
    return reports.per_year(_captures(spark, d))


@query("captures_per_month", f"with {CAP} select substr(ts, 1, 4) as year, substr(ts, 5, 2) as month, count(*) as count from cap group by all")
def captures_per_month(spark: SparkSession, d: str) -> DataFrame:
    return reports.per_month(_captures(spark, d))


@query(
    "validate_captures",
    f"""with {CAP} select count(*) as n_lines, count(*) as n_parts, count_if(regexp_matches(ts, '^[0-9]{{14}}$')) as n_times,
    count_if(json_valid(json)) as n_payloads from cap""",
)
def validate_captures(spark: SparkSession, d: str) -> DataFrame:
    return reports.validation(_captures(spark, d))
