"""Queries for the general data problems (p1 to p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.operators import drift, eager, merkle, orphans, recover
from heliograph.queries.common import query
from heliograph.runtime import table

# ---------------------------------------------------------------- p1


def _references(spark: SparkSession, d: str) -> DataFrame:
    captures = table(spark, d, "captures").select(
        F.lit("captures").alias("ref_table"),
        F.col("capture_id").alias("ref_id"),
        F.concat(F.lit("file/"), orphans.base_name(F.get_json_object("json_data", "$.filename"))).alias("key"),
        F.col("indexed_at").alias("at"),
    )
    blocks = table(spark, d, "zipnum_idx").select(
        F.lit("zipnum_idx").alias("ref_table"),
        F.col("idx_id").alias("ref_id"),
        F.concat(F.lit("shard/"), orphans.base_name(F.col("shard_name"), ".cdx.gz")).alias("key"),
        F.col("built_at").alias("at"),
    )
    return captures.unionByName(blocks)


def _parents(spark: SparkSession, d: str) -> DataFrame:
    def entries(name: str, key) -> DataFrame:
        rows = table(spark, d, name).where("trim(path) <> ''")
        return rows.select(key.alias("key"), "loaded_at", "removed_at")

    files = entries("path_index", F.concat(F.lit("file/"), orphans.base_name(F.col("filename"))))
    shards = entries("zipnum_loc", F.concat(F.lit("shard/"), orphans.base_name(F.col("shard_name"), ".cdx.gz")))
    return files.unionByName(shards)


_P1_SQL = r"""
with refs as (
  select 'captures' as ref_table, capture_id as ref_id, indexed_at as moment,
         'file/' || string_split(trim(json_extract_string(json_data, '$.filename'), ' '), '/')[-1] as key
  from captures
  union all
  select 'zipnum_idx', idx_id, built_at as moment,
         'shard/' || regexp_replace(string_split(trim(shard_name, ' '), '/')[-1], '\.cdx\.gz$', '')
  from zipnum_idx
), parents as (
  select 'file/' || string_split(trim(filename, ' '), '/')[-1] as key, loaded_at, removed_at from path_index
  where trim(path, ' ') <> ''
  union all
  select 'shard/' || regexp_replace(string_split(trim(shard_name, ' '), '/')[-1], '\.cdx\.gz$', ''), loaded_at, removed_at
  from zipnum_loc where trim(path, ' ') <> ''
), judged as (
  select r.ref_table, r.ref_id, r.moment,
         count(p.key) as entries,
         count(*) filter (where p.loaded_at <= r.moment) as loaded,
         count(*) filter (where p.loaded_at <= r.moment and (p.removed_at is null or p.removed_at > r.moment)) as standing
  from refs r left join parents p on r.key = p.key
  where r.key is not null
  group by all
), cases as (
  select ref_table, ref_id, moment, standing,
         case when entries = 0 then 'missing' when loaded > 0 then 'deleted' else 'late' end as reason
  from judged
)
"""


@query("p1_found", _P1_SQL + "select ref_table, ref_id, reason from cases where standing = 0")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(_references(spark, d), _parents(spark, d)).select("ref_table", "ref_id", "reason")


@query(
    "p1_report",
    _P1_SQL
    + """select ref_table, strftime(moment, '%Y-%m') as month, count(*) as checked,
      count_if(standing = 0 and reason = 'missing') as missing,
      count_if(standing = 0 and reason = 'deleted') as deleted,
      count_if(standing = 0 and reason = 'late') as late
      from cases group by all""",
)
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    refs = _references(spark, d)
    return orphans.orphan_report(refs, orphans.orphan_references(refs, _parents(spark, d)))


# ---------------------------------------------------------------- p2

# A payload with members nested at most three deep, as a regular expression; SQL has no grammar.
_STRING = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'
_SCALAR = rf"(?:{_STRING}|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)"
_B = r"[ \t\n\r]*"


def _object(value: str) -> str:
    member = rf"{_STRING}{_B}:{_B}{value}"
    return rf"\{{{_B}(?:{member}(?:{_B},{_B}{member})*)?{_B}\}}"


def _array(value: str) -> str:
    return rf"\[{_B}(?:{value}(?:{_B},{_B}{value})*)?{_B}\]"


_FLAT = f"(?:{_SCALAR}|{_array(_SCALAR)}|{_object(_SCALAR)})"
_NESTED = f"(?:{_SCALAR}|{_array(_FLAT)}|{_object(_FLAT)})"
_P2_SQL = f"""
with lines as (
  select line_id, src_path, regexp_replace(line, '(\\r\\n|\\n|\\r)$', '') as line, ' \t\n\r\x0b\x0c' || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) as white
  from cdxj_lines where line is not null
), parts as (
  select *, string_split(line, ' ') as p from lines where trim(line, white) <> ''
), cut as (
  select line_id, src_path, white, len(p) as n, p[1] as a, p[2] as b, trim(array_to_string(p[3:], ' '), white) as c from parts
), judged as (
  select line_id, src_path, a, b, c, case
    when n < 2 or a = '' or b = '' or (c <> '' and not starts_with(c, '{{')) then 'columns'
    when c <> '' and not regexp_full_match(c, $json${_object(_NESTED)}$json$, 's') then 'json'
    when not regexp_full_match(b, '[0-9]{{14}}') or try_strptime(b, '%Y%m%d%H%M%S') is null then 'timestamp'
    when c <> '' and json_valid(c) and json_exists(c, '$.offset') and json_type(c, '$.offset') <> 'NULL' and not coalesce(
      (json_type(c, '$.offset') = 'VARCHAR' and regexp_full_match(json_extract_string(c, '$.offset'), '[0-9]+')
        or json_type(c, '$.offset') in ('UBIGINT', 'BIGINT') and regexp_full_match(json_extract_string(c, '$.offset'), '-?[0-9]+'))
      and try_cast(json_extract_string(c, '$.offset') as hugeint) between 0 and 9223372036854775807, false) then 'offset'
    end as reason
  from cut
)
"""


@query("p2_found", _P2_SQL + "select line_id, reason from judged where reason is not null")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return recover.rejected(recover.parse_lines(table(spark, d, "cdxj_lines"))).select("line_id", "reason")


@query(
    "p2_loaded",
    _P2_SQL + """select line_id, a as surt, b as ts, nullif(c, '') as json,
    case when c <> '' then try_cast(json_extract_string(c, '$.offset') as bigint) end as "offset" from judged where reason is null""",
)
def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    return recover.loaded(recover.parse_lines(table(spark, d, "cdxj_lines")))


@query(
    "p2_report",
    _P2_SQL + "select src_path, count_if(reason is null) as loaded, "
    + ", ".join(f"coalesce(count_if(reason = '{r}'), 0) as bad_{r}" for r in recover.REASONS) + " from judged group by 1",
)
def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Per file: lines loaded, and lines rejected by reason."""
    parsed = recover.parse_lines(table(spark, d, "cdxj_lines")).where("not recovered")
    by_reason = [F.count_if(F.col("reason") == r).alias(f"bad_{r}") for r in recover.REASONS]
    return parsed.groupBy("src_path").agg(F.count_if(F.col("reason").isNull()).alias("loaded"), *by_reason)


@query(
    "p2_recovered",
    _P2_SQL + """, beside as (
      select l.line_id, lead(l.line_id) over (partition by l.src_path order by l.src_pos, l.line_id) as next_id from cdxj_lines l)
    select b.line_id, n.a as surt, n.b as ts, nullif(n.c, '') as json from beside b
    join judged j on j.line_id = b.line_id and j.reason = 'json' join judged n on n.line_id = b.next_id and n.reason is null""",
)
def p2_recovered(spark: SparkSession, d: str) -> DataFrame:
    """Every line with a broken payload, glued to the one after it as if its end were lost: what
    is recovered is the second line's record (a line that begins with a blank has none)."""
    lines = table(spark, d, "cdxj_lines")
    behind = F.lead("line").over(Window.partitionBy("src_path").orderBy("src_pos", "line_id"))
    broken = recover.parse_lines(lines).where("reason = 'json' and not recovered").select("line_id")
    glued = lines.withColumn("line", F.concat_ws(" ", "line", F.when(~behind.startswith(" "), behind))).join(broken, "line_id", "left_semi")
    return recover.parse_lines(glued).where("recovered and reason is null").select("line_id", "surt", "ts", "json")


# ---------------------------------------------------------------- p3

_P3_SQL = """
with now as (
  select warc_path, arg_max({'c': cdxj_path, 's': warc_sha}, {'t': seen_at, 'i': list_id}) as x
  from warc_listing where warc_path is not null group by warc_path
), indexed as (
  select warc_path, cdxj_path, arg_max({'s': warc_sha}, {'f': finished_at, 'l': logged_at, 'i': log_id}) as y
  from index_log join index_runs using (run_id)
  where run_state = 'ok' and outcome = 'ok' and cdxj_path is not null group by all
)
select now.warc_path, x.c as cdxj_path from now
left join indexed on now.warc_path = indexed.warc_path and x.c = indexed.cdxj_path
where x.s is not null and (y is null or y.s is distinct from x.s)
"""


@query("p3_found", _P3_SQL)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pending = merkle.pending_files(table(spark, d, "warc_listing"), table(spark, d, "index_log"), table(spark, d, "index_runs"))
    return pending.select("warc_path", "cdxj_path")


_P3_ALL = (
    _P3_SQL.split("select now.warc_path")[0]
    + """, cur as (select warc_path, x.c as cdxj_path, x.s as warc_sha from now where x.s is not null),
old as (select warc_path, cdxj_path, y.s as warc_sha from indexed where warc_path is not null)
select coalesce(cur.warc_path, old.warc_path) as warc_path, coalesce(cur.cdxj_path, old.cdxj_path) as cdxj_path,
  case when old.warc_path is null then 'added' when cur.warc_path is null then 'removed' else 'changed' end as change
from cur full join old on cur.warc_path = old.warc_path and cur.cdxj_path = old.cdxj_path
where old.warc_path is null or cur.warc_path is null or cur.warc_sha is distinct from old.warc_sha"""
)


@query("p3_changes", _P3_ALL)
def p3_changes(spark: SparkSession, d: str) -> DataFrame:
    """Everything in which the files and what was indexed of them differ."""
    states = merkle.file_states(table(spark, d, "warc_listing"), table(spark, d, "index_log"), table(spark, d, "index_runs"))
    return merkle.state_changes(*states, ["warc_path", "cdxj_path"]).select("warc_path", "cdxj_path", "change")


# ---------------------------------------------------------------- p4


def _key_statistics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "captures").select("surt_key", "ts", "json_data")
    return eager.key_statistics(rows, "surt_key", F.get_json_object("json_data", "$.digest"), "ts")


@query("p4_found", "select surt_key from captures where surt_key is not null group by 1 having count(*) >= 0.01 * (select count(*) from captures)")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    total = table(spark, d, "captures").count()
    return eager.heavy_keys(_key_statistics(spark, d), "surt_key", total, 0.01).select("surt_key")


@query(
    "p4_key_stats",
    """select surt_key, count(*) as n_rows, count(distinct json_extract_string(json_data, '$.digest')) as n_distinct,
    min(ts) as first, max(ts) as last from captures group by 1""",
)
def p4_key_stats(spark: SparkSession, d: str) -> DataFrame:
    return _key_statistics(spark, d)


@query(
    "p4_pairs_by_host",
    """select split_part(surt_key, ')', 1) as host, cast(sum(n * m) as bigint) as pairs, cast(sum(n) as bigint) as held
    from (select surt_key, count(*) as n from captures group by 1)
    join (select surt_key, count(*) as m from incoming_captures group by 1) using (surt_key) group by 1""",
)
def p4_pairs_by_host(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of held and incoming captures of the same key, rolled up to hosts."""
    states = eager.eager_join(table(spark, d, "captures"), table(spark, d, "incoming_captures"), ["surt_key"])
    named = states.where("surt_key is not null").select(F.split_part("surt_key", F.lit(")"), F.lit(1)).alias("host"), F.col("joined_rows").alias("pairs"), F.col("left_rows").alias("held"))
    return eager.roll_up(named, ["host"], {"pairs": "sum", "held": "sum"})


# ---------------------------------------------------------------- p5

# A field is known by what its names hold, whatever they are: three-digit codes, names of crawls.
_P5_NAMES = """
with members as (
  select capture_id, src_path, name, json_data -> ('$."' || name || '"') as value
  from (select capture_id, src_path, json_data, unnest(json_keys(json_data)) as name from captures where json_valid(json_data))
), written as (
  select *, case json_type(value) when 'ARRAY' then value ->> '$[0]' when 'OBJECT' then value ->> '$.name' else value ->> '$' end as text
  from members
), names as (
  select name, case when avg(regexp_full_match(text, '[1-5][0-9]{2}')::int) >= 0.5 then 'status'
    when avg(regexp_full_match(text, '[A-Z]+-[0-9]{6}')::int) >= 0.5 then 'collection' end as field_name
  from written where json_type(value) <> 'NULL' group by 1
), typed as (
  select m.*, n.field_name, case json_type(value) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array'
         when 'OBJECT' then 'object' when 'NULL' then null else 'number' end as kind
  from members m join names n using (name) where n.field_name is not null
)
"""
_P5_SQL = (
    _P5_NAMES
    + """, by_name as (
  select src_path, field_name, arg_max(name, {'n': n, 'x': name}) as name from
  (select src_path, field_name, name, count(*) as n from typed where kind is not null group by all) group by all
), by_kind as (
  select src_path, field_name, arg_max(kind, {'n': n, 'x': kind}) as kind from
  (select src_path, field_name, kind, count(*) as n from typed where kind is not null group by all) group by all
), places as (
  select src_path, field_name, lag(src_path) over (partition by field_name, regexp_extract(src_path, '^(.*)/[^/]*$', 1)
    order by regexp_extract(src_path, '([0-9]{5})(?:\\.[A-Za-z][^/]*)?$', 1), src_path) as before
  from (select distinct src_path from captures) cross join (values ('status'), ('collection')) f(field_name)
), beside as (
  select p.src_path, p.field_name, a.name as n0, b.name as n1, k.kind as k0, l.kind as k1 from places p
  left join by_name a on a.src_path = p.before and a.field_name = p.field_name
  left join by_name b on b.src_path = p.src_path and b.field_name = p.field_name
  left join by_kind k on k.src_path = p.before and k.field_name = p.field_name
  left join by_kind l on l.src_path = p.src_path and l.field_name = p.field_name
  where p.before is not null
)
select src_path, field_name, 'added' as change_kind from beside where n0 is null and n1 is not null
union all select src_path, field_name, 'removed' from beside where n0 is not null and n1 is null
union all select src_path, field_name, 'renamed' from beside where n0 <> n1
union all select src_path, field_name, 'retyped' from beside where k0 <> k1
"""
)


@query("p5_found", _P5_SQL)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "captures")).select("src_path", "field_name", "change_kind")


@query(
    "p5_table",
    _P5_NAMES
    + """, texts as (
  select capture_id, field_name, case kind when 'array' then array_to_string(cast(value as varchar[]), ',')
    when 'object' then value ->> '$.name' else value ->> '$' end as text
  from typed where kind is not null
)
select c.capture_id, c.surt_key, c.ts, s.text as status, k.text as collection from captures c
left join texts s on s.capture_id = c.capture_id and s.field_name = 'status'
left join texts k on k.capture_id = c.capture_id and k.field_name = 'collection'""",
)
def p5_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent_table(table(spark, d, "captures")).select("capture_id", "surt_key", "ts", "status", "collection")
